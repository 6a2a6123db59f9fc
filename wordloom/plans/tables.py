"""Queries over time, tags, the catalogue, relations and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import tags as TF
from wordloom.functions import text as T
from wordloom.operators import catalog as C
from wordloom.operators import graph as G
from wordloom.operators import tags as TG
from wordloom.operators import trigrams as TRG
from wordloom.operators import trajectory as TR
from wordloom.operators import vector_index as VI
from wordloom.operators import vectors as V
from wordloom.operators.ranges import placed
from wordloom.plans import standin as S
from wordloom.sources.written import scratch_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- usage over time: a document's year is 1800 + 10 * (doc_id mod 21), a book of 1850 reads the words ---
USAGE = """tok AS (SELECT 1800 + 10 * (doc_id % 21) AS decade, unnest(regexp_extract_all(lower(replace(regexp_replace(text, '\\s+', ' ', 'g'), '’', '''')), '[a-z]+(?:[''’-][a-z]+)*')) AS word FROM documents),
byd AS (SELECT word, decade, count(*) AS n FROM tok GROUP BY ALL),
trj AS (SELECT word, decade::INT AS decade, n / sum(n) OVER (PARTITION BY decade) * 1e6 AS pm FROM byd),
agg AS (SELECT word, count(*) AS n, max(pm) AS peak, arg_max(pm, decade) AS last, list_sort(list({'d': decade, 'p': pm}), 'DESC')[2].p AS prev, avg(CASE WHEN decade BETWEEN 1840 AND 1860 THEN pm END) AS ar, avg(CASE WHEN decade <= 1830 THEN pm END) AS be, avg(CASE WHEN decade >= 1870 THEN pm END) AS la,
  coalesce(max(CASE WHEN decade >= 1980 THEN pm END), 0) AS recent FROM trj GROUP BY word),
win AS (SELECT *, coalesce(ar, 0) AS a, coalesce(be, ar, 0) AS b, coalesce(la, ar, 0) AS l FROM agg)"""


def usage(spark, sf_dir):
    """word, decade, pm; the counts that it is made of are written once."""
    docs = S.table(spark, sf_dir, "documents").select((1800 + 10 * (F.col("doc_id") % 21)).alias("year"), F.explode(T.tokens(T.plain_apostrophes(F.col("text")))).alias("word"))
    return TR.trajectories(S.written(docs.groupBy("word", "year").agg(F.count("*").alias("count"))))  # read twice, for totals too


@query("WITH " + USAGE + " SELECT word, decade, round(pm, 6) AS pm FROM trj")
def usage_trajectory(spark, sf_dir):
    return usage(spark, sf_dir).withColumn("pm", F.round("pm", 6))


@query(
    "WITH "
    + USAGE
    + """ SELECT word, CASE WHEN n < 3 THEN NULL WHEN peak < 0.1 THEN 'rare' WHEN greatest(a, b, l) <= 0 OR (greatest(a, b, l) - least(a, b, l)) / greatest(a, b, l) < 0.25 THEN 'timeless' WHEN a >= b AND a >= l THEN 'of' WHEN l > b THEN 'ahead' ELSE 'after' END AS era FROM win"""
)
def era_classes(spark, sf_dir):
    return TR.summarise(usage(spark, sf_dir), ["word"], F.lit(1850), F.lit(2000)).select("word", "era")


@query(
    "WITH "
    + USAGE.replace("BETWEEN 1840 AND 1860", "BETWEEN 1990 AND 2010").replace("decade <= 1830", "decade <= 1980").replace("decade >= 1870", "decade >= 2020")
    + """ SELECT word, CASE WHEN n < 3 THEN NULL WHEN peak < 0.1 THEN 'rare' WHEN last > prev * 1.15 AND last >= peak * 0.9 THEN 'rising' WHEN greatest(a, b, l) <= 0 OR (greatest(a, b, l) - least(a, b, l)) / greatest(a, b, l) < 0.25 THEN 'timeless' WHEN a >= b AND a >= l THEN 'of' WHEN l > b THEN 'ahead' ELSE 'after' END AS era FROM win"""
)
def era_classes_of_2000(spark, sf_dir):
    """The eras of words in a book of the corpus's last decade, the only one whose words can be rising."""
    return TR.summarise(usage(spark, sf_dir), ["word"], F.lit(2000), F.lit(2000)).select("word", "era")


@query("WITH " + USAGE + " SELECT word FROM win WHERE n >= 3 AND peak >= 0.1 AND recent < 0.1 AND recent < 0.15 * peak")
def obsolete_words(spark, sf_dir):
    return TR.summarise(usage(spark, sf_dir), ["word"], F.lit(1850), F.lit(2000)).filter("obsolete").select("word")


@query("WITH " + USAGE + ", m AS (SELECT *, max(pm) OVER (PARTITION BY word) AS top, min(decade) OVER (PARTITION BY word) AS f, max(decade) OVER (PARTITION BY word) AS t FROM trj) SELECT word, decade, round(pm / top, 6) AS bar, round(CASE WHEN t > f THEN greatest(0, least(1, (1850 - f) / (t - f))) ELSE 0 END, 6)::DOUBLE AS marker FROM m")
def usage_chart(spark, sf_dir):
    return TR.usage_chart(usage(spark, sf_dir), F.lit(1850)).select("word", "decade", F.round("bar", 6).alias("bar"), F.round("marker", 6).alias("marker"))


@query("SELECT day, event_type, n, round(n * 1e6 / sum(n) OVER (PARTITION BY day), 6) AS pm FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL)")
def day_usage(spark, sf_dir):
    from wordloom.streaming.usage import window_usage

    by = window_usage(S.table(spark, sf_dir, "events"), "1 day")
    share = F.col("n") * 1e6 / F.sum("n").over(W.partitionBy("start"))
    return by.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round(share, 6).alias("pm"))


# --- tags: an event is the application of a tag to the word of a user, in one of 20 books or everywhere ---
DEFS = (("click", "interesting"), ("view", "neutral"), ("view.a", "uninteresting"), ("purchase", "interesting"), ("purchase.a", "neutral"), ("signup", "uninteresting"), ("error.a.b", "interesting"), ("unused", "neutral"))
TAGS = (
    "dfs(name, interest) AS (VALUES "
    + ", ".join(f"('{n}', '{i}')" for n, i in DEFS)
    + """),
wt AS (SELECT CASE WHEN event_id % 21 = 20 THEN '*' ELSE 'b' || (event_id % 21) END AS book, 'w' || user_id AS word, event_type || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.a' ELSE '.a.b' END AS tag,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE (event_id % 5)::INT END AS value FROM events),
onn AS (SELECT * FROM wt WHERE coalesce(value, 1) >= 1),
rnk AS (SELECT name, CASE interest WHEN 'interesting' THEN 2 WHEN 'uninteresting' THEN 1 ELSE 0 END AS r FROM dfs)"""
)


def definitions(spark):
    return spark.createDataFrame(list(DEFS), "name string, interest string")


def applications(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.when(i % 21 == 20, "*").otherwise(F.concat(F.lit("b"), (i % 21).cast("string"))).alias("book"),
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("word"),
        F.concat("event_type", F.when(i % 4 == 0, "").when(i % 4 == 1, ".a").otherwise(".a.b")).alias("tag"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, 0).otherwise(i % 5).cast("int").alias("value"),
    )


@query("WITH " + TAGS + " SELECT d.name, count(DISTINCT o.word) AS n_words FROM dfs d LEFT JOIN onn o ON o.tag = d.name OR starts_with(o.tag, d.name || '.') GROUP BY d.name")
def tag_hierarchy_counts(spark, sf_dir):
    return TG.usage_counts(definitions(spark), applications(spark, sf_dir))


@query(
    "WITH "
    + TAGS
    + """, hit AS (SELECT DISTINCT o.book, o.word FROM onn o JOIN dfs d ON d.interest = 'interesting' AND (o.tag = d.name OR starts_with(o.tag, d.name || '.'))),
occ AS (SELECT DISTINCT book, word FROM wt WHERE book <> '*'), own AS (SELECT * FROM hit WHERE book <> '*' UNION SELECT occ.book, occ.word FROM occ JOIN hit ON hit.book = '*' AND hit.word = occ.word)
SELECT b.book, count(DISTINCT own.word) AS stars FROM (SELECT 'b' || unnest(range(0, 25)) AS book) b LEFT JOIN own ON own.book = b.book GROUP BY b.book"""
)
def book_stars(spark, sf_dir):
    tags = applications(spark, sf_dir)
    books = spark.range(25).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("book"))
    return TG.book_stars(books, definitions(spark), tags, tags.filter("book <> '*'").select("book", "word").distinct())


_LENT = "len AS (SELECT o.book, o.word, o.tag, max(r) AS r FROM onn o LEFT JOIN rnk d ON o.tag = d.name OR starts_with(o.tag, d.name || '.') GROUP BY ALL)"


@query("WITH " + TAGS + ", " + _LENT + " SELECT book, word, CASE coalesce(max(r), 0) WHEN 2 THEN 'interesting' WHEN 1 THEN 'uninteresting' ELSE 'neutral' END AS interest FROM len GROUP BY ALL")
def effective_interest(spark, sf_dir):
    return TG.effective_interest(definitions(spark), applications(spark, sf_dir))


@query("WITH " + TAGS + ", " + _LENT + ", one AS (SELECT word, tag, max(r) AS r FROM len GROUP BY ALL) SELECT word, sum(CASE r WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END)::BIGINT AS net FROM one GROUP BY word HAVING net > 0")
def net_favourites(spark, sf_dir):
    return TG.net_favourites(definitions(spark), applications(spark, sf_dir))


@query(
    "WITH "
    + TAGS
    + ", "
    + _LENT
    + """, i AS (SELECT word, CASE coalesce(max(r), 0) WHEN 2 THEN 'interesting' WHEN 1 THEN 'uninteresting' ELSE 'neutral' END AS interest FROM len GROUP BY word)
SELECT o.word, string_agg(DISTINCT o.tag, ',' ORDER BY o.tag) AS tags, count(DISTINCT CASE WHEN book <> '*' THEN book END) AS n_books, count(*) AS n_rows, any_value(i.interest) AS interest, max(CASE WHEN value >= 1 THEN value END) AS top_level FROM onn o JOIN i ON o.word = i.word GROUP BY o.word"""
)
def collection_words(spark, sf_dir):
    return TG.sorted_collection(TG.collection(definitions(spark), applications(spark, sf_dir))).select("word", "tags", "n_books", "n_rows", "interest", "top_level")


@query(
    "WITH "
    + TAGS
    + """ SELECT book, word, tag, count(*) AS n, max(value) AS value FROM (SELECT '*' AS book, word, tag, max(coalesce(value, 1)) AS value FROM wt WHERE tag = 'click.a' GROUP BY word, tag UNION ALL SELECT book, word, tag, value FROM wt WHERE tag <> 'click.a') GROUP BY ALL"""
)
def tag_scope_collapse(spark, sf_dir):
    return TG.to_word_scope(applications(spark, sf_dir), "click.a").groupBy("book", "word", "tag").agg(F.count("*").alias("n"), F.max("value").alias("value"))


@query("WITH " + TAGS + " SELECT CASE WHEN tag = 'view' OR starts_with(tag, 'view.') THEN 'seen' || substr(tag, 5) ELSE tag END AS tag, count(*) AS n FROM wt WHERE NOT (tag = 'signup.a' OR starts_with(tag, 'signup.a.')) GROUP BY 1")
def tag_rename_delete(spark, sf_dir):
    table = TG.delete_tag(TG.rename_tag(applications(spark, sf_dir), "view", "seen"), "signup.a")
    return table.groupBy("tag").agg(F.count("*").alias("n"))


@query(
    """WITH books AS (SELECT s_suppkey AS id, 'src' || (s_suppkey % 4) AS source, CASE s_suppkey % 3 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' ELSE 'other' END AS format FROM supplier),
want AS (SELECT id, 'src:' || source AS tag FROM books UNION SELECT id, 'fmt:' || format FROM books WHERE format IN ('epub', 'pdf', 'txt')),
have AS (SELECT s_suppkey AS id, 'src:src' || (s_suppkey % 5) AS tag FROM supplier)
SELECT id AS book, tag, 'add' AS change FROM (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL SELECT id, tag, 'remove' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)"""
)
def autotag_reconcile(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    books = s.select(k.alias("book"), F.concat(F.lit("src"), (k % 4).cast("string")).alias("source"), F.when(k % 3 == 0, "epub").when(k % 3 == 1, "pdf").otherwise("other").alias("format"))
    have = s.select(k.alias("book"), F.concat(F.lit("src:src"), (k % 5).cast("string")).alias("tag"), F.lit(True).alias("auto"))
    add, remove = TG.reconcile_auto_tags(have, books)
    return add.withColumn("change", F.lit("add")).unionByName(remove.withColumn("change", F.lit("remove")))


@query("WITH " + TAGS + """, f AS (SELECT 'w' || (user_id % 10) AS root, 'w' || user_id AS word FROM (SELECT DISTINCT user_id FROM events)) SELECT root, tag, max(coalesce(value, -1)) AS value, count(DISTINCT o.word) AS n_words FROM onn o JOIN f ON o.word = f.word GROUP BY ALL""")
def family_tags(spark, sf_dir):
    users = S.table(spark, sf_dir, "events").select("user_id").distinct()
    members = users.select(F.concat(F.lit("w"), (F.col("user_id") % 10).cast("string")).alias("root"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("word"))
    return TG.family_tags(members, applications(spark, sf_dir), definitions(spark))[0]


@query(
    """WITH t AS (SELECT c_custkey AS book, 'src:' || c_mktsegment AS tag, true AS auto FROM customer UNION ALL SELECT c_custkey, 'shelf' || (c_custkey % 4), false FROM customer WHERE c_custkey % 3 = 0)
SELECT book, coalesce(min(CASE WHEN NOT auto THEN tag END), min(CASE WHEN auto AND starts_with(tag, 'src:') THEN tag END)) AS grp FROM t GROUP BY book"""
)
def primary_group(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    auto = c.select(k.alias("book"), F.concat(F.lit("src:"), "c_mktsegment").alias("tag"), F.lit(True).alias("auto"))
    manual = c.filter(k % 3 == 0).select(k.alias("book"), F.concat(F.lit("shelf"), (k % 4).cast("string")).alias("tag"), F.lit(False).alias("auto"))
    return TG.primary_group(c.select(k.alias("book")), auto.unionByName(manual)).withColumnRenamed("group", "grp")


@query("WITH s AS (SELECT p_brand AS scope, p_name || p_partkey AS name, p_type AS section, p_partkey AS ord FROM part), f AS (SELECT *, min(ord) OVER (PARTITION BY scope, section) AS f FROM s) SELECT scope, name, section, row_number() OVER (PARTITION BY scope ORDER BY f, section, ord, name) AS place FROM f")
def section_order(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    defs = p.select(F.col("p_brand").alias("scope"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("section"), F.col("p_partkey").alias("ord"))
    return TG.section_order(defs).select("scope", "name", "section", "place")


# --- catalogue: the parts; imported are those that line items name ---
CATALOG = "cat AS (SELECT p_partkey AS source_id, 'parts' AS source, p_name AS title, p_brand AS author, p_type || '; ' || lower(p_brand) AS subjects, p_size AS n_words, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 1900 + p_size END AS year FROM part)"


def parts_catalog(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("source_id"), F.lit("parts").alias("source"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.concat("p_type", F.lit("; "), F.lower("p_brand")).alias("subjects"), F.col("p_size").alias("n_words"),
        F.when(F.col("p_partkey") % 7 == 0, None).otherwise(1900 + F.col("p_size")).alias("year"),
    )


def parts_books(spark, sf_dir):
    return S.table(spark, sf_dir, "lineitem").select(F.lit("parts").alias("source"), F.col("l_partkey").alias("source_id"), F.col("l_orderkey").alias("id"), F.concat(F.lit("book-"), F.col("l_orderkey").cast("string")).alias("slug"))


def _search(name, where, order, **how):
    def run(spark, sf_dir):
        return C.search(parts_catalog(spark, sf_dir), most=40, skip=5, **how).select("source_id", "title", "author", "year")

    run.__name__ = name
    sql = f"WITH {CATALOG} SELECT source_id, title, author, year FROM cat WHERE {where} ORDER BY {order} lower(title) NULLS LAST, source_id LIMIT 40 OFFSET 5"
    return query(sql)(run)


_search("catalog_search", "lower(title) LIKE '%1%' OR lower(author) LIKE '%1%'", "CASE WHEN lower(title) = '1' THEN 0 WHEN lower(title) LIKE '1%' THEN 1 WHEN lower(title) LIKE '%1%' THEN 2 ELSE 3 END,", query="1")
_search("catalog_by_subject", "list_contains(string_split_regex(lower(subjects), ';\\s*'), 'brand#11')", "year DESC NULLS LAST,", subject="Brand#11", sort="year")


@query(
    f"""WITH {CATALOG}, q AS (SELECT DISTINCT left(lower(title), k) AS query FROM cat, range(1, 9) r(k) UNION SELECT DISTINCT right(lower(author), k) FROM cat, range(1, 9) r(k) UNION SELECT 'no such name')
SELECT query, source_id AS id FROM q JOIN cat ON contains(lower(title), query) OR contains(lower(author), query)"""
)
def trigram_search(spark, sf_dir):
    """Every beginning of a title and every end of an author of 1 to 8 characters, searched in the catalogue by its index."""
    catalog, path = parts_catalog(spark, sf_dir), scratch_path(spark)
    TRG.write_trigrams(catalog, path, "source_id", ["title", "author"])
    asked = catalog.select(F.explode(F.array(*[F.substring(F.lower("title"), 1, k) for k in range(1, 9)], *[F.right(F.lower("author"), F.lit(k)) for k in range(1, 9)])).alias("q")).distinct()
    # Names are made of a few dozen words and brands, so what their ends can be is bounded.
    return TRG.search_names(spark, path, catalog, "source_id", ["title", "author"], [r[0] for r in asked.collect()] + ["no such name"])


@query(f"WITH {CATALOG}, e AS (SELECT trim(unnest(string_split(subjects, ';'))) AS subject FROM cat) SELECT subject, count(*) AS n FROM e WHERE strlen(subject) BETWEEN 1 AND 60 GROUP BY 1 ORDER BY n DESC, subject LIMIT 120")
def catalog_subjects(spark, sf_dir):
    return C.subjects(parts_catalog(spark, sf_dir))


@query(f"WITH {CATALOG}, b AS (SELECT l_partkey AS k, arg_min('book-' || l_orderkey, l_orderkey) AS slug FROM lineitem GROUP BY 1) SELECT source_id, title, slug FROM cat LEFT JOIN b ON source_id = k")
def catalog_imported(spark, sf_dir):
    return C.with_slug(parts_catalog(spark, sf_dir), parts_books(spark, sf_dir)).select("source_id", "title", "slug")


@query(f"WITH {CATALOG} SELECT source, count(*) AS n_rows, (SELECT count(*) FROM cat JOIN lineitem ON l_partkey = source_id) AS n_imported, 3600::BIGINT AS age_s FROM cat GROUP BY source")
def catalog_status(spark, sf_dir):
    sync = spark.range(1).select(F.lit("parts").alias("source"), F.expr("timestamp'2020-01-01 00:00:00'").alias("synced_at"))
    return C.status(parts_catalog(spark, sf_dir), parts_books(spark, sf_dir), sync, F.expr("timestamp'2020-01-01 01:00:00'"))


@query("SELECT c_custkey AS id, c_name AS title FROM customer WHERE lower(c_name) LIKE '%9%' OR lower(c_mktsegment) LIKE '%9%' ORDER BY lower(c_name), c_custkey LIMIT 12")
def library_search(spark, sf_dir):
    books = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"))
    return C.library_search(books, "9").select("id", "title")


@query(f"WITH {CATALOG} SELECT source_id, CASE WHEN source_id % 10 = 0 THEN 'new ' || title ELSE title END AS title FROM cat UNION ALL SELECT source_id + 10000000, title FROM cat WHERE source_id % 10 = 0")
def catalog_upsert(spark, sf_dir):
    cat = parts_catalog(spark, sf_dir).select("source_id", "title")
    tenth = cat.filter("source_id % 10 = 0")
    fresh = tenth.withColumn("title", F.concat(F.lit("new "), F.col("title"))).unionByName(tenth.withColumn("source_id", F.col("source_id") + 10000000))
    return C.upsert(cat, fresh, ["source_id"])


# --- relations: nations under regions, parts under types and brands ---
@query(
    """WITH m AS (SELECT n_nationkey AS s, n_name AS w, n_regionkey AS p FROM nation), q AS (SELECT a.w AS word, b.w AS target, c.pm FROM m a JOIN m b ON a.p = b.p AND a.s <> b.s AND a.w <> b.w LEFT JOIN (SELECT n_name AS w, n_nationkey * 1.5::DOUBLE AS pm FROM nation) c ON c.w = b.w)
SELECT word, target, row_number() OVER (PARTITION BY word ORDER BY pm DESC, target) AS place FROM q"""
)
def coordinate_terms(spark, sf_dir):
    n = S.table(spark, sf_dir, "nation")
    members = n.select(F.col("n_nationkey").alias("synset"), F.lit(1).alias("domain"), F.col("n_name").alias("word"))
    up = n.select(F.col("n_nationkey").alias("synset"), F.col("n_regionkey").alias("parent"))
    return G.coordinates(members, up, n.select(F.col("n_name").alias("word"), (F.col("n_nationkey") * 1.5).alias("pm")))


@query(
    """WITH m AS (SELECT p_partkey AS s, p_size % 3 AS d, p_name AS w, p_type AS p FROM part UNION SELECT p_partkey, p_size % 3, lower(p_brand) || ' ' || p_name, p_type FROM part UNION ALL SELECT p_partkey, p_size % 3, w, p FROM (SELECT p_partkey, p_size, p_type || p_brand AS p, unnest([p_name, lower(p_brand) || ' ' || p_name]) AS w FROM part)),
f AS (SELECT p_name AS w, round(avg(p_retailprice), 2) AS pm FROM part WHERE p_size <> 7 GROUP BY p_name UNION ALL SELECT lower(p_brand) || ' ' || p_name, round(max(p_retailprice) / 2, 2) FROM part GROUP BY 1),
q AS (SELECT DISTINCT a.w AS word, b.w AS target FROM (SELECT DISTINCT s, d, p, w FROM m) a JOIN (SELECT DISTINCT s, d, p, w FROM m) b ON a.p = b.p AND a.d = b.d AND a.s <> b.s AND a.w <> b.w)
SELECT * FROM (SELECT word, target, row_number() OVER (PARTITION BY word ORDER BY coalesce(pm, 0) DESC, target) AS place FROM q LEFT JOIN f ON f.w = q.target) WHERE place <= 25"""
)
def hub_coordinates(spark, sf_dir):
    """Parts as synsets of two words each, under few types (hubs) and under brands of a type."""
    p = S.table(spark, sf_dir, "part")
    long_name = F.concat(F.lower("p_brand"), F.lit(" "), "p_name")
    synset, domain = F.col("p_partkey").alias("synset"), (F.col("p_size") % 3).alias("domain")
    members = p.select(synset, domain, F.col("p_name").alias("word")).unionByName(p.select(synset, domain, long_name.alias("word")))
    up = p.select(synset, F.explode(F.array("p_type", F.concat("p_type", "p_brand"))).alias("parent"))
    freq = p.filter("p_size <> 7").groupBy(F.col("p_name").alias("word")).agg(F.round(F.avg("p_retailprice"), 2).alias("pm"))
    freq = freq.unionByName(p.groupBy(long_name.alias("word")).agg(F.round(F.max("p_retailprice") / 2, 2).alias("pm")))
    return G.coordinates(members, up, freq)


@query(
    """WITH r AS (SELECT DISTINCT n_name AS word, 'hypernym' AS rel, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT a.n_name, 'coordinate', b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT rel, target, n.n_nationkey % 2 = 0 AND n.n_nationkey IS NOT NULL AS in_book, n.n_nationkey * 1.5::DOUBLE AS pm FROM r LEFT JOIN nation n ON r.target = n.n_name WHERE word = (SELECT min(n_name) FROM nation)"""
)
def relation_page(spark, sf_dir):
    n, r = S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region")
    words = n.select(F.col("n_nationkey").alias("wordid"), F.col("n_name").alias("lemma")).unionByName(r.select((F.col("r_regionkey") + 1000).alias("wordid"), F.col("r_name").alias("lemma")))
    senses = words.select("wordid", (F.col("wordid") + 5000).alias("synsetid"))
    links = n.select((F.col("n_nationkey") + 5000).alias("synset1id"), (F.col("n_regionkey") + 6000).alias("synset2id"), F.lit(1).alias("linkid"))
    hypernyms = G.semantic_links(words, senses, links)
    sisters = coordinate_terms(spark, sf_dir).select("word", F.lit("coordinate").alias("rel"), "target")
    word = n.agg(F.min("n_name")).first()[0]
    freq = n.select(F.col("n_name").alias("word"), (F.col("n_nationkey") * 1.5).alias("pm"))
    return G.relation_page(hypernyms.unionByName(sisters), word, n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("token")), freq)


@query(
    """WITH s AS (SELECT p_name AS lemma, p_type AS category, p_size AS tagcount, p_partkey AS sensenum, p_brand AS pos FROM part) SELECT pos AS lemma, count(*) AS n_senses, count(DISTINCT category) AS n_categories, arg_max(category, (tagcount, -sensenum)) AS primary_category FROM s GROUP BY pos"""
)
def lemma_summary(spark, sf_dir):
    senses = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("lemma"), F.lit("noun").alias("pos"), F.col("p_type").alias("category"), F.col("p_size").alias("tagcount"), F.col("p_partkey").alias("sensenum"))
    return G.lemma_summary(senses).select("lemma", "n_senses", F.size("categories").cast("long").alias("n_categories"), "primary_category")


# --- vectors ---
def _vectors(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM p) WHERE place <= 5"""
)
def cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return V.top_similar(v.filter("id % 20 = 0").select("id", "vector"), v.select("id", "vector"))


@query()
def index_topk(spark, sf_dir):
    """Every row is a query: the five nearest by the index of cells."""
    v, path = _vectors(spark, sf_dir).select("id", "vector"), scratch_path(spark)
    VI.write_index(v, path)
    return VI.nearest(spark, v, path)


def _ranked(spark, sf_dir):
    return placed(_vectors(spark, sf_dir), ["label"], [F.col("id")], "rank").withColumn("rank", F.col("rank") + 1)


@query()
def spherical_kmeans(spark, sf_dir):
    return V.sphere_clusters(_vectors(spark, sf_dir), ["label"])


@query()
def shadow_pick(spark, sf_dir):
    return V.varied_picks(_ranked(spark, sf_dir), ["label"])


@query("WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM e GROUP BY ALL), n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS len FROM m) SELECT label, i::INT AS i, round(x / len, 6) AS x FROM n")
def cluster_centroids(spark, sf_dir):
    out = V.centroids(_vectors(spark, sf_dir), "label")
    return out.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(
    """WITH n AS (SELECT DISTINCT event_type || '.Sub ' || (event_id % 3) || CASE WHEN event_id % 50 = 0 THEN '.!' ELSE '' END AS raw FROM events),
t AS (SELECT raw, list_transform(string_split(lower(trim(raw)), '.'), lambda s: trim(regexp_replace(regexp_replace(s, '[^a-z0-9 -]', '', 'g'), ' +', ' ', 'g'))) AS s FROM n)
SELECT raw, CASE WHEN len(list_filter(s, lambda x: NOT regexp_matches(x, '[a-z]') OR length(x) > 30)) = 0 AND len(s) <= 4 THEN array_to_string(s, '.') END AS tag FROM t"""
)
def tag_names(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    raw = F.concat("event_type", F.lit(".Sub "), (F.col("event_id") % 3).cast("string"), F.when(F.col("event_id") % 50 == 0, ".!").otherwise(""))
    return e.select(raw.alias("raw")).distinct().withColumn("tag", TF.sanitize_tag(F.col("raw")))
