"""Queries of changes to the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import catalog as FC
from wordloom.functions import text as X
from wordloom.operators import grabs as GR
from wordloom.operators import library as L
from wordloom.operators import tags as TG
from wordloom.plans import standin as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HASHED = """hsh AS (SELECT doc_id, 'd' || lpad(doc_id::VARCHAR, 9, '0') AS book, sha256(coalesce(list_aggregate(regexp_extract_all(lower(text), '[a-z]+(?:[''’-][a-z]+)*'), 'string_agg', ' '), '')) AS h, len(regexp_extract_all(lower(text), '[a-z]+(?:[''’-][a-z]+)*')) AS n FROM documents),
chk AS (SELECT *, min(book) OVER (PARTITION BY h) AS f FROM hsh)"""


def _new(spark, sf_dir):
    """Every document as a book to import."""
    docs = S.table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("book"), F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit(1850).alias("year"), "text")


def _none(spark):
    return spark.createDataFrame([], "book string, title string, author string, year int, content_hash string"), spark.createDataFrame([], "book string, token string, count long")


@query("WITH " + HASHED + " SELECT book, h AS content_hash, nullif(f, book) AS duplicate_of FROM chk")
def checked_imports(spark, sf_dir):
    return L.checked_imports(_none(spark)[0], _new(spark, sf_dir)).select("book", "content_hash", "duplicate_of")


@query("WITH " + HASHED + " SELECT count(*) AS asked, sum((f = book)::INT)::BIGINT AS imported, sum((f <> book)::INT)::BIGINT AS refused, sum((n = 0)::INT)::BIGINT AS without_words FROM chk")
def import_summary(spark, sf_dir):
    return L.import_summary(L.checked_imports(_none(spark)[0], _new(spark, sf_dir)))


@query(
    "WITH "
    + HASHED
    + ", tok AS (SELECT c.book, unnest(regexp_extract_all(lower(replace(regexp_replace(text, '\\s+', ' ', 'g'), '’', '''')), '[a-z]+(?:[''’-][a-z]+)*')) AS token FROM documents d JOIN chk c ON d.doc_id = c.doc_id AND f = book) SELECT book, count(*) AS n_tokens, count(DISTINCT token) AS n_types FROM tok GROUP BY book"
)
def commit_books(spark, sf_dir):
    _, counts = L.commit_books(*_none(spark), _new(spark, sf_dir))
    return counts.groupBy("book").agg(F.sum("count").alias("n_tokens"), F.count("*").alias("n_types"))


BOOK_TAGS = """btg AS (SELECT 'b' || c_custkey AS book, 'src:' || lower(c_mktsegment) AS tag, true AS auto FROM customer UNION ALL SELECT 'b' || c_custkey, 'shelf' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.sea' ELSE '.land' END, false FROM customer WHERE c_custkey % 4 <> 0
  UNION ALL SELECT 'b' || c_custkey, 'stack', false FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT 'b' || c_custkey, 'old.paper', false FROM customer WHERE c_custkey % 5 = 0)"""


def book_tags(spark, sf_dir):
    c, k = S.table(spark, sf_dir, "customer"), F.col("c_custkey")
    row = lambda rows, tag, auto: rows.select(F.concat(F.lit("b"), k.cast("string")).alias("book"), tag.alias("tag"), F.lit(auto).alias("auto"), F.expr("timestamp'2020-01-01 00:00:00'").alias("ts"))
    shelf = F.concat(F.lit("shelf"), F.when(k % 3 == 0, "").when(k % 3 == 1, ".sea").otherwise(".land"))
    own = row(c.filter(k % 4 != 0), shelf, False).unionByName(row(c.filter(k % 6 == 0), F.lit("stack"), False)).unionByName(row(c.filter(k % 5 == 0), F.lit("old.paper"), False))
    return row(c, F.concat(F.lit("src:"), F.lower("c_mktsegment")), True).unionByName(own)


@query(
    "WITH "
    + BOOK_TAGS
    + """, rst AS (SELECT * FROM btg WHERE auto OR NOT (tag = 'shelf' OR starts_with(tag, 'shelf.'))), mov AS (SELECT book, 'stack' || substr(tag, 6) AS tag, auto FROM btg WHERE NOT auto AND (tag = 'shelf' OR starts_with(tag, 'shelf.'))),
ren AS (SELECT * FROM rst UNION ALL SELECT * FROM mov WHERE (book, tag) NOT IN (SELECT (book, tag) FROM rst)), del AS (SELECT * FROM ren WHERE auto OR NOT (tag = 'old' OR starts_with(tag, 'old.')))
SELECT book, tag, auto FROM del WHERE NOT (book = 'b1' AND tag = 'stack.sea') UNION ALL SELECT 'b4', 'shelf:new wave', false"""
)
def book_tag_changes(spark, sf_dir):
    """A rename with its descendants, a deletion with its descendants, one tag taken away and one added."""
    table = book_tags(spark, sf_dir)
    table = L.delete_book_tag(L.rename_book_tag(table, "shelf", "stack"), "old")
    table = L.remove_book_tag(table, "b1", "stack.sea")
    return L.add_book_tag(table, table.select("book").distinct(), "b4", " Shelf:New  Wave! ").select("book", "tag", "auto")


# Every seventh book is deleted; its tags lie dormant. Every eleventh has lost its tags, every thirteenth its source tag.
SHELVES = BOOK_TAGS + """, bok AS (SELECT c_custkey AS id, 'b' || c_custkey AS book, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS title FROM customer WHERE c_custkey % 7 <> 0),
tgs AS (SELECT book, tag, auto FROM btg WHERE substr(book, 2)::BIGINT % 11 <> 0 AND NOT (starts_with(tag, 'src:') AND substr(book, 2)::BIGINT % 13 = 0) UNION ALL SELECT 'b' || c_custkey, 'fmt:epub', true FROM customer WHERE c_custkey % 13 = 0)"""


def shelves(spark, sf_dir):
    """(books, book_tags) of SHELVES."""
    c, k = S.table(spark, sf_dir, "customer"), F.col("c_custkey")
    books = c.filter(k % 7 != 0).select(k.alias("id"), F.concat(F.lit("b"), k.cast("string")).alias("book"), F.when(k % 9 != 0, F.col("c_name")).alias("title"))
    n = F.substring("book", 2, 20).cast("long")
    own = book_tags(spark, sf_dir).select("book", "tag", "auto").filter((n % 11 != 0) & ~(F.col("tag").startswith("src:") & (n % 13 == 0)))
    return books, own.unionByName(c.filter(k % 13 == 0).select(F.concat(F.lit("b"), k.cast("string")).alias("book"), F.lit("fmt:epub").alias("tag"), F.lit(True).alias("auto")))


@query("WITH " + SHELVES + " SELECT tag, max(auto::INT)::INT AS auto, count(*) AS n_books FROM tgs JOIN bok USING (book) GROUP BY tag")
def list_book_tags(spark, sf_dir):
    books, own = shelves(spark, sf_dir)
    return TG.book_tag_counts(own, books).withColumn("auto", F.col("auto").cast("int"))


@query(
    "WITH "
    + SHELVES
    + """, cnt AS (SELECT tag, count(*) AS n FROM tgs JOIN bok USING (book) GROUP BY tag)
SELECT id, bok.book, coalesce(title, bok.book) AS title, coalesce(string_agg(t.tag || ' (' || n || ')', ', ' ORDER BY auto DESC, t.tag), '') AS tags FROM bok LEFT JOIN tgs t ON t.book = bok.book LEFT JOIN cnt ON cnt.tag = t.tag GROUP BY ALL"""
)
def books_with_tags(spark, sf_dir):
    found = TG.books_with_tags(*shelves(spark, sf_dir))
    return found.withColumn("tags", F.array_join(F.transform("tags", lambda t: F.concat(t["name"], F.lit(" ("), t["n_books"].cast("string"), F.lit(")"))), ", "))


def _grouped(name: str, where: str, **how):
    def run(spark, sf_dir):
        return TG.grouped_books(*shelves(spark, sf_dir), **how)

    run.__name__ = name
    return query(
        "WITH "
        + SHELVES
        + f""", grp AS (SELECT bok.id, bok.book, coalesce(min(CASE WHEN NOT auto THEN tag END), min(CASE WHEN auto AND starts_with(tag, 'src:') THEN tag END), min(tag), 'untagged') AS g FROM bok LEFT JOIN tgs t ON t.book = bok.book WHERE {where} GROUP BY ALL)
SELECT g AS "group", dense_rank() OVER (ORDER BY g = 'untagged', g) AS group_place, row_number() OVER (PARTITION BY g ORDER BY id) AS place, book, count(*) OVER (PARTITION BY g) AS n_books FROM grp"""
    )(run)


_grouped("grouped_books", "true")
_grouped("grouped_books_of_a_tag", "bok.book = 'b11' OR bok.book IN (SELECT book FROM tgs WHERE tag = 'stack')", want="stack", current="b11")


OLD = """old AS (SELECT CASE WHEN event_id % 50 = 49 THEN NULL ELSE event_id % 30 END AS book_id, user_id AS word_id, event_type AS tag, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'r' || (event_id % 3) END AS rater, ts FROM events)"""


@query("WITH " + OLD + " SELECT 'b' || book_id AS book, 'w' || word_id AS word, tag, coalesce(rater, 'me') AS rater, min(ts) AS ts FROM old WHERE book_id < 25 GROUP BY ALL")
def text_keyed_tags(spark, sf_dir):
    e, i = S.table(spark, sf_dir, "events"), F.col("event_id")
    old = e.select(F.when(i % 50 != 49, i % 30).alias("book_id"), F.col("user_id").alias("word_id"), F.col("event_type").alias("tag"), F.when(i % 3 != 0, F.concat(F.lit("r"), (i % 3).cast("string"))).alias("rater"), "ts")
    books = spark.range(25).select("id", F.concat(F.lit("b"), F.col("id").cast("string")).alias("book"))
    words = e.select(F.col("user_id").alias("id"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("word")).distinct()
    return L.text_keyed(old, books, words)


@query("SELECT o_orderkey AS id, o_orderstatus AS state, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS place FROM (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS o_orderstatus FROM orders)")
def job_list(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return L.job_list(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), F.col("o_orderdate").alias("updated"))).select("id", "state", "place")


# The catalogue is the documents under three sources, one in ten missing; one file in eleven can't be fetched. Half of the
# library has its catalogue row's name, the other half came in by hand. Events ask for documents, some of which aren't there.
GRAB = (
    HASHED
    + """, nam AS (SELECT h.doc_id AS d, h.h, coalesce(documents.source, 'none') AS title FROM hsh h JOIN documents USING (doc_id)),
bks AS (SELECT CASE WHEN d % 12 = 0 THEN 'gutenberg-' || d ELSE title || '-' || d END AS book, CASE WHEN d % 12 = 0 THEN d::VARCHAR ELSE '' END AS source_id, h, d, title FROM nam WHERE d % 6 = 0),
ask AS (SELECT event_id AS place, event_id * 7 % 1200 AS d FROM events), fst AS (SELECT d, min(place) AS f FROM ask GROUP BY d),
jud AS (SELECT fst.*, nam.h, nam.title, CASE WHEN nam.d IS NULL OR fst.d % 10 = 9 THEN 'not in the catalogue' WHEN fst.d % 12 = 0 THEN 'already imported' WHEN fst.d % 11 = 5 THEN 'nothing was fetched' END AS reason FROM fst LEFT JOIN nam ON nam.d = fst.d),
sam AS (SELECT h, min(book) AS same, arg_min(source_id, book) AS same_id FROM bks GROUP BY h),
may AS (SELECT jud.*, same, same_id, row_number() OVER (PARTITION BY jud.h ORDER BY f) AS k FROM jud LEFT JOIN sam ON sam.h = jud.h WHERE reason IS NULL),
fre AS (SELECT h, d, f, CASE d % 3 WHEN 0 THEN 'gutenberg-' || d WHEN 1 THEN 'se-a-' || d ELSE title END AS base FROM may WHERE same IS NULL AND k = 1),
usd AS (SELECT title AS base, d AS n FROM bks WHERE d % 12 <> 0 AND d > 1), bas AS (SELECT base, count(*) AS need FROM fre GROUP BY base),
opn AS (SELECT bas.base, need, unnest(generate_series(1, need + (SELECT count(*) FROM usd WHERE usd.base = bas.base))) AS n FROM bas),
ope AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS r FROM opn WHERE (base, n) NOT IN (SELECT (base, n) FROM usd)),
slg AS (SELECT h, CASE n WHEN 1 THEN x.base ELSE x.base || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY f) AS r FROM fre) x JOIN ope ON ope.base = x.base AND ope.r = x.r),
dec AS (SELECT may.d, f, CASE WHEN same IS NULL AND k = 1 THEN 'imported' ELSE 'skipped' END AS outcome, coalesce(same, slug) AS slug, same IS NOT NULL AND k = 1 AND same_id = '' AS claims FROM may LEFT JOIN slg ON slg.h = may.h),
eac AS (SELECT *, CASE WHEN outcome = 'skipped' THEN 'identical content' END AS reason FROM dec UNION ALL SELECT d, f, CASE WHEN reason = 'already imported' THEN 'skipped' ELSE 'failed' END, CASE WHEN reason = 'already imported' THEN 'gutenberg-' || d END, false, reason FROM jud WHERE reason IS NOT NULL),
grb AS (SELECT place, d, CASE WHEN place > f AND (outcome = 'imported' OR claims) THEN 'skipped' ELSE outcome END AS outcome, slug, CASE WHEN place > f AND (outcome = 'imported' OR claims) THEN 'already imported' ELSE reason END AS reason, claims AND place = f AS claims FROM ask JOIN eac USING (d))"""
)


def grab_tables(spark, sf_dir):
    """items, catalog, books and texts of GRAB."""
    docs, d = S.table(spark, sf_dir, "documents"), F.col("d")
    source = F.when(d % 3 == 0, "gutenberg").when(d % 3 == 1, "standardebooks").otherwise("other")
    source_id = F.when(d % 3 == 1, F.concat(F.lit("a/"), d.cast("string"))).otherwise(d.cast("string"))
    named = docs.select(F.col("doc_id").alias("d"), F.coalesce("source", F.lit("none")).alias("title"), "text").withColumns({"source": source, "source_id": source_id, "author": F.lit("a"), "year": F.lit(1850)})
    items = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), (F.col("event_id") * 7 % 1200).alias("d")).withColumns({"source": source, "source_id": source_id})
    known = d % 12 == 0
    books = named.filter(d % 6 == 0).withColumns({
        "book": F.when(known, F.concat(F.lit("gutenberg-"), d.cast("string"))).otherwise(F.concat_ws("-", "title", d.cast("string"))),
        "source": F.when(known, "gutenberg").otherwise("epub"), "source_id": F.when(known, d.cast("string")), "content_hash": X.content_hash(F.col("text")),
    }).select("book", "source", "source_id", "title", "author", "year", "content_hash")
    return items, named.filter(d % 10 != 9), books, named.filter(d % 11 != 5).select("source", "source_id", "text")


@query("WITH " + GRAB + " SELECT place, outcome, slug, reason, claims FROM grb")
def grabbed(spark, sf_dir):
    """What becomes of each row of a batch, and under which name."""
    return GR.grabbed(*grab_tables(spark, sf_dir)).select("place", "outcome", "slug", "reason", "claims")


@query("WITH " + GRAB + " SELECT count(*) AS n, count_if(outcome = 'imported')::BIGINT AS n_imported, count_if(outcome = 'skipped')::BIGINT AS n_skipped, count_if(outcome = 'failed')::BIGINT AS n_failed, arg_min(reason, CASE WHEN outcome = 'failed' THEN place END) AS first_failure, count_if(outcome = 'failed') = 0 AS ok, CASE WHEN count_if(outcome = 'failed') > 0 THEN CASE WHEN count_if(outcome = 'imported') > 0 THEN 'PARTIAL' ELSE 'ALL_FAILED' END END AS code FROM grb")
def grab_summary(spark, sf_dir):
    return GR.grab_summary(GR.grabbed(*grab_tables(spark, sf_dir)))


@query("WITH " + GRAB + " SELECT book, CASE WHEN c.d IS NOT NULL THEN 'gutenberg' WHEN source_id = '' THEN 'epub' ELSE 'gutenberg' END AS source, coalesce(c.d::VARCHAR, nullif(source_id, '')) AS source_id FROM bks LEFT JOIN (SELECT slug, d FROM grb WHERE claims) c ON c.slug = book WHERE c.d IS NULL OR c.d % 3 = 0 UNION ALL SELECT book, CASE c.d % 3 WHEN 1 THEN 'standardebooks' ELSE 'other' END, CASE c.d % 3 WHEN 1 THEN 'a/' || c.d ELSE c.d::VARCHAR END FROM bks JOIN grb c ON c.slug = book AND claims WHERE c.d % 3 <> 0 UNION ALL SELECT slug, CASE d % 3 WHEN 0 THEN 'gutenberg' WHEN 1 THEN 'standardebooks' ELSE 'other' END, CASE d % 3 WHEN 1 THEN 'a/' || d ELSE d::VARCHAR END FROM grb WHERE outcome = 'imported'")
def books_after_grab(spark, sf_dir):
    """The library after a batch: its books, those that took over a catalogue row, and those that came in."""
    items, catalog, books, texts = grab_tables(spark, sf_dir)
    return GR.with_grabbed(books, catalog, GR.grabbed(items, catalog, books, texts)).select("book", "source", "source_id")


@query("SELECT (SELECT count(DISTINCT event_type) FROM events) AS n_tags, (SELECT count(*) FROM events WHERE event_id % 3 <> 0) AS n_applications, count(*) AS n_book_tags, count_if(auto)::BIGINT AS n_auto FROM (WITH " + BOOK_TAGS + " SELECT * FROM btg)")
def user_counts(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return GR.user_counts(e.select("event_type").distinct(), e.filter("event_id % 3 <> 0"), book_tags(spark, sf_dir))


@query(
    """WITH itm AS (SELECT o_custkey, '[' || string_agg('"' || o_orderstatus || ':' || o_orderkey || '"', ',' ORDER BY o_orderkey) || ']' AS items FROM orders GROUP BY o_custkey)
SELECT o_custkey AS batch, lower(printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(generate_series(1, length(items)), lambda i: ascii(items[i])::HUGEINT)), lambda h, b: xor(h, b) * 17592186044851::HUGEINT % 18446744073709551616::HUGEINT)::UBIGINT)) AS digest FROM itm"""
)
def batch_digests(spark, sf_dir):
    """The short names of batches: a customer's orders as a batch of catalogue rows."""
    item = F.concat_ws(":", "o_orderstatus", F.col("o_orderkey").cast("string"))
    batches = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", item.alias("item"))))["item"].alias("items"))  # a batch is one request
    return batches.select("batch", FC.digest(F.to_json("items")).alias("digest"))
