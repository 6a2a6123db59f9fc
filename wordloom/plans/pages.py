"""Queries of what a reader asks for: pages of candidates, one word, examples, tags, collections, lists."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wordloom.operators import frequency
from wordloom.operators import pages as P
from wordloom.operators import rescore as RS
from wordloom.operators import tags as TG
from wordloom.operators import trajectory as TR
from wordloom.operators import word_index as IX
from wordloom.operators.ranges import placed
from wordloom.plans import standin as S
from wordloom.plans import tables as TB
from wordloom.plans import words as WD
from wordloom.plans.words import TOKENS, WORDS, candidates_sql, lemma_sql, with_
from wordloom.sources.writers import plain_list
from wordloom.sources.written import scratch_path

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Every book is of 1850; categories go by first letters, with catch-alls; events tag words of middling rank.
FIRST_TAGGED = 8000
USAGE = re.sub(r"\btok\b", "utk", TB.USAGE)
PARTS = f"""ps AS (SELECT word, CASE WHEN ends_with(word, 'ing') OR ends_with(word, 'ed') THEN 'verb' WHEN ends_with(word, 'ly') THEN 'adv' WHEN regexp_matches(word, '(able|ible|ish|al|ous)$') THEN 'adj' WHEN length(word) <= 2 THEN 'prep' ELSE 'noun' END AS pos FROM wrd UNION SELECT word, 'noun' FROM wrd WHERE rare IS NOT NULL),
pp AS (SELECT word, CASE WHEN rare IS NOT NULL THEN 'noun' WHEN ends_with(word, 'ing') OR ends_with(word, 'ed') THEN 'verb' WHEN ends_with(word, 'ly') THEN 'adv' WHEN regexp_matches(word, '(able|ible|ish|al|ous)$') THEN 'adj' WHEN length(word) <= 2 THEN 'prep' ELSE 'noun' END AS pos FROM wrd),
ctg AS (SELECT word, 'c.' || left(word, 1) AS category, true AS prim FROM wrd UNION ALL SELECT word, 'noun.Tops', false FROM wrd WHERE rare IS NOT NULL UNION ALL SELECT word, 'adj.all', false FROM wrd WHERE adj),
bkt AS (SELECT word, pos AS bucket FROM ps WHERE pos IN ('noun', 'verb', 'adj', 'adv') UNION SELECT word, category FROM ctg WHERE NOT ends_with(category, '.all') AND category <> 'noun.Tops'),
bks AS (SELECT word, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS buckets FROM bkt GROUP BY word)"""
WORD_TAGS = f"""rkd AS (SELECT word, row_number() OVER (ORDER BY c DESC, word) AS rnk FROM wrd),
wtg AS (SELECT CASE WHEN event_id % 21 = 20 THEN '*' ELSE 'src' || (event_id % 21) END AS book, rkd.word, event_type || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.a' ELSE '.a.b' END AS tag,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE (event_id % 5)::INT END AS value, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'me' END AS rater, ts FROM events JOIN rkd ON rnk = {FIRST_TAGGED} + user_id)"""
DEFS = "dfs(name, interest, sort) AS (VALUES " + ", ".join(f"('{n}', '{i}', {k % 3})" for k, (n, i) in enumerate(TB.DEFS)) + ")"
ERAS = "era AS (" + TB.ORACLES["era_classes"].split(TB.USAGE)[1] + "), obs AS (" + TB.ORACLES["obsolete_words"].split(TB.USAGE)[1] + ")"


def categories(words):
    row = lambda c, primary: words.select("word", c.alias("category"), F.lit(primary).alias("is_primary"))
    tops = words.filter("rare_letters IS NOT NULL").select("word", F.lit("noun.Tops").alias("category"), F.lit(False).alias("is_primary"))
    catch_all = words.filter("is_adj").select("word", F.lit("adj.all").alias("category"), F.lit(False).alias("is_primary"))
    return row(F.concat(F.lit("c."), F.substring("word", 1, 1)), True).unionByName(tops).unionByName(catch_all)


def word_tags(spark, sf_dir, words):
    """book, word, tag, value, rater, ts."""
    ranked = frequency.positional_rank(words.select("word", "count"), "count", "word").select("rank", "word")
    e, i = S.table(spark, sf_dir, "events"), F.col("event_id")
    tagged = e.select(
        (FIRST_TAGGED + F.col("user_id")).alias("rank"), F.when(i % 21 == 20, "*").otherwise(F.concat(F.lit("src"), (i % 21).cast("string"))).alias("book"),
        F.concat("event_type", F.when(i % 4 == 0, "").when(i % 4 == 1, ".a").otherwise(".a.b")).alias("tag"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, 0).otherwise(i % 5).cast("int").alias("value"), F.when(i % 7 == 0, "other").otherwise("me").alias("rater"), "ts",
    )
    return tagged.join(ranked, "rank").select("book", "word", "tag", "value", "rater", "ts")


def definitions(spark):
    return spark.createDataFrame([(n, i, k % 3) for k, (n, i) in enumerate(TB.DEFS)], "name string, interest string, sort int")


def eras(spark, sf_dir):
    return TR.summarise(TB.usage(spark, sf_dir), ["word"], F.lit(1850), F.lit(2000))


def page(spark, sf_dir, spec="", limit=P.PAGE, level=2):
    """The page of each book at a level, under a filter."""
    words, counts = S.words_and_counts(spark, sf_dir)
    rooted, family = S.lemmas(words, level) if level else (None, None)
    kept = WD.scoring.candidates(counts, words, rooted, family, level)
    pos = S.word_pos(words)
    asked = eras(spark, sf_dir) if spec.startswith(("era:", "status:")) else None
    return P.candidate_page(kept, words, pos, WD.primary_pos(pos), categories(words), asked, P.merged_forms(counts, words, rooted), word_tags(spark, sf_dir, words), spec, limit)


def _page_sql(where: str) -> str:
    return (
        with_(TOKENS, WORDS, lemma_sql(2), candidates_sql(2), USAGE, ERAS, PARTS, WORD_TAGS)
        + f""", hit AS (SELECT c.* FROM can2 c WHERE {where}),
pge AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY rank) AS place, count(*) OVER (PARTITION BY book) AS total FROM hit QUALIFY place <= {P.PAGE}),
frm AS (SELECT c.book, coalesce(r.root, c.token) AS word, string_agg(DISTINCT c.token, '/' ORDER BY c.token) FILTER (c.token <> coalesce(r.root, c.token)) AS f FROM cnt c JOIN wrd w ON c.token = w.word LEFT JOIN roo2 r ON r.word = c.token GROUP BY ALL),
tgs AS (SELECT p.book, p.word, string_agg(DISTINCT t.tag, ',' ORDER BY t.tag) AS tags FROM pge p JOIN wtg t ON t.word = p.word AND t.book IN (p.book, '*') WHERE rater = 'me' AND coalesce(value, 1) >= 1 GROUP BY ALL)
SELECT p.book, place, total, p.word, in_book, score, n_forms, w.ety AS origin, k.category, pp.pos, concat_ws('/', p.word, f) AS forms, coalesce(tags, '') AS tags, coalesce(buckets, '') AS buckets
FROM pge p LEFT JOIN wrd w ON w.word = p.word LEFT JOIN ctg k ON k.word = p.word AND prim LEFT JOIN pp ON pp.word = p.word LEFT JOIN frm ON frm.book = p.book AND frm.word = p.word LEFT JOIN tgs ON tgs.book = p.book AND tgs.word = p.word LEFT JOIN bks ON bks.word = p.word"""
    )


def _page_query(name: str, spec: str, where: str):
    def run(spark, sf_dir):
        return page(spark, sf_dir, spec)

    run.__name__ = name
    return query(_page_sql(where))(run)


_page_query("candidate_page", "", "true")
_page_query("candidate_page_by_pos", "pos:verb", "EXISTS (SELECT 1 FROM ps WHERE ps.word = c.word AND ps.pos = 'verb')")
_page_query("candidate_page_by_category", "c.b", "EXISTS (SELECT 1 FROM ctg WHERE ctg.word = c.word AND ctg.category = 'c.b')")
_page_query("candidate_page_by_origin", "origin:rare", f"c.word IN (SELECT word FROM wrd WHERE ety IS NOT NULL AND ety NOT IN ({WD._common((*WD.scoring.FILTER_COMMON, *WD.scoring.FILTER_ROMANCE))}))")
_page_query("candidate_page_by_era", "era:ahead", "c.word IN (SELECT word FROM era WHERE era = 'ahead')")
_page_query("candidate_page_obsolete", "status:obsolete", "c.word IN (SELECT word FROM obs)")


def detail(spark, sf_dir, book, word, level=2):
    """word_detail over the stand-in tables. word: a word, or a function that picks one from (words, candidates, rooted)."""
    words, counts = S.words_and_counts(spark, sf_dir)
    rooted, family = S.lemmas(words, level)
    if callable(word):
        word = word(words, WD.scoring.candidates(counts, words, rooted, family, level).filter(F.col("book") == book), rooted)
    traj = S.written(TB.usage(spark, sf_dir))
    return P.word_detail(book, word, words, counts, rooted, S.word_pos(words), categories(words), traj, TR.summarise(traj, ["word"], F.lit(1850), F.lit(2000)))


def first_of_several(words, kept, rooted):
    """The first candidate with several forms."""
    return kept.filter("n_forms > 1").orderBy("rank").first()["word"]


def first_derived(words, kept, rooted):
    """The first word by name that has another root."""
    return rooted.filter("word <> root").orderBy("word").first()["word"]


def _detail_sql(pick: str) -> str:
    points = "string_agg(decade || ':' || round(pm, 3)::DECIMAL(20, 3), ',' ORDER BY decade)"
    return (
        with_(TOKENS, WORDS, lemma_sql(2), candidates_sql(2), USAGE, ERAS, PARTS)
        + f""", one AS ({pick}), mem AS (SELECT word AS token FROM roo2 WHERE root = (FROM one) UNION SELECT word FROM wrd WHERE alpha AND word = (FROM one)),
oth AS (SELECT book, sum(n)::BIGINT AS n FROM cnt WHERE book <> 'src1' AND token IN (FROM mem) GROUP BY book ORDER BY n DESC, book LIMIT {P.ALSO_IN}),
fml AS (SELECT c.token, c.n, w.pm FROM cnt c JOIN wrd w ON w.word = c.token WHERE c.book = 'src1' AND c.token IN (FROM mem) ORDER BY w.pm DESC NULLS LAST, c.token LIMIT {P.FAMILY}),
rot AS (SELECT root FROM roo2 WHERE word = (FROM one) AND root <> word)
SELECT w.word, w.ety AS origin, round(w.pm, 6) AS freq_pm, w.syl AS syllables, coalesce((SELECT n FROM cnt WHERE book = 'src1' AND token = w.word), 0) AS in_book,
  (SELECT b.word FROM wrd b WHERE b.word = (FROM rot) AND b.pm > coalesce(w.pm, 0)) AS base, (SELECT era FROM era WHERE era.word = w.word) AS era, w.word IN (SELECT word FROM obs) AS obsolete,
  (SELECT string_agg(category, ',' ORDER BY prim DESC, category) FROM ctg WHERE ctg.word = w.word) AS categories, (SELECT buckets FROM bks WHERE bks.word = w.word) AS buckets,
  (SELECT string_agg(token || ':' || n, ',' ORDER BY pm DESC NULLS LAST, token) FROM fml) AS family, (SELECT {points} FROM trj WHERE trj.word = w.word) AS trajectory,
  (SELECT {points} FROM trj WHERE trj.word = (FROM rot)) AS root_trajectory, (SELECT string_agg(book || ':' || n, ',' ORDER BY n DESC, book) FROM oth) AS also_in
FROM wrd w WHERE w.word = (FROM one)"""
    )


_SEVERAL = "SELECT word FROM can2 WHERE book = 'src1' AND n_forms > 1 ORDER BY rank LIMIT 1"


@query(_detail_sql(_SEVERAL))
def word_detail(spark, sf_dir):
    return detail(spark, sf_dir, "src1", first_of_several)


@query(_detail_sql("SELECT min(word) FROM roo2 WHERE word <> root"))
def derived_word_detail(spark, sf_dir):
    return detail(spark, sf_dir, "src1", first_derived)


@query(
    with_(TOKENS, WORDS, lemma_sql(2), candidates_sql(2))
    + f""", one AS ({_SEVERAL}), fms AS (SELECT token AS form FROM (SELECT token FROM cnt WHERE book = 'src1' AND (token = (FROM one) OR token IN (SELECT word FROM roo2 WHERE root = (FROM one))) ORDER BY n DESC, token LIMIT {P.FAMILY}) UNION FROM one),
snt AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(replace(regexp_replace(text, '\\s+', ' ', 'g'), '’', ''''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE source = 'src1')),
hit AS (SELECT doc_id, i, s, form FROM (SELECT *, unnest(list_distinct(regexp_extract_all(lower(s), '[a-z]+(?:[''’-][a-z]+)*'))) AS form FROM snt) WHERE form IN (FROM fms)),
fst AS (SELECT doc_id, i, trim(s) AS x, arg_min(form, (strpos(lower(s), form), form)) AS form FROM hit GROUP BY doc_id, i, s),
top AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY doc_id, i) AS place FROM fst QUALIFY place <= {P.EXAMPLES}),
w AS (SELECT *, regexp_extract(' ' || x || ' ', '(?i)[^a-z]' || form || '[^a-z]') AS h FROM top),
v AS (SELECT *, CASE WHEN h = '' THEN -1 ELSE strpos(' ' || x || ' ', h) - 1 END AS start, greatest(0, ({P.EXAMPLE_CHARS} - length(form)) // 2) AS half FROM w),
u AS (SELECT *, least(length(x), greatest(start - half, 0) + {P.EXAMPLE_CHARS}) AS high FROM v)
SELECT place, total, form, CASE WHEN length(x) <= {P.EXAMPLE_CHARS} THEN x WHEN start < 0 THEN rtrim(left(x, {P.EXAMPLE_CHARS})) || '…'
  ELSE CASE WHEN high > {P.EXAMPLE_CHARS} THEN '…' ELSE '' END || trim(substr(x, greatest(0, high - {P.EXAMPLE_CHARS}) + 1, high - greatest(0, high - {P.EXAMPLE_CHARS}))) || CASE WHEN high < length(x) THEN '…' ELSE '' END END AS text FROM u"""
)
def word_examples(spark, sf_dir):
    words, counts = S.words_and_counts(spark, sf_dir)
    rooted, family = S.lemmas(words, 2)
    word = first_of_several(words, WD.scoring.candidates(counts, words, rooted, family, 2).filter("book = 'src1'"), rooted)
    return P.word_examples(S.table(spark, sf_dir, "documents").filter("source = 'src1'"), P.searched_forms(counts, rooted, "src1", word))


def word_index(spark, sf_dir, level=2):
    """(path of an index of all documents, words, counts, rooted, family)."""
    words, counts = S.words_and_counts(spark, sf_dir)
    rooted, family = S.lemmas(words, level)
    path = scratch_path(spark)
    IX.write_index(path, S.table(spark, sf_dir, "documents"), words, counts, rooted)
    return path, words, counts, rooted, family


@query(ORACLES["word_examples"])
def indexed_examples(spark, sf_dir):
    """word_examples of an index: a few ranges of it, and the texts of the examples, are read."""
    path, words, counts, rooted, family = word_index(spark, sf_dir)
    word = first_of_several(words, WD.scoring.candidates(counts, words, rooted, family, 2).filter("book = 'src1'"), rooted)
    return IX.indexed_examples(spark, path, S.table(spark, sf_dir, "documents"), "src1", IX.indexed_forms(spark, path, "src1", word))


@query(ORACLES["word_detail"])
def indexed_word_detail(spark, sf_dir):
    """word_detail of an index: the word's, its family's and its root's ranges are read."""
    path, words, counts, rooted, family = word_index(spark, sf_dir)
    word = first_of_several(words, WD.scoring.candidates(counts, words, rooted, family, 2).filter("book = 'src1'"), rooted)
    own, n, roots = IX.word_rows(spark, path, word)
    traj = S.written(TB.usage(spark, sf_dir))
    return P.word_detail("src1", word, own, n, roots, S.word_pos(own), categories(own), traj, TR.summarise(traj, ["word"], F.lit(1850), F.lit(2000)))


@query(with_(TOKENS, WORDS, lemma_sql(2), candidates_sql(2)) + "SELECT * FROM can2")
def rescored_candidates(spark, sf_dir):
    """The candidates of all books after changes: a library with half of one book, with a book that is no more and with
    other features of some words takes the whole book in, lets the other one go and follows the dictionary."""
    words, counts = S.words_and_counts(spark, sf_dir)
    rooted, family = S.lemmas(words, 2)
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"), "text")
    half = frequency.token_counts(docs.filter("book = 'src1' AND doc_id % 2 = 0"), ["book"])
    extra = frequency.token_counts(docs.filter("book = 'src2'").withColumn("book", F.lit("a/b=c %")), ["book"])
    old = counts.filter("book <> 'src1'").unionByName(half).unionByName(extra)
    odd = F.length("word") % 5 == 4
    before = RS.Dictionary(S.written(words.withColumns({"is_offensive": F.col("is_offensive") | odd, "pm_lc": F.when(F.col("word").startswith("b"), F.col("pm_lc") * 2).otherwise(F.col("pm_lc"))})), rooted, S.written(family))
    after, path = RS.Dictionary(words, rooted, S.written(family)), scratch_path(spark)
    RS.write_library(path, old, before, 2)
    RS.refresh_books(spark, path, docs.filter("book = 'src1'").select("book", "text"), ["a/b=c %"], before, 2)
    RS.refresh_words(spark, path, before, after, 2)
    return RS.stored(spark, path, "candidates").select(*ranked_columns)


ranked_columns = ["book", "level", "word", "in_book", "n_forms", "score", "s_rarity", "s_salience", "s_origin", "s_aesthetic", "rank"]


@query(with_(WORDS, WORD_TAGS) + "SELECT word, tag, coalesce(value, -1) AS value, count(*) AS n FROM wtg WHERE book IN ('src3', '*') AND rater = 'me' GROUP BY ALL")
def book_tags(spark, sf_dir):
    own = P.book_tags(word_tags(spark, sf_dir, S.words_table(spark, sf_dir)), "src3")
    return own.groupBy("word", "tag", "value").agg(F.count("*").alias("n"))


COLLECTION = (
    DEFS
    + """,
onn AS (SELECT t.*, d.interest FROM wtg t JOIN dfs d ON d.name = t.tag WHERE rater = 'me' AND coalesce(value, 1) >= 1),
bok AS (SELECT DISTINCT word, book FROM onn WHERE book <> '*' UNION SELECT c.token, c.book FROM cnt c WHERE c.token IN (SELECT word FROM onn WHERE book = '*')),
per AS (SELECT b.word, count(*) AS n_books, sum(coalesce(c.n, 0))::BIGINT AS count FROM bok b LEFT JOIN cnt c ON c.book = b.book AND c.token = b.word GROUP BY b.word),
eff AS (SELECT o.word, CASE max(CASE d.interest WHEN 'interesting' THEN 2 WHEN 'uninteresting' THEN 1 ELSE 0 END) WHEN 2 THEN 'interesting' WHEN 1 THEN 'uninteresting' ELSE 'neutral' END AS interest FROM onn o JOIN dfs d ON o.tag = d.name OR starts_with(o.tag, d.name || '.') GROUP BY o.word),
nte AS (SELECT word, sum(CASE interest WHEN 'interesting' THEN 1 WHEN 'uninteresting' THEN -1 ELSE 0 END)::BIGINT AS net FROM (SELECT DISTINCT word, tag, interest FROM onn WHERE book = '*') GROUP BY word),
col AS (SELECT t.word, tags, coalesce(n_books, 0) AS n_books, coalesce(count, 0) AS count, eff.interest, round(w.pm, 6) AS freq_pm, coalesce(net, 0) AS net FROM (SELECT word, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM onn GROUP BY word) t
  LEFT JOIN per ON per.word = t.word JOIN eff ON eff.word = t.word LEFT JOIN nte ON nte.word = t.word LEFT JOIN wrd w ON w.word = t.word)"""
)


def _collection_query(name: str, spec: str, by: str, where: str, order: str):
    def run(spark, sf_dir):
        words = S.words_table(spark, sf_dir)
        found = P.collection_page(definitions(spark), word_tags(spark, sf_dir, words), S.counts_table(spark, sf_dir), words, spec)
        return placed(found, [], P.collection_order(by)).withColumn("place", F.col("place") + 1)

    run.__name__ = name
    return query(with_(TOKENS, WORDS, WORD_TAGS, COLLECTION) + f"SELECT *, row_number() OVER (ORDER BY {order} word) AS place FROM col WHERE {where}")(run)


_collection_query("collection_page", "", "interest", "true", "CASE interest WHEN 'interesting' THEN 0 WHEN 'uninteresting' THEN 2 ELSE 1 END,")
_collection_query("collection_of_tag", "view", "rarest", "word IN (SELECT word FROM onn WHERE tag = 'view' OR starts_with(tag, 'view.'))", "freq_pm NULLS LAST,")
_collection_query("collection_top_global", "special:top-global", "net", "net > 0", "net DESC,")
_collection_query("collection_by_count", "click", "count", "word IN (SELECT word FROM onn WHERE tag = 'click' OR starts_with(tag, 'click.'))", "count DESC,")


@query(with_(WORDS, WORD_TAGS, DEFS) + "SELECT d.name, d.interest, d.sort, n_words, row_number() OVER (ORDER BY d.sort, d.name) AS place FROM dfs d JOIN (SELECT d.name, count(DISTINCT t.word) AS n_words FROM dfs d LEFT JOIN wtg t ON (t.tag = d.name OR starts_with(t.tag, d.name || '.')) AND rater = 'me' AND coalesce(value, 1) >= 1 GROUP BY d.name) u ON u.name = d.name")
def collection_tags(spark, sf_dir):
    return P.collection_tags(definitions(spark), word_tags(spark, sf_dir, S.words_table(spark, sf_dir)))


@query(
    with_(TOKENS, WORDS, WORD_TAGS, DEFS)
    + """, bok AS (SELECT DISTINCT source AS book, 'Book ' || source AS title FROM documents),
hit AS (SELECT DISTINCT t.book, t.word FROM wtg t JOIN dfs d ON d.interest = 'interesting' AND (t.tag = d.name OR starts_with(t.tag, d.name || '.')) WHERE coalesce(value, 1) >= 1),
own AS (SELECT * FROM hit WHERE book <> '*' UNION SELECT c.book, c.token FROM cnt c JOIN hit ON hit.book = '*' AND hit.word = c.token)
SELECT b.book, b.title, (SELECT sum(n)::BIGINT FROM cnt WHERE cnt.book = b.book) AS n_tokens, (SELECT count(*) FROM cnt WHERE cnt.book = b.book) AS n_types, (SELECT count(DISTINCT word) FROM own WHERE own.book = b.book) AS stars FROM bok b"""
)
def list_books(spark, sf_dir):
    books = S.table(spark, sf_dir, "documents").select(F.col("source").alias("book")).distinct().withColumn("title", F.concat(F.lit("Book "), "book"))
    return P.list_books(books, S.counts_table(spark, sf_dir), definitions(spark), word_tags(spark, sf_dir, S.words_table(spark, sf_dir)))


@query(
    with_(TOKENS, WORDS, WORD_TAGS, DEFS)
    + """, bok AS (SELECT DISTINCT source AS book FROM documents), hit AS (SELECT DISTINCT t.book, t.word FROM wtg t JOIN dfs d ON d.interest = 'interesting' AND (t.tag = d.name OR starts_with(t.tag, d.name || '.')) WHERE coalesce(value, 1) >= 1),
own AS (SELECT * FROM hit WHERE book <> '*' UNION SELECT c.book, c.token FROM cnt c JOIN hit ON hit.book = '*' AND hit.word = c.token)
SELECT coalesce(try_cast(substr(b.book, 4) AS BIGINT), -1) AS id, b.book, '' AS title, 'Writer of ' || b.book AS author, NULL::INT AS year, CASE WHEN length(b.book) % 2 = 0 THEN 'epub' ELSE '' END AS format, 'local' AS source, '' AS text_source,
(SELECT sum(n)::BIGINT FROM cnt WHERE cnt.book = b.book) AS n_tokens, (SELECT count(*) FROM cnt WHERE cnt.book = b.book) AS n_types, '2020-01-01T00:00:00Z' AS ingested_at, (SELECT count(DISTINCT word) FROM own WHERE own.book = b.book) AS n_selected FROM bok b"""
)
def list_books_admin(spark, sf_dir):
    none = F.lit(None).cast("string")
    books = S.table(spark, sf_dir, "documents").select(F.col("source").alias("book")).distinct().select(
        F.coalesce(F.expr("try_cast(substr(book, 4) AS bigint)"), F.lit(-1)).cast("long").alias("id"), "book", none.alias("title"), F.concat(F.lit("Writer of "), "book").alias("author"), F.lit(None).cast("int").alias("year"),
        F.when(F.length("book") % 2 == 0, "epub").alias("format"), F.lit("local").alias("source"), none.alias("text_source"), F.lit("2020-01-01T00:00:00Z").alias("ingested_at"),
    )
    return P.list_books_admin(books, S.counts_table(spark, sf_dir), definitions(spark), word_tags(spark, sf_dir, S.words_table(spark, sf_dir)))


# Of these, tags reach words that are on pages.
REJECTING = """rej AS (SELECT DISTINCT book, word FROM (SELECT p.book, p.word, CASE d.interest WHEN 'interesting' THEN 2 WHEN 'uninteresting' THEN 1 ELSE 0 END AS r FROM pag p JOIN ptg t ON t.word = p.word AND t.book IN (p.book, '*') JOIN dfs d ON t.tag = d.name OR starts_with(t.tag, d.name || '.')) GROUP BY book, word HAVING max(r) = 1)"""


@query(
    f"""WITH pag AS (FROM ({ORACLES["candidate_page"]})), {DEFS}, ptg AS (SELECT CASE WHEN place % 40 = 3 THEN '*' ELSE book END AS book, word, CASE place % 4 WHEN 0 THEN 'signup' WHEN 1 THEN 'view.a' WHEN 2 THEN 'click' ELSE 'signup.x' END AS tag FROM pag WHERE place % 3 = 0 UNION ALL SELECT book, word, 'purchase' FROM pag WHERE place % 12 = 0), {REJECTING}
SELECT book, word, place, total FROM pag WHERE (book, word) NOT IN (SELECT (book, word) FROM rej)"""
)
def visible_page(spark, sf_dir):
    """The page of each book without the words that its tags reject; every third word of a page has tags."""
    shown, p = S.written(page(spark, sf_dir)), F.col("place")
    tag = F.when(p % 4 == 0, "signup").when(p % 4 == 1, "view.a").when(p % 4 == 2, "click").otherwise("signup.x")
    own = shown.filter(p % 3 == 0).select(F.when(p % 40 == 3, "*").otherwise(F.col("book")).alias("book"), "word", tag.alias("tag"))
    own = own.unionByName(shown.filter(p % 12 == 0).select("book", "word", F.lit("purchase").alias("tag"))).withColumns({"value": F.lit(None).cast("int"), "rater": F.lit("me")})
    return P.visible_page(shown, definitions(spark), own).select("book", "word", "place", "total")


@query(f"SELECT book, word, place, row_number() OVER (PARTITION BY book ORDER BY in_book DESC, place) AS text_place FROM ({ORACLES['candidate_page']})")
def most_in_text(spark, sf_dir):
    return P.most_in_text(page(spark, sf_dir)).select("book", "word", "place", "text_place")


@query(
    with_(TOKENS, WORDS, lemma_sql(2), candidates_sql(2), USAGE, ERAS, PARTS)
    + f""", src AS (SELECT DISTINCT c.word FROM can2 c WHERE book = 'src1')
SELECT 'pos:' || pos AS option, count(DISTINCT src.word) AS n FROM src JOIN ps ON ps.word = src.word GROUP BY 1 UNION ALL SELECT category, count(DISTINCT src.word) FROM src JOIN ctg ON ctg.word = src.word GROUP BY 1
UNION ALL SELECT 'origin:uncommon', count(*) FROM src JOIN wrd ON wrd.word = src.word WHERE ety IS NOT NULL AND ety NOT IN ({WD._common(WD.scoring.FILTER_COMMON)})
UNION ALL SELECT 'origin:rare', count(*) FROM src JOIN wrd ON wrd.word = src.word WHERE ety IS NOT NULL AND ety NOT IN ({WD._common((*WD.scoring.FILTER_COMMON, *WD.scoring.FILTER_ROMANCE))})
UNION ALL SELECT 'era:' || era, count(*) FROM src JOIN era ON era.word = src.word WHERE era IS NOT NULL GROUP BY 1 UNION ALL SELECT 'status:obsolete', count(*) FROM src JOIN obs ON obs.word = src.word"""
)
def filter_options(spark, sf_dir):
    """What the candidates of a book can be filtered by, each with how many it lets through."""
    words, counts = S.words_and_counts(spark, sf_dir)
    rooted, family = S.lemmas(words, 2)
    kept = WD.scoring.candidates(counts, words, rooted, family, 2).filter("book = 'src1'")
    return P.filter_options(S.written(kept), words, S.word_pos(words), categories(words), eras(spark, sf_dir))


@query(
    with_(WORDS, PARTS)
    + f"""SELECT kind, name, n, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS place FROM (SELECT 'language' AS kind, ety AS name, count(*) AS n FROM wrd WHERE ety IS NOT NULL GROUP BY ety UNION ALL SELECT 'category', category, count(DISTINCT word) FROM ctg GROUP BY category)) WHERE place <= {P.TOP}"""
)
def dictionary_report(spark, sf_dir):
    words = S.words_table(spark, sf_dir)
    return P.dictionary_report(words, categories(words))


@query(
    with_(TOKENS, WORDS, candidates_sql(0), WORD_TAGS)
    + f""", pge AS (SELECT book, word, rank, CASE WHEN length(word) > 8 THEN 'long' ELSE 'short' END AS section FROM can0 WHERE rank <= {P.PAGE}),
tgs AS (SELECT p.book, p.word, string_agg(DISTINCT '#' || t.tag, ' ' ORDER BY '#' || t.tag) AS tags FROM pge p JOIN wtg t ON t.word = p.word AND t.book = p.book WHERE rater = 'me' AND coalesce(value, 1) >= 1 GROUP BY ALL),
lin AS (SELECT p.book, rank, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY p.book ORDER BY rank) THEN '# ' || section || chr(10) ELSE '' END || p.word || coalesce(' // ' || tags, '') AS line FROM pge p LEFT JOIN tgs ON tgs.book = p.book AND tgs.word = p.word)
SELECT book, string_agg(line, chr(10) ORDER BY rank) AS list FROM lin GROUP BY book"""
)
def tagged_list_export(spark, sf_dir):
    words, counts = S.words_and_counts(spark, sf_dir)
    top = WD.scoring.candidates(counts, words).filter(F.col("rank") <= P.PAGE).select("book", "word", F.col("rank").alias("place"))
    on = word_tags(spark, sf_dir, words).filter("rater = 'me' AND coalesce(value, 1) >= 1").groupBy("book", "word").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    section = F.when(F.length("word") > 8, "long").otherwise("short")
    return plain_list(top.join(on, ["book", "word"], "left").withColumn("section", section))


@query(
    with_(WORDS, WORD_TAGS)
    + "SELECT book, word, tag, rater, max(value) AS value, max(ts) AS ts, count(*) AS n FROM (SELECT '*' AS book, word, tag, rater, max(coalesce(value, 1)) AS value, max(ts) AS ts FROM wtg WHERE tag = 'click.a' GROUP BY word, tag, rater UNION ALL SELECT book, word, tag, rater, value, ts FROM wtg WHERE tag <> 'click.a') GROUP BY book, word, tag, rater"
)
def tag_scope_of_raters(spark, sf_dir):
    """A tag's rows collapsed to words, of each rater, with the latest time."""
    table = word_tags(spark, sf_dir, S.words_table(spark, sf_dir))
    return TG.to_word_scope(table, "click.a").groupBy("book", "word", "tag", "rater").agg(F.max("value").alias("value"), F.max("ts").alias("ts"), F.count("*").alias("n"))
