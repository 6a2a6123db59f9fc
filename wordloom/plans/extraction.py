"""Queries over books' surroundings: pages, segments, sentences, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import segments as X
from wordloom.plans import standin as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def html_text(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", X.html_text("html").alias("text"))


NOTICE = "Title: Book {0}\nAuthor: A. Writer\nRelease date: May 1, 1999 [eBook #12]\n*** START OF THE PROJECT GUTENBERG EBOOK B ***\nProduced by Someone\n\nCONTENTS\n\nChapter 1\nChapter 2\n\n"
FOOTER = "\n\nTranscriber's Notes: none\n*** END OF THE PROJECT GUTENBERG EBOOK B ***\nlegal"


def _books(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    framed = F.concat(F.lit(NOTICE.partition("{0}")[0]), F.col("doc_id").cast("string"), F.lit(NOTICE.partition("{0}")[2]), "text", F.lit(FOOTER))
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, framed).otherwise(F.col("text")).alias("text"))


@query()
def segments(spark, sf_dir):
    found = _books(spark, sf_dir).select("doc_id", X.segments("text").alias("segments"))
    return X.segment_totals(found, ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Book ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN 'A. Writer' END AS author, CASE WHEN doc_id % 3 = 0 THEN '12' END AS source_id, CASE WHEN doc_id % 3 = 0 THEN 1999 END AS year FROM documents")
def header_fields(spark, sf_dir):
    """The fields of all documents; those without a header have nulls."""
    return _books(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in X.header_fields(F.col("text")).items()])


@query(r"SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Produced by Someone' || chr(10) || chr(10) || 'CONTENTS' || chr(10) || chr(10) || 'Chapter 1' || chr(10) || 'Chapter 2' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Transcriber''s Notes: none' || chr(10) ELSE text END) AS body_sha256 FROM documents")
def marked_body(spark, sf_dir):
    """What stands between the marks; documents without marks stay as they are."""
    return _books(spark, sf_dir).select("doc_id", F.sha2(X.strip_marks(F.col("text")), 256).alias("body_sha256"))


@query()
def text_diff(spark, sf_dir):
    turns = S.table(spark, sf_dir, "conversations")
    pairs = turns.alias("a").join(turns.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    diff = pairs.select("a.conv_id", "a.turn", X.word_diff("a.text", "b.text").alias("d"))
    return diff.select("conv_id", "turn", F.round("d.ratio", 6).alias("ratio"), F.size("d.ops").alias("n_ops"))


@query(
    """WITH p AS (SELECT conv_id AS book, turn AS page, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) >= 15 AS t FROM conversations), c AS (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY book ORDER BY page) THEN 0 ELSE 1 END AS g FROM p),
r AS (SELECT *, sum(g) OVER (PARTITION BY book ORDER BY page)::BIGINT AS run FROM c) SELECT book, run, t AS has_text, min(page) AS first_page, max(page) AS last_page FROM r GROUP BY ALL"""
)
def page_runs(spark, sf_dir):
    pages = S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    return X.page_runs(pages)


@query(r"SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM conversations")
def turn_sentences(spark, sf_dir):
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query("WITH s AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60] AS base FROM part), b AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'same' ELSE base END AS base FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM b) SELECT id, CASE WHEN k > 1 THEN base || '-' || k ELSE base END AS slug FROM n")
def unique_slugs(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "same").otherwise(T.slugify(F.col("p_name"))).alias("slug"))
    return X.unique_slugs(rows, order="id")
