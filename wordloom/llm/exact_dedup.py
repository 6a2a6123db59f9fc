"""Exact deduplication by content-defined chunk recipes.

A text is cut at places that its own content names; a chunk's identifier is its 64-bit hash with its length, and a
text's recipe the ordered list of identifiers. Identifiers are verified: were one identifier to stand for two chunks
(told by SHA-256), recipes would be built of SHA-256 values instead. Then only recipes are shuffled and compared,
about 16 bytes for each chunk, so no long text moves. Only DataFrame functions; no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import ascii_lower, cut

#: Chunks end after the first sentence mark or line end beyond `least` characters, at `most` characters otherwise.
LEAST, MOST = 512, 8192


def chunks(text, least: int = LEAST, most: int = MOST):
    """The content-defined chunks of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?:[.,;!?]\s|\n)|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, text: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """docs without its text, with text_sha256 and recipe (h, n, sha of each chunk) of the text with A-Z lower-cased;
    null counts as empty, and an empty text has an empty recipe. Written to the shared folder."""
    kept = [c for c in docs.columns if c != text]
    folded = docs.select(*kept, ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_folded"))
    return cut(
        folded.select(
            *kept,
            F.sha2("_folded", 256).alias("text_sha256"),
            F.transform(chunks(F.col("_folded"), least, most), lambda c: F.struct(F.xxhash64(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("recipe"),
        )
    )


def ambiguous(found: DataFrame) -> DataFrame:
    """The identifiers in recipes that stand for more than one chunk."""
    each = found.select(F.explode("recipe").alias("c")).select("c.h", "c.n", "c.sha")
    return each.groupBy("h", "n").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a <> b")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row for each row of docs: id, keep_id (the largest id among equal texts), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Rows that share a group's largest id
    are all kept, being one document written twice; a null id counts as smaller than any other, and a group of null
    ids alone has keep_id null and keeps its rows. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    found = recipes(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text", least, most)
    if ambiguous(found).isEmpty():
        same = F.transform("recipe", lambda c: F.struct(c["h"], c["n"]))
    else:
        same = F.transform("recipe", lambda c: c["sha"])
    rows = found.select("_id", "text_sha256", same.alias("recipe"))
    groups = rows.groupBy("recipe").agg(F.max("_id").alias("keep_id"), F.count("*").alias("size")).filter("size > 1")
    # The second key makes Spark deal both sides anew for the join, so that it can split a group of very many rows.
    rows, groups = (x.withColumn("_k", F.xxhash64("recipe")) for x in (rows, groups))
    joined = rows.join(groups, ["_k", "recipe"], "left")
    keep = F.when(F.col("size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("_id").alias(id),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
