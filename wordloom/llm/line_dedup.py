"""Removal of boilerplate lines by the number of sites (sources) that carry them.

Each line hash gets a HyperLogLog sketch of its sites; sketches merge in the aggregation, before and after the
shuffle. Lines whose estimate is within BAND of the threshold get an exact distinct count. A boilerplate line stays
in the document of the smallest id that has it, so that no content is lost. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import cut, row_key

MIN_SITES, BAND, LG_K = 8, 0.15, 12


def lines_of(docs: DataFrame, id: str, text: str, site: str) -> DataFrame:
    """A row for each line that isn't empty: _id, _row, site hash, position, and two hashes of the line."""
    return (
        docs.select(F.col(id).alias("_id"), row_key(text).alias("_row"), F.when(F.col(site).isNull(), F.lit(0)).otherwise(F.xxhash64(site)).alias("_site"), F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
        .filter("_line <> ''")
        .select("_id", "_row", "_site", "_at", F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), F.col("_line")).alias("_g"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """_h, _g and _first (the smallest id) of the lines on at least min_sites distinct sites. The result is exact as
    long as sketches err by less than band (with lg_k 12, over 9 standard errors)."""
    seen = cut(
        lines.groupBy("_h", "_g")
        .agg(F.hll_sketch_agg("_site", lg_k).alias("sketch"), F.count("*").alias("n"), F.min("_id").alias("_first"))
        .filter(F.col("n") >= min_sites)
        .select("_h", "_g", "_first", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - band))
    )
    near = seen.filter(F.col("sites") <= min_sites * (1 + band))
    exact = (
        lines.select("_h", "_g", "_site").distinct().join(near.select("_h", "_g"), ["_h", "_g"], "left_semi")
        .groupBy("_h", "_g").count().filter(F.col("count") >= min_sites)
    )
    sure = seen.filter(F.col("sites") > min_sites * (1 + band)).select("_h", "_g", "_first")
    return cut(sure.unionByName(near.join(exact, ["_h", "_g"], "left_semi").select("_h", "_g", "_first")))


def remove_boilerplate(docs: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """docs with boilerplate lines taken out of its text, and n_lines and n_removed (long) after its columns.

    A line is what stands between two line feeds, compared exactly; empty lines are never boilerplate. A null text
    stays null with 0 lines, an empty one has one (empty) line. A null site is a site of its own. Where ids repeat,
    each row that has the smallest id keeps the line; rows with a null id keep it only if no row has an id. Columns
    of docs named n_lines or n_removed are replaced; names that begin with __wl_ are reserved.
    """
    lines = lines_of(docs, id, text, site)
    bad = boilerplate(lines, min_sites, band)
    gone = (
        lines.join(bad, ["_h", "_g"])
        .filter(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy("_id", "_row")
        .agg(F.collect_set("_at").alias("_gone"))
        .select(F.col("_id").alias("__wl_id"), F.col("_row").alias("__wl_same"), F.col("_gone").alias("__wl_gone"))
    )
    joined = docs.withColumn("__wl_row", row_key(text)).join(gone, F.col(id).eqNullSafe(F.col("__wl_id")) & (F.col("__wl_row") == F.col("__wl_same")), "left")
    split, names = F.split(text, "\n"), [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = joined.withColumns({
        "__wl_n": F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"),
        "__wl_kept": F.when(F.col("__wl_gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains("__wl_gone", i)), "\n")),
    })
    return joined.select(
        *[(F.col("__wl_kept") if c == text else F.col(c)).alias(c) for c in names],
        F.col("__wl_n").alias("n_lines"),
        F.coalesce(F.size("__wl_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = remove_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
bad AS (SELECT line, min(doc_id) AS f FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= {MIN_SITES}),
k AS (SELECT l.doc_id, l.pos, l.line, bad.line IS NOT NULL AND bad.f <> l.doc_id AS gone FROM l LEFT JOIN bad ON l.line = bad.line),
r AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed, string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
