"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut, join_anew


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for each node of edges (a, b), long. Nodes without an edge to
    another node don't appear. Each round is written to the shared folder; a node of very many edges is split."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while before != (mark := _mark(now)):
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = join_anew(both, low, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_anew(large, low, ["a"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; ends when every edge leads to its component."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())
