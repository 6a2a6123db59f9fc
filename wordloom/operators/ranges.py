"""Positions in sorted groups and dense numbers, without a task that holds a whole group or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.sources.written import written

#: monotonically_increasing_id() has the partition's number above this bit and the row's place in it below.
ROW_BITS = 33


def placed(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with `name` (long): the position, from 0, of each row among the rows that agree on `by`, in `order`.

    Rows are dealt out by ranges of (by, order), so that a group of any size lies in many tasks; each task numbers its
    own range, and what a group has in earlier ranges is a sum over one row for each range. Rows that tie in `order`
    come in order of a hash of the whole row, so that reruns agree; repeated rows are told apart by where they are read,
    so that no number of them makes one range. Nulls in `by` are a group like others; an empty table gives no rows.
    The result is written; names of df that begin with __wl_ are reserved.
    """
    kinds = dict(df.dtypes)
    hashed = [F.col(f"`{c}`") for c in df.columns if "map<" not in kinds[c]]
    rows = df.withColumns({
        "__wl_g": F.struct(*[F.col(f"`{b}`") for b in by]) if by else F.lit(0), "__wl_tie": F.xxhash64(*hashed), "__wl_read": F.monotonically_increasing_id(),
    })
    keys = [*[F.col(f"`{b}`") for b in by], *order, F.col("__wl_tie"), F.col("__wl_read")]
    ranged = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__wl_tie", "__wl_read").withColumn("__wl_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__wl_range", F.shiftright("__wl_m", ROW_BITS))
    runs = ranged.groupBy("__wl_g", "__wl_range").agg(F.min("__wl_m").alias("__wl_first"), F.count("*").alias("__wl_n"))
    before = F.sum("__wl_n").over(W.partitionBy("__wl_g").orderBy("__wl_range").rowsBetween(W.unboundedPreceding, -1))
    starts = runs.select("__wl_g", "__wl_range", (F.coalesce(before, F.lit(0)) - F.col("__wl_first")).alias("__wl_start"))
    out = ranged.join(starts, ["__wl_g", "__wl_range"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("__wl_m") + F.col("__wl_start")).alias(name))


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """df with `name` (long): its rows numbered from 0 without gaps, in no order of note. The result is written."""
    rows = written(df.withColumn("__wl_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("__wl_range", F.shiftright("__wl_m", ROW_BITS))
    before = F.sum("__wl_n").over(W.orderBy("__wl_range").rowsBetween(W.unboundedPreceding, -1))
    runs = rows.groupBy("__wl_range").agg(F.count("*").alias("__wl_n"))
    starts = runs.select("__wl_range", F.coalesce(before, F.lit(0)).alias("__wl_start"))
    # One row for each partition of what was written.
    out = rows.join(F.broadcast(starts), "__wl_range")
    place = F.col("__wl_m").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (place + F.col("__wl_start")).alias(name))
