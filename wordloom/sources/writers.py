"""Writers: replacing the rows of some keys, appending to the log, lists and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df by keys; the folders of keys that df has are replaced, others stay."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_log(spark: SparkSession, path: str, source: str, detail: str, rows: int) -> None:
    """Appends a line to the ingest log."""
    line = spark.range(1).select(F.lit(source).alias("source"), F.lit(detail).alias("detail"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("ts"))
    line.write.mode("append").parquet(path)


def plain_list(items: DataFrame, separator: str = "\n") -> DataFrame:
    """book, list: the words of each book (book, place, word, and where wanted forms, tags (an array of 'tag' or
    'tag:level') and section) as text. Words are parted by a line end, a space or a comma; forms come as word a/b,
    tags as // #tag, and sections, in lists by lines alone, as a line before their first word."""
    has = set(items.columns)
    line = F.col("word")
    if "forms" in has:
        line = F.when(F.coalesce(F.contains("forms", F.lit("/")), F.lit(False)), F.concat_ws(" ", line, "forms")).otherwise(line)
    if "tags" in has:
        line = F.when(F.size("tags") > 0, F.concat(line, F.lit(" // "), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " "))).otherwise(line)
    if "section" in has and separator == "\n":
        fresh = ~F.lag("section").over(W.partitionBy("book").orderBy("place")).eqNullSafe(F.col("section"))
        line = F.when(fresh, F.concat(F.lit("# "), F.col("section"), F.lit("\n"), line)).otherwise(line)
    rows = items.select("book", "place", line.alias("line"))
    return rows.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), {",": ", "}.get(separator, separator)).alias("list"))  # a page's words


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
