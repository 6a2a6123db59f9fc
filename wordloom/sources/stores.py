"""Tables on disk of which a reader takes only the parts it needs: by ranges of a key, or by a column's values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wordloom.sources.written import written

PARTS = 64


def write_ranges(df: DataFrame, path: str, key: str, order: tuple[str, ...] = (), parts: int = PARTS) -> None:
    """df as Parquet under path, dealt by ranges of (key, order), a folder for each, sorted within; what is there is replaced.

    A key of very many rows has several ranges, if order tells its rows apart. Beside the rows stands a table with a row
    for each range: its first and last key, and its number of rows. Rows without a key are left out.
    """
    keys = [key, *order]
    dealt = df.filter(F.col(key).isNotNull()).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", *keys).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(f"{_ddl(dealt)}").parquet(f"{path}/rows")
    rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def ranges_for(spark: SparkSession, path: str, values: list[str] = (), prefixes: list[str] = ()) -> list[tuple[int, int]]:
    """(part, rows) of the ranges that may hold some of the keys, or keys that begin with some prefix."""
    first, last = F.col("first"), F.col("last")
    wanted = []
    if values:
        wanted.append(_between(first, last, sorted(set(values))))
    for n, some in _by_length(prefixes):
        wanted.append(_between(F.substring(first, 1, n), F.substring(last, 1, n), some))
    found = spark.read.parquet(f"{path}/ranges")  # a row a range
    return [tuple(r) for r in found.filter(reduce(or_, wanted)).select("part", "n").collect()] if wanted else []


def _between(first: Column, last: Column, values: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, values)), lambda v: (first <= v) & (last >= v))


def _by_length(prefixes: list[str]) -> list[tuple[int, list[str]]]:
    return [(n, sorted({p for p in prefixes if len(p) == n})) for n in sorted({len(p) for p in prefixes})]


def read_ranges(spark: SparkSession, path: str, key: str, values: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """The rows of some keys, or of keys that begin with some prefix, read from their ranges alone."""
    parts = [p for p, _ in ranges_for(spark, path, values, prefixes)]
    own = [F.col(key).isin(*values)] * bool(values) + [F.substring(key, 1, n).isin(*some) for n, some in _by_length(prefixes)]
    rows = spark.read.parquet(f"{path}/rows")
    return rows.filter(F.col("part").isin(*parts)).filter(reduce(or_, own, F.lit(False))).drop("part")


def write_parts(df: DataFrame, path: str, column: str, order: tuple[str, ...]) -> None:
    """df as Parquet under path, a folder for each value of column; what is there is replaced. Tasks write ranges of
    (column, order), so a value of very many rows is written by several."""
    df.repartitionByRange(column, *order).sortWithinPartitions(column, *order).write.mode("overwrite").partitionBy(column).parquet(path)


def read_parts(spark: SparkSession, path: str, schema: StructType, column: str, values: list[str]) -> DataFrame:
    """The parts that `values` name. schema: that of all, for a table that may have no part yet."""
    return spark.read.schema(schema).parquet(path).filter(F.col(column).isin(*values))


def replace_parts(df: DataFrame, path: str, column: str, order: tuple[str, ...], values: list[str]) -> None:
    """The parts of the table under path (of write_parts) that `values` name, replaced by df's rows.

    df may come from the table itself: it is written elsewhere before. The other parts are neither read nor touched;
    of values without rows in df no part remains."""
    spark, fresh = df.sparkSession, written(df.filter(F.col(column).isin(*values)))
    fresh.repartitionByRange(column, *order).sortWithinPartitions(column, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    left = {r[0] for r in fresh.select(column).distinct().collect()}  # as many as values at most
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for value in values:
        if value not in left:
            folder = jvm.org.apache.hadoop.fs.Path(path, f"{column}={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}")
            folder.getFileSystem(conf).delete(folder, True)
