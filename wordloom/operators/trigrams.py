"""Search for parts of names by an index of three-character runs (grams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.stores import PARTS, ranges_for, read_ranges, write_ranges

GRAM, RAREST = 3, 3
#: Stands after a name's end, so that its last characters begin grams too; no name has it.
END = "\x00"
#: Queries whose hits stand in one long.
BITS = 63


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of `size` characters from each character of a lower-cased text on; those at its end have END."""
    padded = F.concat(text, F.lit(END * (size - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.substring(padded, k, F.lit(size))))


def texts_of(names: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """id, t: the different lower-cased texts that each row has in some columns; none that are null or empty."""
    texts = F.array_distinct(F.array_compact(F.array(*[F.lower(c) for c in columns])))
    return names.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.explode(texts).alias("t")).filter("length(t) > 0")


def write_trigrams(names: DataFrame, path: str, id: str, columns: list[str], parts: int = PARTS) -> None:
    """The index of some text columns under path: the different texts (t, k: a hash), postings (gram, k) and sizes (gram, n),
    the last two by ranges of grams. A text is posted once, however many names have it. Null and empty texts have no
    grams. A gram that very many texts have lies in several ranges."""
    texts_of(names, id, columns).select("t").distinct().withColumn("k", F.xxhash64("t")).write.mode("overwrite").parquet(f"{path}/texts")
    posts = _texts(names.sparkSession, path).select(F.explode(grams(F.col("t"))).alias("gram"), "k")
    write_ranges(posts, f"{path}/postings", "gram", ("k",), parts)
    write_ranges(posts.groupBy("gram").agg(F.count("*").alias("n")), f"{path}/sizes", "gram", (), parts)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t string, k long").parquet(f"{path}/texts")


def wanted(spark: SparkSession, path: str, queries: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """(the rarest grams of each query that has whole ones, the queries that are shorter), lower-cased. A query with a
    gram that no name has finds nothing and is left out."""
    low = sorted({q.lower() for q in queries if q})
    short = [q for q in low if len(q) < GRAM]
    each = {q: sorted({q[k : k + GRAM] for k in range(len(q) - GRAM + 1)}) for q in low if len(q) >= GRAM}
    asked = sorted({g for x in each.values() for g in x})
    sizes = {r["gram"]: r["n"] for r in read_ranges(spark, f"{path}/sizes", "gram", asked).collect()} if asked else {}
    return {q: sorted(x, key=lambda g: (sizes[g], g))[:RAREST] for q, x in each.items() if all(g in sizes for g in x)}, short


def matching_texts(spark: SparkSession, path: str, queries: list[str]) -> tuple[DataFrame, DataFrame]:
    """(t, word, bits: the queries that each text of the index has, as bits of numbered words; query, word, bit: the queries).

    A text meets a query by the query's rarest gram, if all its RAREST ones post the text; a query of one or two
    characters by any gram that begins with it, as every such part of a text begins one. What met is verified on the text,
    which tells texts of one hash apart too."""
    long, short = wanted(spark, path, queries)
    some = sorted([(q, x[0], x) for q, x in long.items()] + [(q, q, []) for q in short])
    asked = spark.createDataFrame([(*row, n // BITS, 1 << n % BITS) for n, row in enumerate(some)], "query string, key string, rarest array<string>, word int, bit long")
    posts = read_ranges(spark, f"{path}/postings", "gram", sorted({g for x in long.values() for g in x}), short)
    met = posts.groupBy("k").agg(F.collect_set("gram").alias("grams")).join(_texts(spark, path), "k")
    keys = F.array_distinct(F.flatten(F.transform("grams", lambda g: F.array(*[F.substring(g, 1, n) for n in range(1, GRAM + 1)]))))
    each = met.select("t", "grams", F.explode(keys).alias("key")).join(F.broadcast(asked), "key")
    found = each.filter(F.forall("rarest", lambda g: F.array_contains(F.col("grams"), g)) & F.contains("t", "query"))
    return found.groupBy("t", "word").agg(F.bit_or("bit").alias("bits")), asked.select("query", "word", "bit")


def search_names(spark: SparkSession, path: str, names: DataFrame, id: str, columns: list[str], queries: list[str]) -> DataFrame:
    """query (lower case), id: the names that have a query in one of the columns, in any case; as a scan would find them.

    Queries meet the different texts of the index, and names meet the texts that have some. What a name has found in
    several texts is joined as bits, BITS queries to a word, so a row for each query and name is made once, at the end.
    An empty query is no query. queries is what a user typed: a list of bounded length."""
    found, asked = matching_texts(spark, path, queries)
    own = texts_of(names, id, columns).join(found, "t").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    asked = F.broadcast(asked.withColumnRenamed("word", "_word"))
    return own.join(asked, (F.col("word") == F.col("_word")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0)).select("query", "id")


def rows_read(spark: SparkSession, path: str, queries: list[str]) -> tuple[int, int]:
    """(postings in the ranges that a search reads, all postings)."""
    long, short = wanted(spark, path, queries)
    read = ranges_for(spark, f"{path}/postings", sorted({g for x in long.values() for g in x}), short)
    return sum(n for _, n in read), spark.read.parquet(f"{path}/postings/ranges").agg(F.sum("n")).first()[0] or 0
