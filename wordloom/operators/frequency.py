"""Histograms and corpus frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from wordloom.functions import text as T
from wordloom.operators.ranges import placed

#: Tokens that a task counts at a time.
GATHERED = 3 << 20


def histogram(docs: DataFrame, book: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """book, token, count, and example: the snippet around the token's first occurrence in the book (by order, then
    sentence). Counts and the least (order, sentence) are combined in the tasks that read the texts and again after the
    shuffle; only then does a text meet the tokens that it has first, so that it travels once."""
    docs = docs.select(F.col(book).alias("book"), F.col(order).alias("o"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))  # h tells texts of one order apart
    found = firsts(docs).groupBy("book", "token").agg(F.sum("count").alias("count"), F.min(F.struct("o", "s", "h")).alias("at"))
    key = F.struct("book", "o", "h").alias("key")  # nulls in a struct are equal
    found = found.select("book", "token", "count", "at.o", "at.s", F.coalesce("at.h", F.lit(0)).alias("h"))  # never null, as that of docs: or keys are cast and dealt anew
    of_text = found.groupBy(key).agg(F.collect_list(F.struct("token", "count", "s")).alias("firsts"))
    texts = docs.select(key, "text").dropDuplicates(["key"])
    met = of_text.join(texts, "key").select("key.book", "firsts", F.transform(T.sentences(T.normalise(F.col("text"))), lambda s: F.trim(s)).alias("sentences"))
    cut = F.transform("firsts", lambda x: F.struct(x["token"].alias("token"), x["count"].alias("count"), T.window_around(F.get("sentences", x["s"]), x["token"]).alias("example")))
    return met.select("book", F.explode(cut).alias("x")).select("book", "x.*")


def firsts(docs: DataFrame) -> DataFrame:
    """book, token, count, o, s, h: how often some texts (book, o, h, text) have a token, and the first text and sentence
    (by o, s, h) that has it. A row stands for up to GATHERED tokens that a task reads, so a token and a book may have several."""
    parts = docs.select("book", "o", "h", F.posexplode(T.sentences(T.normalise(F.col("text")))).alias("s", "sentence"))
    each = parts.select("book", "o", "s", "h", T.tokens(F.col("sentence")).alias("t"))
    kind = docs.schema
    schema = StructType([kind["book"], StructField("token", StringType()), StructField("count", LongType()), kind["o"], StructField("s", IntegerType()), kind["h"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch["t"].flatten())
            if n >= GATHERED:
                yield _firsts(held, schema.names)
                held, n = [], 0
        if n:
            yield _firsts(held, schema.names)

    return each.mapInArrow(run, schema)


def _firsts(batches: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    """Rows of firsts() from sentences (book, o, s, h, t)."""
    rows = pa.Table.from_batches(batches)
    rows = rows.take(pc.sort_indices(rows, [("o", "ascending"), ("s", "ascending"), ("h", "ascending")], null_placement="at_start")).combine_chunks().to_batches()[0]
    row = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(rows["t"]), 0).to_numpy(zero_copy_only=False))
    tokens, books = rows["t"].flatten(), pc.dictionary_encode(rows["book"], null_encoding="encode")
    key = tokens.dictionary_encode().indices.to_numpy().astype(np.int64) * len(books.dictionary) + books.indices.to_numpy()[row]
    by_key = np.argsort(key, kind="stable")  # of a key, the first in order stays first
    key = key[by_key]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    at, count = by_key[starts], np.diff(np.append(starts, len(key)))
    own = rows.take(pa.array(row[at]))
    return pa.record_batch([own["book"], tokens.take(pa.array(at)), pa.array(count, pa.int64()), own["o"], own["s"], own["h"]], names)


def token_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, token, count: the histogram without examples."""
    return docs.select(*keys, F.explode(T.tokens(T.plain_apostrophes(F.col(text)))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("count"))


def case_folded(surface: DataFrame, token: str = "token", count: Column | None = None, shape: str = "^[A-Za-z]+(?:['-][A-Za-z]+)*$") -> DataFrame:
    """token (lower case), count, count_lc (written all lower case), cap_ratio. Tokens of other shapes and rows without
    a count are left out."""
    n = F.lit(1).cast("long") if count is None else count
    rows = surface.filter(F.col(token).rlike(shape)).select(F.col(token).alias("t"), n.alias("n")).filter("n IS NOT NULL")
    found = rows.groupBy(F.lower("t").alias("token")).agg(F.sum("n").alias("count"), F.sum(F.when(F.col("t") == F.lower("t"), F.col("n")).otherwise(0)).alias("count_lc"))
    return found.withColumn("cap_ratio", (F.col("count") - F.col("count_lc")) / F.col("count"))


def positional_rank(df: DataFrame, count: str = "count", name: str = "token", rank: str = "rank") -> DataFrame:
    """df with the position (from 1) of each row by count descending, then name; written. Rows are dealt out by ranges of
    that order, so no task has all words of one count."""
    return placed(df, [], [F.col(count).desc(), F.col(name)], rank).withColumn(rank, F.col(rank) + 1)


def per_million(counts: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """counts with pm and pm_lc. total: one row, total; by default the sum of the counts."""
    total = counts.agg(F.sum("count").alias("total")) if total is None else total
    pm = F.col("count") * 1e6 / F.col("total")
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("pm", pm).withColumn("pm_lc", F.col("pm") * F.col("count_lc") / F.col("count")).drop("total")


def weirdness(general: DataFrame, special: DataFrame) -> DataFrame:
    """token, pm, fic_pm and their smoothed ratio for tokens of both corpora."""
    return general.select("token", "pm").join(special.select("token", F.col("pm").alias("fic_pm")), "token").withColumn("weirdness", (F.col("fic_pm") + 1) / (F.col("pm") + 1))


def merge_frequencies(words: DataFrame, freq: DataFrame, prefix: str) -> DataFrame:
    """words with count, rank and pm columns of freq under a prefix, and in_<prefix> for words it has."""
    renamed = freq.select(F.col("token").alias("word"), *[F.col(c).alias(f"{prefix}_{c}") for c in freq.columns if c != "token"], F.lit(True).alias(f"in_{prefix}"))
    return words.join(renamed, "word", "left").withColumn(f"in_{prefix}", F.coalesce(f"in_{prefix}", F.lit(False)))
