"""An inverted index of words: where each stands, what it counts, its family. A word's page reads a few ranges of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from wordloom.functions import text as X
from wordloom.operators.pages import EXAMPLE_CHARS, EXAMPLES, FAMILY, MOST_EXAMPLES
from wordloom.sources.stores import PARTS, read_ranges, write_ranges
from wordloom.sources.written import written

#: Places that a task puts together at a time, and those of a row.
GATHERED, MOST_PLACES = 3 << 20, 4096


def sentences_of(docs: DataFrame, order: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """o, i, s (and more): the sentences of each text, in order; h tells texts of one o apart."""
    parts = docs.select(*more, F.col(order).alias("o"), F.posexplode(X.sentences(X.normalise(F.col(text)))).alias("i", "s"))
    return parts.withColumn("h", F.xxhash64("s"))


def places(docs: DataFrame, book: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """token, book, first, o, i, h: where tokens of a book stand: in the i-th sentence of text o.
    o, i and h are arrays, a value for each sentence, put together from the texts that a task reads, so that a token and a
    book's name don't travel with each place; first is the first of o. h tells the texts of one o apart; where a book has one
    text of an o, which needs no telling, it is 0. A row has MOST_PLACES places at most."""
    docs = docs.select(F.col(book).alias("book"), F.col(order).alias("o"), F.col(text).alias("text"))
    again = written(docs.groupBy(F.col("book").alias("_b"), F.col("o").alias("_o")).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    marked = docs.join(again.withColumn("_again", F.lit(True)), F.col("book").eqNullSafe(F.col("_b")) & F.col("o").eqNullSafe(F.col("_o")), "left")
    found = sentences_of(marked, "o", "text", "book", "_again").withColumn("h", F.when(F.col("_again"), F.col("h")).otherwise(0))
    each = found.select("book", "o", "i", "h", F.array_distinct(X.tokens(F.col("s"))).alias("t"))
    kind = docs.schema
    one = StructType([StructField("token", StringType()), StructField("book", kind["book"].dataType), StructField("first", kind["o"].dataType)])
    many = [("o", kind["o"].dataType), ("i", IntegerType()), ("h", LongType())]
    schema = StructType([*one.fields, *[StructField(n, ArrayType(t)) for n, t in many]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch["t"].flatten())
            if n >= GATHERED:
                yield _by_token(held, schema.names)
                held, n = [], 0
        if n:
            yield _by_token(held, schema.names)

    return each.mapInArrow(run, schema)


def _by_token(batches: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    """Rows of places() from sentences (book, o, i, h, t)."""
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    row = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(rows["t"]), 0).to_numpy(zero_copy_only=False))
    tokens, books = rows["t"].flatten(), pc.dictionary_encode(rows["book"], null_encoding="encode")
    key = tokens.dictionary_encode().indices.to_numpy().astype(np.int64) * len(books.dictionary) + books.indices.to_numpy()[row]
    order = np.argsort(key, kind="stable")
    key = key[order]
    place = np.arange(len(key)) - np.searchsorted(key, key)
    starts = np.flatnonzero(place % MOST_PLACES == 0)
    at, first = pa.array(row[order]), pa.array(row[order][starts])
    offsets = pa.array(np.append(starts, len(key)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, rows[c].take(at)) for c in ("o", "i", "h")]
    return pa.record_batch([tokens.take(pa.array(order[starts])), rows["book"].take(first), rows["o"].take(first), *lists], names)


def write_index(path: str, docs: DataFrame, words: DataFrame, counts: DataFrame, rooted: DataFrame, parts: int = PARTS, **columns: str) -> None:
    """The index under path: places by token, words and roots by word, counts by token, members by root."""
    write_ranges(places(docs, **columns), f"{path}/places", "token", ("book", "first"), parts)
    write_ranges(words, f"{path}/words", "word", (), parts)
    write_ranges(counts, f"{path}/counts", "token", ("book",), parts)
    write_ranges(rooted, f"{path}/roots", "word", (), parts)
    write_ranges(rooted, f"{path}/members", "root", ("word",), parts)


def family_of(spark: SparkSession, path: str, word: str) -> list[str]:
    """A word and all that merges into it, on the driver: a family has some dozens of words."""
    return sorted({word, *(r[0] for r in read_ranges(spark, f"{path}/members", "root", [word]).select("word").collect())})


def word_rows(spark: SparkSession, path: str, word: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, counts, rooted) with all that word_detail() asks for about a word: the word, its family and its root."""
    family = family_of(spark, path, word)
    own = read_ranges(spark, f"{path}/roots", "word", [word])
    asked = sorted({*family, *(r[0] for r in own.select("root").collect())})
    rooted = own.unionByName(read_ranges(spark, f"{path}/members", "root", [word])).distinct()
    return read_ranges(spark, f"{path}/words", "word", asked), read_ranges(spark, f"{path}/counts", "token", family), rooted


def indexed_forms(spark: SparkSession, path: str, book: str, word: str, most: int = FAMILY) -> list[str]:
    """The book's most frequent forms that merge into a word, and the word itself."""
    found = read_ranges(spark, f"{path}/counts", "token", family_of(spark, path, word)).filter(F.col("book") == book)
    return sorted({word, *(r[0] for r in found.orderBy(F.col("count").desc(), "token").limit(most).select("token").collect())})


def indexed_examples(spark: SparkSession, path: str, docs: DataFrame, book: str, forms: list[str], limit: int = EXAMPLES, source: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """place, total, form, text: as word_examples() gives them, from the index. docs is read for the texts of the `limit`
    examples alone: their order numbers stand as values in the scan's filter.

    A word that the book doesn't have gives no rows; so does a book that isn't there."""
    limit = max(1, min(limit, MOST_EXAMPLES))
    hits = read_ranges(spark, f"{path}/places", "token", forms).filter(F.col("book") == book)
    hits = hits.select("token", F.explode(F.arrays_zip("o", "i", "h")).alias("p")).select("p.*")
    first = hits.distinct()
    total = first.agg(F.count("*").alias("total")).withColumn("_j", F.lit(1))
    top = [tuple(r) for r in first.orderBy("o", "i").limit(limit).select("o", "i", "h").collect()]  # `limit` rows
    chosen = spark.createDataFrame(top, f"o {hits.schema['o'].dataType.simpleString()}, i int, h long")
    own = docs.filter(F.col(source) == book).filter(F.col(order).isin(*sorted({t[0] for t in top})))
    met = sentences_of(own, order, text).join(F.broadcast(chosen.withColumnRenamed("h", "_h")), ["o", "i"]).filter("_h = 0 OR _h = h").dropDuplicates(["o", "i", "h"])
    low, has = F.lower("s"), X.tokens(F.col("s"))
    of = [F.when(F.array_contains(has, form), F.struct(F.instr(low, form).alias("at"), F.lit(form).alias("form"))) for form in forms]  # FAMILY + 1 at most
    met = met.withColumn("form", F.array_min(F.array_compact(F.array(*of)))["form"]).withColumn("_j", F.lit(1)).join(total, "_j")
    place = F.row_number().over(W.orderBy("o", "i")).cast("long")  # `limit` rows
    return met.select(place.alias("place"), "total", "form", X.window_around(F.trim("s"), F.col("form"), EXAMPLE_CHARS).alias("text"))
