"""A scored library on disk that follows changes of books and of the dictionary without a full run.

Counts and candidates are tables with a folder for each book. A change of some books says which (book, token) counts
differ; a change of the dictionary, which words, roots and families differ. Both lead to the (book, root) pairs whose
score may be another one. Only those are scored again, only their books' ranks are counted anew, and only these books'
folders are written.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import frequency, scoring, trajectory
from wordloom.sources.stores import read_parts, replace_parts, write_parts
from wordloom.sources.written import written


class Dictionary(NamedTuple):
    """words (word and its features), rooted (word, root) and family (root, pm_lc) of a level; the last two may be None."""

    words: DataFrame
    rooted: DataFrame | None = None
    family: DataFrame | None = None


COUNTS, CANDIDATES = ("token",), ("rank",)


def write_library(path: str, counts: DataFrame, known: Dictionary, level: int) -> None:
    """counts (book, token, count) and the candidates of all books, under path. Rows without a book are left out."""
    counts = counts.filter("book IS NOT NULL")
    write_parts(counts, f"{path}/counts", "book", COUNTS)
    write_parts(scoring.candidates(counts, known.words, known.rooted, known.family, level), f"{path}/candidates", "book", CANDIDATES)


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}")


def differing(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the rows that only one of two tables has, or that have other values in it. Values are compared by hash."""
    values = sorted(set(after.columns) & set(before.columns) - set(keys))
    old, new = (x.select(*keys, F.xxhash64(F.lit(1), *values).alias(c)) for x, c in ((before, "_old"), (after, "_new")))
    return old.join(new, keys, "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys)


def rooted_tokens(rows: DataFrame, known: Dictionary) -> DataFrame:
    """rows (token, ...) with word: the token's root, or itself."""
    if known.rooted is None:
        return rows.withColumn("word", F.col("token"))
    return rows.join(known.rooted.select(F.col("word").alias("token"), "root"), "token", "left").withColumn("word", F.coalesce("root", "token")).drop("root")


def rescore(spark: SparkSession, path: str, pairs: DataFrame, books: list[str], known: Dictionary, level: int) -> None:
    """The candidates of some books with the scores of pairs (book, word), all in these books, made anew."""
    pairs = written(pairs.distinct())
    counts = read_parts(spark, f"{path}/counts", stored(spark, path, "counts").schema, "book", books)
    tokens = rooted_tokens(counts, known).join(pairs, ["book", "word"], "left_semi").select("book", "token", "count")
    fresh = scoring.scored(tokens, known.words, known.rooted, known.family, level)
    schema = stored(spark, path, "candidates").schema
    others = read_parts(spark, f"{path}/candidates", schema, "book", books).join(pairs, ["book", "word"], "left_anti")
    replace_parts(scoring.ranked(others.drop("rank").unionByName(fresh)), f"{path}/candidates", "book", CANDIDATES, books)


def refresh_books(spark: SparkSession, path: str, texts: DataFrame, gone: list[str], known: Dictionary, level: int) -> list[str]:
    """The library after some books' texts (book, text) came in or changed and some books went. The names of the books of
    one change come to the driver; their texts don't. A text of null has no words, and so has a book without texts."""
    books = sorted({r[0] for r in texts.filter("book IS NOT NULL").select("book").distinct().collect()} | set(gone))
    if not books:
        return books
    new = written(frequency.token_counts(texts.filter("book IS NOT NULL"), ["book"]))
    old = read_parts(spark, f"{path}/counts", stored(spark, path, "counts").schema, "book", books)
    changed = written(differing(old, new, ["book", "token"]))
    replace_parts(new, f"{path}/counts", "book", COUNTS, books)
    rescore(spark, path, rooted_tokens(changed, known).select("book", "word"), books, known, level)
    return books


def affected_roots(before: Dictionary, after: Dictionary) -> DataFrame:
    """word: the roots whose own features, family or members differ between two dictionaries."""
    own = differing(before.words, after.words, ["word"])
    found = [own]
    moved = own.select(F.col("word").alias("token"))
    if after.rooted is not None:
        moved = moved.unionByName(differing(before.rooted, after.rooted, ["word"]).select(F.col("word").alias("token")))
    found += [rooted_tokens(moved, x).select("word") for x in (before, after)]
    if after.family is not None:
        found.append(differing(before.family, after.family, ["root"]).select(F.col("root").alias("word")))
    return reduce(DataFrame.unionByName, found).distinct()


def refresh_words(spark: SparkSession, path: str, before: Dictionary, after: Dictionary, level: int) -> list[str]:
    """The library after a change of the dictionary. Which books have an affected word is asked of the counts' book and
    token columns alone; only the books that do are scored and written."""
    roots = written(affected_roots(before, after))
    held = stored(spark, path, "counts").select("book", "token")
    pairs = reduce(DataFrame.unionByName, [rooted_tokens(held, x).join(roots, "word", "left_semi").select("book", "word") for x in (before, after)])
    pairs = written(pairs.distinct())
    books = sorted(r[0] for r in pairs.select("book").distinct().collect())  # names of books
    if books:
        rescore(spark, path, pairs, books, after, level)
    return books


def refresh_trajectories(held: DataFrame, usage: DataFrame, gated: DataFrame) -> DataFrame:
    """held (word, decade, pm) for the words worth charting (gated: word): those it has stay as they are, those it hasn't
    are made of usage (word, year, count), whose decades' totals are of all words; others go."""
    missing = gated.join(held.select("word").distinct(), "word", "left_anti")
    more = trajectory.trajectories(usage).join(missing, "word", "left_semi")
    return held.join(gated, "word", "left_semi").unionByName(more.select(*held.columns))
