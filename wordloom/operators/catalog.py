"""Catalogue search: filters, orders, facets, what is imported already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(query: str) -> Column:
    """Title or author contain query, in any case."""
    q = query.lower()
    return F.lower("title").contains(q) | F.lower("author").contains(q)


def has_subject(subject: str, mode: str = "entry") -> Column:
    """A whole entry of the subject list, or any part of it with mode 'substring'; in any case."""
    if mode == "substring":
        return F.lower("subjects").contains(subject.lower())
    return F.array_contains(F.split(F.lower("subjects"), r";\s*"), subject.lower())


def relevance(query: str) -> Column:
    """0 exact title, 1 it begins the title, 2 it is in the title, 3 elsewhere."""
    title, q = F.lower("title"), query.lower()
    return F.when(title == q, 0).when(title.startswith(q), 1).when(title.contains(q), 2).otherwise(3)


def search(catalog: DataFrame, query: str = "", source: str | None = None, subject: str | None = None, subject_mode: str = "entry", sort: str = "relevance", most: int = 50, skip: int = 0) -> DataFrame:
    """A page of the catalogue; unknown values come last, ties go by source_id."""
    found = catalog.filter(matches(query)) if query else catalog
    found = found.filter(F.col("source") == source) if source else found
    found = found.filter(has_subject(subject, subject_mode)) if subject else found
    key = {"relevance": [relevance(query)] if query else [], "title": [], "author": [F.lower("author").asc_nulls_last()], "year": [F.col("year").desc_nulls_last()], "words": [F.col("n_words").desc_nulls_last()]}[sort]
    return found.orderBy(*key, F.lower("title").asc_nulls_last(), "source_id").offset(skip).limit(most)


def subjects(catalog: DataFrame, most: int = 120, longest: int = 60) -> DataFrame:
    """subject, n: the most frequent subjects, in alphabetical order."""
    each = catalog.select(F.explode(F.split("subjects", ";")).alias("s")).select(F.trim("s").alias("subject")).filter(F.octet_length("subject").between(1, longest))
    top = each.groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "subject").limit(most)
    return top.orderBy(F.lower("subject"), "subject")


def with_slug(catalog: DataFrame, books: DataFrame) -> DataFrame:
    """catalog with the slug of the first book (by id) of the same source and source_id; no row is doubled."""
    first = books.groupBy("source", "source_id").agg(F.min_by("slug", "id").alias("slug"))
    return catalog.join(first, ["source", "source_id"], "left")


def status(catalog: DataFrame, books: DataFrame, sync: DataFrame, now: Column | None = None) -> DataFrame:
    """source, n_rows, n_imported, age_s for each source."""
    imported = catalog.join(books.select("source", "source_id"), ["source", "source_id"]).groupBy("source").agg(F.count("*").alias("n_imported"))
    rows = catalog.groupBy("source").agg(F.count("*").alias("n_rows"))
    age = F.unix_timestamp(F.current_timestamp() if now is None else now) - F.unix_timestamp("synced_at")
    return rows.join(imported, "source", "left").join(sync, "source", "left").select("source", "n_rows", F.coalesce("n_imported", F.lit(0)).alias("n_imported"), age.alias("age_s"))


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of fresh in place of those of equal keys; no fresh rows at all is an error."""
    if fresh.isEmpty():
        raise ValueError("a sync without rows")
    return table.join(fresh, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def synced(catalog: DataFrame, sync: DataFrame, fresh: DataFrame, source: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(catalog, sync) after a source was read again: its rows by upsert, and its stamp (source, synced_at, n_rows) in
    place of the earlier one. Nothing is stamped for a sync without rows, which is an error."""
    stamp = fresh.agg(F.count("*").alias("n_rows")).select(F.lit(source).alias("source"), at.alias("synced_at"), "n_rows")
    return upsert(catalog, fresh, ["source", "source_id"]), sync.filter(F.col("source") != source).unionByName(stamp, allowMissingColumns=True)


def newly_imported(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return after.join(before, keys, "left_anti")


def first_seen(rows: DataFrame, id: str, order: str) -> DataFrame:
    """One row for each id: that of least order."""
    others = [c for c in rows.columns if c not in (id, order)]
    return rows.groupBy(id).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others]).select(*rows.columns)


def library_search(books: DataFrame, query: str, most: int = 12) -> DataFrame:
    return books.filter(matches(query)).orderBy(F.lower("title"), "id").limit(most)
