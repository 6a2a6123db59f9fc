"""Fetching a batch of catalogue rows into the library: what comes in, under which name, and why others don't.

items has place, source, source_id: what was asked for, in order. catalog has source, source_id, title, author, year;
texts has source, source_id, text: what was fetched. books has book (the slug), source, source_id, title, author, year,
content_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators.ranges import placed
from wordloom.sources.written import written

ID = ["source", "source_id"]
# What is said of rows that don't come in.
HAVE, UNKNOWN, NO_FILE, SAME = "already imported", "not in the catalogue", "nothing was fetched", "identical content"


def base_slug(source: Column, source_id: Column, title: Column) -> Column:
    """The name that a catalogue row's book gets if it is free."""
    other = F.coalesce(F.nullif(X.slugify(F.coalesce(F.nullif(title, F.lit("")), source_id)), F.lit("")), F.lit("book"))
    return (
        F.when(source == "gutenberg", F.concat(F.lit("gutenberg-"), source_id))
        .when(source == "standardebooks", F.concat(F.lit("se-"), X.slugify(F.replace(source_id, F.lit("/"), F.lit("-")))))
        .otherwise(other)
    )


def free_slugs(rows: DataFrame, books: DataFrame) -> DataFrame:
    """rows (place, base, ...) with slug: the base itself, else the first free of base-2, base-3, ... in order of place.

    Names in books are taken, and so is a numbered name that is the base of another of rows. A base's rows and the books
    with its name may be many: places come from ranges, and numbers are made a row each."""

    def numbered_names(t: DataFrame, c: str) -> DataFrame:
        number = F.regexp_extract(c, r"-([1-9]\d{0,8})$", 1)
        found = t.filter(number != "").select(F.regexp_replace(c, r"-[1-9]\d{0,8}$", "").alias("base"), number.cast("long").alias("number"))
        return found.filter("number > 1")

    bases = rows.groupBy("base").agg(F.count("*").alias("need"))
    used = books.select(F.col("book").alias("base"), F.lit(1).cast("long").alias("number")).unionByName(numbered_names(books, "book")).unionByName(numbered_names(bases, "base")).distinct()
    used = written(used.join(bases, "base", "left_semi"))
    have = used.groupBy("base").agg(F.count("*").alias("have"))
    open_ = bases.join(have, "base", "left").select("base", "need", F.explode(F.sequence(F.lit(1).cast("long"), F.col("need") + F.coalesce("have", F.lit(0)))).alias("number"))
    free = placed(open_.join(used, ["base", "number"], "left_anti"), ["base"], [F.col("number")], "_k").filter("_k < need")
    asked = placed(rows, ["base"], [F.col("place")], "_k")
    name = F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("number").cast("string")))
    return asked.join(free.select("base", "_k", "number"), ["base", "_k"]).withColumn("slug", name).drop("_k", "number")


def grabbed(items: DataFrame, catalog: DataFrame, books: DataFrame, texts: DataFrame) -> DataFrame:
    """place, source, source_id, outcome (imported, skipped or failed), slug, reason, content_hash, claims for each of items.

    A row that isn't in the catalogue, or of which nothing was fetched, fails; the others go on. One whose source and
    source_id a book has is skipped, and so is one whose words a book has, or an earlier one of the batch: slug names that
    book. A book without a source_id takes over that of the first such row (claims), which later ones of the batch then
    find. No place is decided by a walk along the batch: first places by source and by content decide. The result is
    written once. Rows without a place are left out; a null source or source_id is in no catalogue."""
    asked = items.filter("place IS NOT NULL").select("place", *ID)
    first = asked.filter("source IS NOT NULL AND source_id IS NOT NULL").groupBy(*ID).agg(F.min("place").alias("first"))
    known = catalog.groupBy(*ID).agg(F.min_by("title", F.struct("title")).alias("title"), F.lit(True).alias("_known"))
    own = books.filter("source_id <> ''").groupBy(*ID).agg(F.min("book").alias("_own"))
    got = texts.filter("text IS NOT NULL").groupBy(*ID).agg(F.min(X.content_hash(F.col("text"))).alias("content_hash"))
    met = first.join(known, ID, "left").join(own, ID, "left").join(got, ID, "left")
    same = books.groupBy("content_hash").agg(F.min("book").alias("_same"), F.min_by(F.coalesce("source_id", F.lit("")), "book").alias("_same_id"))
    judged = written(met.join(same, "content_hash", "left").withColumn("reason", F.when(F.col("_known").isNull(), UNKNOWN).when(F.col("_own").isNotNull(), HAVE).when(F.col("content_hash").isNull(), NO_FILE)))
    may = judged.filter("reason IS NULL")
    earliest = may.groupBy("content_hash").agg(F.min("first").alias("_earliest"))
    may = may.join(earliest, "content_hash").withColumn("_first_of_its_words", F.col("first") == F.col("_earliest"))
    fresh = may.filter("_same IS NULL AND _first_of_its_words").select(F.col("first").alias("place"), "content_hash", base_slug(F.col("source"), F.col("source_id"), F.col("title")).alias("base"))
    named = written(free_slugs(fresh, books).select("content_hash", "slug"))
    decided = may.join(named, "content_hash", "left").select(
        *ID, "first", "content_hash",
        F.when(F.col("_same").isNull() & F.col("_first_of_its_words"), "imported").otherwise("skipped").alias("outcome"),
        F.coalesce("_same", "slug").alias("slug"), (F.col("_same").isNotNull() & F.col("_first_of_its_words") & (F.col("_same_id") == "")).alias("claims"),
    ).withColumn("reason", F.when(F.col("outcome") == "skipped", SAME))
    known_outcome = F.when(F.col("reason") == HAVE, "skipped").otherwise("failed")
    others = judged.filter("reason IS NOT NULL").select(*ID, "first", "content_hash", known_outcome.alias("outcome"), F.when(F.col("reason") == HAVE, F.col("_own")).alias("slug"), F.lit(False).alias("claims"), "reason")
    each = decided.unionByName(others)
    again = F.col("place") > F.col("first")
    there = again & ((F.col("outcome") == "imported") | F.col("claims"))
    out = asked.join(each, ID, "left").select(
        "place", *ID, F.when(there, "skipped").otherwise(F.coalesce("outcome", F.lit("failed"))).alias("outcome"), "slug",
        F.when(there, HAVE).when(F.col("first").isNull(), UNKNOWN).otherwise(F.col("reason")).alias("reason"), "content_hash", (~again & F.col("claims")).alias("claims"),
    )
    return written(out.withColumn("claims", F.coalesce("claims", F.lit(False))))


def with_grabbed(books: DataFrame, catalog: DataFrame, outcomes: DataFrame) -> DataFrame:
    """books after a batch: what came in, and the source and source_id that books without any took over."""
    claims = outcomes.filter("claims").select(F.col("slug").alias("book"), *[F.col(c).alias(f"_{c}") for c in ID])
    taken = F.col("_source_id").isNotNull()
    kept = books.join(claims, "book", "left").withColumns({c: F.when(taken, F.col(f"_{c}")).otherwise(F.col(c)) for c in ID}).select(*books.columns)
    details = catalog.groupBy(*ID).agg(*[F.min_by(c, F.struct("title")).alias(c) for c in ("title", "author", "year")])
    fresh = outcomes.filter("outcome = 'imported'").join(details, ID).withColumnRenamed("slug", "book")
    return kept.unionByName(fresh.select(*[c if c in fresh.columns else F.lit(None).cast(books.schema[c].dataType).alias(c) for c in books.columns]))


def grab_summary(outcomes: DataFrame) -> DataFrame:
    """One row: n, n_imported, n_skipped, n_failed, ok, and code: PARTIAL or ALL_FAILED where some failed, and first_failure."""
    count = lambda what: F.count_if(F.col("outcome") == what)
    row = outcomes.agg(F.count("*").alias("n"), *[count(x).alias(f"n_{x}") for x in ("imported", "skipped", "failed")], F.min_by("reason", F.when(F.col("outcome") == "failed", F.col("place"))).alias("first_failure"))
    return row.withColumn("ok", F.col("n_failed") == 0).withColumn("code", F.when(F.col("n_failed") > 0, F.when(F.col("n_imported") > 0, "PARTIAL").otherwise("ALL_FAILED")))


def user_counts(tags: DataFrame, applications: DataFrame, book_tags: DataFrame) -> DataFrame:
    """One row: n_tags, n_applications, n_book_tags, n_auto of the user's own tables."""
    one = lambda t, **c: t.agg(*[v.alias(k) for k, v in c.items()])
    return one(tags, n_tags=F.count("*")).crossJoin(one(applications, n_applications=F.count("*"))).crossJoin(one(book_tags, n_book_tags=F.count("*"), n_auto=F.count_if(F.col("auto"))))
