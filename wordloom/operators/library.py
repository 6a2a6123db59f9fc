"""Changes to the library: importing books, editing and deleting them, their tags, and moving old tags to text keys.

Each change takes tables and gives new ones. books has book (the slug), title, author, year, content_hash; counts has
book, token, count; book_tags has book, tag, auto, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import tags as T
from wordloom.functions import text as X
from wordloom.operators import frequency
from wordloom.operators.ranges import placed

# The name spaces of automatic tags, and the years a book may have.
RESERVED, YEARS = ("src", "fmt"), (1000, 2200)


def checked_imports(books: DataFrame, new: DataFrame) -> DataFrame:
    """new (book, text, ...) with content_hash and duplicate_of: the book of equal content that the library has under
    another name, or that comes earlier by name among the new ones; null if it may come in."""
    hashed = new.withColumn("content_hash", X.content_hash(F.col("text")))
    known = books.groupBy("content_hash").agg(F.min("book").alias("_a"), F.max("book").alias("_b"))
    first = hashed.groupBy("content_hash").agg(F.min("book").alias("_first"))
    met = hashed.join(first, "content_hash").join(known, "content_hash", "left")
    other = [F.when(F.col(c) != F.col("book"), F.col(c)) for c in ("_a", "_b", "_first")]
    return met.withColumn("duplicate_of", F.coalesce(*other)).drop("_first", "_a", "_b")


def commit_books(books: DataFrame, counts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, counts) with the accepted of new in place of earlier ones of the same name."""
    good = checked_imports(books, new).filter("duplicate_of IS NULL")
    histogram = frequency.token_counts(good, ["book"])
    rows = good.select(*[c if c in good.columns else F.lit(None).cast(books.schema[c].dataType).alias(c) for c in books.columns])
    return (
        books.join(good.select("book"), "book", "left_anti").unionByName(rows),
        counts.join(good.select("book"), "book", "left_anti").unionByName(histogram.select(*counts.columns)),
    )


def reingest(books: DataFrame, counts: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, counts) with the books of texts (book, text) read anew: their counts and content_hash change, their
    details stay. A text of a book that isn't in the library, or that another book has, is left out."""
    own = texts.select("book", "text").join(books.drop("content_hash"), "book")
    return commit_books(books, counts, own)


def import_summary(checked: DataFrame) -> DataFrame:
    """One row: how many books were asked for, came in, were refused, and are too short to be books (no words)."""
    ok = F.col("duplicate_of").isNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return checked.agg(F.count("*").alias("asked"), count(ok).alias("imported"), count(~ok).alias("refused"), count(F.size(X.tokens(F.col("text"))) == 0).alias("without_words"))


def update_book(books: DataFrame, book: str, title: str, author: str, year: str) -> DataFrame:
    """books with one book's details; a year that is no number of four digits in range is none."""
    given = int(year.strip()) if year.strip().isdigit() and YEARS[0] <= int(year) <= YEARS[1] else None
    own = F.col("book") == book
    fresh = {"title": F.lit(title.strip()), "author": F.lit(author.strip()), "year": F.lit(given).cast(books.schema["year"].dataType)}
    return books.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in fresh.items()})


def delete_book(book: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without a book's rows. Tags are keyed by name and are left, so that they return with the book."""
    return tuple(t.filter(F.col("book") != book) for t in tables)


def _canonical(table: DataFrame, name: str) -> str:
    clean = table.sparkSession.range(1).select(T.sanitize_book_tag(F.lit(name)).alias("t")).first()["t"]
    if clean is None:
        raise ValueError(f"no tag name: {name}")
    return clean


def reserved(name: str) -> bool:
    """Whether a tag is in a name space of automatic tags."""
    return name.startswith(tuple(f"{r}{mark}" for r in RESERVED for mark in ":.")) or name in RESERVED


def _own_name(table: DataFrame, name: str) -> str:
    clean = _canonical(table, name)
    if reserved(clean):
        raise ValueError(f"{clean} follows from the book itself")
    return clean


def _under(name: str) -> Column:
    return (F.col("tag") == name) | F.col("tag").startswith(f"{name}.")


def add_book_tag(book_tags: DataFrame, books: DataFrame, book: str, tag: str) -> DataFrame:
    """book_tags with a manual tag on a known book; one that is there stays as it is."""
    clean = _own_name(book_tags, tag)
    if books.filter(F.col("book") == book).isEmpty():
        raise ValueError(f"unknown book {book}")
    row = book_tags.sparkSession.range(1).select(F.lit(book).alias("book"), F.lit(clean).alias("tag"), F.lit(False).alias("auto"), F.current_timestamp().alias("ts"))
    return book_tags.unionByName(row.join(book_tags, ["book", "tag"], "left_anti").select(*book_tags.columns))


def remove_book_tag(book_tags: DataFrame, book: str, tag: str) -> DataFrame:
    """book_tags without a manual tag of a book; an automatic one can't go."""
    own = (F.col("book") == book) & (F.col("tag") == _canonical(book_tags, tag))
    if not book_tags.filter(own & F.col("auto")).isEmpty():
        raise ValueError(f"{tag} follows from the book itself")
    return book_tags.filter(~own)


def rename_book_tag(book_tags: DataFrame, old: str, new: str) -> DataFrame:
    """book_tags with a manual tag and its descendants under another name in all books; where a book has the new name
    already, that row stays."""
    clean = _own_name(book_tags, new)
    if _own_name(book_tags, old) != old:
        raise ValueError(f"no tag name: {old}")
    if clean == old:
        return book_tags
    if clean.startswith(f"{old}."):
        raise ValueError("a tag can't go below itself")
    if not book_tags.filter(_under(old) & F.col("auto")).isEmpty():
        raise ValueError(f"{old} is kept automatically")
    rest = book_tags.filter(~_under(old))
    moved = book_tags.filter(_under(old)).withColumn("tag", F.concat(F.lit(clean), F.substring("tag", F.lit(len(old) + 1), F.length("tag"))))
    return rest.unionByName(moved.join(rest, ["book", "tag"], "left_anti").select(*rest.columns))


def delete_book_tag(book_tags: DataFrame, tag: str) -> DataFrame:
    """book_tags without a manual tag and its descendants."""
    clean = _own_name(book_tags, tag)
    return book_tags.filter(~(_under(clean) & ~F.col("auto")))


def text_keyed(old: DataFrame, books: DataFrame, words: DataFrame) -> DataFrame:
    """Old tag rows (book_id, word_id, tag, rater, ts) keyed by the names of books (id, book) and words (id, word). Rows
    of unknown ids go; a missing rater is 'me'; of rows that become equal the first by time stays."""
    named = old.join(books.select(F.col("id").alias("book_id"), "book"), "book_id").join(words.select(F.col("id").alias("word_id"), "word"), "word_id")
    return named.groupBy("book", "word", "tag", F.coalesce("rater", F.lit("me")).alias("rater")).agg(F.min("ts").alias("ts"))


def legacy_values(word_tags: DataFrame) -> DataFrame:
    """Values of 1 from before there were levels as null, which is how 'on' is kept."""
    return word_tags.withColumn("value", F.when(F.col("value") != 1, F.col("value")))


def job_list(jobs: DataFrame) -> DataFrame:
    """jobs (state, updated, ...) with place: running, queued, then the others; within each the latest first. Places come
    from ranges, so the list of all jobs ever is in no task."""
    rank = F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).otherwise(2)
    return placed(jobs, [], [rank, F.col("updated").desc(), F.col("id")]).withColumn("place", F.col("place") + 1)
