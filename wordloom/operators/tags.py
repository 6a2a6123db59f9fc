"""Tag applications: counts over the hierarchy, interest, collections, and the changes a user makes to the tables.

word_tags has book, word, tag, value (null: on, 0: declined, 1 and more: a level); book '*' is a tag on the word in
every book. tag_defs has name, interest, scale_max. Each change takes tables and gives new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import tags as T
from wordloom.operators.ranges import placed

EVERYWHERE = "*"


def with_ancestors(applied: DataFrame, tag: str = "tag") -> DataFrame:
    """applied with a row for each tag and each of its ancestors in place of the tag; turns the prefix join of tags and
    definitions into an equi join."""
    return applied.withColumn(tag, F.explode(T.self_and_ancestors(F.col(tag))))


def usage_counts(defs: DataFrame, word_tags: DataFrame) -> DataFrame:
    """name, n_words: distinct words that carry a tag or a descendant of it; unused definitions have 0."""
    used = with_ancestors(word_tags.filter(T.applied(F.col("value")))).groupBy(F.col("tag").alias("name")).agg(F.countDistinct("word").alias("n_words"))
    return defs.select("name").join(used, "name", "left").select("name", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def book_stars(books: DataFrame, defs: DataFrame, word_tags: DataFrame, occurrences: DataFrame) -> DataFrame:
    """book, stars: distinct words of a book that carry a tag under an interesting definition, in the book itself or
    everywhere and then among the book's words; books without have 0."""
    good = defs.filter("interest = 'interesting'").select(F.col("name").alias("tag"))
    hits = with_ancestors(word_tags.filter(T.applied(F.col("value")))).join(good, "tag", "left_semi").select("book", "word").distinct()
    everywhere = occurrences.join(hits.filter(F.col("book") == EVERYWHERE).select("word"), "word", "left_semi").select("book", "word")
    own = hits.filter(F.col("book") != EVERYWHERE).unionByName(everywhere)
    return books.join(own.groupBy("book").agg(F.countDistinct("word").alias("stars")), "book", "left").select("book", F.coalesce("stars", F.lit(0)).alias("stars"))


def effective_interest(defs: DataFrame, word_tags: DataFrame) -> DataFrame:
    """book, word, interest: the strongest interest of a word's tags and their existing ancestors."""
    lent = with_ancestors(word_tags.filter(T.applied(F.col("value")))).join(defs.select(F.col("name").alias("tag"), T.interest_rank(F.col("interest")).alias("r")), "tag", "left")
    return lent.groupBy("book", "word").agg(T.interest_name(F.max("r")).alias("interest"))


def net_favourites(defs: DataFrame, word_tags: DataFrame) -> DataFrame:
    """word, net: how many of its distinct tags are interesting, less the uninteresting ones; only above 0."""
    each = word_tags.filter(T.applied(F.col("value"))).select("word", "tag").distinct().withColumn("own", F.col("tag"))
    rated = with_ancestors(each).join(defs.select(F.col("name").alias("tag"), T.interest_rank(F.col("interest")).alias("r")), "tag", "left")
    best = rated.groupBy("word", "own").agg(F.max("r").alias("r"))
    net = F.sum(F.when(F.col("r") == 2, 1).when(F.col("r") == 1, -1).otherwise(0))
    return best.groupBy("word").agg(net.alias("net")).filter("net > 0")


def collection(defs: DataFrame, word_tags: DataFrame) -> DataFrame:
    """word, tags, n_books, n_rows, interest, top_level: everything that is tagged, a row a word."""
    on = word_tags.filter(T.applied(F.col("value")))
    interest = effective_interest(defs, on.withColumn("book", F.lit(EVERYWHERE))).select("word", "interest")
    folded = on.groupBy("word").agg(
        F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"), F.countDistinct(F.when(F.col("book") != EVERYWHERE, F.col("book"))).alias("n_books"),
        F.count("*").alias("n_rows"), F.max(T.tag_level(F.col("value"))).alias("top_level"),
    )
    return folded.join(interest, "word")


def sorted_collection(rows: DataFrame, by: str = "interest") -> DataFrame:
    """A collection in one of the orders interest, word, tags, books, count; ties go by word."""
    rank = {"interest": [T.interest_rank(F.col("interest")).desc()], "word": [], "tags": [F.size(F.split("tags", ",")).desc()], "books": [F.col("n_books").desc()], "count": [F.col("n_rows").desc()]}
    return rows.orderBy(*rank[by], "word")


def set_tag(word_tags: DataFrame, book: str, word: str, tag: str, on: bool) -> DataFrame:
    """A tag switched on (value null) or off (its row goes)."""
    rest = word_tags.filter(~_is(book, word, tag))
    return rest.unionByName(_row(word_tags, book, word, tag, None)) if on else rest


def set_value(word_tags: DataFrame, book: str, word: str, tag: str, value: int | None, scale_max: int | None = None) -> DataFrame:
    """A tag with a value, not above the tag's scale."""
    value = value if value is None or scale_max is None else max(0, min(value, scale_max))
    return word_tags.filter(~_is(book, word, tag)).unionByName(_row(word_tags, book, word, tag, value))


def _is(book: str, word: str, tag: str) -> Column:
    return (F.col("book") == book) & (F.col("word") == word) & (F.col("tag") == tag)


def _row(word_tags: DataFrame, book: str, word: str, tag: str, value: int | None) -> DataFrame:
    return word_tags.sparkSession.range(1).select(F.lit(book).alias("book"), F.lit(word).alias("word"), F.lit(tag).alias("tag"), F.lit(value).cast(word_tags.schema["value"].dataType).alias("value"))


def add_definitions(defs: DataFrame, names: DataFrame) -> DataFrame:
    """defs with names (name, comment) and their missing ancestors; a known name only takes a new comment that is
    given."""
    asked = names.select("name", "comment", F.lit(0).alias("k")).unionByName(names.select(F.explode(T.ancestor_names(F.col("name"))).alias("name"), F.lit(None).cast("string").alias("comment"), F.lit(1).alias("k")))
    asked = asked.groupBy("name").agg(F.max("comment").alias("new"))
    kept = defs.join(asked, "name", "left").withColumn("comment", F.coalesce("new", "comment")).select(*defs.columns)
    fresh = asked.join(defs, "name", "left_anti").select("name", F.col("new").alias("comment"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def _under(tag: Column, name: str) -> Column:
    return (tag == name) | tag.startswith(f"{name}.")


def register(defs: DataFrame, name: str) -> DataFrame:
    """defs with a tag and its missing ancestors, for a tag that is applied before it is defined."""
    return add_definitions(defs, defs.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("string").alias("comment")))


def set_definition(defs: DataFrame, name: str, **fields) -> DataFrame:
    """defs with other values of one tag's fields, such as interest and fav."""
    if "interest" in fields and fields["interest"] not in T.INTEREST:
        raise ValueError(f"no interest: {fields['interest']}")
    return defs.withColumns({c: F.when(F.col("name") == name, F.lit(v)).otherwise(F.col(c)).cast(defs.schema[c].dataType) for c, v in fields.items()})


def visible(rows: DataFrame, interest: DataFrame, on: list[str]) -> DataFrame:
    """rows without the words whose effective interest is uninteresting."""
    return rows.join(interest.filter("interest = 'uninteresting'"), on, "left_anti")


def scope_order(by: str = "sort") -> list[Column]:
    """The orders of definitions: sort, name, interest; star always comes first."""
    first = {"sort": [F.col("sort")], "name": [], "interest": [T.interest_place(F.col("interest"))]}
    return [(F.col("name") != "star"), *first[by], F.col("name")]


def is_known(defs: DataFrame, text: str) -> bool:
    """Whether a tag of exactly this name is there."""
    return not defs.filter(F.col("name") == text.strip().lower()).isEmpty()


def rename_tag(table: DataFrame, old: str, new: str, column: str = "tag", defs: DataFrame | None = None) -> DataFrame:
    """A tag and its descendants under another name. star keeps its name, no tag goes below itself, and with defs no
    name that one of them has is taken."""
    if old == "star" or new == old or new.startswith(f"{old}."):
        raise ValueError(f"{old} can't become {new}")
    if defs is not None:
        moved = defs.filter(_under(F.col("name"), old)).select(F.concat(F.lit(new), F.substring("name", F.lit(len(old) + 1), F.length("name"))).alias("name"))
        if not defs.filter(~_under(F.col("name"), old)).join(moved, "name", "left_semi").isEmpty():
            raise ValueError(f"{new} is there already")
    tag = F.col(column)
    return table.withColumn(column, F.when(_under(tag, old), F.concat(F.lit(new), F.substring(tag, F.lit(len(old) + 1), F.length(tag)))).otherwise(tag))


def delete_tag(table: DataFrame, name: str, column: str = "tag") -> DataFrame:
    """table without a tag and its descendants."""
    return table.filter(~_under(F.col(column), name))


def clamp_levels(word_tags: DataFrame, name: str, scale_max: int) -> DataFrame:
    """Stored levels of a tag cut to a smaller scale."""
    return word_tags.withColumn("value", F.when((F.col("tag") == name) & (F.col("value") > scale_max), scale_max).otherwise(F.col("value")).cast(word_tags.schema["value"].dataType))


def to_word_scope(word_tags: DataFrame, name: str) -> DataFrame:
    """A tag's rows in books collapsed to one for each word (and rater, if there is one) everywhere, of the latest time
    (ts, if there is one); a value-less row counts as level 1."""
    own = word_tags.filter(F.col("tag") == name)
    keys, latest = [c for c in ("word", "tag", "rater") if c in word_tags.columns], [F.max(c).alias(c) for c in word_tags.columns if c == "ts"]
    folded = own.groupBy(*keys).agg(F.max(F.coalesce("value", F.lit(1))).alias("value"), *latest).withColumn("book", F.lit(EVERYWHERE))
    return word_tags.filter(F.col("tag") != name).unionByName(folded.select(*word_tags.columns))


def to_book_scope(word_tags: DataFrame, name: str, occurrences: DataFrame) -> DataFrame:
    """A tag's rows everywhere dealt to the books that have the word; rows already there stay, words in no book go."""
    own = word_tags.filter((F.col("tag") == name) & (F.col("book") == EVERYWHERE))
    dealt = own.drop("book").join(occurrences.select("book", "word").distinct(), "word")
    rest = word_tags.filter((F.col("tag") != name) | (F.col("book") != EVERYWHERE))
    return rest.unionByName(dealt.join(rest, ["book", "word", "tag"], "left_anti").select(*word_tags.columns))


def reconcile_auto_tags(book_tags: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows to take away): the automatic tags that books should have against those of known books."""
    want = books.select("book", F.explode(F.array_compact(F.array(T.source_tag(F.col("source")), T.format_tag(F.col("format"))))).alias("tag")).distinct()
    have = book_tags.filter("auto").select("book", "tag").join(books.select("book"), "book", "left_semi")
    return want.join(have, ["book", "tag"], "left_anti"), have.join(want, ["book", "tag"], "left_anti")


def book_tag_counts(book_tags: DataFrame, books: DataFrame) -> DataFrame:
    """tag, auto, n_books over the books that are there: tags of deleted books stay in the table and don't count."""
    return book_tags.join(books.select("book"), "book", "left_semi").groupBy("tag").agg(F.max("auto").alias("auto"), F.count("*").alias("n_books"))


def suggest(defs: DataFrame, text: str, most: int = 10) -> DataFrame:
    """Definitions whose name contains text in any case, star aside."""
    return defs.filter(F.lower("name").contains(text.lower()) & (F.col("name") != "star")).orderBy("name").limit(most)


def family_tags(members: DataFrame, word_tags: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For groups of words (root, word): (root, tag, value, n_words) with the highest value of any member, -1 for on
    without a level, and (root, interest, n) how many of its tags have which interest."""
    on = word_tags.filter(T.applied(F.col("value"))).join(members, "word")
    joined = on.groupBy("root", "tag").agg(F.max(T.value_code(F.col("value"))).alias("value"), F.countDistinct("word").alias("n_words"))
    named = joined.join(defs.select(F.col("name").alias("tag"), "interest"), "tag", "left")
    return joined, named.groupBy("root", F.coalesce("interest", F.lit("neutral")).alias("interest")).agg(F.count("*").alias("n"))


def books_with_tag(books: DataFrame, book_tags: DataFrame, tag: str, always: str | None = None) -> DataFrame:
    """The books that carry a tag, and the one named in always."""
    tagged = books.join(book_tags.filter(F.col("tag") == tag).select("book"), "book", "left_semi")
    return tagged if always is None else tagged.unionByName(books.filter(F.col("book") == always)).distinct()


def books_with_tags(books: DataFrame, book_tags: DataFrame) -> DataFrame:
    """books (id, book, title) with tags: an array of (name, auto, n_books), automatic ones first, then by name. A book
    without a title shows its name; one without tags has an empty array. n_books counts the books that are there."""
    own = book_tags.join(books.select("book"), "book", "left_semi").groupBy("book", "tag").agg(F.max("auto").alias("auto"))
    counted = own.join(book_tag_counts(book_tags, books).select("tag", "n_books"), "tag")
    item = F.struct((~F.col("auto")).alias("manual"), F.col("tag").alias("name"), "auto", "n_books")
    folded = counted.groupBy("book").agg(F.sort_array(F.collect_list(item)).alias("_t"))  # the tags of one book
    tags = F.transform(F.coalesce("_t", F.expr("cast(array() AS array<struct<manual: boolean, name: string, auto: boolean, n_books: bigint>>)")), lambda t: F.struct(t["name"], t["auto"], t["n_books"]))
    return books.join(folded, "book", "left").select("id", "book", F.coalesce("title", "book").alias("title"), tags.alias("tags"))


UNTAGGED = "untagged"


def primary_group(books: DataFrame, book_tags: DataFrame) -> DataFrame:
    """book, group: a book's first manual tag, else its first source tag, else its first automatic tag, else null."""
    auto = lambda where: F.min(F.when(F.col("auto") & where, F.col("tag")))
    first = F.coalesce(F.min(F.when(~F.col("auto"), F.col("tag"))), auto(F.col("tag").startswith("src:")), auto(F.lit(True)))
    return books.select("book").join(book_tags.groupBy("book").agg(first.alias("group")), "book", "left")


def grouped_books(books: DataFrame, book_tags: DataFrame, want: str = "", current: str | None = None) -> DataFrame:
    """group, group_place, place, book, n_books: the list to choose a book from. Groups are the primary ones, by name, books
    without tags last; in a group, books stand by id. n_books is the group's size in the list. want leaves the books that
    carry a tag, whatever their group is, and the current one.

    A group may have a third of all books: places come from ranges."""
    kept = books_with_tag(books, book_tags, want, current) if want else books
    named = kept.select("book", "id").join(primary_group(kept, book_tags), "book").withColumn("group", F.coalesce("group", F.lit(UNTAGGED)))
    sizes = named.groupBy("group").agg(F.count("*").alias("n_books"))
    order = placed(sizes, [], [F.col("group") == UNTAGGED, F.col("group")], "group_place").withColumn("group_place", F.col("group_place") + 1)
    rows = placed(named, ["group"], [F.col("id"), F.col("book")]).withColumn("place", F.col("place") + 1)
    return rows.join(order, "group").select("group", "group_place", "place", "book", "n_books")


def section_order(defs: DataFrame) -> DataFrame:
    """defs (scope, name, section, ord) with place: sections stand where their first tag does, tags by ord in them."""
    first = F.min("ord").over(W.partitionBy("scope", "section"))
    return defs.withColumn("_f", first).withColumn("place", F.row_number().over(W.partitionBy("scope").orderBy("_f", "section", "ord", "name")).cast("long")).drop("_f")


def set_layout(defs: DataFrame, layout: DataFrame) -> DataFrame:
    """defs with the order and section that layout (name, ord, section) gives; others keep theirs."""
    new = layout.select("name", F.col("ord").alias("_o"), F.col("section").alias("_s"))
    return defs.join(new, "name", "left").withColumns({"ord": F.coalesce("_o", "ord"), "section": F.coalesce("_s", "section")}).select(*defs.columns)


def shuffled(rows: DataFrame, id: str, seed: int) -> DataFrame:
    """rows in an order that depends on seed and id alone."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id)), id)
