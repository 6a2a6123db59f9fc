"""What a reader of the results asks for: a page of candidates, one word, its examples, tags, collections, lists.

Tables: candidates (book, level, word, in_book, n_forms, score, rank), words (word, pm, etymology_lang, syllables, ...),
counts (book, token, count), rooted (word, root) of a level, pos (word, pos, source), categories (word, category,
is_primary), eras (word, era, obsolete), word_tags (book, word, tag, value, rater, ts), tag definitions (name, interest,
sort, section). One filter holds at a time, written as the reader's page has it: '', 'pos:noun', 'origin:uncommon',
'origin:rare', 'era:ahead', 'status:obsolete', or a category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import tags as T
from wordloom.functions import text as X
from wordloom.operators import tags as TG
from wordloom.sources.written import written
from wordloom.operators.scoring import uncommon_origin

# Rows of a page, of a family, of other books, of examples; characters of an example; rows of a report.
PAGE, FAMILY, ALSO_IN, EXAMPLES, MOST_EXAMPLES, EXAMPLE_CHARS, TOP = 400, 15, 20, 20, 40, 400, 12
# The classes that are buckets of their own, and the categories that are none.
CONTENT_POS, NO_BUCKET = ("noun", "verb", "adj", "adv"), "noun.Tops"


def matching(kept: DataFrame, spec: str, words: DataFrame, pos: DataFrame, categories: DataFrame, eras: DataFrame | None) -> DataFrame:
    """The candidates that a filter lets through; each has to exist once in what the filter asks. Filters by era and by
    obsolescence alone ask for eras."""
    kind, _, value = spec.partition(":")
    if not spec:
        return kept
    if kind == "pos":
        asked = pos.filter(F.col("pos") == value)
    elif kind == "origin":
        asked = words.filter(uncommon_origin(F.col("etymology_lang"), value == "rare"))
    elif kind == "era":
        asked = eras.filter(F.col("era") == value)
    elif spec == "status:obsolete":
        asked = eras.filter("obsolete")
    else:
        asked = categories.filter(F.col("category") == spec)
    return kept.join(asked.select("word"), "word", "left_semi")


def filter_options(kept: DataFrame, words: DataFrame, pos: DataFrame, categories: DataFrame, eras: DataFrame) -> DataFrame:
    """option, n: every filter of candidates with how many words it lets through. kept is read once for each kind."""
    own = kept.select("word").distinct()
    count = lambda rows, option: rows.join(own, "word", "left_semi").groupBy(option.alias("option")).agg(F.countDistinct("word").alias("n"))
    one = lambda rows, option: rows.join(own, "word", "left_semi").agg(F.countDistinct("word").alias("n")).select(F.lit(option).alias("option"), "n")
    origin = F.col("etymology_lang")
    out = count(pos, F.concat(F.lit("pos:"), "pos")).unionByName(count(categories, F.col("category"))).unionByName(count(eras.filter("era IS NOT NULL"), F.concat(F.lit("era:"), "era")))
    return out.unionByName(one(words.filter(uncommon_origin(origin)), "origin:uncommon")).unionByName(one(words.filter(uncommon_origin(origin, True)), "origin:rare")).unionByName(one(eras.filter("obsolete"), "status:obsolete"))


def dictionary_report(words: DataFrame, categories: DataFrame, most: int = TOP) -> DataFrame:
    """kind, name, n, place: the languages of origin and the categories with the most words."""
    langs = words.filter("etymology_lang IS NOT NULL").groupBy(F.lit("language").alias("kind"), F.col("etymology_lang").alias("name")).agg(F.count("*").alias("n"))
    named = categories.groupBy(F.lit("category").alias("kind"), F.col("category").alias("name")).agg(F.countDistinct("word").alias("n"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.col("n").desc(), "name")).cast("long")
    return langs.unionByName(named).withColumn("place", place).filter(F.col("place") <= most)


def buckets(pos: DataFrame, categories: DataFrame) -> DataFrame:
    """word, bucket: content classes and categories, without catch-all ones."""
    own = pos.filter(F.col("pos").isin(*CONTENT_POS)).select("word", F.col("pos").alias("bucket"))
    named = categories.filter(~F.col("category").endswith(".all") & (F.col("category") != NO_BUCKET)).select("word", F.col("category").alias("bucket"))
    return own.unionByName(named).distinct()


def listed(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """keys and the distinct values of a column in order, as one string."""
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(column)), ",").alias(name))  # values of one word


def merged_forms(counts: DataFrame, words: DataFrame, rooted: DataFrame | None) -> DataFrame:
    """book, word, forms: the representative, then the book's other forms of it in order."""
    known = counts.join(words.select(F.col("word").alias("token")), "token")
    if rooted is not None:
        known = known.join(rooted.select(F.col("word").alias("token"), "root"), "token", "left")
    named = known.select("book", F.coalesce("root", "token").alias("word") if rooted is not None else F.col("token").alias("word"), "token")
    found = named.groupBy("book", "word").agg(F.array_sort(F.collect_set(F.when(F.col("token") != F.col("word"), F.col("token")))).alias("f"))
    return found.select("book", "word", F.array_join(F.concat(F.array("word"), "f"), "/").alias("forms"))


def book_tags(word_tags: DataFrame, book: str, rater: str = "me") -> DataFrame:
    """word, tag, value of a book: its own tags and those on words everywhere. A value of -1 is on without a level."""
    own = word_tags.filter(((F.col("book") == book) | (F.col("book") == TG.EVERYWHERE)) & (F.col("rater") == rater))
    return own.select("word", "tag", T.value_code(F.col("value")).alias("value"))


def candidate_page(kept: DataFrame, words: DataFrame, pos: DataFrame, primary: DataFrame, categories: DataFrame, eras: DataFrame | None, forms: DataFrame, word_tags: DataFrame, spec: str = "", limit: int = PAGE, rater: str = "me") -> DataFrame:
    """The first `limit` candidates of each book that pass the filter, with what the page shows of them: book, place,
    total (how many pass, before the limit), word, in_book, score, n_forms, origin, category, pos, forms, tags, buckets.
    A filter by era or obsolescence comes before the limit as all others do."""
    passed = matching(kept, spec, words, pos, categories, eras)
    totals = passed.groupBy("book").agg(F.count("*").alias("total"))
    place = F.row_number().over(W.partitionBy("book").orderBy("rank")).cast("long")
    # At most `limit` rows a book, taken several times below: scored, placed and written once.
    page = written(passed.withColumn("place", place).filter(F.col("place") <= limit).join(totals, "book"))
    shown_words = page.select("word").distinct()
    pos, categories = (x.join(shown_words, "word", "left_semi") for x in (pos, categories))
    on = word_tags.filter(T.applied(F.col("value")) & (F.col("rater") == rater))
    everywhere = on.filter(F.col("book") == TG.EVERYWHERE).select("word", "tag").join(page.select("word", "book"), "word")
    own = on.filter(F.col("book") != TG.EVERYWHERE).select("word", "tag", "book").unionByName(everywhere.select("word", "tag", "book"))
    shown = page.join(words.select("word", F.col("etymology_lang").alias("origin")), "word", "left").join(categories.filter("is_primary").select("word", "category"), "word", "left")
    shown = shown.join(primary.select("word", "pos"), "word", "left").join(forms, ["book", "word"], "left")
    shown = shown.join(listed(own, ["book", "word"], "tag", "tags"), ["book", "word"], "left").join(listed(buckets(pos, categories), ["word"], "bucket", "buckets"), "word", "left")
    return shown.select("book", "place", "total", "word", "in_book", "score", "n_forms", "origin", "category", "pos", F.coalesce("forms", "word").alias("forms"), F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("buckets", F.lit("")).alias("buckets"))


def visible_page(page: DataFrame, defs: DataFrame | None = None, word_tags: DataFrame | None = None, picks: DataFrame | None = None, rater: str = "me") -> DataFrame:
    """What is shown of a page (book, word, place, total, ...): with defs and word_tags, without the words that the rater's
    tags, of the book or everywhere, make uninteresting; with picks (book, word), the varied choice alone. Places and
    totals stay as they are, as the page's filters come before."""
    if word_tags is not None:
        on = word_tags.filter(F.col("rater") == rater).select("book", "word", "tag", "value")
        everywhere = on.filter(F.col("book") == TG.EVERYWHERE).drop("book").join(page.select("book", "word"), "word")
        own = on.filter(F.col("book") != TG.EVERYWHERE).unionByName(everywhere)
        page = TG.visible(page, TG.effective_interest(defs, own.join(page.select("book", "word"), ["book", "word"], "left_semi")), ["book", "word"])
    return page if picks is None else page.join(picks.select("book", "word").distinct(), ["book", "word"], "left_semi")


def _ordered(rows: DataFrame, item: Column, order: list[Column], most: int | None, name: str) -> DataFrame:
    """word and the items of rows in order, as one string; at most `most` of them."""
    place = F.row_number().over(W.partitionBy("word").orderBy(*order))
    cut = rows.withColumn("_k", place)
    cut = cut if most is None else cut.filter(F.col("_k") <= most)
    pairs = F.array_sort(F.collect_list(F.struct("_k", item.alias("item"))))
    return cut.groupBy("word").agg(F.array_join(F.transform(pairs, lambda x: x["item"]), ",").alias(name))


def word_detail(book: str, word: str, words: DataFrame, counts: DataFrame, rooted: DataFrame, pos: DataFrame, categories: DataFrame, traj: DataFrame, eras: DataFrame) -> DataFrame:
    """One row on a word of a book: origin, frequency, syllables, in_book; base (a more frequent root) with its own
    usage; its categories, buckets, family (the book's forms that merge into it), usage by decade, era, and the other
    books that have it or its family."""
    own = words.filter(F.col("word") == word).select("word", F.col("etymology_lang").alias("origin"), F.round("pm", 6).alias("freq_pm"), "syllables")
    members = rooted.filter(F.col("root") == word).select(F.col("word").alias("token")).unionByName(words.filter((F.col("word") == word) & F.col("alpha_only")).select(F.col("word").alias("token"))).distinct()
    here = counts.filter((F.col("book") == book) & (F.col("token") == word)).select(F.col("token").alias("word"), F.col("count").alias("in_book"))
    forms = counts.filter(F.col("book") == book).join(members, "token").join(words.select(F.col("word").alias("token"), "pm"), "token").withColumn("word", F.lit(word))
    others = counts.filter(F.col("book") != book).join(members, "token").groupBy("book").agg(F.sum("count").alias("n")).withColumn("word", F.lit(word))
    base = rooted.filter((F.col("word") == word) & (F.col("root") != word)).join(words.select(F.col("word").alias("root"), F.col("pm").alias("root_pm")), "root")
    base = base.join(words.select("word", "pm"), "word").select("word", F.when(F.col("root_pm") > F.coalesce("pm", F.lit(0.0)), F.col("root")).alias("base"), "root")
    points = lambda t: F.concat_ws(":", F.col("decade").cast("string"), F.round(t, 3).cast("decimal(20,3)").cast("string"))
    of_root = traj.select(F.col("word").alias("root"), "decade", "pm").join(base.select("word", "root"), "root")
    out = own.join(here, "word", "left").join(base.select("word", "base"), "word", "left").join(eras.filter(F.col("word") == word), "word", "left")
    parts = [
        _ordered(categories.filter(F.col("word") == word), F.col("category"), [F.col("is_primary").desc(), F.col("category")], None, "categories"),
        listed(buckets(pos, categories).filter(F.col("word") == word), ["word"], "bucket", "buckets"),
        _ordered(forms, F.concat_ws(":", "token", F.col("count").cast("string")), [F.col("pm").desc_nulls_last(), F.col("token")], FAMILY, "family"),
        _ordered(traj.filter(F.col("word") == word), points(F.col("pm")), [F.col("decade")], None, "trajectory"),
        _ordered(of_root, points(F.col("pm")), [F.col("decade")], None, "root_trajectory"),
        _ordered(others, F.concat_ws(":", "book", F.col("n").cast("string")), [F.col("n").desc(), F.col("book")], ALSO_IN, "also_in"),
    ]
    for part in parts:
        out = out.join(part, "word", "left")
    return out.select("word", "origin", "freq_pm", "syllables", F.coalesce("in_book", F.lit(0)).alias("in_book"), "base", "era", F.coalesce("obsolete", F.lit(False)).alias("obsolete"), "categories", "buckets", "family", "trajectory", "root_trajectory", "also_in")


def searched_forms(counts: DataFrame, rooted: DataFrame, book: str, word: str, most: int = FAMILY) -> DataFrame:
    """form: the book's most frequent forms that merge into a word, and the word itself."""
    members = rooted.filter(F.col("root") == word).select(F.col("word").alias("token")).unionByName(rooted.sparkSession.range(1).select(F.lit(word).alias("token"))).distinct()
    found = counts.filter(F.col("book") == book).join(members, "token", "left_semi").orderBy(F.col("count").desc(), "token").limit(most).select(F.col("token").alias("form"))
    return found.unionByName(rooted.sparkSession.range(1).select(F.lit(word).alias("form"))).distinct()


def word_examples(docs: DataFrame, forms: DataFrame, limit: int = EXAMPLES, order: str = "doc_id", text: str = "text") -> DataFrame:
    """place, total, form, text: the sentences of a book (docs, in order) that have one of some forms among their tokens,
    cut around the first of them; total counts all of them."""
    limit = max(1, min(limit, MOST_EXAMPLES))
    parts = docs.select(F.col(order).alias("o"), F.posexplode(X.sentences(X.normalise(F.col(text)))).alias("i", "s"))
    hits = parts.withColumn("form", F.explode(F.array_distinct(X.tokens(F.col("s"))))).join(F.broadcast(forms), "form")  # at most FAMILY + 1 forms
    first = hits.groupBy("o", "i", "s").agg(F.min(F.struct(F.expr("instr(lower(s), form)").alias("at"), "form")).alias("m"))
    total = first.agg(F.count("*").alias("total")).withColumn("_j", F.lit(1))
    top = first.orderBy("o", "i").limit(limit).withColumn("_j", F.lit(1)).join(total, "_j")
    place = F.row_number().over(W.orderBy("o", "i")).cast("long")  # at most `limit` rows
    return top.select(place.alias("place"), "total", F.col("m.form").alias("form"), X.window_around(F.trim("s"), F.col("m.form"), EXAMPLE_CHARS).alias("text"))


def collection_page(defs: DataFrame, word_tags: DataFrame, counts: DataFrame, words: DataFrame, spec: str = "", rater: str = "me") -> DataFrame:
    """The collection: word, tags, n_books, count (its occurrences in those books), interest, freq_pm, net. spec: '' for
    all, a tag for the words that carry it or a descendant (with all their tags), or 'special:top-global' for the words
    whose tags everywhere are more often interesting than uninteresting."""
    on = word_tags.filter(T.applied(F.col("value")) & (F.col("rater") == rater)).join(defs.select(F.col("name").alias("tag"), F.col("interest").alias("own_interest")), "tag")
    occurrences = counts.select("book", F.col("token").alias("word"), "count").join(on.select("word").distinct(), "word", "left_semi")
    everywhere = on.filter(F.col("book") == TG.EVERYWHERE)
    books = on.filter(F.col("book") != TG.EVERYWHERE).select("word", "book").unionByName(occurrences.join(everywhere.select("word").distinct(), "word", "left_semi").select("word", "book")).distinct()
    per = books.join(occurrences, ["word", "book"], "left").groupBy("word").agg(F.count("*").alias("n_books"), F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    interest = TG.effective_interest(defs, on.withColumn("book", F.lit(TG.EVERYWHERE))).select("word", "interest")
    rated = everywhere.select("word", "tag", "own_interest").distinct().groupBy("word").agg(F.sum(F.when(F.col("own_interest") == "interesting", 1).when(F.col("own_interest") == "uninteresting", -1).otherwise(0)).alias("net"))
    out = listed(on, ["word"], "tag", "tags").join(per, "word", "left").join(interest, "word").join(rated, "word", "left").join(words.select("word", F.round("pm", 6).alias("freq_pm")), "word", "left")
    if spec == "special:top-global":
        out = out.filter("net > 0")
    elif spec:
        out = out.join(on.filter((F.col("tag") == spec) | F.col("tag").startswith(f"{spec}.")).select("word"), "word", "left_semi")
    return out.select("word", "tags", F.coalesce("n_books", F.lit(0)).alias("n_books"), F.coalesce("count", F.lit(0)).alias("count"), "interest", "freq_pm", F.coalesce("net", F.lit(0)).cast("long").alias("net"))


def collection_order(by: str = "interest") -> list[Column]:
    """The orders of a collection: interest, word, rarest (unmeasured last), count, net."""
    first = {"interest": [T.interest_place(F.col("interest"))], "word": [], "rarest": [F.col("freq_pm").asc_nulls_last()], "count": [F.col("count").desc()], "net": [F.col("net").desc()]}
    return [*first[by], F.col("word")]


def collection_tags(defs: DataFrame, word_tags: DataFrame, rater: str = "me") -> DataFrame:
    """name, n_words, fav of every definition, with the words of its descendants; place by sort, then name."""
    used = TG.usage_counts(defs, word_tags.filter(F.col("rater") == rater))
    return list_tags(defs.join(used, "name"))


def list_tags(defs: DataFrame) -> DataFrame:
    """Definitions with place: by sort, then name. They are few."""
    return defs.withColumn("place", F.row_number().over(W.orderBy("sort", "name")).cast("long"))


def list_books(books: DataFrame, counts: DataFrame, defs: DataFrame, word_tags: DataFrame) -> DataFrame:
    """books (book, title, author, year) with n_tokens, n_types and stars."""
    sizes = counts.groupBy("book").agg(F.sum("count").alias("n_tokens"), F.count("*").alias("n_types"))
    stars = TG.book_stars(books.select("book"), defs, word_tags, counts.select("book", F.col("token").alias("word")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return books.join(sizes, "book", "left").join(stars, "book", "left").select(*books.columns, zero("n_tokens"), zero("n_types"), zero("stars"))


def list_books_admin(books: DataFrame, counts: DataFrame, defs: DataFrame, word_tags: DataFrame) -> DataFrame:
    """id, book, title, author, year, format, source, text_source, n_tokens, n_types, ingested_at, n_selected (stars): the
    books with where they came from. Unknown texts are empty, an unknown year stays null; a page shows them by id."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = list_books(books, counts, defs, word_tags)
    return found.select("id", "book", text("title"), text("author"), "year", *map(text, ("format", "source", "text_source")), "n_tokens", "n_types", text("ingested_at"), F.col("stars").alias("n_selected"))


def most_in_text(page: DataFrame) -> DataFrame:
    """page with text_place: by the count in the book, ties as on the page."""
    return page.withColumn("text_place", F.row_number().over(W.partitionBy("book").orderBy(F.col("in_book").desc(), "place")).cast("long"))
