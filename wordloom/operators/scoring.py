"""Which words of a book are interesting, how much, and why the others are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators.ranges import placed

# Languages of origin that don't count as unusual to the score.
COMMON_ORIGINS = (
    "en", "enm", "ang", "gem-pro", "ine-pro", "fr", "fro", "frm", "xno", "la", "la-med", "la-ecc", "la-cla", "grc",
    "non", "is", "de", "nl", "gml", "goh", "gmh", "osx", "nds", "it", "es", "pt", "ca",
)
# Languages of origin that the origin filter leaves out, and those that its strict form adds.
FILTER_COMMON = (
    "ang", "enm", "enm-nor", "ang-nrt", "la", "la-med", "la-new", "la-vul", "fr", "fro", "fro-nor", "frm", "xno", "nrf",
    "grc", "el", "gem-pro", "gem", "gmw", "gmq", "non", "gml", "gmh", "goh", "nds", "osx", "got", "dum", "odt", "nl",
    "vls", "de", "ine-pro", "mul", "sco",
)
FILTER_ROMANCE = (
    "it", "es", "pt", "ca", "gl", "oc", "an", "co", "rm", "sc", "fur", "lld", "nap", "scn", "vec", "lij", "pms", "lmo",
    "frp", "wa", "mwl", "ext", "lad",
)
WEIGHTS = {"rarity": 1.0, "salience": 0.6, "origin": 1.5, "aesthetic": 0.5}
UNKNOWN_RARITY, MAX_RARITY, MIN_LENGTH, MAX_PM, MAX_CAPS = 4.0, 5.0, 3, 12.0, 0.5
REASONS = {"nodict": "not in the dictionary", "nonalpha": "not only letters", "nowikt": "no known word", "formof": "a form of another word", "proper": "a proper noun", "offensive": "offensive", "capitalised": "mostly capitalised", "short": "too short", "common": "too common", "": "kept"}


def reason_label(why: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[why]


def rarity(pm: Column) -> Column:
    return F.when(pm.isNull(), UNKNOWN_RARITY).when(pm <= 0, MAX_RARITY).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MAX_RARITY), -F.log10(pm))))


def parts(count: Column, pm: Column, length: Column, syllables: Column, rare: Column, origin: Column) -> dict[str, Column]:
    """The score's four parts, and the score."""
    s_origin = F.when(origin.isNotNull() & (origin != "") & ~origin.isin(*COMMON_ORIGINS), 2.0).otherwise(0.0)
    s_look = 0.5 * F.coalesce(F.length(rare), F.lit(0)) + F.when(length.between(6, 13), 0.5).otherwise(0.0) + F.when(syllables.between(3, 5), 0.5).otherwise(0.0)
    each = {"s_rarity": rarity(pm), "s_salience": F.log1p(count.cast("double")), "s_origin": s_origin, "s_aesthetic": s_look}
    weights = list(WEIGHTS.values())
    total = weights[0] * each["s_rarity"] + weights[1] * each["s_salience"] + weights[2] * each["s_origin"] + weights[3] * each["s_aesthetic"]
    return each | {"score": total}


def eligible(pm: Column, max_pm: float = MAX_PM) -> Column:
    """The hard filter on a word's features (columns of words) and a frequency; unknown values pass where they may."""
    flags = F.col("alpha_only") & F.col("in_wiktionary") & ~F.col("is_form_of") & ~F.col("is_proper") & ~F.col("is_offensive")
    return flags & F.coalesce(F.col("cap_ratio") <= MAX_CAPS, F.lit(True)) & (F.coalesce("length", F.lit(0)) >= MIN_LENGTH) & F.coalesce(pm <= max_pm, F.lit(True))


def grouped(counts: DataFrame, words: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """book, word (the representative), in_book, n_forms: a book's dictionary words of letters, by representative.
    lemmas: word, root; None leaves each word alone."""
    known = counts.join(words.filter("alpha_only").select(F.col("word").alias("token")), "token")
    if lemmas is not None:
        known = known.join(lemmas.select(F.col("word").alias("token"), "root"), "token", "left")
        known = known.select("book", F.coalesce("root", "token").alias("word"), "count")
    else:
        known = known.select("book", F.col("token").alias("word"), "count")
    return known.groupBy("book", "word").agg(F.sum("count").alias("in_book"), F.count("*").alias("n_forms"))


def candidates(counts: DataFrame, words: DataFrame, lemmas: DataFrame | None = None, family: DataFrame | None = None, level: int = 0, max_pm: float = MAX_PM) -> DataFrame:
    """The ranked candidates of each book at a level: book, level, word, in_book, n_forms, score and parts, rank.

    A family's frequency stands for its representative's own where there is one, even 0. Ties go by word. Ranks come
    from ranges of (book, score), as one book may have most of the candidates; what they are made of is written.
    """
    return ranked(scored(counts, words, lemmas, family, level, max_pm))


def scored(counts: DataFrame, words: DataFrame, lemmas: DataFrame | None = None, family: DataFrame | None = None, level: int = 0, max_pm: float = MAX_PM) -> DataFrame:
    """candidates() without their ranks."""
    group = grouped(counts, words, lemmas).join(words, "word")
    if family is not None:
        group = group.join(family.select(F.col("root").alias("word"), F.col("pm_lc").alias("family_pm"), F.lit(True).alias("has_family")), "word", "left")
        group = group.withColumn("used_pm", F.when(F.col("has_family"), F.col("family_pm")).otherwise(F.col("pm_lc")))
    else:
        group = group.withColumn("used_pm", F.col("pm_lc"))
    kept = group.filter(eligible(F.col("used_pm"), max_pm))
    found = kept.withColumns(parts(F.col("in_book"), F.col("used_pm"), F.col("length"), F.col("syllables"), F.col("rare_letters"), F.col("etymology_lang")))
    found = found.withColumn("score", F.round("score", 9))
    return found.select("book", F.lit(level).alias("level"), "word", "in_book", "n_forms", "score", *[F.round(c, 9).alias(c) for c in ("s_rarity", "s_salience", "s_origin", "s_aesthetic")])


def ranked(rows: DataFrame) -> DataFrame:
    """rows (book, score, word, ...) with rank: 1 for the best score of a book, ties by word."""
    return placed(rows, ["book"], [F.col("score").desc(), F.col("word")], "rank").withColumn("rank", F.col("rank") + 1)


def exclusion_reasons(counts: DataFrame, words: DataFrame, kept: DataFrame, lemmas: DataFrame | None = None, family: DataFrame | None = None, max_pm: float = MAX_PM) -> DataFrame:
    """book, token, count, pm, why: exactly one reason for each token of a book, '' for those that count."""
    lemma = words.select("word").withColumn("root", F.col("word")) if lemmas is None else lemmas
    own = words.select(F.col("word").alias("token"), F.col("alpha_only").alias("own_alpha"))
    rep = words.drop("count").withColumnRenamed("word", "root")
    joined = counts.join(own, "token", "left").join(lemma.select(F.col("word").alias("token"), "root"), "token", "left").withColumn("root", F.coalesce("root", "token")).join(rep, "root", "left")
    joined = joined.join(kept.select("book", F.col("word").alias("root")).distinct().withColumn("chosen", F.lit(True)), ["book", "root"], "left")
    pm = F.col("pm_lc")
    if family is not None:
        joined = joined.join(family.select("root", F.col("pm_lc").alias("family_pm"), F.lit(True).alias("has_family")), "root", "left")
        pm = F.when(F.col("has_family"), F.col("family_pm")).otherwise(F.col("pm_lc"))
    why = (
        F.when(F.col("own_alpha").isNull(), "nodict").when(~F.col("own_alpha"), "nonalpha").when(F.col("chosen"), "")
        .when(~F.col("in_wiktionary"), "nowikt").when(F.col("is_form_of"), "formof").when(F.col("is_proper"), "proper")
        .when(F.col("is_offensive"), "offensive").when(F.col("cap_ratio") > MAX_CAPS, "capitalised")
        .when(F.coalesce("length", F.lit(0)) < MIN_LENGTH, "short").when(pm > max_pm, "common").otherwise("")
    )
    return joined.select("book", "token", "count", pm.alias("pm"), why.alias("why"))


def reason_counts(reasons: DataFrame) -> DataFrame:
    """book, why, n_types, n_tokens."""
    return reasons.groupBy("book", "why").agg(F.count("*").alias("n_types"), F.sum("count").alias("n_tokens"))


def left_out_order(by_count: bool = False) -> list[Column]:
    """Unmeasured words last: rarest first, or most frequent in the book."""
    unmeasured = F.when(F.coalesce("pm", F.lit(0.0)) <= 0, 1).otherwise(0)
    return [F.col("count").desc()] if by_count else [unmeasured, F.round("pm", 9).asc_nulls_last(), F.col("count").desc()]


def excluded_words(reasons: DataFrame, most: int = 200, by_count: bool = False) -> DataFrame:
    """The first `most` words of each book that are left out, by left_out_order, then token."""
    place = F.row_number().over(W.partitionBy("book").orderBy(*left_out_order(by_count), "token"))
    return reasons.filter("why <> ''").withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def uncommon_origin(origin: Column, strict: bool = False) -> Column:
    return origin.isNotNull() & ~origin.isin(*FILTER_COMMON, *(FILTER_ROMANCE if strict else ()))
