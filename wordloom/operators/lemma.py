"""Grouping words under roots at four levels: none, inflection, suffixes, and aggressive with prefixes.

A step takes the first rule that reaches a known word, and of that rule's candidates the most frequent. Steps don't
depend on how a word was reached, so each level's step table is made once and followed up to six times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes in order of priority, with what may stand in their place.
RULES = [
    ("ically", ["ical", "ic"]), ("ally", ["al", "ical", "ic"]), ("fully", ["ful"]), ("ously", ["ous"]), ("iness", ["y"]),
    ("ily", ["y", "e"]), ("bly", ["ble"]), ("ply", ["ple"]), ("lly", ["ll", "l"]), ("ly", ["", "le", "e"]),
    ("ation", ["ate", "e"]), ("ition", ["ite"]), ("ity", ["e", "ous", ""]), ("ness", ["", "e"]), ("iest", ["y"]),
    ("ier", ["y"]), ("ied", ["y"]), ("ies", ["y"]), ("ing", ["", "e"]), ("er", ["", "e"]), ("ed", ["", "e"]),
    ("es", ["", "e"]), ("s", [""]),
]
# The grammatical suffixes, those of comparison, prefixes that always and that sometimes come off.
INFLECTIONAL = ("iest", "ier", "ied", "ies", "ing", "er", "ed", "es", "s")
COMPARATIVE = ("er", "ier", "iest")
SAFE_PREFIXES = ("counter", "pseudo", "under", "anti", "semi", "over", "multi", "non", "mis", "un")
GUARDED_PREFIXES = ("dis", "pre", "ir", "il", "im", "in", "re", "de")
CLOSE, MIN_BASE_PM, MAX_STEPS = 0.35, 1.0, 6


def _candidates(word: Column, rules: list, aggressive: bool) -> Column:
    """Array of (rule, place, base, comparative, doubled) for the suffixes that word ends with."""
    options = []
    for r, (suffix, replacements) in enumerate(rules):
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        fits = word.endswith(suffix) & (F.length(word) > len(suffix) + 1)
        for k, end in enumerate(replacements):
            options.append(F.when(fits, F.struct(F.lit(r).alias("rule"), F.lit(k).alias("place"), F.concat(stem, F.lit(end)).alias("base"), F.lit(suffix in COMPARATIVE).alias("comparative"), F.lit(False).alias("doubled"))))
        if aggressive:
            last = F.substring(stem, -1, 1)
            twice = fits & (F.length(stem) >= 3) & (last == F.substring(stem, -2, 1)) & ~last.isin("a", "e", "i", "o", "u")
            options.append(F.when(twice, F.struct(F.lit(r).alias("rule"), F.lit(len(replacements)).alias("place"), F.substring(stem, F.lit(1), F.length(stem) - 1).alias("base"), F.lit(suffix in COMPARATIVE).alias("comparative"), F.lit(True).alias("doubled"))))
    return F.array_compact(F.array(*options))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of two vectors: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _close(rows: DataFrame, vectors: DataFrame | None, word: str, base: str) -> DataFrame:
    """rows with close: whether both words have vectors and their cosine is at least CLOSE."""
    if vectors is None:
        return rows.withColumn("close", F.lit(False))
    left, right = (vectors.select(F.col("word").alias(c), F.col("vector").alias(f"_{c}")) for c in (word, base))
    joined = rows.join(left, word, "left").join(right, base, "left")
    return joined.withColumn("close", F.coalesce(cosine(F.col(f"_{word}"), F.col(f"_{base}")) >= CLOSE, F.lit(False))).drop(f"_{word}", f"_{base}")


def suffix_steps(words: DataFrame, level: int, vectors: DataFrame | None = None) -> DataFrame:
    """word, next for the words (word, pm, is_adj) that a suffix rule of the level takes to another known word. A word
    without a frequency is no base. Level 1 has inflections only, level 3 also undoes doubled consonants."""
    rules = [r for r in RULES if level > 1 or r[0] in INFLECTIONAL]
    tried = words.select("word", F.explode(_candidates(F.col("word"), rules, level == 3)).alias("c")).select("word", "c.*")
    tried = tried.filter("base <> word AND length(base) >= 3")
    known = words.filter("pm IS NOT NULL").select(F.col("word").alias("base"), F.col("pm").alias("base_pm"), F.col("is_adj").alias("base_adj"))
    met = _close(tried.join(known, "base"), vectors if level == 3 else None, "word", "base")
    good = F.when(F.col("doubled"), F.col("close")).when(F.col("comparative"), F.coalesce("base_adj", F.lit(False)) | F.col("close")).otherwise(True)
    return met.filter(good).groupBy("word").agg(F.min_by("base", F.struct("rule", (-F.col("base_pm")).alias("f"), "place")).alias("next"))


def prefix_steps(words: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """word, next for the words that begin with a safe prefix, or a guarded one before a base close in meaning."""
    word = F.col("word")
    options = [F.when(word.startswith(p), F.struct(F.lit(i).alias("rule"), F.substring(word, F.lit(len(p) + 1), F.length(word)).alias("base"), F.lit(p in GUARDED_PREFIXES).alias("guarded"))) for i, p in enumerate((*SAFE_PREFIXES, *GUARDED_PREFIXES))]
    tried = words.select("word", F.explode(F.array_compact(F.array(*options))).alias("c")).select("word", "c.*").filter("length(base) >= 3")
    known = words.filter("pm IS NOT NULL").select(F.col("word").alias("base"))
    met = _close(tried.join(known, "base"), vectors, "word", "base").filter("close OR NOT guarded")
    return met.groupBy("word").agg(F.min_by("base", "rule").alias("next"))


def almost_prefix(word: Column, base: Column) -> Column:
    """Whether word begins with base, its last letter aside."""
    return word.startswith(F.substring(base, F.lit(1), F.greatest(F.length(base) - 1, F.lit(0))))


def derivation_steps(words: DataFrame, derivations: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """word, next: the most frequent derivation (word, target) that is more frequent, common, near in form and close."""
    own = words.select("word", F.coalesce("pm", F.lit(0.0)).alias("own"))
    base = words.filter("pm IS NOT NULL").select(F.col("word").alias("target"), F.col("pm").alias("target_pm"))
    met = derivations.filter("word <> target").distinct().join(own, "word").join(base, "target")
    met = met.filter((F.col("target_pm") > F.col("own")) & (F.col("target_pm") >= MIN_BASE_PM) & almost_prefix(F.col("word"), F.col("target")))
    return _close(met, vectors, "word", "target").filter("close").groupBy("word").agg(F.min_by("target", F.struct((-F.col("target_pm")).alias("f"), "target")).alias("next"))


def steps(words: DataFrame, level: int, vectors: DataFrame | None = None, derivations: DataFrame | None = None) -> DataFrame:
    """word, next: at level 3 the suffix step, else the prefix step, else the derivation step."""
    found = suffix_steps(words, level, vectors)
    if level < 3:
        return found
    order = [found.withColumn("o", F.lit(0)), prefix_steps(words, vectors).withColumn("o", F.lit(1))]
    if derivations is not None:
        order.append(derivation_steps(words, derivations, vectors).withColumn("o", F.lit(2)))
    out = order[0]
    for more in order[1:]:
        out = out.unionByName(more)
    return out.groupBy("word").agg(F.min_by("next", "o").alias("next"))


def two_steps(step: DataFrame) -> DataFrame:
    """word, first, second: the step of each word and the one after it (null if there is none)."""
    after = step.select(F.col("word").alias("first"), F.col("next").alias("second"))
    return step.withColumnRenamed("next", "first").join(after, "first", "left").select("word", "first", "second")


def roots(words: DataFrame, two: DataFrame, most: int = MAX_STEPS) -> DataFrame:
    """word, root (itself if no step applies): steps followed at most `most` times, two at a time; a cycle ends before it
    repeats. two: the table of two_steps(), written if it is dear."""
    path = words.select("word", F.col("word").alias("_0"))
    for k in range(0, most, 2):
        path = path.join(two.select(F.col("word").alias(f"_{k}"), F.col("first").alias(f"_{k + 1}"), F.col("second").alias(f"_{k + 2}")), f"_{k}", "left")
    way = [F.col(f"_{k}") for k in range(most + 1)]
    root, open_ = way[0], F.lit(True)
    for k in range(1, most + 1):  # the way goes on as long as there is a step to a word that isn't on it yet
        open_ = open_ & way[k].isNotNull() & ~F.coalesce(way[k].isin(*way[:k]), F.lit(False))
        root = F.when(open_, way[k]).otherwise(root)
    return path.select("word", root.alias("root"))


def families(words: DataFrame, rooted: DataFrame) -> DataFrame:
    """root, pm, pm_lc, n_members of the families of at least two words; unknown frequencies add 0."""
    joined = rooted.join(words.select("word", "pm", "pm_lc"), "word")
    found = joined.groupBy("root").agg(F.sum(F.coalesce("pm", F.lit(0.0))).alias("pm"), F.sum(F.coalesce("pm_lc", F.lit(0.0))).alias("pm_lc"), F.count("*").alias("n_members"))
    return found.filter("n_members >= 2")
