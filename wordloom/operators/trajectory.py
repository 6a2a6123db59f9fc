"""Usage over time: per-decade frequencies, eras, obsolete words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RARE_PM, RECENT_FROM, FIRST_DECADE, DEFAULT_END = 0.10, 1980, 1800, 2000
ERA_LABELS = {"ahead": "ahead of its time", "rising": "on the rise", "of": "of its time", "after": "declining", "timeless": "timeless", "rare": "always rare"}


def era_label(era: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ERA_LABELS.items() for x in pair])[era]


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def trajectories(usage: DataFrame, first: int = FIRST_DECADE) -> DataFrame:
    """word, decade, pm of usage (word, year, count): counts of a decade against all of that decade."""
    by = usage.withColumn("decade", decade(F.col("year"))).filter(F.col("decade") >= first).groupBy("word", "decade").agg(F.sum("count").alias("n"))
    totals = by.groupBy("decade").agg(F.sum("n").alias("total"))  # a row a decade
    return by.join(F.broadcast(totals), "decade").select("word", "decade", (F.col("n") / F.col("total") * 1e6).alias("pm"))


def last_decade(traj: DataFrame) -> DataFrame:
    return traj.agg(F.coalesce(F.max("decade"), F.lit(DEFAULT_END)).alias("corpus_end"))


def summarise(traj: DataFrame, keys: list[str], book_decade: Column, end: Column) -> DataFrame:
    """keys, era, obsolete: each key's trajectory (decade, pm) judged by book_decade and the corpus's end, both constant
    for a key. One aggregation; nothing is collected."""
    pm, d = F.col("pm"), F.col("decade")
    at = F.least(book_decade, end)
    mean = lambda when: F.avg(F.when(when, pm))
    found = traj.withColumns({"_at": at, "_raw": book_decade, "_end": end}).groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(pm).alias("peak"), F.max_by(pm, d).alias("last"),
        F.sort_array(F.collect_list(F.struct(d, pm)), asc=False).alias("points"),  # at most one for each decade
        mean(d.between(F.col("_at") - 10, F.col("_at") + 10)).alias("around"), mean(d <= F.col("_at") - 20).alias("before"), mean(d >= F.col("_at") + 20).alias("later"),
        F.max(F.when(d >= RECENT_FROM, pm)).alias("recent"), F.first("_raw").alias("raw"), F.first("_end").alias("end"),
    )
    around = F.coalesce("around", F.lit(0.0))
    before, later = F.coalesce(F.col("before"), around), F.coalesce(F.col("later"), around)
    high, low = F.greatest(before, around, later), F.least(before, around, later)
    previous = F.try_element_at("points", F.lit(2))["pm"]
    rising = (F.col("raw") >= F.col("end")) & (F.col("last") > previous * 1.15) & (F.col("last") >= F.col("peak") * 0.90)
    era = (
        F.when(F.col("raw").isNull() | (F.col("n") < 3), None).when(F.col("peak") < RARE_PM, "rare").when(rising, "rising")
        .when((high <= 0) | ((high - low) / high < 0.25), "timeless").when((around >= before) & (around >= later), "of")
        .when(later > before, "ahead").otherwise("after")
    )
    recent = F.coalesce("recent", F.lit(0.0))
    obsolete = (F.col("n") >= 3) & (F.col("peak") >= RARE_PM) & (recent < RARE_PM) & (recent < 0.15 * F.col("peak"))
    return found.select(*keys, era.alias("era"), obsolete.alias("obsolete"))


def usage_chart(traj: DataFrame, book_decade: Column) -> DataFrame:
    """traj (word, decade, pm) with bar (height of 0 to 1) and marker (where the book stands between the word's first
    and last decade)."""
    w = W.partitionBy("word")
    first, last = F.min("decade").over(w), F.max("decade").over(w)
    place = F.when(last > first, (book_decade - first) / (last - first)).otherwise(0.0)
    return traj.withColumn("bar", F.coalesce(F.try_divide(F.col("pm"), F.max("pm").over(w)), F.lit(0.0))).withColumn("marker", F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)))


def gated_words(words: DataFrame, occurrences: DataFrame, stems: DataFrame) -> DataFrame:
    """word: the words whose usage is worth charting: those of letters that some book has, and the roots (word, root)
    of such; ASCII only."""
    own = words.filter("alpha_only").join(occurrences.select(F.col("token").alias("word")), "word", "left_semi").select("word")
    rooted = stems.join(own, "word", "left_semi").select(F.col("root").alias("word"))
    return own.unionByName(rooted).distinct().filter(F.col("word").rlike(r"^[\x00-\x7F]+$"))
