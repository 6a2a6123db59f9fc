"""Pronunciations: syllables, stress and rhyme of a list of phones such as AE1 B AH0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def syllables(phones: Column) -> Column:
    return F.size(F.filter(phones, lambda p: p.rlike(r"\d")))


def stress(phones: Column) -> Column:
    return F.regexp_replace(F.array_join(phones, ""), r"[^0-9]", "")


def rhyme_key(phones: Column) -> Column:
    """The phones from the last primary stress on (else from the last vowel), without digits; null without a vowel."""
    back = F.reverse(phones)
    primary = F.array_position(F.transform(back, lambda p: p.endswith("1")), True)
    vowel = F.array_position(F.transform(back, lambda p: p.rlike(r"\d")), True)
    n = F.when(primary > 0, primary).otherwise(vowel).cast("int")
    return F.when(n > 0, F.regexp_replace(F.array_join(F.slice(phones, -n, n), " "), r"\d", ""))
