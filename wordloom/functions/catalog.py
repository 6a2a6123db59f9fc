"""Catalogue fields: authors, numbers in prose, links, file names, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_YEAR = r"\d{1,4}\s*\??\s*(?:BCE|BC|CE|AD)?"
_SUFFIXES = (
    r"\s*\[[^\]]*\]\s*$",
    rf"(?i),\s*(?:{_YEAR}\s*-\s*(?:{_YEAR})?|-\s*{_YEAR})\s*$",
    r"(?i),\s*(?:active|fl\.?|approximately|ca\.?)\s+[^,]*$",
)


def normalize_author(raw: Column) -> Column:
    """'Surname, Given, Tail, 1812-1870 [Role]; ...' in reading order: 'Given Surname, Tail; ...'. Roles, life dates
    and 'active ...' go, in this order. A lower-case second part is an epithet and stays behind the name."""

    def one(part: Column) -> Column:
        name = F.trim(part)
        for suffix in _SUFFIXES:
            name = F.regexp_replace(name, suffix, "")
        pieces = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
        first, second = F.try_element_at(pieces, F.lit(1)), F.try_element_at(pieces, F.lit(2))
        turned = F.when(second.rlike(r"^\p{Ll}"), F.concat_ws(" ", first, second)).otherwise(F.concat_ws(" ", second, first))
        return F.when(F.size(pieces) < 2, first).otherwise(F.concat_ws(", ", F.array(turned), F.slice(pieces, F.lit(3), F.greatest(F.size(pieces) - 2, F.lit(0)))))

    return F.array_join(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), one), lambda p: p.isNotNull() & (p != "")), "; ")


def number_before(text: Column, words: str) -> Column:
    """The number, with or without commas, before some words, as in '12,345 words'."""
    return F.replace(F.regexp_extract(text, rf"([\d,.]+)\s*{words}", 1), F.lit(","), F.lit("")).try_cast("double")


def download_path(slug: Column) -> Column:
    """The file of an ebook at /ebooks/a/b: /ebooks/a/b/downloads/a_b.epub."""
    parts = F.split(F.regexp_replace(slug, "^/?ebooks/", ""), "/")
    return F.concat(F.lit("/ebooks/"), F.array_join(parts, "/"), F.lit("/downloads/"), F.array_join(parts, "_"), F.lit(".epub"))


def mirror_path(number: Column) -> Column:
    """The numbered mirror folder of an ebook: 1342 is 1/3/4/1342/."""
    digits = number.cast("string")
    return F.concat(F.when(F.length(digits) == 1, F.lit("0/")).otherwise(F.concat(F.array_join(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""), "/"), F.lit("/"))), digits, F.lit("/"))


def safe_name(name: Column, most: int = 80) -> Column:
    return F.substring(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), 1, most)


def looks_wrong(content: Column, fmt: Column) -> Column:
    """Why a downloaded file can't be the book that was asked for; empty if it may be."""
    head = F.substring(F.ltrim(F.regexp_replace(F.substring(content, 1, 4096).cast("string"), r"^\s+", "")), 1, 1)
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty response")
        .when((fmt == "epub") & (F.substring(content, 1, 2) != F.lit(b"PK")), "not a zip (epub) — probably an error or interstitial page")
        .when((fmt == "txt") & (head == "<"), "looks like HTML, not plain text")
        .otherwise("")
    )


def title_of_file(path: Column) -> Column:
    """A title from a file's name: without folder and last extension, underscores as spaces."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.trim(F.replace(name, F.lit("_"), F.lit(" ")))


def shortened(text: Column, n: int) -> Column:
    """At most n characters of a text, with … where some are missing; null as empty."""
    return F.coalesce(F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text), F.lit(""))


def byline(author: Column, year: Column) -> Column:
    """Author and year as one line, either alone if the other is missing."""
    names = F.regexp_replace(F.trim(F.coalesce(author, F.lit(""))), "; ?", ", ")
    return F.concat_ws(" · ", F.nullif(names, F.lit("")), year.cast("string"))


def settings(lines: list[str], environment: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines as a dictionary, without comments and quotes; the environment's values come before them."""
    pairs = (line.partition("=") for line in lines if line.strip() and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, mark, v in pairs if mark} | environment


MASK = (1 << 32) - 1
# The start and the multiplier of a selection's digest, which names the job that fetches it.
DIGEST_START, DIGEST_FACTOR = 0xCBF29CE484222325, 0x1000000001B3


def digest(text: Column) -> Column:
    """A 64-bit multiply-and-xor hash of a text's UTF-8 bytes as 16 hexadecimal digits: the short name of a selection.

    The product is taken in two halves of 32 bits, none of which passes a long. Null has none."""
    high, low = F.lit(DIGEST_START >> 32), F.lit(DIGEST_START & MASK)
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"))
    top, rest = DIGEST_FACTOR >> 32, DIGEST_FACTOR & MASK

    def step(h: Column, pair: Column) -> Column:
        own = h["low"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        product = own * F.lit(rest)
        above = (h["high"] * F.lit(rest) + F.shiftrightunsigned(product, 32) + own * F.lit(top)).bitwiseAND(F.lit(MASK))
        return F.struct(above.alias("high"), product.bitwiseAND(F.lit(MASK)).alias("low"))

    start = F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))
    return F.aggregate(pairs, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0"))))


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def ago(seconds: Column) -> Column:
    """An age in words."""
    def unit(n: Column, name: str) -> Column:
        n = F.floor(n)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (
        F.when(seconds <= 90, F.lit("just now"))
        .when(seconds < 3600, unit(seconds / 60, "minute"))
        .when(seconds < 86400, unit(seconds / 3600, "hour"))
        .otherwise(unit(seconds / 86400, "day"))
    )


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
