"""Column expressions over text: tokens, sentences, snippets, hashes, word shape. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([a-z]+(?:['’-][a-z]+)*)"
SURFACE = r"([A-Za-z]+(?:['-][A-Za-z]+)*)"
SENTENCE_END = r"(?<=[.!?])\s+"
EXAMPLE_CHARS = 280

# Tile points by letter, and the letters that count as rare.
TILE_POINTS = {"a": 1, "b": 3, "c": 3, "d": 2, "e": 1, "f": 4, "g": 2, "h": 4, "i": 1, "j": 8, "k": 5, "l": 1, "m": 3, "n": 1, "o": 1, "p": 3, "q": 10, "r": 1, "s": 1, "t": 1, "u": 1, "v": 4, "w": 4, "x": 8, "y": 4, "z": 10}
RARE_LETTERS = ("j", "k", "q", "x", "z")
# What the bytes 0x80-0x9F of Windows text mean where they were read as control characters.
WINDOWS_CONTROLS = ("\x85\x91\x92\x93\x94\x96\x97", "…‘’“”–—")


def normalise(text: Column) -> Column:
    """White space runs as one space, typographic apostrophes as plain ones."""
    return plain_apostrophes(F.regexp_replace(text, r"[\t\n\x0B\f\r]\s*| \s+", " "))  # single spaces, the most, stay unmatched


def plain_apostrophes(text: Column) -> Column:
    """Typographic apostrophes as plain ones: all that tokens ask for, as white space of any kind parts them."""
    return F.replace(text, F.lit("’"), F.lit("'"))


def tokens(text: Column) -> Column:
    """The lower-case tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def surface_tokens(text: Column) -> Column:
    """The tokens of a text as they are written."""
    return F.regexp_extract_all(text, F.lit(SURFACE), F.lit(1))


def sentences(text: Column) -> Column:
    """The sentences of a text: parts between white space that follows . ! or ?"""
    return F.split(text, SENTENCE_END)


def window_around(sentence: Column, token: Column, most: int = EXAMPLE_CHARS) -> Column:
    """At most `most` characters of sentence around the first whole-word occurrence of token, cut sides marked …"""
    pattern = F.concat(F.lit(r"(?i)(?<![a-z])\Q"), token, F.lit(r"\E(?![a-z])"))
    start = F.regexp_instr(sentence, pattern) - 1
    half = F.greatest(F.lit(0), F.floor((F.lit(most) - F.length(token)) / 2))
    high = F.least(F.length(sentence), F.greatest(start - half, F.lit(0)) + most).cast("int")
    low = F.greatest(F.lit(0), high - most).cast("int")
    cut = F.trim(F.substring(sentence, low + 1, high - low))
    around = F.concat(F.when(low > 0, "…").otherwise(""), cut, F.when(high < F.length(sentence), "…").otherwise(""))
    return (
        F.when(F.length(sentence) <= most, sentence)
        .when(start < 0, F.concat(F.rtrim(F.substring(sentence, 1, most)), F.lit("…")))
        .otherwise(around)
    )


def content_hash(text: Column) -> Column:
    """sha256 of the tokens joined by spaces; apostrophes are taken as written."""
    return F.sha2(F.array_join(tokens(text), " "), 256)


def slugify(text: Column, most: int = 60) -> Column:
    """Lower case, other characters than a-z and 0-9 as single dashes, none at the ends, at most `most` long."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def alpha_only(word: Column) -> Column:
    return word.rlike("^[a-z]+$")


def letter_count(word: Column) -> Column:
    return F.length(F.regexp_replace(word, r"[^\p{L}]", ""))


def scrabble(word: Column) -> Column:
    """The tile points of an a-z word, else null."""
    points = F.create_map(*[F.lit(x) for pair in TILE_POINTS.items() for x in pair])
    return F.when(alpha_only(word), F.aggregate(F.split(word, ""), F.lit(0), lambda a, c: a + F.coalesce(points[c], F.lit(0))))


def rare_letters(word: Column) -> Column:
    """The distinct rare letters of a word in order, null if it has none."""
    found = F.array_sort(F.array_distinct(F.filter(F.split(word, ""), lambda c: c.isin(*RARE_LETTERS))))
    return F.when(F.size(found) > 0, F.array_join(found, ""))


def vowel_groups(word: Column) -> Column:
    """A stand-in for syllables where no pronunciation is known: runs of vowels."""
    return F.regexp_count(word, F.lit("[aeiouy]+"))


def word_shape(word: Column) -> dict[str, Column]:
    """The shape columns of a headword."""
    return {
        "char_len": F.length(word).cast("long"),
        "length": letter_count(word).cast("long"),
        "n_tokens": F.size(F.filter(F.split(word, r"\s+"), lambda x: x != "")).cast("long"),
        "is_phrase": F.contains(word, F.lit(" ")),
        "alpha_only": alpha_only(word),
        "scrabble": scrabble(word).cast("long"),
        "rare_letters": rare_letters(word),
    }


def fix_mojibake(text: Column) -> Column:
    return F.translate(text, *WINDOWS_CONTROLS)


def clean_title(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.btrim(F.trim(fix_mojibake(text)), F.lit('"'))), r"\s+", " ")


def dehyphenate(text: Column) -> Column:
    """Words that a line end divides are joined; soft hyphens go."""
    return F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), r"(\w)-[ \t]*\n[ \t]*(\w)", "$1$2")


def highlight(text: Column, word: Column, left: str = "[", right: str = "]") -> Column:
    """text with each whole-word occurrence of word, in any case, between marks."""
    pattern = F.concat(F.lit(r"(?i)(?<![a-z])(\Q"), word, F.lit(r"\E)(?![a-z])"))
    return F.regexp_replace(text, pattern, F.lit(f"{left}$1{right}"))


def page_numbers(spec: Column) -> Column:
    """The 0-based pages of a specification like '1,5,9-12', in order, without repeats."""
    def part(p: Column) -> Column:
        ends = F.split(F.trim(p), "-")
        first = F.try_element_at(ends, F.lit(1)).try_cast("int")
        last = F.coalesce(F.try_element_at(ends, F.lit(2)).try_cast("int"), first)
        return F.when(first.isNotNull() & (last >= first), F.sequence(first - 1, last - 1)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), part))))
