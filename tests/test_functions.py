"""Golden values of the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import catalog as C
from wordloom.functions import phones as P
from wordloom.functions import tags as G
from wordloom.functions import text as T
from wordloom.operators.frequency import token_counts
from wordloom.plans import tables as TB


def values(spark, f, *rows):
    """f of each row's columns a, b, ..."""
    names = "abcd"[: len(rows[0]) if isinstance(rows[0], tuple) else 1]
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.coalesce(1).select(f(*[F.col(n) for n in names])).collect()]


@pytest.mark.parametrize(
    ("f", "rows", "expected"),
    [
        (T.scrabble, ["quiz", "jukebox", "man-of-war"], [22, 27, None]),
        (T.rare_letters, ["quiz", "jukebox", "hello"], ["qz", "jkx", None]),
        (T.slugify, ["Moby-Dick; Or, The Whale", "--a--"], ["moby-dick-or-the-whale", "a"]),
        (lambda c: T.tokens(T.normalise(c)), ["Don’t stop—the man-of-war’s crew", "café naïve", ""], [["don't", "stop", "the", "man-of-war's", "crew"], ["caf", "na", "ve"], []]),
        (T.page_numbers, ["1,5,9-12", "2,1", "x"], [[0, 4, 8, 9, 10, 11], [0, 1], []]),
        (T.dehyphenate, ["ele-\nphant s­oft"], ["elephant soft"]),
        (T.clean_title, [' "A  \x93Title\x94" '], ["A “Title”"]),
        (T.letter_count, ["can't", "naïve"], [4, 5]),
        (
            C.normalize_author,
            ["Dickens, Charles, 1812-1870 [Author of introduction, etc.]", "Alger, Horatio, Jr.", "Marie, de France, active 12th century", "Tacitus, Cornelius, 56-117", "Various", "A, B; C, D, 107 BCE-44 BCE", None],
            ["Charles Dickens", "Horatio Alger, Jr.", "Marie de France", "Cornelius Tacitus", "Various", "B A; D C", ""],
        ),
        (G.ancestor_names, ["a.b.c", "a", "pick:noun.food"], [["a", "a.b"], [], []]),
        (G.sanitize_tag, [" Thing.Material ", "pick", "star.x", "star", "123", "a.b.c.d.e", "x" * 31], ["thing.material", None, None, "star", None, None, None]),
        (lambda c: C.number_before(c, "words"), ["12,345 words; 70.5 reading ease", "none"], [12345.0, None]),
        (lambda c: C.iso_utc(c.cast("long")), ["0", "951782400"], ["1970-01-01T00:00:00Z", "2000-02-29T00:00:00Z"]),
        (lambda c: C.ago(c.cast("long")), ["90", "91", "7200", "172800"], ["just now", "1 minute ago", "2 hours ago", "2 days ago"]),
        (lambda c: C.commas(c.cast("long")), ["14207"], ["14,207"]),
        (C.mirror_path, ["1342", "7"], ["1/3/4/1342/", "0/7/"]),
        (C.download_path, ["/ebooks/a-b/c"], ["/ebooks/a-b/c/downloads/a-b_c.epub"]),
        (lambda c: P.syllables(F.split(c, " ")), ["AE1 B AH0 K AH0 S"], [3]),
        (lambda c: P.stress(F.split(c, " ")), ["AE1 B AH0 K AH0 S"], ["100"]),
        (lambda c: P.rhyme_key(F.split(c, " ")), ["AE1 B AH0 K AH0 S", "B AH0 K", "S T"], ["AE B AH K AH S", "AH K", None]),
    ],
)
def test_golden(spark, f, rows, expected):
    assert values(spark, f, *rows) == expected


def test_window_around(spark):
    long = "x " * 300 + "whale " + "y " * 300
    (short, snippet, missing) = values(spark, T.window_around, ("A whale.", "whale"), (long, "whale"), (long, "absent"))
    assert short == "A whale."
    assert "whale" in snippet and snippet.startswith("…") and snippet.endswith("…") and len(snippet) <= 282
    assert missing == ("x " * 140).rstrip() + "…"


def test_highlight(spark):
    assert values(spark, T.highlight, ("Whale whales WHALE", "whale")) == ["[Whale] whales [WHALE]"]


def test_tag_states(spark):
    df = spark.createDataFrame([(None,), (0,), (3,)], "v int").coalesce(1)
    assert [tuple(r) for r in df.select(G.applied(F.col("v")), G.tag_level(F.col("v")), G.value_code(F.col("v"))).collect()] == [(True, None, -1), (False, None, 0), (True, 3, 3)]


def test_counts_leave_white_space_alone(spark):
    """Tokens are the same with and without white space made one, so counts don't ask for it."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(" \t\n\x0b\f\r\x85\u2028  aBz'’-.!ÉKİ") for _ in range(rng.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = F.replace(F.regexp_replace("text", r"\s+", " "), F.lit("’"), F.lit("'"))
    assert df.filter((T.normalise(F.col("text")) != plain) | (T.tokens(T.plain_apostrophes(F.col("text"))) != T.tokens(plain))).count() == 0
    plan = token_counts(df.withColumn("book", F.lit("b")), ["book"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_replace" not in plan


def test_usage_reads_texts_once(spark):
    """Decades' totals and words' counts come from one written table, not each from the documents."""
    plan = TB.usage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Relation") == 2
