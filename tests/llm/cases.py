"""Small tables with everything awkward in them, and plain versions to compare with."""

import re

TEXTS = [
    (1, "The cat sat on the mat.\nShared line of many sites.\nThe end.", "en", "a"),
    (2, "THE CAT SAT ON THE MAT.\nShared line of many sites.\nThe end.", "en", "b"),
    (3, None, None, None),
    (4, "", "de", "a"),
    (5, " \t\n\x0b\x0c\r ", "de", ""),
    (6, "Größe über ÄÖÜ éàè 中文 😀 <|endoftext|> don't   stop\n\n", "fr", "c"),
    (7, "w " * 120, "en", "a"),
    (8, " ".join(f"word{i}" for i in range(90)), "en", "a"),
    (9, "lead in " + " ".join(f"word{i}" for i in range(90)) + " tail out", "en", "b"),
    (9, "lead in " + " ".join(f"word{i}" for i in range(90)) + " tail out", "en", "b"),
    (None, " ".join(f"word{i}" for i in range(90)), None, "a"),
    (10, "a" * 30000 + " " + "b c " * 20000, "en", "d"),
    (11, "one", "en", "e"),
    (12, "one", "en", "f"),
    (13, " ".join(f"word{i}" for i in range(89)) + " changed", "en", "g"),
]


def table(spark, texts=TEXTS, extra=True):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    if not extra:
        return df
    # Names that operators use for themselves or give their results.
    return df.selectExpr("*", "length(text) AS n_chars", "1 AS id", "2 AS row", "3 AS h", "'x' AS component_id", "4 AS size", "'y' AS score", "5 AS n_tokens", "6 AS kept", "7 AS n_removed", "8 AS _row", "9 AS `group`")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
