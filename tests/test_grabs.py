"""A batch of catalogue rows against a walk along it."""

import hashlib
import re

from wordloom.operators import grabs as GR
from wordloom.plans.library import grab_tables

SF = "/root/testdata/sf0.001"


def slug_of(name):
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", name.lower()))[:60]


def words_hash(text):
    return hashlib.sha256(" ".join(re.findall("[a-z]+(?:['’-][a-z]+)*", text.lower())).encode()).hexdigest()


def walk(items, catalog, books, texts):
    """The outcomes, one item after another, and the library after."""
    titles, files = {(r["source"], r["source_id"]): r["title"] for r in catalog}, {(r["source"], r["source_id"]): r["text"] for r in texts if r["text"] is not None}
    own = {r["book"]: [r["source"], r["source_id"], r["content_hash"]] for r in books}
    out = []
    for r in sorted(items, key=lambda r: r["place"]):
        key = (r["source"], r["source_id"])
        there = min((b for b, (s, i, _) in own.items() if (s, i) == key), default=None)
        if key not in titles:
            out.append((r["place"], "failed", None, GR.UNKNOWN, False))
        elif there:
            out.append((r["place"], "skipped", there, GR.HAVE, False))
        elif key not in files:
            out.append((r["place"], "failed", None, GR.NO_FILE, False))
        elif same := min((b for b, (*_, h) in own.items() if h == words_hash(files[key])), default=None):
            out.append((r["place"], "skipped", same, GR.SAME, claims := not own[same][1]))
            if claims:
                own[same][:2] = key
        else:
            base = {"gutenberg": f"gutenberg-{key[1]}", "standardebooks": "se-" + slug_of(key[1].replace("/", "-"))}.get(key[0], slug_of(titles[key] or key[1]) or "book")
            name, n = base, 1
            while name in own:
                n += 1
                name = f"{base}-{n}"
            own[name] = [*key, words_hash(files[key])]
            out.append((r["place"], "imported", name, None, False))
    return out, sorted((b, s, i) for b, (s, i, _) in own.items())


def both(items, catalog, books, texts):
    done = GR.grabbed(items, catalog, books, texts)
    got = sorted(tuple(r) for r in done.select("place", "outcome", "slug", "reason", "claims").collect())
    after = sorted(tuple(r) for r in GR.with_grabbed(books, catalog, done).select("book", "source", "source_id").collect())
    return got, after, done


def test_a_walk_gives_the_same(spark):
    tables = grab_tables(spark, SF)
    got, after, _ = both(*tables)
    want, library = walk(*[t.collect() for t in tables])
    assert got == want and after == sorted(library, key=lambda r: (r[0], r[1], r[2] or ""))
    assert {r[1] for r in got} == {"imported", "skipped", "failed"} and any(r[4] for r in got) and any(r[1] == "imported" and re.fullmatch(r"src\d+-\d+", r[2]) for r in got)


def test_names_nulls_and_failures(spark):
    """Names with numbers of their own, gaps, no title, repeated rows, null ids; a batch of nothing but failures."""
    catalog = [("x", str(i), t, "a", 1850) for i, t in enumerate(["A", "a!", "A", "A 3", "", None, "…"])]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cat = frame(catalog + catalog[:1], "source string, source_id string, title string, author string, year int")
    books = frame([("a-2", "x", "77", "h", "t"), ("b", None, None, words_hash("Same words"), None)], "book string, source string, source_id string, content_hash string, title string")
    texts = frame([("x", str(i), f"text {chr(97 + i)}") for i in range(6)] + [("x", "6", "same WORDS"), ("x", "0", None)], "source string, source_id string, text string")
    items = frame([(i, "x", str(i)) for i in range(7)] + [(7, "x", "0"), (7, "x", "0"), (8, None, "1"), (9, "x", None), (10, "x", "6"), (None, "x", "1")], "place int, source string, source_id string")
    got, after, done = both(items, cat, books, texts)
    assert [r[2] for r in got[:7]] == ["a", "a-4", "a-5", "a-3", "4", "5", "b"] and got[6][4]
    assert [r[1:4] for r in got[7:]] == [("skipped", "a", GR.HAVE)] * 2 + [("failed", None, GR.UNKNOWN)] * 2 + [("skipped", "b", GR.HAVE)]
    assert ("b", "x", "6") in after and len(after) == 8
    assert GR.grab_summary(done).first()["code"] == "PARTIAL"
    none = GR.grabbed(items.filter("source IS NULL"), cat, books, texts)
    assert tuple(GR.grab_summary(none).select("n", "n_failed", "ok", "code", "first_failure").first()) == (1, 1, False, "ALL_FAILED", GR.UNKNOWN)
    empty = GR.grab_summary(GR.grabbed(items.limit(0), cat, books, texts)).first()
    assert empty["ok"] and empty["n"] == 0 and empty["code"] is None
