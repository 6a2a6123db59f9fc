"""Operators on small tables."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.operators import catalog, frequency, graph, lemma, scoring, segments, tags, trajectory, vectors
from wordloom.plans.words import POS_ORDER, pos_arranged, primary_pos


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_case_folded(spark):
    df = spark.createDataFrame([("The", 3), ("the", 7), ("run_VERB", 9), ("x", None)], "token string, n long")
    out = frequency.per_million(frequency.case_folded(df, count=F.col("n")), spark.createDataFrame([(100,)], "total long"))
    ((token, count, lower, caps, pm, pm_lc),) = rows(frequency.positional_rank(out).select("token", "count", "count_lc", "cap_ratio", "pm", "pm_lc"))
    assert (token, count, lower, caps, pm) == ("the", 10, 7, 0.3, 100000.0) and pm_lc == pytest.approx(70000)


def test_positional_rank_is_a_permutation(spark):
    df = spark.createDataFrame([(f"w{i % 17}x{i}", i % 5) for i in range(200)], "token string, count int")
    ranked = sorted(frequency.positional_rank(df).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 201))
    assert [(-r["count"], r["token"]) for r in ranked] == sorted((-r["count"], r["token"]) for r in ranked)


def words(spark, *entries):
    return spark.createDataFrame([(w, float(pm), bool(adj)) for w, pm, adj in entries], "word string, pm double, is_adj boolean")


def test_lemma_levels(spark):
    w = words(spark, ("trembling", 1, 0), ("tremble", 2, 0), ("untrembling", 1, 0), ("importantly", 1, 0), ("important", 3, 1), ("darkness", 1, 0), ("dark", 5, 1), ("baker", 1, 0), ("bake", 4, 0), ("taller", 1, 0), ("tall", 2, 1), ("hatter", 1, 0), ("hat", 9, 0), ("hatt", 1, 0), ("illegal", 1, 1), ("legal", 5, 1), ("import", 5, 0), ("port", 9, 0))
    close = {"hatter": [1, 0], "hat": [1, 0], "illegal": [0, 1], "legal": [0, 1], "import": [1, 0], "port": [0, 1], "baker": [0, 1], "bake": [1, 0], "hatt": [0, 1]}
    v = spark.createDataFrame([(k, [float(x) for x in y]) for k, y in close.items()], "word string, vector array<float>")
    found = {n: dict(rows(lemma.roots(w, lemma.two_steps(lemma.steps(w, n, v))))) for n in (1, 2, 3)}
    assert found[1]["trembling"] == "tremble" and found[1]["taller"] == "tall" and found[1]["importantly"] == "importantly" and found[1]["baker"] == "baker"
    assert found[2]["importantly"] == "important" and found[2]["darkness"] == "dark" and found[2]["baker"] == "baker" and found[2]["untrembling"] == "untrembling"
    assert found[3]["untrembling"] == "tremble" and found[3]["illegal"] == "legal" and found[3]["import"] == "import" and found[3]["hatter"] == "hat" and found[3]["baker"] == "baker"


def test_lemma_cycle_ends(spark):
    w = words(spark, ("a", 1, 0), ("b", 1, 0))
    step = spark.createDataFrame([("a", "b"), ("b", "a")], "word string, next string")
    assert rows(lemma.roots(w, lemma.two_steps(step))) == [("a", "b"), ("b", "a")]


def test_derivations(spark):
    w = words(spark, ("desirous", 1, 0), ("desire", 9, 0), ("judicial", 1, 0), ("judge", 9, 0))
    d = spark.createDataFrame([("desirous", "desire"), ("judicial", "judge")], "word string, target string")
    v = spark.createDataFrame([(x, [1.0, 0.0]) for x in ("desirous", "desire", "judicial", "judge")], "word string, vector array<float>")
    assert rows(lemma.derivation_steps(w, d, v)) == [("desirous", "desire")]


def test_score(spark):
    df = spark.createDataFrame([(3, 0.01, 8, 3, "kz", "fa")], "n int, pm double, length int, syl int, rare string, ety string")
    out = df.select(*[c.alias(k) for k, c in scoring.parts(*map(F.col, df.columns)).items()]).first()
    assert (out["s_rarity"], out["s_origin"], out["s_aesthetic"]) == (2.0, 2.0, 2.0) and out["score"] == pytest.approx(6.831777, abs=1e-6)
    rarity = spark.createDataFrame([(None,), (0.0,), (12.0,), (0.01,), (1e-7,)], "pm double").coalesce(1).select(scoring.rarity(F.col("pm"))).collect()
    assert [r[0] for r in rarity] == [4.0, 5.0, 0.0, 2.0, 5.0]


@pytest.mark.parametrize(
    ("points", "book", "era", "obsolete"),
    [
        ({1800: 0.05, 1850: 1, 1900: 0.05}, 1851, "of", True), ({1800: 0.1, 1850: 0.1, 1950: 1}, 1851, "ahead", True), ({1800: 1, 1850: 0.1, 1950: 0.1}, 1851, "after", True),
        ({1800: 0.5, 1850: 0.5, 1900: 0.5}, 1851, "timeless", True), ({1800: 0.05, 1850: 0.05, 1900: 0.05}, 1851, "rare", False), ({1800: 1, 1850: 1}, 1851, None, False),
        ({1980: 0.2, 1990: 0.5, 2000: 1}, 2015, "rising", False), ({1800: 1, 1850: 0.5, 1900: 0.05}, 1851, "after", True),
    ],
)
def test_eras(spark, points, book, era, obsolete):
    t = spark.createDataFrame([("w", d, float(p)) for d, p in points.items()], "word string, decade int, pm double")
    assert trajectory.summarise(t, ["word"], trajectory.decade(F.lit(book)), F.lit(2000)).first()[1:] == (era, obsolete)


def test_exclusions_are_a_partition(spark):
    w = spark.createDataFrame(
        [("good", True, 0.1, 1.0, 4, True, False), ("Caps", True, 0.9, 1.0, 4, True, False), ("ab", True, 0.0, 1.0, 2, True, False), ("common", True, 0.0, 99.0, 6, True, False), ("x-y", False, 0.0, 1.0, 2, True, False), ("rude", True, 0.0, 1.0, 4, True, True), ("odd", True, None, None, 3, False, False)],
        "word string, alpha_only boolean, cap_ratio double, pm_lc double, length int, in_wiktionary boolean, is_offensive boolean",
    ).withColumns({"is_form_of": F.lit(False), "is_proper": F.lit(False), "syllables": F.lit(2), "rare_letters": F.lit(None).cast("string"), "etymology_lang": F.lit("xx")})
    counts = spark.createDataFrame([("b", x, 2) for x in ("good", "Caps", "ab", "common", "x-y", "rude", "odd", "unknown")], "book string, token string, count long")
    kept = scoring.candidates(counts, w)
    why = dict((r["token"], r["why"]) for r in scoring.exclusion_reasons(counts, w, kept).collect())
    assert why == {"good": "", "Caps": "capitalised", "ab": "short", "common": "common", "x-y": "nonalpha", "rude": "offensive", "odd": "nowikt", "unknown": "nodict"}
    assert kept.count() + sum(1 for v in why.values() if v) == counts.count()


def test_tag_changes(spark):
    t = spark.createDataFrame([("b1", "w", "t", None), ("b2", "w", "t", 0), ("b1", "v", "t.x", 3)], "book string, word string, tag string, value int")
    assert rows(tags.to_word_scope(t, "t").select("book", "word", "tag", "value")) == [("*", "w", "t", 1), ("b1", "v", "t.x", 3)]
    assert {r["tag"] for r in tags.rename_tag(t, "t", "u").collect()} == {"u", "u.x"}
    assert tags.delete_tag(t, "t").count() == 0
    with pytest.raises(ValueError):
        tags.rename_tag(t, "star", "x")
    with pytest.raises(ValueError):
        tags.rename_tag(t, "t", "t.y")
    assert tags.set_tag(t, "b2", "w", "t", False).count() == 2
    assert tags.set_value(t, "b2", "w", "t", 9, 5).filter("book = 'b2'").first()["value"] == 5
    assert tags.clamp_levels(t, "t.x", 2).filter("tag = 't.x'").first()["value"] == 2
    everywhere = tags.to_word_scope(t, "t")
    occurrences = spark.createDataFrame([("b7", "w"), ("b8", "w")], "book string, word string")
    assert {r["book"] for r in tags.to_book_scope(everywhere, "t", occurrences).filter("tag = 't'").collect()} == {"b7", "b8"}
    defs = spark.createDataFrame([("a", "old")], "name string, comment string")
    new = spark.createDataFrame([("a.b.c", "x"), ("a", None)], "name string, comment string")
    assert rows(tags.add_definitions(defs, new).fillna("")) == [("a", "old"), ("a.b", ""), ("a.b.c", "x")]


def test_pos_sections(spark):
    items = spark.createDataFrame([("k", w, p, i) for i, (w, p) in enumerate([("n1", "noun"), ("n2", "noun"), ("n3", "noun"), ("v1", "verb"), ("x1", None)])], "key string, word string, pos string, rank int")
    out = sorted(pos_arranged(items, "key", "rank", 2).select("place", "section", "word").collect())
    assert [(r["section"], r["word"]) for r in out] == [("nouns", "n1"), ("nouns", "n2"), ("verbs", "v1"), ("nouns", "n3"), ("other (1)", "x1")]
    pos = spark.createDataFrame([("round", "prep", "wordnet"), ("round", "noun", "wordnet"), ("round", "verb", "wiktextract")], "word string, pos string, source string")
    assert primary_pos(pos).first()["pos"] == "noun" and POS_ORDER[0] == "noun"


def test_catalog(spark):
    c = spark.createDataFrame([("s", 1, "Whale", "A", "Sea; Ships"), ("s", 2, "The Whale", "B", "Seas"), ("s", 3, None, "Whale Man", None)], "source string, source_id int, title string, author string, subjects string").withColumns({"year": F.lit(1900), "n_words": F.lit(1)})
    assert [r["source_id"] for r in catalog.search(c, "whale").collect()] == [1, 2, 3]
    assert [r["source_id"] for r in catalog.search(c, subject="sea").collect()] == [1]
    assert [r["source_id"] for r in catalog.search(c, subject="sea", subject_mode="substring").collect()] == [2, 1]
    with pytest.raises(ValueError):
        catalog.upsert(c, c.limit(0), ["source", "source_id"])
    assert rows(catalog.first_seen(spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "id string, page int, v string"), "id", "page")) == [("a", 1, "x")]


def test_lexical_links(spark):
    w = spark.createDataFrame([(1, "joy"), (2, "joyous")], "wordid int, lemma string")
    links = spark.createDataFrame([(2, 1, 81), (1, 2, 5)], "word1id int, word2id int, linkid int")
    types = spark.createDataFrame([(81, "derivation"), (5, "other")], "linkid int, link string")
    assert rows(graph.lexical_links(w, links, types)) == [("joyous", "derivation", "joy")]


def test_varied_choice():
    x = np.random.default_rng(0).normal(size=(200, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    picks = vectors.varied(x)
    sims = x[picks] @ x[picks].T - 2 * np.eye(len(picks))
    assert picks[0] == 0 and len(picks) <= 20 and sims.max() < 0.55
    assert vectors.varied(x[picks[2] + 1 :], before=x[picks[:3]]) == [p - picks[2] - 1 for p in picks[3:]]


def vector_table(spark, groups):
    rows = [(g, i, i, [float(v) for v in x]) for g, xs in groups.items() for i, x in enumerate(xs)]
    rows += [("none", 1, 1, None), ("none", None, 2, [1.0] * 4)]
    return spark.createDataFrame(rows, "g string, id long, rank long, vector array<double>")


@pytest.mark.parametrize("block", [1, 5, 64])
def test_clusters_and_picks(spark, block):
    rng = np.random.default_rng(1)
    near = np.concatenate([c + 0.05 * rng.normal(size=(30, 4)) for c in np.eye(4)])
    groups = {"a": rng.normal(size=(120, 4)), None: near, "one": np.ones((1, 4)), "same": np.ones((9, 4)), "zero": np.zeros((3, 4))}
    df = vector_table(spark, groups)
    picks = {}
    for r in vectors.varied_picks(df, ["g"], top=6, block=block).collect():
        picks.setdefault(r["g"], []).append(r["rank"])
    unit = {g: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0) for g, x in groups.items()}
    assert {g: sorted(p) for g, p in picks.items()} == {g: vectors.varied(x, top=6) for g, x in unit.items()}
    if block > 1:
        return
    found = vectors.clusters_and_picks(df, ["g"], k=4, top=6)
    assert found.columns == ["g", "id", "rank", "cluster", "selected"] and found.count() == df.count()
    got = {}
    for r in found.filter("cluster IS NOT NULL").collect():
        got.setdefault(r["g"], {})[r["id"]] = r["cluster"]
    assert {g: len(x) for g, x in got.items()} == {g: len(x) for g, x in groups.items()}
    assert len(set(got["same"].values())) == 1 and set(got["a"].values()) <= set(range(4))
    assert len({tuple(got[None][i] for i in range(k, k + 30)) for k in range(0, 120, 30)}) == 4 and all(len({got[None][i] for i in range(k, k + 30)}) == 1 for k in range(0, 120, 30))
    assert vectors.clusters_and_picks(df.limit(0), ["g"]).count() == 0


def test_clusters_of_one_large_group(spark):
    """A label of 100,000 rows is summed in many tasks, and comes to rest."""
    points = spark.range(100_000, numPartitions=16).select(
        F.lit(1).alias("g"), "id", F.array(*[F.when(F.col("id") % 3 == k, 10.0).otherwise(0.0) + F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000 for k in range(3)]).alias("vector")
    )
    found = vectors.sphere_clusters(points, ["g"], k=3).withColumn("k", F.col("id") % 3).groupBy("k", "cluster").count().collect()
    assert len(found) == 3 and len({r["cluster"] for r in found}) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Produced by X\n\n", "CONTENTS\n", "Chapter 1\n", "II. The sea 12\n", "prose line\n", "\n", "Transcriber's Note\n", "*SMALL PRINT! a\nEND SMALL PRINT*\n", "End of the Project Gutenberg EBook\n", "x" * 80 + "\n"]), max_size=25))
def test_segments_make_up_the_body(lines):
    body = "".join(lines)
    assert "".join(s[2] for s in segments.body_segments(body)) == body


def test_segment_labels():
    toc = "A Title\n\nCONTENTS\n\nChapter 1\nChapter 2\n\nIt was night.\n"
    assert [s[:2] for s in segments.body_segments(toc)] == [("body", True), ("toc", False), ("body", True)]
    assert [s[0] for s in segments.body_segments("Produced by Me\n\nText.\n\nTranscriber's Note: x")] == ["credits", "body", "transcriber-note"]
    assert [s[0] for s in segments.body_segments("THE FULL PROJECT GUTENBERG LICENSE")] == ["body"]


def test_page_runs(spark):
    full = "w " * 20
    pages = spark.createDataFrame([("b", i, t) for i, t in enumerate([full, full, "", None, full])], "book string, page int, text string")
    runs = segments.page_runs(pages)
    assert [tuple(r)[2:] for r in runs.orderBy("run").collect()] == [(True, 0, 1), (False, 2, 3), (True, 4, 4)]
    assert segments.has_text_layer(runs).first()["has_text_layer"]
    many = spark.createDataFrame([("b", i) for i in range(100)], "book string, page int")
    picked = [r["page"] for r in segments.even_sample(many, 5).orderBy("page").collect()]
    assert len(picked) == 5 and picked[0] == 5 and picked[-1] == 94


def test_layouts_and_shuffles(spark):
    defs = spark.createDataFrame([("s", "a", "x", 1), ("s", "b", "y", 2), ("s", "c", "x", 3)], "scope string, name string, section string, ord int")
    assert [r["name"] for r in tags.section_order(defs).orderBy("place").collect()] == ["a", "c", "b"]
    moved = tags.set_layout(defs, spark.createDataFrame([("b", 0, "z")], "name string, ord int, section string"))
    assert [r["name"] for r in tags.section_order(moved).orderBy("place").collect()] == ["b", "a", "c"]
    once, again, other = ([r["name"] for r in tags.shuffled(defs, "name", s).collect()] for s in (1, 1, 2))
    assert once == again and sorted(once) == sorted(other) == ["a", "b", "c"]


def test_gated_words(spark):
    w = spark.createDataFrame([("cats", True), ("x-y", False), ("naïve", True), ("rare", True)], "word string, alpha_only boolean")
    seen = spark.createDataFrame([("cats",), ("x-y",), ("naïve",)], "token string")
    stems = spark.createDataFrame([("cats", "cat"), ("rare", "r")], "word string, root string")
    assert rows(trajectory.gated_words(w, seen, stems)) == [("cat",), ("cats",)]


def test_histogram_of_odd_texts(spark):
    """Texts of one order number, repeated ones, null books, orders and texts; a long sentence; a text travels once, and not as sentences."""
    long = "Lorem zip " + "filler words " * 40 + "target of it. "
    texts = [(3, "b", "A lamp. The lamp walks! Zebra?"), (1, "b", "No one. The lamp stood’s here. A\n lamp"), (1, "b", "One lamp."), (1, "b", "One lamp."), (None, None, "Zebra runs. Lamp"), (2, None, "Zebra"), (7, "b", None), (8, "c", ""), (9, "c", long * 3), (0, "d", "...  Last  one "), (5, "d", "Last")]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    counts, at = Counter(), {}
    for o, book, text in texts:
        for i, sentence in enumerate(re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", text or "").replace("’", "'"))):
            for token in re.findall(r"[a-z]+(?:['’-][a-z]+)*", sentence.lower()):
                counts[book, token] += 1
                at.setdefault((book, token), []).append((-1 if o is None else o, i, sentence.strip()))
    for few in (frequency.GATHERED, 2):
        kept, frequency.GATHERED = frequency.GATHERED, few
        try:
            found = frequency.histogram(docs)
            got = {(r["book"], r["token"]): r for r in found.collect()}
        finally:
            frequency.GATHERED = kept
        assert {k: r["count"] for k, r in got.items()} == counts and found.columns == ["book", "token", "count", "example"]
        for key, places in at.items():
            first = {s for *place, s in places if place == list(min(p[:2] for p in places))}
            example = got[key]["example"]
            assert example in first or any(len(s) > 280 and example.strip("…") in s and key[1] in example.lower() for s in first)
    assert frequency.firsts(docs.select(F.col("source").alias("book"), F.col("doc_id").alias("o"), F.xxhash64("text").alias("h"), "text").coalesce(1)).count() == len(counts)
    plan = frequency.histogram(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # tokens, their texts' lists, texts
