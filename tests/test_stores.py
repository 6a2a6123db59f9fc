"""Ranges, stores read by parts, and what is built on them: against plain versions, and by what is read and written."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from wordloom.operators import frequency, graph, lemma, pages, ranges, rescore, scoring, trigrams, word_index
from wordloom.sources import stores

WORDS = ["bright", "dim", "brighter", "brightest", "lamp", "lamps", "quiz", "zebra", "zebras", "of", "walking", "walk", "jazz", "oxen"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_placed(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(random.Random(k).choice(["a", "a", "a", "b", None]), k % 11 if k % 5 else None, "x") for k in range(300)] + [("a", 3, "x")] * 200
        df = spark.createDataFrame(data, "g string, v int, place string")
        got = ranges.placed(df.repartition(5), ["g"], [F.col("v").asc_nulls_first()], "at")
        groups = {}
        for g, v, _ in data:
            groups.setdefault(g, []).append(v)
        expected = [(g, v, "x", k) for g, vs in groups.items() for k, v in enumerate(sorted(vs, key=lambda v: (v is not None, v or 0)))]
        assert rows(got) == sorted(expected, key=str)
        assert ranges.placed(df.limit(0), ["g"], [F.col("v")]).count() == 0
        alone = ranges.placed(df, [], [F.col("v").desc_nulls_last(), F.col("g")], "at").collect()
        assert sorted(r["at"] for r in alone) == list(range(500))
        assert sorted(r["n"] for r in ranges.numbered(df.repartition(6), "n").collect()) == list(range(500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_task_ranks_a_whole_group(spark):
    """One word count, or one book, with nearly all rows: the largest part that is numbered is a range."""
    df = spark.range(20000).select(F.lit(1).alias("count"), F.col("id").cast("string").alias("token"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = frequency.positional_rank(df)
        held = [x.split("(")[0] for x in ranked._jdf.queryExecution().executedPlan().toString().splitlines() if "SinglePartition" in x]
        assert not held
        most = ranked.groupBy(F.expr("(rank - 1) div 1")).count().agg(F.max("count")).first()[0]
        assert most == 1 and ranked.agg(F.max("rank")).first()[0] == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_coordinates(members, hypernyms, freq, most):
    under = {(s, d, w, p) for s, d, w in members for t, p in hypernyms if s == t and None not in (s, d, w, p)}
    found = {}
    for s, d, w, p in under:
        found.setdefault(w, set()).update(x for t, e, x, q in under if (e, q) == (d, p) and t != s and x != w)
    return sorted(((w, t, k + 1) for w, ts in found.items() for k, t in enumerate(sorted(ts, key=lambda t: (-(freq.get(t) or 0.0), t))[:most])), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_coordinates(spark, seed):
    rng = random.Random(seed)
    members = [(rng.randrange(12), rng.randrange(2), f"w{rng.randrange(18)}") for _ in range(60)] + [(3, 1, None), (None, 1, "w1"), (4, None, "w2")]
    hypernyms = [(s, rng.randrange(3)) for s in range(12) for _ in range(rng.randrange(3))] + [(5, None)]
    freq = {f"w{k}": rng.choice([None, 1.0, 2.0, float(k)]) for k in range(14)}
    got = graph.coordinates(
        spark.createDataFrame(members, "synset long, domain int, word string"), spark.createDataFrame(hypernyms, "synset long, parent long"), spark.createDataFrame(list(freq.items()), "word string, pm double"), most=3
    )
    assert rows(got) == plain_coordinates(members, hypernyms, freq, 3)


def test_coordinates_of_a_hub(spark):
    """20,000 synsets under one parent: rows in proportion to them, not to their pairs."""
    n = 20000
    members = spark.range(n).select(F.col("id").alias("synset"), F.lit(1).alias("domain"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    up = spark.range(n).select(F.col("id").alias("synset"), F.lit(0).cast("long").alias("parent"))
    freq = members.select("word", F.col("synset").cast("double").alias("pm"))
    found = graph.coordinates(members, up, freq).cache()
    assert found.count() == 25 * n
    assert [r["target"] for r in found.filter("word = 'w19999'").orderBy("place").collect()] == [f"w{k}" for k in range(19998, 19973, -1)]
    found.unpersist()


def texts(rng, n):
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))).capitalize() + rng.choice(". ? ! ".split())
    return [(k, f"b{k % 5}", None if k == 7 else " ".join(line() for _ in range(rng.randrange(0, 6)))) for k in range(n)]


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame(texts(random.Random(5), 60), "doc_id long, source string, text string")
    words = spark.createDataFrame(
        [(w, 10 - k % 7, 0.1, float(k % 9), float(k % 5), "en" if k % 2 else "xx", len(w), True, None, k % 4, True, False, False, False, False) for k, w in enumerate(WORDS)],
        "word string, count int, cap_ratio double, pm double, pm_lc double, etymology_lang string, length int, alpha_only boolean, rare_letters string, syllables int, in_wiktionary boolean, is_form_of boolean, is_proper boolean, is_offensive boolean, is_adj boolean",
    )
    counts = frequency.token_counts(docs.select(F.col("source").alias("book"), "text"), ["book"])
    two = lemma.two_steps(lemma.steps(words, 2))
    rooted = lemma.roots(words, two).cache()
    return docs, words, counts.cache(), rooted, lemma.families(words, rooted).cache()


def scan_filters(df):
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", df._jdf.queryExecution().executedPlan().toString())


def test_word_index(spark, library, tmp_path):
    docs, words, counts, rooted, _ = library
    path = str(tmp_path / "index")
    word_index.write_index(path, docs, words, counts, rooted, parts=6)
    for book, word in [("b0", "lamp"), ("b0", "walk"), ("b3", "zebra"), ("b3", "absent"), ("none", "lamp")]:
        forms = word_index.indexed_forms(spark, path, book, word)
        assert forms == sorted(r[0] for r in pages.searched_forms(counts, rooted, book, word).collect())
        plain = pages.word_examples(docs.filter(F.col("source") == book), pages.searched_forms(counts, rooted, book, word), limit=5)
        assert rows(word_index.indexed_examples(spark, path, docs, book, forms, limit=5)) == rows(plain)
    own, n, roots = word_index.word_rows(spark, path, "lamp")
    assert word_index.family_of(spark, path, "lamp") == ["lamp", "lamps"] and {r[0] for r in own.select("word").collect()} == {"lamp", "lamps"}
    assert rows(n) == rows(counts.filter("token IN ('lamp', 'lamps')").select(*n.columns)) and rows(roots.select("word", "root")) == [("lamp", "lamp"), ("lamps", "lamp")]
    hits = stores.read_ranges(spark, f"{path}/places", "token", ["zebra"])
    assert scan_filters(hits) and all("part" in x for x in scan_filters(hits))
    read = {os.path.dirname(f) for f in hits.inputFiles()}
    assert len(stores.ranges_for(spark, f"{path}/places", ["zebra"])) < 6 and read


def test_places_of_a_token_share_rows(spark, tmp_path):
    """A text of each o: a row for each token and book of a task, not for each place. Texts that share an o are told apart,
    repeated ones count once; long lists are cut."""
    plain = [(k, "b", "A lamp. The lamp walks. Zebra!") for k in range(2100)]
    docs = spark.createDataFrame(plain, "doc_id long, source string, text string").coalesce(1)
    found = word_index.places(docs).collect()
    assert len(found) == 6 and sorted(len(r["o"]) for r in found if r["token"] == "lamp") == [104, 4096] and {h for r in found for h in r["h"]} == {0}
    odd = spark.createDataFrame([*plain, (3, "b", "No lamp here. The lamp walks."), (3, "b", "A lamp. Lamp!"), plain[5], (9, "c", "Lamp. x"), (None, "b", "Zebra"), (50, None, "Lamp"), (51, "b", None)], docs.schema)
    words = spark.createDataFrame([], "word string, pm double")
    word_index.write_index(str(tmp_path / "i"), odd, words, frequency.token_counts(odd.select(F.col("source").alias("book"), "text"), ["book"]), spark.createDataFrame([], "word string, root string"), parts=3)
    for book in ("b", "c"):
        want = pages.word_examples(odd.filter(F.col("source") == book), spark.createDataFrame([("lamp",), ("x",)], "form string"), limit=40)
        assert rows(word_index.indexed_examples(spark, str(tmp_path / "i"), odd, book, ["lamp", "x"], limit=40).select("total", "form", "text")) == rows(want.select("total", "form", "text"))


def test_ranges_of_a_hot_key(spark, tmp_path):
    df = spark.createDataFrame([("the", k) for k in range(500)] + [("a", 1), (None, 2), ("zoo", 3)], "w string, k int")
    stores.write_ranges(df, str(tmp_path / "t"), "w", ("k",), parts=5)
    assert len(stores.ranges_for(spark, str(tmp_path / "t"), ["the"])) > 2
    read = lambda *a: stores.read_ranges(spark, str(tmp_path / "t"), "w", *a).count()
    assert [read(["the"]), read(["a", "zoo"]), read(["none"]), read([]), read([], ["t"]), read([], ["z", "a"])] == [500, 2, 0, 0, 500, 2]


def test_trigrams(spark, tmp_path):
    names = [(1, "Moby Dick", "Herman Melville"), (2, "The Whale", None), (3, "", "A"), (4, None, None), (5, "ÄÖ ab%_", "x"), (6, "a", "moby"), (7, "aaa aaa", "bob"), (7, "aaa aaa", "bob"), (8, "Ab", "MELVILLE, H."), (9, "中文书", "é\\")]
    df = spark.createDataFrame(names, "id long, title string, author string")
    path = str(tmp_path / "grams")
    trigrams.write_trigrams(df, path, "id", ["title", "author"], parts=4)
    asked = {s[a : a + n].lower() for _, *each in names for s in each if s for n in range(1, 9) for a in range(len(s) - n + 1)} | {"zzz", "q", "Moby", "", "aaaaaaa", "mobx"}
    expected = sorted({(q.lower(), i) for q in asked if q for i, *each in names for s in each if s and q.lower() in s.lower()}, key=str)
    assert rows(trigrams.search_names(spark, path, df, "id", ["title", "author"], sorted(asked))) == expected
    assert trigrams.search_names(spark, path, df, "id", ["title", "author"], ["zzz", ""]).count() == 0
    read, everything = trigrams.rows_read(spark, path, ["melville"])
    assert 0 < read < everything


def test_trigrams_post_each_text_once(spark, tmp_path):
    """The index grows with different texts, not with the names that share them; what a name has found in two texts is a row."""
    names = [(k // 2 if k < 20 else k, f"Red bolt {k % 3}", "Bolt & Co" if k % 5 else None) for k in range(600)] + [(None, "Red bolt 1", "x")]
    df = spark.createDataFrame(names, "id long, title string, author string")
    path = str(tmp_path / "grams")
    trigrams.write_trigrams(df, path, "id", ["title", "author"], parts=4)
    low = {s.lower() for i, *each in names for s in each if s and i is not None}
    assert trigrams.rows_read(spark, path, ["bolt"])[1] == sum(len({f"{t}\0\0"[k : k + 3] for k in range(len(t))}) for t in low)
    asked = ["bolt", "b", "lt", "t & c", "red bolt 2", "bolt 1", *(f"none {k}" for k in range(200)), *(s[a : a + n] for s in low for n in (2, 3, 7) for a in range(len(s)))]
    expected = sorted({(q, i) for q in asked if q for i, *each in names for s in each if s and i is not None and q in s.lower()}, key=str)
    assert rows(trigrams.search_names(spark, path, df, "id", ["title", "author"], asked)) == expected


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("level", [0, 2])
def test_rescoring(spark, library, tmp_path, level):
    docs, words, counts, rooted, family = library
    known = rescore.Dictionary(words, rooted, family) if level else rescore.Dictionary(words)
    path = str(tmp_path / "library")
    full = lambda c, k: rows(scoring.candidates(c, k.words, k.rooted, k.family, level))
    held = lambda: rows(rescore.stored(spark, path, "candidates").select("book", "level", "word", "in_book", "n_forms", "score", "s_rarity", "s_salience", "s_origin", "s_aesthetic", "rank"))
    rescore.write_library(path, counts, known, level)
    assert held() == full(counts, known)

    # A book changes, a new one comes, one goes: no other folder is written.
    before = files(path)
    fresh = spark.createDataFrame([("b1", "A lamp, a quiz. Oxen walking!"), ("new", "Zebra jazz"), ("new", None), (None, "lamp")], "book string, text string")
    assert rescore.refresh_books(spark, path, fresh, ["b4"], known, level) == ["b1", "b4", "new"]
    now = counts.filter("book NOT IN ('b1', 'b4')").unionByName(frequency.token_counts(fresh.filter("book IS NOT NULL"), ["book"]))
    assert held() == full(now, known)
    after = files(path)
    assert {f: t for f, t in before.items() if "book=b1" not in f and "book=b4" not in f} == {f: t for f, t in after.items() if "book=b1" not in f and "book=new" not in f}
    assert rescore.refresh_books(spark, path, fresh.limit(0), [], known, level) == []

    # Words change: one that only some books have, its family, and where it leads.
    only = now.groupBy("token").agg(F.countDistinct("book").alias("n"), F.first("book").alias("book"))
    word = "quiz"
    other = words.withColumn("pm_lc", F.when(F.col("word") == word, 11.0).otherwise(F.col("pm_lc"))).filter("word <> 'jazz'")
    changed = rescore.Dictionary(other, rooted.withColumn("root", F.when(F.col("word") == "lamps", F.col("word")).otherwise(F.col("root"))), None) if level else rescore.Dictionary(other)
    if level:
        changed = changed._replace(family=lemma.families(other, changed.rooted))
    books = rescore.refresh_words(spark, path, known, changed, level)
    assert held() == full(now, changed) and books and only.count()
    assert rescore.refresh_words(spark, path, changed, changed, level) == []


def test_rescoring_reads_the_books_of_a_change_alone(spark, library, tmp_path):
    docs, words, counts, rooted, family = library
    path = str(tmp_path / "library")
    rescore.write_library(path, counts, rescore.Dictionary(words, rooted, family), 2)
    own = stores.read_parts(spark, f"{path}/counts", rescore.stored(spark, path, "counts").schema, "book", ["b2"])
    assert any("b2" in x for x in scan_filters(own))
    read = own.select("token", F.input_file_name().alias("f")).select("f").distinct().collect()
    assert read and all("book=b2" in r[0] for r in read)


def test_refresh_trajectories(spark):
    usage = spark.createDataFrame([("a", 1850, 10), ("b", 1850, 30), ("b", 1860, 5), ("c", 1860, 5)], "word string, year int, count long")
    held = spark.createDataFrame([("a", 1850, 1.5), ("gone", 1900, 2.0)], "word string, decade int, pm double")
    gated = spark.createDataFrame([("a",), ("b",), ("none",)], "word string")
    assert rows(rescore.refresh_trajectories(held, usage, gated)) == [("a", 1850, 1.5), ("b", 1850, 750000.0), ("b", 1860, 500000.0)]
