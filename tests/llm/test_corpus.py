"""Near duplicates, repeated passages, the language model and the pipeline against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import TEXTS, low, rows, table, words
from wordloom.llm import hmm, near_dedup, substring_dedup
from wordloom.llm.components import components


def shingles(text):
    w = words(low(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    """{id: component} by comparing all pairs."""
    top = {i: i for i, *_ in texts if i is not None}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = [(i, shingles(t)) for i, t, *_ in texts if i is not None]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            a, b = root(i), root(j)
            top[max(a, b)] = min(a, b)
    return {i: root(i) for i in top}


def variants(n, seed):
    """n texts of one base, each with some words changed; their similarities lie about the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(120)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 9)):
            own[k] = f"x{i}_{k}"
        out.append((i * 3 + 1, " ".join(own), "en", "a"))
    return out


def check_groups(df, texts):
    component = groups(texts)
    expected = [(i, len(shingles(t)), component.get(i), component.get(i) == i or i is None) for i, t, *_ in texts]
    assert rows(df) == sorted(expected, key=str)


def test_near_groups(spark):
    check_groups(near_dedup.near_groups(table(spark)), TEXTS)
    assert near_dedup.near_groups(table(spark).limit(0)).count() == 0


def test_near_groups_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "MEMBERS", 8)
    texts = variants(150, 5)
    check_groups(near_dedup.near_groups(table(spark, texts, extra=False)), texts)


def test_near_groups_find_pairs_about_the_threshold(spark):
    """Recall on random pairs, short and long, about half of them between 0.70 and 0.85 alike: every link is found."""
    rng = np.random.default_rng(17)
    texts = []
    for k in range(400):
        n = int(rng.choice([12, 30, 80, 200, 600]))
        base = [f"v{x}" for x in rng.integers(0, 10**6, n)]
        other = list(base)
        for p in rng.choice(n, max(1, round(n * rng.uniform(0.015, 0.04))), replace=False):
            other[p] = f"c{k}_{p}"
        texts += [(2 * k + 1, " ".join(base), "en", "a"), (2 * k + 2, " ".join(other), "en", "b")]
    linked = sum(100 * len(a & b) >= 75 * len(a | b) for a, b in ((shingles(texts[i][1]), shingles(texts[i + 1][1])) for i in range(0, len(texts), 2)))
    assert 100 < linked < 390
    check_groups(near_dedup.near_groups(table(spark, texts, extra=False)), texts)


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30))).astype(np.uint64) for _ in range(12)]
    got = near_dedup.common_counts(sets[:5], sets[5:], width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(k, k + 1) for k in range(100, 130)] + [(5, 5)]
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    alone = {i for i in top} - {x for a, b in edges if a != b for x in (a, b)}
    assert rows(components(spark.createDataFrame(edges, "a long, b long"))) == sorted(((i, root(i)) for i in top if i not in alone), key=str)


def without_repeats(texts, window):
    first = {}
    for i, t, *_ in texts:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    out = []
    for i, t, *_ in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [256, 1, 0])
def test_substring_dedup(spark, bucket):
    """bucket=0: every bucket is split at every level, down to single windows."""
    assert rows(substring_dedup.remove_repeats(table(spark), bucket=bucket)) == without_repeats(TEXTS, 50)
    assert substring_dedup.remove_repeats(table(spark).limit(0)).count() == 0


def test_substring_dedup_of_small_windows(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4, 40)), "en", "a") for i in range(30)]
    for bucket in (256, 3, 0):
        got = substring_dedup.remove_repeats(table(spark, texts, extra=False), window=9, minimiser=3, bucket=bucket)
        assert rows(got) == without_repeats(texts, 9)


def test_substring_dedup_of_text_that_repeats_itself(spark):
    texts = [(i, " ".join([*["x", "y", "z"] * (4 + i % 9), f"own{i % 4}", *["x"] * (i % 23)]), "en", "a") for i in range(40)]
    for bucket in (256, 0):
        got = substring_dedup.remove_repeats(table(spark, texts, extra=False), window=9, minimiser=3, bucket=bucket)
        assert rows(got) == without_repeats(texts, 9)


def test_substring_dedup_of_a_passage_that_all_share(spark):
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(40)]
    texts = [(i, " ".join([*(f"a{x}" for x in rng.integers(0, 9**9, rng.integers(3, 30))), *passage, *(f"z{x}" for x in rng.integers(0, 9**9, rng.integers(3, 30)))]), "en", "a") for i in range(60)]
    got = substring_dedup.remove_repeats(table(spark, texts, extra=False), window=12, minimiser=4, bucket=8)
    assert rows(got) == without_repeats(texts, 12)


def test_hmm_counts(spark):
    texts = [*TEXTS, *((i, f"some words {i % 7} here ## {i}", "en", "a") for i in range(20, 60))]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    own = [(i, [*words(low(t)), "\n"]) for i, t, *_ in texts]
    c = Counter(w for i, t in own if not held(i) for w in t)
    n = sum(c.values())
    for limit in (hmm.TABLE, 5):
        out = hmm.score_texts(table(spark, texts), table=limit)
        got = {(r["doc_id"], r["n_tokens"]): r for r in out.collect()}
        assert out.count() == len(texts)
        for i, t in own:
            r = got[(i, len(t))]
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t)
            assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held(i), sum(c[w] > 0 for w in t), n)
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert hmm.score_texts(table(spark).limit(0)).count() == 0


def test_hmm_forward_is_exact():
    rng = np.random.default_rng(4)
    states = 3
    start, moves = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states)
    emits = rng.random((hmm.CLASSES + 1, states))
    model = hmm.Hmm(start, moves, emits)
    lengths = [1, 4, 2]
    offsets = np.cumsum([0, *lengths])
    classes = rng.integers(0, hmm.CLASSES, offsets[-1])
    for k, n in enumerate(lengths):
        seq = classes[offsets[k] : offsets[k] + n]
        total = sum(
            start[p[0]] * emits[seq[0], p[0]] * math.prod(moves[p[t - 1], p[t]] * emits[seq[t], p[t]] for t in range(1, n))
            for p in np.ndindex(*(states,) * n)
        )
        assert hmm.log10_likelihoods(model, classes, offsets)[k] == pytest.approx(math.log10(total))


def test_hmm_expected_counts():
    rng = np.random.default_rng(5)
    _, classes, offsets = hmm.tokens(pa.array(["a bb ccc", "", "dd a a"]))
    model = hmm.Hmm.of_counts(np.ones(2), rng.random((2, 2)), rng.random((hmm.CLASSES + 1, 2)))
    start, moves, emits, log = hmm.expected_counts(model, classes, offsets)
    assert log == pytest.approx(hmm.log10_likelihoods(model, classes, offsets).sum(), rel=1e-5)
    assert start.sum() == pytest.approx(3) and emits.sum() == pytest.approx(len(classes)) and moves.sum() == pytest.approx(len(classes) - 3)
    before = hmm.log10_likelihoods(model, classes, offsets).sum()
    for _ in range(5):
        model = hmm.Hmm.of_counts(*hmm.expected_counts(model, classes, offsets)[:3])
    assert hmm.log10_likelihoods(model, classes, offsets).sum() > before


def test_hmm_scores_end_to_end(spark):
    """score against a plain forward pass over the words with the trained weights."""
    texts = [*TEXTS, *((i, f"some words {i % 7} here ## {i}", "en", "a") for i in range(20, 60))]
    docs = table(spark, texts)
    trained = hmm.train(docs)
    own = [[*words(low(t)), None] for _, t, *_ in texts]
    c = Counter(w for (i, *_), ws in zip(texts, own, strict=True) if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    kind = lambda w: hmm.CLASSES if w is None else int(hmm.tokens(pa.array([w]))[1][0])
    mass = defaultdict(float)
    for w, n in c.items():
        mass[kind(w)] += n + 0.1
    m = trained.model
    got = defaultdict(list)
    for r in hmm.score_texts(docs, trained=trained).collect():
        got[r["doc_id"], r["n_tokens"]].append(r["score"])
    for (i, *_), ws in zip(texts, own, strict=True):
        alpha, log = m.start, 0.0
        for k, w in enumerate(ws):
            alpha = (alpha if k == 0 else alpha @ m.moves) * m.emits[kind(w)] * (c[w] + 0.1) / (mass[kind(w)] + 0.1)
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert got[i, len(ws)][0] == pytest.approx(log, rel=1e-6)


def test_hmm_learns(spark):
    """Each round's likelihood is no worse than the one before; held-out text gains on word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trained = hmm.train(docs)
    assert len(trained.seen) > 1 and all(b >= a - 1e-6 * abs(a) for a, b in zip(trained.seen, trained.seen[1:], strict=False))
    r = hmm.score_texts(docs, trained=trained).filter("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert r[1] > r[0]


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = source = spark.read.parquet(f"{sf}/documents.parquet").cache()
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        docs = p.cut(stage(spark, docs, sf))
        seen[name] = docs
        assert k + 1 == len(p.STAGES) or docs.columns == source.columns
    good, lines, near, mixed, encoded = (seen[n].collect() for n, _ in p.STAGES)
    assert 0.6 * source.count() < len(good) < source.count() and len(lines) == len(good)
    component = groups([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in near} == {i for i, c in component.items() if i == c}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    assert sorted(r["doc_id"] for r in encoded) == sorted(r["doc_id"] for r in mixed)
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in encoded)
    times = defaultdict(int)
    for r in mixed:
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3


def test_pipeline_stages_take_anything(spark, tmp_path):
    """Null, empty and repeated rows, clashing names, no n_chars, an empty table; every stage."""
    import corpus_pipeline as p

    texts = [*TEXTS, *((40 + i, f"shared line\nown text {i} of some length", "en", f"s{i}") for i in range(9)), (60, "shared line\nmore", "en", None)]
    spark.createDataFrame([(1, 1), (8, 1), (11, 0), (None, 0), (12, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(p.STAGES)
    wide = table(spark, texts)
    for docs in (wide, wide.drop("n_chars"), wide.limit(0)):
        many = docs.count()
        for name, stage in p.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            assert out.columns == (docs.columns if name != "bpe_codec" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            assert many or not got
            if name in ("line_dedup", "bpe_codec"):
                assert len(got) == many
            if name in ("quality_classifier", "near_dedup"):
                assert set(got) <= set(docs.collect())
    lines = {(r["doc_id"], r["source"]): r for r in stages["line_dedup"](spark, wide, str(tmp_path)).collect()}
    assert lines[40, "s0"]["text"] == "shared line\nown text 0 of some length" and lines[60, None]["text"] == "more" and lines[60, None]["n_chars"] == 4
    assert lines[44, "s4"]["score"] == "y" and lines[44, "s4"]["n_removed"] == 7
    near = stages["near_dedup"](spark, wide, str(tmp_path)).collect()
    component = groups(texts)
    assert sorted(str(r["doc_id"]) for r in near) == sorted(str(i) for i, *_ in texts if i is None or component[i] == i)
    taken = stages["mixing"](spark, wide, str(tmp_path)).collect()
    assert {r["doc_id"] for r in taken if not words(r["text"])} == {3, 4, 5}
