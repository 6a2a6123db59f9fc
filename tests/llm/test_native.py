"""Mixing, exact and line deduplication against plain versions."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tests.llm.cases import TEXTS, low, rows, table, words
from wordloom.llm import exact_dedup, line_dedup, mixing


def test_exact_groups(spark):
    got = rows(exact_dedup.exact_groups(table(spark)))
    by = defaultdict(list)
    for i, t, *_ in TEXTS:
        by[low(t)].append(i)
    expected = []
    for i, t, *_ in TEXTS:
        ids = by[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert exact_dedup.exact_groups(table(spark).limit(0)).count() == 0


def test_exact_groups_survive_equal_chunk_hashes(spark, monkeypatch):
    plain = rows(exact_dedup.exact_groups(table(spark)))
    monkeypatch.setattr(exact_dedup, "ambiguous", lambda found: found.limit(1))
    assert rows(exact_dedup.exact_groups(table(spark))) == plain


def test_chunks_make_up_the_text(spark):
    df = table(spark).filter("text IS NOT NULL")
    for r in df.select("text", exact_dedup.chunks(df["text"], 4, 64).alias("c")).collect():
        assert "".join(r["c"]) == r["text"] and all(len(c) <= 64 for c in r["c"])


@pytest.mark.parametrize("band", [0.15, 5.0])
def test_line_dedup(spark, band):
    # A null site is a site of its own.
    texts = [*TEXTS, (30, "a line of no site and one\nown 30", None, None), (31, "a line of no site and one\nown 31", None, "z"), (32, "only of no site\nx", None, None), (33, "only of no site\ny", None, None)]
    docs = table(spark, texts)
    out = line_dedup.remove_boilerplate(docs, min_sites=2, band=band)
    assert out.columns == [c for c in docs.columns if c != "n_removed"] + ["n_lines", "n_removed"]
    sites, first = defaultdict(set), {}
    for i, t, _, s in texts:
        for line in (t or "").split("\n"):
            if line:
                sites[line].add(s)
                first[line] = min((x for x in (first.get(line), i) if x is not None), default=None)
    expected = []
    for i, t, *_ in texts:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not (x and len(sites[x]) >= 2 and first[x] != i)]
        expected.append((i, "\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept)))
    assert rows(out.select("doc_id", "text", "n_lines", "n_removed")) == sorted(expected, key=str)
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def plan(texts):
    size = Counter()
    for _, t, _, s in texts:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            return size, target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= over
    return size, target


def test_mix_targets_and_bounds(spark):
    out = mixing.mix(table(spark)).collect()
    size, target = plan(TEXTS)
    assert len(out) == len(TEXTS)
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sum(r["taken"] for r in out) <= sum(target.values()) + 1e-6
    assert rows(mixing.mix(table(spark))) == sorted((tuple(r) for r in out), key=str)
    assert mixing.mix(table(spark).limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    texts = [(i, "w " * (1 + i % 7), "en", f"s{min(i % 13, 4)}") for i in range(2000)]
    docs = table(spark, texts)
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 10 for s, t in target.items())
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    ordered = got.select("text", "source").collect()
    assert sum(len(words(r["text"])) for r in ordered) == sum(taken.values())
    budget, so_far = sum(target.values()), Counter()
    for k, r in enumerate(ordered):  # every beginning of the mix is near the targets' shares
        so_far[r["source"]] += len(words(r["text"]))
        if k >= 200 and k % 50 == 0:
            assert all(abs(so_far[s] - t * sum(so_far.values()) / budget) <= 30 for s, t in target.items())


@pytest.mark.parametrize("range_rows", [1, 7, 1 << 16])
def test_mix_is_cut_where_the_budget_ends(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    texts = [(i, "w " * (i % 5), "en", f"s{i % 3}") for i in range(40)]
    out = mixing.mix(table(spark, texts)).collect()
    copies = sorted(((e * r["source_size"] + r["cum"]) / r["target"], r["size"]) for r in out if r["size"] for e in range(3))
    stop, spent = -1.0, 0
    for v in sorted({v for v, _ in copies}):
        spent += sum(n for x, n in copies if x == v)
        if spent > sum({r["source"]: r["target"] for r in out}.values()) * (1 + 1e-12):
            break
        stop = v
    for r in out:
        assert r["copies"] == (1 if not r["size"] else sum((e * r["source_size"] + r["cum"]) / r["target"] <= stop for e in range(3)))


def test_mix_without_words(spark):
    out = mixing.mix(table(spark, [(1, None, "x", "a"), (2, "", "x", None), (2, "", "x", None)])).collect()
    assert [(r["taken"], r["copies"], r["target"]) for r in out] == [(0, 1, 0.0)] * 3
