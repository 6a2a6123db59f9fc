"""Merkle manifest, prefix trie and decontamination against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, low, rows, table
from wordloom.llm import decontaminate, merkle, prefix_trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def runs(nodes, f):
    return [nodes[k : k + f] for k in range(0, len(nodes), f)]


def plain_proofs(leaves, f):
    """The top and each leaf's steps (before, after)."""
    at, steps, nodes = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(nodes) > 1:
        groups = runs(nodes, f)
        for i, p in enumerate(at):
            run, k = groups[p // f], p % f
            steps[i].append((run[:k], run[k + 1 :]))
            at[i] = p // f
        nodes = [sha("".join(g)) for g in groups]
    return nodes[0], steps


def plain_manifest(docs, f):
    groups = defaultdict(list)
    for i, text, lang, source, n in docs:
        fields = [encoded(x) for x in (i, source, lang, n, text)]
        changed = [encoded(x) for x in (i, source, lang, None if n is None else n + 1, text)]
        leaf = sha("".join(fields))
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups[lang].append((i, leaf, sha("".join(changed)) if hit else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted(groups[x], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for x in langs}
    below = {x: plain_proofs([r[1] for r in own[x]], f) for x in langs}
    root, above = plain_proofs([below[x][0] for x in langs], f)
    out = []
    for k, x in enumerate(langs):
        for (i, leaf, other), steps in zip(own[x], below[x][1], strict=True):
            proof, again = steps + above[k], other
            for before, after in proof:
                again = sha("".join([*before, again, *after]))
            out.append((i, leaf, below[x][0], root, sha("".join(d for s in proof for p in s for d in p)), again, again == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "f", "band"), [(1, 2, 2), (5, 2, 1), (17, 2, 2), (33, 3, 2), (90, 2, 3)])
def test_manifest(spark, monkeypatch, n, f, band):
    monkeypatch.setattr(merkle.bands, "__defaults__", (f, band))
    monkeypatch.setattr(merkle.pushed, "__defaults__", (f, band))
    texts = [(k, f"text {k} ä", ["en", "de", None, "", "é"][k % 7 % 5] if k % 3 else "en", None if k % 4 == 0 else "s", None if k % 5 == 0 else k) for k in range(n)]
    texts += texts[:1] * 2 + [(None, None, None, None, None)] * (n > 10)
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"tree": F.lit(1), "place": F.lit("x"), "proof": F.lit(0)})
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(docs, other=F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")), fan_out=f)
    steps = F.transform("proof", lambda s: F.concat(merkle.joined(s["before"]), merkle.joined(s["after"])))
    again = merkle.folded(F.col("other_leaf"), F.col("proof"))
    h = merkle.hexed
    got = found.select("doc_id", h(F.col("leaf")), h(F.col("subroot")), h(F.col("root")), F.sha2(F.array_join(steps, ""), 256), h(again), again == F.col("root"))
    expected = plain_manifest(texts, f)
    assert rows(got) == expected
    if n == 90:
        assert {r[-1] for r in expected} == {True, False}
        assert merkle.manifest(docs.limit(0)).count() == 0


def plain_trie(talks):
    own = defaultdict(list)
    for c, turn, role, text in talks:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}")), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        like = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(like, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(str(c) for c in m if len(built[c]) == len(p)))) for p, m in members.items()), key=str)


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN_BITS", 2)
    talks = []
    for c in [*range(40), 1000, 1001, 1004, -7, -5]:
        for t in range([1, 3, 8, 21, 0, 13, 2][c % 7]):
            talks.append((c, t, ["user", "bot", None, ""][t % 4], None if t == 5 else f"turn {t % 6} é {c % 3 if t > 2 else 0}"))
    talks += [(2, None, "user", "no turn"), (None, 0, "user", "no conversation"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, None, None), (50, 0, "a", "b c"), (55, 0, "ab", " c")]
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("x"), "place": F.lit(1), "name": F.lit(2)})
    got = rows(prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(frame))))
    assert got == plain_trie(talks)
    assert any(r[6] for r in got) and max(r[1] for r in got) > 16 and any(r[1] == 0 and r[2] is None for r in got)
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(frame.limit(0)))).count() == 0


def plain_leaks(docs, items, size):
    find = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    windows = defaultdict(set)
    for i, text in items:
        w = find(text)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for i, text, *_ in docs:
        w, hit, met = find(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    met |= own
        met = sorted(str(x) for x in met if x is not None)
        out.append((i, len(w), len(hit), len(met), sha(",".join(met)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 1 << 19])
def test_contamination(spark, block):
    items = [
        (7, " ".join(f"word{k}" for k in range(20, 45))), (11, "Sat on, the MAT! shared-line"), (12, "one"), (13, None), (14, " ?! "), (None, "the end"), (15, "w " * 30), (15, "stop größe"),
        (100, " ".join(f"word{k}" for k in range(30, 42))), (9, "cat dog"), (21, "the cat sat on the mat shared line of many sites the end and more"),
    ]
    extra = [(40, "a b", None, None), (41, "größe STOP größe Größe.stop größe", None, None), (42, "x" * 70000 + " one", None, None), (41, "größe STOP größe Größe.stop größe", None, None), (43, "cat, cat dog dog", None, None)]
    texts = [*TEXTS, *extra]
    docs = table(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"sha": F.lit(1), "number": F.lit(2), "words": F.lit("x")})
    found = decontaminate.contamination(docs, bench, block=block)
    assert rows(found.drop("spans")) == plain_leaks(texts, items, 10)
    assert sum(r["contaminated"] for r in found.collect()) >= 10
    if block > 3:
        clean = decontaminate.contamination(docs, bench.limit(0))
        assert clean.filter("contaminated OR n_hit > 0").count() == 0 and clean.count() == len(texts)
        assert decontaminate.contamination(docs.limit(0), bench).count() == 0
