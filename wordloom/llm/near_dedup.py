"""Near-duplicate documents by a join over signature coordinates.

A document's set is its distinct word shingles, as 64-bit hashes. Its signature has a coordinate for each value of a
hash's top bits, holding the least hash there; each coordinate-value pair has a posting list. Two documents of
similarity 0.75 agree on about three quarters of their coordinates, and on fewer than half in about 3 of 10^6 cases,
so pairs agreeing on at least half are candidates. Such a pair meets on the rarer side of either signature: a document
of f values posts only its f - f/2 + 1 rarest (prefix), and values that no other document has are skipped.

Documents of equal sets are one node. In a first round every document of a posting list is compared with the list's
most shared document only, which joins large groups of copies without their pairs. Where a list still spans several
components, its documents outside the component of that document are compared, in blocks and on full sets, with all
members of the lists around it. Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, cut, fold, join_anew, mix, row_key, run_hashes, slices, span_hashes, utf8, words
from wordloom.llm.components import components

SHINGLE, COORDINATE_BITS, PERCENT = 5, 6, 75
#: Members of a posting list in a block, shingles of a block about, and members compared with one pivot in a task.
BLOCK, BLOCK_SHINGLES, MEMBERS = 192, 1 << 18, 64


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased; with fewer words the whole sequence's hash."""
    data, bounds = utf8(texts)
    data = fold(data)
    starts, ends, first = words(data, bounds)
    each = span_hashes(data, starts, ends)
    runs = run_hashes(each, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        else:
            out.append(run_hashes(each[a:b], b - a, 1000 + b - a) if b > a else runs[:0])
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, id: str, text: str, shingle: int = SHINGLE, bits: int = COORDINATE_BITS) -> DataFrame:
    """For each row: id, row (of row_key), n (set size), h and g (of the whole set), values (the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, h, g, values = [], [], [], []
            for s in shingle_sets(batch["text"], shingle):
                top = s >> np.uint64(64 - bits)
                n.append(len(s))
                h.append(s.sum(dtype=np.uint64))
                g.append(mix(s).sum(dtype=np.uint64))
                values.append(_signed(s[np.flatnonzero(np.diff(top, prepend=np.uint64(1 << bits)))]))
            yield pa.record_batch(
                [batch["id"], batch["row"], pa.array(n, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(values, pa.list_(pa.int64()))],
                ["id", "row", "n", "h", "g", "values"],
            )

    source = docs.select(F.col(id).cast("long").alias("id"), row_key(text).alias("row"), F.col(text).alias("text"))
    return arrow_map(source, run, "id long, row long, n long, h long, g long, values array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm. Each a goes, with up to about MEMBERS of its partners, to one place."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = join_anew(pairs, sizes, ["a"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    rows = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("id")).unionByName(
        dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("id")).distinct()
    )
    rows = rows.join(texts, "id").repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in slices(batches, "text"):
            left, right = [], []
            for a, part, role, i, s in zip(*(batch[c].to_pylist() for c in ("a", "part", "role", "id")), shingle_sets(batch["text"], shingle), strict=True):
                if (a, part) != key:
                    key, heads = (a, part), []
                if role == 0:
                    heads.append(s)
                    continue
                for h in heads:
                    if 100 * min(len(h), len(s)) < percent * max(len(h), len(s)):
                        continue
                    small, large = (h, s) if len(h) < len(s) else (s, h)
                    at = np.searchsorted(large, small)
                    common = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                    if 100 * common >= percent * (len(h) + len(s) - common):
                        left.append(a)
                        right.append(i)
                        break
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return arrow_map(rows, run, "a long, b long")


def _matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree on at least half of the longer one's values."""
    left, right = (nodes.select(F.col("id").alias(x), F.col("values").alias(f"v{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(2 * F.size(F.array_intersect("va", "vb")) >= F.greatest(F.size("va"), F.size("vb"))).select("a", "b")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The size of the intersection of each set of left with each of right, over `width` values at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    names = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    of = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    at = [np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0)) for x in (a, b)]
    if not len(names):
        return out
    held = [names[k] == x for k, x in zip(at, (a, b), strict=True)]
    for begin in range(0, len(names), width):
        each = []
        for sets, rows, k, h in zip((left, right), of, at, held, strict=True):
            here = h & (k >= begin) & (k < begin + width)
            seen = np.zeros((len(sets), min(width, len(names) - begin)), np.float32)
            seen[rows[here], k[here] - begin] = 1
            each.append(seen)
        out += each[0] @ each[1].T
    return out


def _rest(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links (a, b) between components among members (group, id, component, n), on full sets.

    A group's documents outside its own component are compared with all of the group, in blocks, each pair of blocks
    in a place of its own. Of the links of two blocks only those that join components are given.
    """
    blocks = lambda own: F.greatest(F.ceil(F.count(F.when(own, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES))
    sizes = members.groupBy("group").agg(blocks(F.lit(True)).alias("nj"), blocks(F.col("component") != F.col("group")).alias("ni"))
    sized = join_anew(members, sizes, ["group"])
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    outside = sized.filter("component <> group").select("group", block(F.col("ni")).alias("i"), all_(F.col("nj")).alias("j"), F.lit(0).alias("side"), "id", "component")
    everyone = sized.filter("ni > 0").select("group", all_(F.col("ni")).alias("i"), block(F.col("nj")).alias("j"), F.lit(1).alias("side"), "id", "component")
    rows = outside.unionByName(everyone).join(texts, "id").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side")

    def compare(rows: list) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r[0] == k and len(r[3])] for k in (0, 1)]
        if not sides[0] or not sides[1] or len({r[2] for r in rows}) < 2:
            return []
        common = common_counts([r[3] for r in sides[0]], [r[3] for r in sides[1]])
        n = [np.array([len(r[3]) for r in x]) for x in sides]
        apart = np.array([r[2] for r in sides[0]])[:, None] != np.array([r[2] for r in sides[1]])[None]
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := top.get(c, c)) != c:
                c = up
            return c

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(apart & (100 * common >= percent * (n[0][:, None] + n[1][None] - common)))), strict=True):
            a, b = root(sides[0][i][2]), root(sides[1][j][2])
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((sides[0][i][1], sides[1][j][1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in slices(batches, "text"):
            out = []
            for group, i, j, side, id_, component, s in zip(*(batch[c].to_pylist() for c in ("group", "i", "j", "side", "id", "component")), shingle_sets(batch["text"], shingle), strict=True):
                if (group, i, j) != key:
                    out += compare(held)
                    key, held = (group, i, j), []
                held.append((side, id_, component, s))
            if out:
                yield pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
        if out := compare(held):
            yield pa.record_batch([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return arrow_map(rows, run, "a long, b long")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bits: int = COORDINATE_BITS) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id linked with it, over any number of
    links), kept (id = component_id). Documents link when 100 * intersection >= percent * union of their sets.

    A text without words, or null, has an empty set and links with nothing. Rows that share an id are one document:
    what one of them links with, all do. A row with a null id links with nothing, has component_id null and is kept.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    found = cut(signatures(docs, id, text, shingle, bits))
    named = found.filter("id IS NOT NULL AND n > 0")
    classes = named.groupBy("h", "g", "n").agg(F.min("id").alias("node"))
    member = cut(join_anew(named.select("id", "row", "h", "g", "n"), classes, ["h", "g", "n"]).select("id", "row", "n", "node"))
    nodes = named.join(classes.select(F.col("node").alias("id"), "h", "g", "n"), ["id", "h", "g", "n"], "left_semi").select("id", "h", "values")
    nodes = nodes.dropDuplicates(["id", "h"])
    posts = nodes.select("id", "h", F.size("values").alias("f"), F.explode("values").alias("v"))
    shared = posts.groupBy("v").agg(F.count("*").alias("size")).filter("size > 1")
    met = cut(join_anew(posts, shared, ["v"]))
    order = W.partitionBy("id", "h").orderBy("size", "v")
    ranked = met.withColumns({"rank": F.row_number().over(order), "met": F.count("*").over(W.partitionBy("id", "h")), "weight": F.sum("size").over(W.partitionBy("id", "h"))})
    # Values met nowhere else come first in the prefix of floor(f / 2) + 1 values.
    prefix = cut(ranked.filter("rank + f - met <= floor(f / 2) + 1").select("id", "v", "weight"))
    pivots = prefix.groupBy("v").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("p"), F.count("*").alias("size")).filter("size > 1")
    pivots = pivots.select("v", (-F.col("p.id")).alias("pivot"), "size")
    lists = cut(join_anew(prefix.select("id", "v"), pivots, ["v"]))
    nodes = cut(nodes.join(lists.select("id").distinct(), "id", "left_semi"))
    texts = cut(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(lists.select("id").distinct(), "id", "left_semi"))

    star = lists.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = cut(_confirm(_matching(star, nodes), texts, shingle, percent))
    many = member.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    links = links.unionByName(many.select("a", "b"))
    first = cut(components(links))
    of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    labelled = lists.filter("size > 2").join(of("id"), "id", "left").join(of("pivot"), "pivot", "left")
    labelled = labelled.select("v", "id", F.coalesce("id_component", "id").alias("component"), F.coalesce("pivot_component", "pivot").alias("group"))
    open_ = labelled.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("v")
    # Lists whose pivots are in one component have mostly the same members, so they are one group.
    members = cut(join_anew(labelled, open_, ["v"]).select("group", "id", "component").distinct())
    members = cut(join_anew(members, member.groupBy("id").agg(F.max("n").alias("n")), ["id"]))
    more = cut(_rest(members, texts, shingle, percent))
    last = first if more.isEmpty() else cut(components(links.unionByName(more)))

    ends = join_anew(member, last.select("node", "component"), ["node"], "left")
    ends = ends.select(F.col("id").alias("_i"), F.col("row").alias("_r"), F.coalesce("component", "node").alias("_c")).distinct()
    out = found.select("id", "row", "n").join(ends, (F.col("id") == F.col("_i")) & (F.col("row") == F.col("_r")), "left")
    component = F.coalesce("_c", "id")
    kind = docs.schema[id].dataType
    return out.select(F.col("id").cast(kind).alias(id), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(sh.s) AS n FROM d LEFT JOIN sh ON d.doc_id = sh.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.x
"""
