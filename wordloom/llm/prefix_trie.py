"""A trie of conversations by their turns, from prefix names made by doubling.

Equal turns get one dense number. Round k names the blocks of 2^k turns that begin at multiples of 2^k: a block is the
pair of names of its halves, and the distinct pairs are numbered anew. A prefix of d turns is the blocks of d's binary
digits, largest first: rounds from the largest block down put the names of the prefix so far and of the next block
together and number those pairs. So log(longest) join rounds each way name all prefixes, over at most twice as many
rows as there are turns, and prefixes are equal where their depths and names are. A node is a group of equal prefixes.

What a node's subtree adds up to comes by pointer doubling: after round k a node has the sums of the nodes up to
2^k - 1 levels below it, which it hands to its ancestor 2^k levels up.

A turn, prefix, node or conversation that very many rows share is counted before it is shuffled, and its joins are dealt
anew for Spark to split (join_anew); positions come from ranges (wordloom/operators/ranges.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, cut, join_anew
from wordloom.operators.ranges import numbered, placed

#: Conversation numbers of one node are put together in text for spans of 2 ** SPAN_BITS numbers.
SPAN_BITS = 14


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that stand for (role, text); the role's length keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 0), turn (digest), bytes (of the text) for each row with a conversation, by turn (null first);
    rows of one turn come in order of their digest. Null role or text is empty. Texts don't travel."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    rows = cut(talks.filter(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("at"), turn_digest(role_, text_).alias("turn"), F.octet_length(text_).cast("long").alias("bytes")))
    return cut(placed(rows, ["conv"], [F.col("at").asc_nulls_first(), F.col("turn")]).drop("at"))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with name: a dense number for each distinct value of keys. Written."""
    return cut(join_anew(rows, numbered(rows.select(*keys).distinct(), "name"), keys).drop(*keys))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, name for each conversation and each d from 1 to its number of turns; equal depth and name mean equal
    turns. turns: conv, place, turn (digest). The result is written."""
    longest = turns.agg(F.max("place")).first()[0]
    blocks = [_named(turns.select("conv", F.col("place").alias("block"), "turn"), ["turn"])]
    while longest is not None and 1 << len(blocks) <= longest + 1:
        half = lambda k: F.max(F.when(F.col("block") % 2 == k, F.col("name")))
        pairs = blocks[-1].groupBy("conv", F.expr("block div 2").alias("block")).agg(half(0).alias("left"), half(1).alias("right"))
        blocks.append(_named(pairs.filter("left IS NOT NULL AND right IS NOT NULL"), ["left", "right"]))
    found = None  # conv, depth, name of the prefixes so far: those whose depth is a multiple of the block to come, twice
    for k in range(len(blocks) - 1, -1, -1):
        size = 1 << k
        # Every second block follows a prefix of a depth that is a multiple of two blocks; the first one follows none.
        next_ = blocks[k].filter("block % 2 = 0").select("conv", (F.col("block") * size).alias("start"), F.col("name").alias("last"))
        first = next_.filter("start = 0").select("conv", (F.col("start") + size).alias("depth"), F.lit(-1).cast("long").alias("so_far"), "last")
        if found is not None:
            met = next_.filter("start > 0").join(found.select("conv", F.col("depth").alias("start"), F.col("name").alias("so_far")), ["conv", "start"])
            first = first.unionByName(met.select("conv", (F.col("start") + size).alias("depth"), "so_far", "last"))
        # Depth is part of the key, so a name never stands for prefixes of two depths.
        own = first.withColumn("_d", F.col("depth"))
        named = _named(own, ["_d", "so_far", "last"])
        found = named if found is None else found.unionByName(named)
    return cut(found)


def joined_digests(members: DataFrame) -> DataFrame:
    """depth, name and sha256 of the members' numbers (conv) in decimal, ascending and joined by commas.

    A SHA-256 has to run over its text in order. What meets for a node are texts of up to 2 ** SPAN_BITS numbers each,
    put together in many tasks before, and a task passes over them one at a time."""
    spans = members.groupBy("depth", "name", F.shiftright("conv", SPAN_BITS).alias("span")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("part"))
    rows = spans.repartition("depth", "name").sortWithinPartitions("depth", "name", "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def told(out: list) -> pa.RecordBatch:
            depth, name, sha = zip(*out, strict=True) if out else ((), (), ())
            return pa.record_batch([pa.array(depth, pa.int64()), pa.array(name, pa.int64()), pa.array(sha, pa.string())], ["depth", "name", "sha256"])

        for batch in batches:
            out = []
            for depth, name, part in zip(*(batch[c].to_pylist() for c in ("depth", "name", "part")), strict=True):
                if (depth, name) == key:
                    digest.update(b"," + part.encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (depth, name), hashlib.sha256(part.encode())
            yield told(out)
        if key:
            yield told([(*key, digest.hexdigest())])

    return arrow_map(rows, run, "depth long, name long, sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """node and, for each column of sums, its total over the node's subtree. nodes: node, parent (null at the top), sums."""
    now = cut(nodes.select("node", F.col("parent").alias("up"), *sums))
    for _ in range(deepest.bit_length()):
        given = now.filter("up IS NOT NULL").groupBy("up").agg(*[F.sum(c).alias(f"_{c}") for c in sums]).withColumnRenamed("up", "node")
        further = now.filter("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("_up"))
        added = now.join(given, "node", "left").select("node", "up", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
        now = cut(join_anew(added, further, ["up"], "left").select("node", F.col("_up").alias("up"), *sums))
    return now.select("node", *sums)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. turns: conv, place, turn, bytes (of ordered_turns); convs: conv, n (its turns, or 0).

    The root (depth 0) has all conversations, those without turns too, and no last turn to save. Repeated rows of a
    conversation are turns of their own. Without conversations there are no nodes.
    """
    named = prefixes(turns)
    groups = named.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
    last = turns.select("conv", (F.col("place") + 1).alias("depth"), "bytes")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("name"), "conv", "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = numbered(groups.join(last, ["conv", "depth"]).select("depth", "name", "conv", "n_convs", "bytes").unionByName(root), "node")

    # A node's parent is the prefix, one turn shorter, of its smallest member.
    above = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("up_name"))
    child = nodes.join(above, ["conv", "depth"], "left").withColumns({"up_depth": F.col("depth") - 1, "up_name": F.coalesce("up_name", F.lit(-1))})
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("name").alias("up_name"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    linked = cut(join_anew(child, parents, ["up_depth", "up_name"], "left").drop("up_depth", "up_name"))
    children = linked.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    linked = cut(linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    sums = subtree_sums(linked.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"], linked.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])

    ends = convs.filter("n > 0").select("conv", F.col("n").alias("depth")).join(named, ["conv", "depth"])
    ends = ends.select("depth", "name", "conv").unionByName(convs.filter("n = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("name"), "conv"))
    out = linked.join(sums, "node").join(joined_digests(ends), ["depth", "name"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", none).alias("ends_sha256"))


def rebuilt(turns: DataFrame, most: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) in which conversation c begins with the first h turns of c - c % family (h: its CRC-32 % most), in
    place of as many of its own."""
    lengths = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = lengths.select("conv", "own", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"), (F.col("conv") - F.col("conv") % family).alias("like"))
    convs = convs.join(lengths.select(F.col("conv").alias("like"), F.col("own").alias("there")), "like", "left")
    convs = cut(convs.withColumn("head", F.least("h", F.coalesce("there", F.lit(0)))).select("conv", "h", "like", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    tails = join_anew(turns, convs.select("conv", "h", "head"), ["conv"]).filter("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    heads = turns.filter(F.col("place") < most - 1).select(F.col("conv").alias("like"), "place", "turn", "bytes").join(convs.select("conv", "like", "head"), "like").filter("place < head")
    columns = ["conv", "place", "turn", "bytes"]
    return cut(tails.select(*columns).unionByName(heads.select(*columns))), convs.select("conv", "n")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations. Rows without a conversation belong to none."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt(ordered_turns(talks)))


ORACLE = """
WITH bits AS (SELECT list(t ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
o AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, o.t, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda a, b: xor(a >> 8, bits.t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295)::BIGINT % 9 AS h FROM o, bits),
b AS (SELECT h.c, list_concat(coalesce(o.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN o ON o.c = h.c - h.c % 5),
p AS (SELECT c, len(t) AS n, d, t[1:d] AS p, t[d].x AS x FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM b)),
g AS (SELECT p, d, min(c) AS c, count(*) AS n_convs, any_value(x) AS x, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY p, d),
k AS (SELECT g.*, u.c AS parent, (SELECT count(*) FROM g v WHERE v.d = g.d + 1 AND v.p[1:g.d] = g.p) AS kids FROM g LEFT JOIN g u ON u.d = g.d - 1 AND u.p = g.p[1:g.d - 1]),
s AS (SELECT k.p, k.d, count(*) FILTER (v.kids = 0) AS leaves, sum((v.n_convs - 1) * strlen(coalesce(v.x, '')))::BIGINT AS saved FROM k JOIN k v ON v.d >= k.d AND v.p[1:k.d] = k.p GROUP BY k.p, k.d)
SELECT k.c AS conv_id, k.d AS depth, k.parent AS parent_conv_id, n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, ends AS ends_sha256
FROM k JOIN s ON s.p = k.p AND s.d = k.d
"""
