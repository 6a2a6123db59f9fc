"""Merkle manifest of a dataset: each row's digest, a tree for each group, one root above, and a proof for each row.

Bottom-up build: leaves of a group have places from 0 and meet by place, FAN_OUT nodes to a run. BAND levels at a time
are one table in the shared folder, a row being the subtree over FAN_OUT ** BAND nodes with the digests of its levels.
Top-down proof push: beginning at the top, the nodes of each band join the row above them, which inherited a proof
suffix; each prepends its siblings of the band's levels to it. So 10^9 leaves take six joins up and down, and a proof's
upper part travels once for 32 nodes. The groups' roots are leaves of a tree above, built and pushed by the same
functions. A row holds at most 32 nodes and a proof of log n steps; no group meets in one task, as places come from
ranges (wordloom/operators/ranges.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import cut, join_anew
from wordloom.operators.ranges import placed

FAN_OUT, BAND = 2, 5
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: Column) -> Column:
    """A value as a leaf holds it: "-" for null, else its number of UTF-8 bytes, ":" and the value in decimal or as text."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """The SHA-256 of the encoded fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in fields]), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """The digests as hexadecimal text, one after the other."""
    return F.array_join(F.transform(digests, hexed), "")


def node_digest(children: Column) -> Column:
    return F.unhex(F.sha2(joined(children), 256))


def level_above(nodes: Column, fan_out: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(fan_out)), lambda k: node_digest(F.slice(nodes, k, F.lit(fan_out))))


def bands(leaves: DataFrame, fan_out: int = FAN_OUT, band: int = BAND) -> list[DataFrame]:
    """The trees over leaves (tree, place, digest) as tables of `band` levels each, written: tree, place, runs (the digests
    of each level, the last one being that of the row's top), top, whole (this row's top is its tree's).

    A row that is the first of its tree and isn't full has all that is left of the tree, so it ends where one node is
    left; any other row has all `band` levels, however few nodes it has."""
    most, out, now = fan_out**band, [], leaves.select("tree", "place", "digest")
    while True:
        rows = now.groupBy("tree", F.expr(f"place div {most}").alias("place")).agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("k"), "digest"))).alias("kids"))
        rows = rows.select("tree", "place", ((F.col("place") == 0) & (F.size("kids") < most)).alias("whole"), F.array("kids.digest").alias("runs"))
        for _ in range(band):
            last = F.element_at("runs", -1)
            rows = rows.withColumn("runs", F.when(F.col("whole") & (F.size(last) == 1), F.col("runs")).otherwise(F.concat("runs", F.array(level_above(last, fan_out)))))
        out.append(cut(rows.withColumn("top", F.element_at("runs", -1)[0])))
        now = out[-1].filter("NOT whole").select("tree", "place", F.col("top").alias("digest"))
        if now.isEmpty():
            return out


def tops(above: list[DataFrame]) -> DataFrame:
    """tree, top, band (the table it is in) of each tree."""
    each = [x.filter("whole").select("tree", "top", F.lit(k).alias("band")) for k, x in enumerate(above)]
    return cut(reduce(DataFrame.unionByName, each))


def steps(runs: Column, place: Column, fan_out: int) -> Column:
    """The siblings before and after the node at a place of a row's lowest level, and those of the nodes above it."""

    def one(run: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fan_out)), level)).cast("int")
        k = at % fan_out
        kids = F.slice(run, at - k + 1, F.lit(fan_out))
        return F.struct(F.slice(kids, F.lit(1), k).alias("before"), F.slice(kids, k + 2, F.lit(fan_out)).alias("after"))

    return F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), one)


def pushed(leaves: DataFrame, above: list[DataFrame], roofs: DataFrame, fan_out: int = FAN_OUT, band: int = BAND) -> DataFrame:
    """leaves with proof: the steps from the leaf up to its tree's top, then those of roofs (tree, band, proof).

    From the top down, the nodes of each band join the row above them, which holds the suffix that it inherited."""
    most, below = fan_out**band, None
    for k in range(len(above) - 1, -2, -1):
        here = leaves if k < 0 else above[k].select("tree", "place", "runs", "whole")
        if below is not None:
            rows = below.select("tree", F.col("place").alias("__wl_parent"), F.col("runs").alias("__wl_runs"), F.col("proof").alias("__wl_suffix"))
            met = (here if k < 0 else here.filter("NOT whole")).withColumn("__wl_parent", F.expr(f"place div {most}")).join(rows, ["tree", "__wl_parent"])
            met = met.select(*[F.col(f"`{c}`") for c in here.columns], F.concat(steps(F.col("__wl_runs"), F.col("place") % most, fan_out), F.col("__wl_suffix")).alias("proof"))
        if k < 0:
            return met
        ended = here.filter("whole").join(roofs.filter(F.col("band") == k).select("tree", "proof"), "tree")
        below = cut(ended if below is None else met.unionByName(ended))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, s: F.unhex(F.sha2(F.concat(joined(s["before"]), hexed(digest), joined(s["after"])), 256)))


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, other: Column | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """One row for each row of docs: id, leaf, subroot, root (32 bytes each), proof (array of steps, each with the siblings
    before and after), and other_leaf: the leaf with `other` in place of n_chars, or the leaf if other is None.

    Leaves of a group ascend by id (null first), rows of one id by their digest; a null group is one like others and comes
    first. A leaf that is alone in its group is the group's root; a single group's root is the root. Repeated rows are
    leaves of their own. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    own = [F.col(f"`{f}`") for f in fields]
    changed = [other if other is not None and f == "n_chars" else c for f, c in zip(fields, own, strict=True)]
    tree = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    # Texts are hashed once, before ranges are found: only digests travel.
    digest = leaf_digest(own)
    rows = cut(docs.select(F.col(f"`{id}`").alias("id"), tree.alias("tree"), digest.alias("digest"), (digest if other is None else leaf_digest(changed)).alias("other")))
    leaves = cut(placed(rows, ["tree"], [F.col("id").asc_nulls_first(), F.col("digest")]))
    above = bands(leaves, fan_out)
    roots = tops(above)

    upper = cut(placed(roots.select(F.col("tree").alias("lower"), F.col("top").alias("digest"), "band"), [], [F.col("lower")]).withColumn("tree", F.lit("")))
    upper_bands = bands(upper, fan_out)
    root = tops(upper_bands)
    none = F.expr("cast(array() AS array<struct<before: array<binary>, after: array<binary>>>)")
    proofs = pushed(upper.withColumnRenamed("band", "own_band"), upper_bands, root.select("tree", "band", none.alias("proof")), fan_out)
    proofs = proofs.join(F.broadcast(root.select("tree", F.col("top").alias("root"))), "tree")  # one row
    roofs = cut(proofs.select(F.col("lower").alias("tree"), F.col("own_band").alias("band"), "proof", F.col("digest").alias("subroot"), "root"))

    named = join_anew(leaves, roofs.select("tree", "subroot", "root"), ["tree"])
    found = pushed(named, above, roofs.select("tree", "band", "proof"), fan_out)
    return found.select(F.col("id").alias(id), F.col("digest").alias("leaf"), "subroot", "root", "proof", F.col("other").alias("other_leaf"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's CRC-32 seven divides are checked with n_chars one larger; only they may fail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, other=F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    again = folded(F.col("other_leaf"), F.col("proof"))
    steps = F.transform("proof", lambda s: F.concat(joined(s["before"]), joined(s["after"])))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"), again.alias("again"))
    return out.select("doc_id", *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof_sha256", hexed(F.col("again")).alias("folded_root"), (F.col("again") == F.col("root")).alias("verified"))


ORACLE = """
WITH RECURSIVE bits AS (SELECT list(t ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
crc AS (SELECT doc_id, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), bits),
d AS (SELECT documents.*, coalesce(crc % 7 = 0, false) AS hit FROM documents LEFT JOIN crc ON documents.doc_id = crc.doc_id),
e AS (SELECT doc_id, lang, hit, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS m, coalesce(strlen(text) || ':' || text, '-') AS t FROM d),
f AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(a || n || t) AS leaf, sha256(a || CASE WHEN hit THEN m ELSE n END || t) AS other FROM e),
g AS (SELECT row_number() OVER () AS r, doc_id, tree, leaf, other, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
lv AS (SELECT 0 AS k, tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM g
  UNION ALL SELECT k + 1, tree, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM lv WHERE n > 1 GROUP BY k, tree, i // 2),
s AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM lv WHERE n = 1),
up AS (SELECT 0 AS k, i, h, count(*) OVER () AS n FROM s
  UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY k, i // 2),
p AS (SELECT r, g.tree, 0 AS k, g.i, '' AS proof, other AS fold, n FROM g JOIN (SELECT tree, any_value(n) AS n FROM lv WHERE k = 0 GROUP BY tree) c ON g.tree = c.tree
  UNION ALL SELECT r, p.tree, p.k + 1, p.i // 2, proof || coalesce(lv.h, ''), sha256(CASE WHEN p.i % 2 = 0 THEN fold || coalesce(lv.h, '') ELSE lv.h || fold END), (p.n + 1) // 2
  FROM p LEFT JOIN lv ON lv.tree = p.tree AND lv.k = p.k AND lv.i = xor(p.i, 1) WHERE p.n > 1),
q AS (SELECT r, 0 AS k, s.i, proof, fold, (SELECT count(*) FROM s) AS n FROM p JOIN s ON p.tree = s.tree WHERE p.n = 1
  UNION ALL SELECT r, q.k + 1, q.i // 2, proof || coalesce(up.h, ''), sha256(CASE WHEN q.i % 2 = 0 THEN fold || coalesce(up.h, '') ELSE up.h || fold END), (q.n + 1) // 2
  FROM q LEFT JOIN up ON up.k = q.k AND up.i = xor(q.i, 1) WHERE q.n > 1)
SELECT g.doc_id, g.leaf, s.h AS subroot, x.h AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root, q.fold = x.h AS verified
FROM g JOIN q ON q.r = g.r AND q.n = 1 JOIN s ON s.tree = g.tree CROSS JOIN (SELECT h FROM up WHERE n = 1) x
"""
