"""Vectors: similarity, clusters on the sphere, and a varied choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators.lemma import cosine
from wordloom.operators.ranges import numbered
from wordloom.sources.written import written

SHADOW, TOP, ROUNDS, CLUSTERS = 0.55, 20, 60, 12
#: Queries that a worker holds at a time.
QUERY_BLOCK = 4096
#: Rounds of seeding; groups whose centres or choices are held at a time; rows of a group that a round of the choice takes;
#: groups whose names may be broadcast.
SEED_ROUNDS, GROUPS, BLOCK, MOST_GROUPS = 4, 256, 64, 10_000


def normalise(vector: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def top_similar(queries: DataFrame, vectors: DataFrame, most: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, similarity, place: the nearest of vectors (id, vector) for each query (id, vector), itself aside.

    queries is a stated set. It meets all vectors in blocks of about `block` queries, each one broadcast; a task gives
    the nearest of each Arrow batch only, so what is shuffled grows with batches and not with pairs. Rows without an id
    or a vector find and are found by nothing."""
    queries, vectors = (x.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL") for x in (queries, vectors))
    parts = max(1, -(-queries.count() // block))
    kind, found = vectors.schema["id"].dataType.simpleString(), None
    for part in range(parts):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()
        if not own.num_rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((own["id"].to_numpy(), np.array(own["vector"].to_pylist(), np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in batches:
                ids = batch["id"].to_numpy(zero_copy_only=False)
                for a in range(0, len(ids), 2048):
                    own_ids = ids[a : a + 2048]
                    close = np.round(np.array(batch["vector"].slice(a, 2048).to_pylist(), np.float64) @ q.T, 6)
                    close[own_ids[:, None] == names[None]] = -np.inf
                    rows, columns = [], []
                    for j in range(len(names)):
                        best = np.lexsort((own_ids, -close[:, j]))[:most]
                        best = best[close[best, j] > -np.inf]
                        rows.append(best)
                        columns.append(np.full(len(best), j))
                    at, of = np.concatenate(rows), np.concatenate(columns)
                    yield pa.record_batch([pa.array(names[of]), pa.array(own_ids[at]), pa.array(close[at, of])], ["query_id", "id", "similarity"])

        near = vectors.mapInArrow(run, f"query_id {kind}, id {kind}, similarity double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, similarity double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("query_id", "id", "similarity", "place")


def grouped_points(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(points with _g, a number for each group of keys, in place of keys; keys with _g). Both are written."""
    named = numbered(points.select(*keys).distinct(), "_g")
    same = [F.col(f"_p.{c}").eqNullSafe(F.col(f"_n.{c}")) for c in keys]
    met = points.alias("_p").join(F.broadcast(named).alias("_n") if named.count() <= MOST_GROUPS else named.alias("_n"), same)
    return written(met.select("_g", *[F.col(f"_p.{c}") for c in points.columns if c not in keys])), named


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The groups and unit vectors of a batch."""
    x = pyarrow.compute.list_flatten(batch["vector"]).to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return batch["_g"].to_numpy(zero_copy_only=False), np.divide(x, norm, out=x.copy(), where=norm > 0)


def _closest(groups: np.ndarray, x: np.ndarray, centres: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centre of its group, and their cosine."""
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    for g in np.unique(groups):
        own = groups == g
        close = np.round(x[own] @ centres[int(g)].T, 9)
        at[own], best[own] = close.argmax(1), close.max(1)
    return at, best


def _seeds(points: DataFrame, k: int, rounds: int, seed: int) -> dict[int, np.ndarray]:
    """k centres far apart for each group: from one row, rounds that take about 2 * k rows each, the likelier the farther they
    are from all taken before; then k of those, weighted by how many rows are nearest to them."""
    sc, key = points.sparkSession.sparkContext, lambda r: F.xxhash64(F.lit(seed), F.lit(r), "_g", "id")
    first = points.groupBy("_g").agg(F.min_by("vector", F.struct(key(-1).alias("h"), "id")).alias("vector")).toArrow()
    centres = {int(g): x[None] for g, x in zip(*_rows(first), strict=True)}
    for r in range(rounds):
        shared = sc.broadcast(centres)

        def far(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups, x = _rows(batch)
                yield pa.record_batch([batch["_g"], batch["id"], batch["vector"], pa.array(np.clip(1.0 - _closest(groups, x, shared.value)[1], 0, None))], ["_g", "id", "vector", "far"])

        away = points.mapInArrow(far, f"{_ddl(points)}, far double")
        total = away.groupBy("_g").agg(F.sum("far").alias("all"))
        chance = F.pmod(key(r), F.lit(1 << 30)) / float(1 << 30)
        taken = away.join(total, "_g").filter((F.col("all") > 0) & (chance < 2 * k * F.col("far") / F.col("all"))).select("_g", "id", "vector").orderBy("_g", "id").toArrow()
        groups, x = _rows(taken)
        for g in np.unique(groups):
            centres[int(g)] = np.concatenate([centres[int(g)], x[groups == g]])
    weights = {g: np.zeros(len(c)) for g, c in centres.items()}
    for g, c, n in assigned(points, centres).groupBy("_g", "cluster").count().toArrow().to_pandas().itertuples(index=False):
        weights[g][c] = n
    out = {}
    for g, c in centres.items():
        rng, chosen = np.random.default_rng([seed, g]), [int(weights[g].argmax())]
        while len(chosen) < min(k, len(c)):
            away_ = np.clip(1.0 - (c @ c[chosen].T).max(1), 0, None) * np.maximum(weights[g], 1e-9)
            away_[chosen] = 0
            if away_.sum() <= 1e-12:
                break
            chosen.append(int(rng.choice(len(c), p=away_ / away_.sum())))
        out[g] = c[chosen]
    return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def assigned(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["_g"], batch["id"], pa.array(_closest(*_rows(batch), shared.value)[0].astype(np.int32))], ["_g", "id", "cluster"])

    return points.mapInArrow(run, f"{_ddl(points.select('_g', 'id'))}, cluster int")


def moved(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The centres in the direction of their members' sums. A task sums its rows before any are sent; a centre without
    members stays."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            groups, x = _rows(batch)
            at, _ = _closest(groups, x, shared.value)
            for g in np.unique(groups):
                own = groups == g
                mine = held.setdefault(int(g), np.zeros_like(shared.value[int(g)]))
                np.add.at(mine, at[own], x[own])
        for g, mine in held.items():
            n, dim = mine.shape
            yield pa.record_batch([pa.array(np.full(n * dim, g)), pa.array(np.repeat(np.arange(n, dtype=np.int32), dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), n)), pa.array(mine.ravel())], ["_g", "cluster", "i", "x"])

    rows = points.mapInArrow(sums, "_g long, cluster int, i int, x double").groupBy("_g", "cluster", "i").agg(F.round(F.sum("x"), 9).alias("x")).toArrow()
    total = {g: np.zeros_like(c) for g, c in centres.items()}
    groups, cluster, i, x = (rows[c].to_numpy() for c in ("_g", "cluster", "i", "x"))
    for g in np.unique(groups):
        own = groups == g
        total[int(g)][cluster[own], i[own]] = x[own]
    norm = {g: np.linalg.norm(t, axis=1, keepdims=True) for g, t in total.items()}
    return {g: np.where(norm[g] > 0, t / np.where(norm[g] > 0, norm[g], 1), centres[g]) for g, t in total.items()}


def in_group_blocks(points: DataFrame, named: DataFrame, most: int) -> list[DataFrame]:
    """points in parts of at most `most` groups each: what the driver and the workers hold is of one part."""
    return [points.filter(F.expr(f"_g div {most} = {part}")) for part in range(-(-named.count() // most))]


def sphere_clusters(points: DataFrame, keys: list[str], k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """keys, id, cluster of points (keys, id, vector): the nearest of at most k centres of the row's group, by cosine.

    Centres are seeded by oversampling in rounds and then moved to their members' means until none moves by more than
    1e-5, at most `rounds` times. Each round is a job over all rows wherever they are; a group of any size is summed in
    many tasks, and only sums of centres come together: k * dimensions for each of GROUPS groups at a time. A centre
    without members stays where it is. Fewer distinct vectors than k make fewer clusters. Rows without an id or vector
    are left out; rows of one id in a group should have one vector."""
    rows, named = grouped_points(points.select(*keys, "id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL"), keys)
    found = None
    for part in in_group_blocks(rows, named, GROUPS):
        centres = _seeds(part, k, SEED_ROUNDS, seed)
        for _ in range(rounds):
            before, centres = centres, moved(part, centres)
            if all(np.allclose(before[g], c, atol=1e-5) for g, c in centres.items()):
                break
        own = assigned(part, centres)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return points.select(*keys, "id", F.lit(0).alias("cluster")).limit(0)
    return found.join(named, "_g").select(*keys, "id", "cluster")


def varied(x: np.ndarray, shadow: float = SHADOW, top: int = TOP, before: np.ndarray | None = None) -> list[int]:
    """The rows chosen going down x: each whose cosine with all chosen, and with those chosen before, is under shadow; at
    most top with those before."""
    held = list(before) if before is not None else []
    chosen: list[int] = []
    for i in range(len(x)):
        if len(held) == top:
            break
        if not held or float(np.round(np.array(held) @ x[i], 9).max()) < shadow:
            chosen.append(i)
            held.append(x[i])
    return chosen


def varied_picks(ranked: DataFrame, keys: list[str], shadow: float = SHADOW, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """keys, id, rank of the varied choice from ranked (keys, id, rank, vector): going down a group's ranks (ties by id),
    each row whose cosine with all chosen before is under shadow, at most top.

    A group's state is what is chosen so far. In each round the tasks drop the rows that it shadows and those already
    passed, the first `block` of the others come together, and the choice goes on through them; where fewer are left, the
    group is done. So rounds grow with the choice and not with the group. Rows without an id, rank or vector are left out."""
    rows, named = grouped_points(ranked.select(*keys, "id", "rank", "vector").filter("id IS NOT NULL AND rank IS NOT NULL AND vector IS NOT NULL"), keys)
    spark, picked = ranked.sparkSession, []
    for part in in_group_blocks(rows, named, GROUPS):
        state: dict[int, tuple[np.ndarray | None, tuple | None]] = {int(r[0]): (None, None) for r in part.select("_g").distinct().collect()}
        while state:
            shared = spark.sparkContext.broadcast(state)

            def left(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    groups, x = _rows(batch)
                    ids, ranks = batch["id"].to_pylist(), batch["rank"].to_pylist()
                    keep = np.zeros(len(x), bool)
                    for g in np.unique(groups):
                        if int(g) in shared.value:
                            held, last = shared.value[int(g)]
                            own = np.flatnonzero(groups == g)
                            clear = np.ones(len(own), bool) if held is None else np.round(x[own] @ held.T, 9).max(1) < shadow
                            keep[own] = [c and (last is None or (ranks[i], ids[i]) > last) for c, i in zip(clear, own, strict=True)]
                    yield batch.filter(pa.array(keep))

            first = F.row_number().over(W.partitionBy("_g").orderBy("rank", "id"))  # cut to `block` before the shuffle
            near = part.mapInArrow(left, _ddl(part)).withColumn("_k", first).filter(F.col("_k") <= block).orderBy("_g", "_k").toArrow().combine_chunks()
            groups, x = _rows(near)
            ids, ranks = near["id"].to_pylist(), near["rank"].to_pylist()
            after = {}
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                held, _ = state[int(g)]
                chosen = own[varied(x[own], shadow, top, held)]
                picked += [(int(g), ids[i], ranks[i]) for i in chosen]
                held = x[chosen] if held is None else np.concatenate([held, x[chosen]])
                if len(own) == block and len(held) < top:
                    after[int(g)] = (held, (ranks[own[-1]], ids[own[-1]]))
            state = after
    # At most `top` rows for each group.
    picks = spark.createDataFrame(picked, f"_g long, {_ddl(rows.select('id', 'rank'))}")
    return picks.join(named, "_g").select(*keys, "id", "rank")


def clusters_and_picks(ranked: DataFrame, keys: list[str], k: int = CLUSTERS, shadow: float = SHADOW, top: int = TOP) -> DataFrame:
    """ranked (keys, id, rank, vector) with cluster and selected for each group of keys, by sphere_clusters() and
    varied_picks(). A group of any size is spread over many tasks; rows without a vector have no cluster."""
    same = lambda other: [F.col(f"_r.{c}").eqNullSafe(F.col(f"_o.{c}")) for c in other]
    rows = ranked.select(*keys, "id", "rank").alias("_r")
    own = [F.col(f"_r.{c}") for c in (*keys, "id", "rank")]
    met = rows.join(sphere_clusters(ranked, keys, k).distinct().alias("_o"), same([*keys, "id"]), "left").select(*own, "cluster").alias("_r")
    picks = varied_picks(ranked, keys, shadow, top).withColumn("selected", F.lit(True)).alias("_o")
    return met.join(picks, same([*keys, "id", "rank"]), "left").select(*own, "cluster", F.coalesce("selected", F.lit(False)).alias("selected"))


def centroids(vectors: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, centroid: the normalised mean of each cluster's vectors, by coordinate."""
    each = vectors.select(cluster, F.posexplode("vector").alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    folded = each.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))  # as long as a vector
    return folded.select(cluster, normalise(F.col("mean")).alias("centroid"))
