"""An index of vectors by cells: the nearest of very many queries, each of which meets the rows of a few cells only."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from wordloom.operators.vectors import moved, top_similar
from wordloom.sources.stores import read_parts, write_parts
from wordloom.sources.written import written

#: Cells at most; rows for each cell, and rounds, that the centres are fitted to; vectors of a block; queries that the number
#: of cells to try is measured by, and the share of their neighbours to be found.
MOST_CELLS, FIT_ROWS, FIT_ROUNDS, BLOCK, TRIED, TARGET = 4096, 256, 8, 512, 256, 0.95
#: Parts, at least, that queries are dealt to, and rows; bytes of the vectors of a part; queries that are compared at once,
#: and answers that they gather before all but the first of each are dropped.
PARTS, PART_BYTES, AT_ONCE, GATHERED = 6, 64 << 20, 2048, 1 << 20
#: Bytes of an Arrow batch of blocks.
BATCH_BYTES = 8 << 20


def _by_hash(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, the same in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _units(batch: pa.RecordBatch) -> np.ndarray:
    x = _matrix(batch["vector"]).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x.copy(), where=norm > 0)


def _fitted(rows: DataFrame, cells: int, n: int, seed: int) -> np.ndarray:
    """The centres of cells: spherical k-means on FIT_ROWS rows for each, chosen by a hash, from seeds among them."""
    share = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS * cells / n) * (1 << 30))
    sample = written(rows.filter(share).select(F.lit(0).cast("long").alias("_g"), "id", "vector"))
    seeds = _by_hash(sample, cells, seed + 1).toArrow().combine_chunks().to_batches()
    centres = {0: np.concatenate([_units(b) for b in seeds])}
    for _ in range(FIT_ROUNDS):
        before, centres = centres, moved(sample, centres)
        if np.allclose(before[0], centres[0], atol=1e-4):
            break
    return centres[0]


def _near(batch: pa.RecordBatch, centres: np.ndarray, tried: int) -> np.ndarray:
    return np.argsort(-np.round(_units(batch) @ centres.T, 9), 1, kind="stable")[:, :tried]


def _celled(rows: DataFrame, centres: np.ndarray, tried: int = 1) -> DataFrame:
    """rows with cell: the `tried` cells whose centres are nearest, a row for each."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                near = _near(own, shared.value, tried)
                again = own.take(pa.array(np.repeat(np.arange(own.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(near.ravel().astype(np.int32))], [*own.schema.names, "cell"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cell", IntegerType())]))


def write_index(vectors: DataFrame, path: str, most: int = 5, cells: int | None = None, target: float = TARGET, seed: int = 0) -> None:
    """An index of vectors (id, vector) under path, for searches that ask for at most `most` neighbours.

    Each row goes to the cell of the nearest of so many centres (about the square root of the number of rows, MOST_CELLS at
    most), which are fitted to a sample of FIT_ROWS rows a cell; a cell is a folder, written by as many tasks as it needs.
    How many cells a search tries follows from the data: TRIED rows search all rows exactly, and the number is the least
    that finds `target` of their neighbours. Vectors without clusters need most cells, clustered ones few.

    Of rows with equal vectors the most + 1 of least id are held: the others come after these in every answer. Vectors have
    one length, and are of unit length where similarity should be the cosine. Rows without an id or vector are left out."""
    rows = vectors.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    held = written(rows.withColumn("_n", F.row_number().over(W.partitionBy("vector").orderBy("id"))).filter(F.col("_n") <= most + 1).drop("_n"))
    spark, n = rows.sparkSession, held.count()
    cells = cells or max(1, min(MOST_CELLS, isqrt(n)))
    centres = _fitted(held, cells, n, seed) if n else np.zeros((0, 1))
    write_parts(_celled(held, centres) if n else held.withColumn("cell", F.lit(0)), f"{path}/cells", "cell", ("id",))
    tried = _by_hash(held, TRIED, seed + 2)
    found = top_similar(tried, held, most).select("query_id", "id")  # TRIED * most rows
    own = spark.read.schema(_cell_schema(held)).parquet(f"{path}/cells").select("id", "cell").join(F.broadcast(found), "id")
    ranked = _celled(tried, centres, len(centres)).groupBy("id").agg(F.collect_list("cell").alias("order")) if n else None
    ranks = own.join(F.broadcast(ranked.withColumnRenamed("id", "query_id")), "query_id").select(F.array_position("order", F.col("cell")).alias("r")) if n else None
    sorted_ranks = sorted(r["r"] for r in ranks.collect()) if n else []
    tries = int(sorted_ranks[min(len(sorted_ranks) - 1, int(target * len(sorted_ranks)))]) if sorted_ranks else 1
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame([(tries, most, rows.schema["id"].dataType.simpleString(), rows.schema["vector"].dataType.simpleString())], "tries int, most int, id string, vector string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _cell_schema(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("cell", IntegerType())])


class _Deal(NamedTuple):
    """How the vectors of cells are dealt to parts of about `size`: those of cell c stand at start[c] and the n[c] - 1 places
    after it, each at one that a hash of its id gives. A cell of very many has several parts."""

    start: np.ndarray
    n: np.ndarray
    size: int

    def parts(self) -> int:
        return max(1, -(-int(self.n.sum()) // self.size))

    def of(self, cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return (self.start[cells] + hashes % np.maximum(self.n[cells], 1)) // self.size

    def holding(self) -> np.ndarray:
        """Whether a part (column) may hold vectors of a cell (row)."""
        part = np.arange(self.parts())
        return (self.n[:, None] > 0) & (part >= (self.start // self.size)[:, None]) & (part <= ((self.start + np.maximum(self.n, 1) - 1) // self.size)[:, None])


def _deal(celled: DataFrame, places: np.ndarray, width: int) -> _Deal:
    """PARTS parts, or as many as parts of PART_BYTES need. celled: cell; its counts, a row a cell, come to the driver."""
    n = np.zeros(len(places), np.int64)
    for cell, count in celled.groupBy("cell").count().collect():
        n[places[cell]] = count
    return _Deal(np.cumsum(n) - n, n, max(1, min(-(-int(n.sum()) // PARTS), PART_BYTES // width)))


def _in_order(centres: np.ndarray) -> np.ndarray:
    """The place of each cell in an order in which near ones mostly stand together, so that queries of a part try few parts."""
    spread = centres - centres.mean(0)
    return np.argsort(np.argsort(np.round(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], 9), kind="stable"), kind="stable")


def _asking(asked: DataFrame, centres: np.ndarray, places: np.ndarray, tried: int, queries: _Deal, rows: _Deal) -> DataFrame:
    """g, s, ids, x, tries, cells: blocks of the queries (id, vector) of part g that try cells of the rows' part s, with the
    cells that each tries as bits, and those of part s that one of them tries. Cells go by place."""
    schema = StructType([
        StructField("g", IntegerType()), StructField("s", IntegerType()), StructField("ids", ArrayType(asked.schema["id"].dataType)), StructField("x", BinaryType()), StructField("tries", BinaryType()), StructField("cells", ArrayType(IntegerType())),
    ])
    shared = asked.sparkSession.sparkContext.broadcast((centres, places, queries, rows, rows.holding()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, places, queries, rows, holding = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                near = places[_near(own, centres, tried)]
                tries = np.zeros((own.num_rows, len(places)), bool)
                np.put_along_axis(tries, near, True, 1)
                tries &= rows.n > 0
                part = queries.of(near[:, 0], own["h"].to_numpy())
                x, bits = _matrix(own["vector"]), np.packbits(tries, axis=1)
                out = []
                for s in range(holding.shape[1]):
                    held = tries & holding[:, s]
                    met = held.any(1)
                    for g in np.unique(part[met]).tolist():
                        at = np.flatnonzero(met & (part == g))
                        out.append((g, s, own["id"].take(pa.array(at)).to_pylist(), x[at].tobytes(), bits[at].tobytes(), np.flatnonzero(held[at].any(0)).tolist()))
                if out:
                    ids = pa.list_(own["id"].type)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), ids, pa.binary(), pa.binary(), pa.list_(pa.int32())), strict=True)], schema.names)

    return asked.select("id", "vector", F.xxhash64("id").alias("h")).mapInArrow(run, schema)


def _answering(rows: DataFrame, places: np.ndarray, deal: _Deal) -> DataFrame:
    """place, s, ids, x: blocks of at most BLOCK of the rows (id, vector, cell) of a cell in part s. Cells go by place."""
    schema = StructType([StructField("place", IntegerType()), StructField("s", IntegerType()), StructField("ids", ArrayType(rows.schema["id"].dataType)), StructField("x", BinaryType())])
    shared = rows.sparkSession.sparkContext.broadcast((places, deal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, deal = shared.value
        for batch in batches:
            place = places[batch["cell"].to_numpy()]
            part = deal.of(place, batch["h"].to_numpy())
            order = np.lexsort((part, place))
            ends = np.flatnonzero((np.diff(place[order]) != 0) | (np.diff(part[order]) != 0)) + 1
            for some in np.split(order, ends):
                for a in range(0, len(some), BLOCK):
                    own = batch.take(pa.array(some[a : a + BLOCK]))
                    yield pa.record_batch([pa.array([place[some[0]]], pa.int32()), pa.array([part[some[0]]], pa.int32()), pa.array([own["id"].to_pylist()], pa.list_(own["id"].type)), pa.array([_matrix(own["vector"]).tobytes()])], schema.names)

    return rows.select("id", "vector", "cell", F.xxhash64("id").alias("h")).mapInArrow(run, schema)


def _first(q: np.ndarray, r: np.ndarray, close: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (q, r) the k closest of each q, ties by rank of r."""
    order = np.lexsort((rank[r], -close, q))
    q, r, close = q[order], r[order], close[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], r[kept], close[kept]


def _nearest_of(asking: pa.Table, answering: pa.Table, k: int, kind: np.dtype, cells: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(query ids, ids, similarity) of the first k rows of each query among the rows of the cells that it tries, for AT_ONCE
    queries at a time."""
    names = pa.concat_arrays([b.values for b in asking["ids"].combine_chunks()])
    ids = pa.concat_arrays([b.values for b in answering["ids"].combine_chunks()])
    rank = np.empty(len(ids), np.int64)
    rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    q = np.frombuffer(b"".join(asking["x"].to_pylist()), kind).reshape(len(names), -1)
    tries = np.frombuffer(b"".join(asking["tries"].to_pylist()), np.uint8).reshape(len(names), -1)
    place = answering["place"].to_numpy()
    sizes = pa.compute.list_value_length(answering["ids"]).to_numpy()
    starts, blocks = np.cumsum(sizes) - sizes, answering["x"].to_pylist()
    for a in range(0, len(names), AT_ONCE):
        own = q[a : a + AT_ONCE].astype(np.float64)
        open_ = np.unpackbits(tries[a : a + AT_ONCE], axis=1, count=cells).astype(bool)
        least = np.full(len(own), -np.inf)  # no answer below it is among the first k
        found, n = [], 0
        for j, block in enumerate(blocks):
            at = np.flatnonzero(open_[:, place[j]])
            if not len(at):
                continue
            x = np.frombuffer(block, kind).reshape(sizes[j], -1).astype(np.float64)
            close = own[at] @ x.T
            if sizes[j] >= k and (least[at] == -np.inf).any():
                least[at] = np.maximum(least[at], np.round(np.partition(close, -k, 1)[:, -k], 6))
            of, r = np.nonzero(close >= least[at][:, None] - 1e-6)  # before rounding
            found.append((at[of], r + starts[j], np.round(close[of, r], 6)))
            n += len(of)
            if n > GATHERED:
                found = [_first(*map(np.concatenate, zip(*found, strict=True)), rank, k)]
                n = len(found[0][0])
                full = np.bincount(found[0][0], minlength=len(own)) == k
                last = np.searchsorted(found[0][0], np.arange(len(own)), "right") - 1
                least[full] = np.maximum(least[full], found[0][2][last[full]])
        if found:
            of, r, close = _first(*map(np.concatenate, zip(*found, strict=True)), rank, k)
            yield names.take(pa.array(of + a)), ids.take(pa.array(r)), close


def nearest(spark: SparkSession, queries: DataFrame, path: str, most: int = 5) -> DataFrame:
    """query_id, id, similarity, place: the nearest rows of the index under path for each query (id, vector), itself aside.

    queries may be as many as the rows. Equal vectors search once, each in the cells nearest to it. Queries and rows are dealt
    to parts, near cells together, and a task compares a part of the queries with one of the rows, where a query tries a cell of
    it: so a query travels to PARTS tasks at most and not to each cell that it tries, and a row to as many; a pair of parts gives
    the first of each query only. Parts have PART_BYTES at most; more parts than PARTS make what travels grow with queries
    times rows. Cells that no query tries aren't read. Similarity has six digits; ties stand by id. A neighbour in a cell that
    isn't tried is missed: write_index says how often."""
    about = spark.read.parquet(f"{path}/about").first()
    if most > about["most"]:
        raise ValueError(f"the index answers for {about['most']} neighbours at most")
    conf = spark.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    queries = queries.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    kind, k = queries.schema["id"].dataType, most + 1
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # MOST_CELLS at most
    out = f"query_id {kind.simpleString()}, id {about['id']}, similarity double"
    if not len(centres):
        return spark.createDataFrame([], f"{out}, place long")
    schema = spark.createDataFrame([], f"id {about['id']}, vector {about['vector']}, cell int").schema
    both = {about["vector"], queries.schema["vector"].dataType.simpleString()}
    single = both == {"array<float>"}
    if not single:  # of one kind on both sides
        queries = queries.withColumn("vector", F.col("vector").cast("array<double>"))
    number, n_cells = np.dtype(np.float32 if single else np.float64), len(centres)
    width, places = centres.shape[1] * number.itemsize, _in_order(centres)
    asked = written(queries.groupBy("vector").agg(F.min("id").alias("id")))
    dealt = _deal(_celled(asked, centres), places, width)
    slices = _deal(spark.read.schema(schema).parquet(f"{path}/cells"), places, width)
    asking = written(_asking(asked, centres, places, about["tries"], dealt, slices))
    wanted = written(asking.select("g", F.explode("cells").alias("place")).distinct())  # parts times cells at most
    tried = np.zeros(n_cells, bool)
    tried[[r[0] for r in wanted.select("place").distinct().collect()]] = True
    rows = read_parts(spark, f"{path}/cells", schema, "cell", np.flatnonzero(tried[places]).tolist())
    if not single:
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    answering = _answering(rows, places, slices).join(F.broadcast(wanted), "place")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "similarity"]
        found = [pa.table([of, r, close], names) for of, r, close in _nearest_of(left, right, k, number, n_cells)] if left.num_rows and right.num_rows else []
        return pa.concat_tables(found) if found else pa.table([pa.array([], left["ids"].type.value_type), pa.array([], right["ids"].type.value_type), pa.array([], pa.float64())], names)

    pairs, by = dealt.parts() * slices.parts(), ["g", "s"]
    found = asking.drop("cells").repartition(pairs, *by).groupBy(*by).cogroup(answering.repartition(pairs, *by).groupBy(*by)).applyInArrow(compare, out)
    first = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.col("similarity").desc(), "id"))
    found = found.withColumn("_k", first("query_id")).filter(F.col("_k") <= k).drop("_k").withColumnRenamed("query_id", "_asked")
    named = queries.join(asked.withColumnRenamed("id", "_asked"), "vector").select(F.col("id").alias("query_id"), "_asked")
    met = named.join(found, "_asked").filter(F.col("query_id") != F.col("id"))
    return met.withColumn("place", first("query_id").cast("long")).filter(F.col("place") <= most).select("query_id", "id", "similarity", "place")
