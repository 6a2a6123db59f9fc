"""A compression classifier of text quality.

One zstandard dictionary is built from good and one from bad labelled text. A text is compressed with either, in
blocks of about BLOCK bytes so that the dictionaries count for all of a long text; the difference of the two sizes, normalised
by their sum, is the evidence, with the sizes against the text's own. A logistic curve makes it a probability; it is
fitted to each half of the sample with dictionaries of the other half. Only text enters a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import arrow_map, cut, hash_sample, slices

BLOCK, LEVEL, DICTIONARY = 2048, 3, 64 << 10
#: The fit's bounds: so many labelled texts of each label, taken whole, and so many blocks of them, drawn from anywhere
#: in the texts, for each dictionary.
SAMPLE, SAMPLE_BLOCKS = 1500, 4096
THRESHOLD = 0.7
#: Quantiles of the sample's shrinkage at which the curve may bend.
BENDS = (0.5, 0.9)


@dataclass(frozen=True)
class Model:
    """The two dictionaries, where the curve bends, and its weights."""

    good: bytes
    bad: bytes
    bends: tuple[float, ...]
    weights: tuple[float, ...]


def _pressed(dictionary: bytes):
    """A function that gives the compressed size of each block of some data."""
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    made.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda blocks: [len(press(x)) for x in blocks]


def evidence(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Of each text: the normalised difference of its sizes with the two dictionaries; the logarithm of its length; how
    far its blocks shrink (mean logarithm, with the worse dictionary). An empty text has 0 of each."""
    with_good, with_bad = _pressed(good), _pressed(bad)
    rows = []
    for text in texts:
        data = text.encode()
        n = len(data)
        parts = max(1, round(n / BLOCK))
        blocks = [data[n * i // parts : n * (i + 1) // parts] for i in range(parts)] if n else []
        g, b = with_good(blocks), with_bad(blocks)
        least = [max(x, y) for x, y in zip(g, b, strict=True)]  # a dictionary may hold a good passage whole; both hardly do
        shrunk = sum(math.log((len(d) + 32) / (x + 32)) for d, x in zip(blocks, least, strict=True)) / parts
        rows.append(((sum(b) - sum(g)) / (sum(b) + sum(g) + 160), math.log1p(n), shrunk))
    return np.array(rows, float).reshape(-1, 3)


def _design(found: np.ndarray, bends: tuple[float, ...]) -> np.ndarray:
    """What the curve weighs: 1, the difference, plain and times the logarithm of the length, and the shrinkage beyond
    each bend, as text that repeats itself shrinks most."""
    d, size, shrunk = found.T
    return np.stack([np.ones(len(d)), 10 * d, 2 * d * size, *(np.maximum(0.0, shrunk - x) for x in bends)], 1)


def probabilities(found: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(found, model.bends) @ np.array(model.weights), -30, 30)))


def _dictionary(blocks: list[bytes]) -> bytes:
    """A zstandard dictionary of the blocks; of few blocks their plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-DICTIONARY:] or b"\0" * 8


def _own_lines(picked: DataFrame) -> DataFrame:
    """picked (id, y, text) without the lines that several of its texts share, as they are boilerplate, good or bad by
    accident; a text of such lines alone stays as it is."""
    lines = picked.select("id", "y", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    single = lines.groupBy("line").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("id"), F.min("at").alias("at")).filter("ids = 1").select("id", "line")
    kept = lines.join(single, ["id", "line"]).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("own"))  # a text's own lines
    return picked.join(kept, "id", "left").select("id", "y", F.when(F.length("own") > 0, F.col("own")).otherwise(F.col("text")).alias("text"))


def _blocks(own: DataFrame, most: int) -> dict[tuple[int, int], list[bytes]]:
    """(label, half) -> blocks of own (id, y, text): all, or the `most` / 2 of least hash of id and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(i, y, k, data[a : a + BLOCK]) for i, y, t in zip(*(batch[c].to_pylist() for c in ("id", "y", "text")), strict=True) for data in [t.encode()] for k, a in enumerate(range(0, len(data), BLOCK))]
            yield pa.record_batch([pa.array([x[0] for x in found], batch["id"].type), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.binary())], ["id", "y", "k", "block"])

    kind = own.schema["id"].dataType.simpleString()
    each = cut(arrow_map(own.select("id", F.col("y").cast("int").alias("y"), "text"), run, f"id {kind}, y int, k int, block binary").withColumn("half", _half("id")))
    out = {}
    for y in (0, 1):
        for half in (0, 1):
            rows = each.filter((F.col("y") == y) & (F.col("half") == half)).orderBy(F.xxhash64("id", "k"), "id", "k").limit(most // 2).select("block").toArrow()
            out[y, half] = rows["block"].to_pylist()
    return out


def _half(id: str):
    return F.pmod(F.xxhash64(F.lit(5), F.col(id)), F.lit(2)).cast("int")


def _curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """The weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, blocks: int = SAMPLE_BLOCKS) -> Model:
    """The model of the texts of docs (id, text) that labels (id, label 0 or 1) marks and that aren't held out.

    At most `sample` ids of each label enter, those of least hash, with their whole texts; at most `blocks` blocks of
    these build the dictionaries of either label. So what the driver gets and what is broadcast (the chosen ids) is
    bounded however large the input. Each half's evidence, for the curve, comes from dictionaries of the other half;
    all build the final dictionaries. Null labels, null ids and texts without characters say nothing; of an id with
    several labels the least counts, of an id with several texts the least. With one label only, or none, the model
    gives every text the share of good labels (1 if there is no label).
    """
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("id")).agg(F.min(label).alias("y"))
    times = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    chosen = [hash_sample(marks.filter(F.col("y") == y), "id", sample, times.get(y, 0)) for y in (0, 1)]
    own = docs.filter(F.length(text) > 0).select(F.col(id).alias("id"), F.col(text).alias("t"))
    picked = cut(own.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").groupBy("id", "y").agg(F.min("t").alias("text")))
    found = _blocks(_own_lines(picked), blocks)
    good, bad = (found[y, 0] + found[y, 1] for y in (1, 0))
    if not good or not bad:
        return Model(b"\0" * 8, b"\0" * 8, (0.0,) * len(BENDS), (8.0 if good or not bad else -8.0, *(0.0,) * (2 + len(BENDS))))
    kind = picked.schema["id"].dataType.simpleString()
    seen = []
    for half in (0, 1):
        pair = [_dictionary(found[y, half] or found[y, 1 - half]) for y in (1, 0)]

        def run(batches: Iterator[pa.RecordBatch], pair=pair) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                columns = evidence(batch["text"].to_pylist(), *pair).T
                yield pa.record_batch([batch["id"], batch["y"], *map(pa.array, columns)], ["id", "y", "d", "size", "shrunk"])

        other = picked.filter(_half("id") == 1 - half).select("id", F.col("y").cast("int").alias("y"), "text")
        seen.append(arrow_map(other, run, f"id {kind}, y int, d double, size double, shrunk double").toArrow())
    rows = pa.concat_tables(seen).sort_by("id")
    evidence_ = np.stack([rows[c].to_numpy() for c in ("d", "size", "shrunk")], 1)
    y = rows["y"].to_numpy().astype(float)
    bends = tuple(float(x) for x in np.quantile(evidence_[:, 2], BENDS))
    w = _curve(_design(evidence_, bends), y)
    share, sampled = times[1] / (times[0] + times[1]), np.clip(y.mean(), 1e-6, 1 - 1e-6)
    # The sample has about as many good as bad texts; the labelled rows have not.
    w[0] += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    return Model(_dictionary(good), _dictionary(bad), bends, tuple(map(float, w)))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: good likelier) and predicted (1 if score >= threshold, else 0) after its
    columns; a null text counts as empty. An empty text has the score of no evidence. Columns of docs named score or
    predicted are replaced. Repeated rows get equal scores; an empty table gives no rows."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index(text)
    source = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            p = probabilities(evidence([t or "" for t in batch.column(at).to_pylist()], model.good, model.bad), model)
            yield pa.record_batch([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return arrow_map(source, run, schema)


def held_out(id: str = "doc_id"):
    """Whether a row is kept from the fit: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
