"""What the training-text operators share: written intermediate tables, byte-level word spans, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.sources.written import shared_dir
from wordloom.sources.written import written as cut

__all__ = ["WORD", "arrow_map", "ascii_lower", "bloom_filter", "bloom_passes", "cut", "fold", "hash_sample", "join_anew", "mix", "release", "row_key", "run_hashes", "shared_dir", "slices", "span_hashes", "utf8", "words"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word is a longest run of characters other than these six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: How many bytes the JVM gathers for one Arrow batch, unless the session says otherwise.
BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of about BATCH_BYTES, so that neither the JVM nor a worker holds many
    long texts at a time. A worker gives freed memory back to the system when its task ends."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_lower(text):
    """text with A-Z lower-cased and nothing else changed. Pure ASCII takes the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(text="text"):
    """A number that tells rows of one doc_id apart by their text: rows equal in both are the same row."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold about `most` bytes (one longer text stands alone)."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(ends[end - 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more: the end). Nulls are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _FOLD[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in data, and for each text the index of its first word (one more: the count)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = bounds[bounds < len(data)]
    starts[at] = inside[at]  # a word ends where its text ends
    at = bounds[bounds > 0] - 1
    ends[at] = inside[at]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, bounds)


_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... of n numbers; made anew each time, as that costs less than to keep them."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps, out=steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    own = sums[ends] - sums[starts]
    del sums
    return mix(own * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def run_hashes(items: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each n consecutive items."""
    if len(items) < n:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = items[: len(items) - n + 1] * factors[0]
    for k in range(1, n):
        out += items[k : len(items) - n + 1 + k] * factors[k]
    return mix(out)


def join_anew(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, with both sides dealt out for this join alone. An aggregate that is already
    dealt by the keys would keep Spark from splitting the partition of a key with very many rows on the left."""
    tag = "__wl_deal"
    left, right = (x.withColumn(tag, F.xxhash64(*keys)) for x in (left, right))
    return left.join(right, [tag, *keys], how).drop(tag)


def hash_sample(df: DataFrame, id: str, most: int, total: int) -> DataFrame:
    """At most `most` of df's `total` rows, those of least hash of the id. Most rows fall out where they are read, so
    that what the last step gathers doesn't grow with the number of tasks."""
    place = F.pmod(F.xxhash64(id), F.lit(1 << 30))
    share = min(1.0, (2 * most + 100) / max(total, 1))
    return df.filter(place < int(share * (1 << 30))).orderBy(place, id).limit(most)


#: A filter has KEY_BITS bits for each key that it holds, and at most MOST_BITS (128 MB). Beyond that number of keys
#: (67 million) it lets more of the others through; as it only says what travels, results stay the same.
KEY_BITS, MOST_BITS = 16, 1 << 30


def bloom_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of a written table's keys (64-bit hashes), sized by their number: bits / 64 numbers at most come to
    the driver. A key's low bits name its two places."""
    bits = min(MOST_BITS, 1 << (KEY_BITS * keys.count() + 1023).bit_length())
    size, m = bits.bit_length() - 1, F.col(key)
    at = keys.select(F.explode(F.array(m.bitwiseAND(F.lit(bits - 1)), F.shiftright(m, size).bitwiseAND(F.lit(bits - 1)))).alias("p"))
    rows = at.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def bloom_passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = 64 * len(filter_)
    places = np.stack([keys & (bits - 1), (keys >> (bits.bit_length() - 1)) & (bits - 1)])
    return (filter_[places >> 6] >> (places & 63) & 1).astype(bool).all(0)
