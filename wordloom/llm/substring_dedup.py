"""Removal of repeated passages by super-k-mers.

A window is `window` consecutive words of a document. Its minimiser is the least hash of the runs of MINIMISER words
in it. Consecutive windows of equal minimiser form a super-k-mer, which goes as one packed string of words to its
minimiser's bucket; equal strings are counted as one, by partial aggregation, before they travel. In a bucket the
windows are sorted and counted exactly, word for word.

A bucket of more than BUCKET different strings is split: its strings are cut again by the least hash of longer runs of
words, so that windows of equal words still meet, at the last level by the window itself. What a level finds are
stretches of windows of its strings, which the level above takes over.

A minimiser that only one document has can repeat no window. A Bloom filter, sized by their number, holds the others,
and only super-k-mers whose minimiser passes it travel; as the filter's answer depends on the minimiser alone, a false
one costs traffic and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, bloom_filter, bloom_passes, cut, join_anew, row_key, run_hashes, slices, span_hashes, utf8, words

WINDOW, MINIMISER, BUCKET = 50, 8, 256
SPANS = "array<struct<at: int, n: int>>"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive items, in about log2(width) passes."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(texts: pa.Array, window: int, minimiser: int) -> tuple[np.ndarray, ...]:
    """Of each super-k-mer: its text's index, its first word there, how many windows it has, its minimiser."""
    data, bounds = utf8(texts)
    starts, ends, first = words(data, bounds)
    runs = run_hashes(span_hashes(data, starts, ends), minimiser)
    if len(runs) < window - minimiser + 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    least = _least(runs, window - minimiser + 1)
    counts = np.diff(first)
    of = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    whole = np.arange(len(least)) + window <= first[of + 1]  # the window ends in its text
    fresh = whole.copy()
    if minimiser < window:  # else each window stands alone
        fresh[1:] &= (least[1:] != least[:-1]) | (of[1:] != of[:-1]) | ~whole[:-1]
    at = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    n = np.bincount(group[whole], minlength=len(at)) if len(at) else np.zeros(0, np.int64)
    return of[at], at - first[of[at]], n.astype(np.int64), least[at].view(np.int64)


def _minimisers(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    """A row for each super-k-mer of docs (id, row, text): id, m (its minimiser)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of, _, _, m = super_kmers(batch["text"], window, minimiser)
            yield pa.record_batch([batch["id"].take(pa.array(of)), pa.array(m)], ["id", "m"])

    return arrow_map(docs, run, "id long, m long")


def levels(window: int, minimiser: int) -> list[int]:
    """The lengths of the runs that name buckets, level by level: from the minimiser to the whole window."""
    gap = window - minimiser
    return sorted({minimiser, window - gap // 3, window - gap // 10, window})


def _packed(texts: pa.Array, of: np.ndarray, at: np.ndarray, n: np.ndarray, window: int) -> list[bytes]:
    """The words of each super-k-mer, joined by spaces."""
    data, bounds = utf8(texts)
    starts, ends, first = words(data, bounds)
    begin = first[of] + at
    raw = data.tobytes()
    return [b" ".join([raw[s:t] for s, t in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]) for a, b in zip(begin.tolist(), (begin + n + window - 1).tolist(), strict=True)]


def _digests(packed: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in packed]), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _travellers(docs: DataFrame, shared, window: int, minimiser: int, columns: list[str]) -> DataFrame:
    """The super-k-mers of docs (id, row, text) whose minimiser passes the filter `shared` (a broadcast): the columns
    asked for of id, row, at (first word), n (windows), m (minimiser), s and t (the packed string's digest), packed."""
    kinds = {"id": "long", "row": "long", "at": "int", "n": "int", "m": "long", "s": "long", "t": "long", "packed": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of, at, n, m = super_kmers(batch["text"], window, minimiser)
            keep = bloom_passes(shared.value, m)
            of, at, n, m = of[keep], at[keep], n[keep], m[keep]
            packed = _packed(batch["text"], of, at, n, window)
            take = pa.array(of, pa.int64())
            s, t = _digests(packed)
            own = {"id": batch["id"].take(take), "row": batch["row"].take(take), "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int32()), "m": pa.array(m), "s": s, "t": t}
            if "packed" in columns:
                own["packed"] = pa.array(packed, pa.binary())
            yield pa.record_batch([own[c] for c in columns], columns)

    return arrow_map(docs, run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _parts(strings: DataFrame, window: int, length: int) -> DataFrame:
    """The super-k-mers, by runs of `length` words, of strings (s, t, a, packed): s and t, a, ats (where they begin),
    n, m, u and v (the part's digest), packed. Equal parts of one string, as text that repeats itself has, are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed"):
            texts = batch["packed"].cast(pa.string())
            of, at, n, m = super_kmers(texts, window, length)
            packed = _packed(texts, of, at, n, window)
            ats: dict[tuple[int, bytes], list[int]] = {}
            first = []
            for k, (i, p, x) in enumerate(zip(of.tolist(), at.tolist(), packed, strict=True)):
                if (places := ats.setdefault((i, x), [])) == []:
                    first.append(k)
                places.append(p)
            own = np.array(first, np.int64)
            packed = [packed[k] for k in first]
            take = pa.array(of[own], pa.int64())
            yield pa.record_batch(
                [*(batch[c].take(take) for c in "sta"), pa.array(list(ats.values()), pa.list_(pa.int32())), pa.array(n[own], pa.int32()), pa.array(m[own]), *_digests(packed), pa.array(packed, pa.binary())],
                ["s", "t", "a", "ats", "n", "m", "u", "v", "packed"],
            )

    return arrow_map(strings.select("s", "t", "a", "packed"), run, "s long, t long, a long, ats array<int>, n int, m long, u long, v long, packed binary")


def repeated_windows(ids: np.ndarray, packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of super-k-mers of some buckets: which, and at which of its windows, has a word sequence that a smaller id has.

    Words are numbered; runs of 2, 4, 8, ... words are then numbered by sorting pairs of numbers, and a window by the
    pair of runs that cover it. Equal numbers mean equal words throughout.
    """
    split = [p.split(b" ") for p in packed]
    flat = [w for s in split for w in s]
    table: dict[bytes, int] = {}
    code = np.array([table.setdefault(w, len(table)) for w in flat], np.int64)
    width = 1
    while width * 2 <= window:
        code = _numbered(code[:-width], code[width:])
        width *= 2
    if width < window:
        code = _numbered(code[: -(window - width)], code[window - width :])
    lengths = np.array([len(s) for s in split])
    begin, counts = np.cumsum(lengths) - lengths, lengths - window + 1
    of = np.repeat(np.arange(len(packed)), counts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    code = code[begin[of] + at]
    order = np.lexsort((ids[of], code))
    fresh = np.ones(len(order), bool)
    fresh[1:] = code[order][1:] != code[order][:-1]
    smallest = ids[of][order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    hit = np.zeros(len(order), bool)
    hit[order] = smallest < ids[of][order]
    return of[hit], at[hit]


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs (a, b), different ones for different pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _sorted_buckets(strings: DataFrame, window: int, most: int = 2048) -> DataFrame:
    """s, t, a and spans (array of at, n: stretches of windows that a smaller id has) of strings (m, s, t, a, b,
    packed), where a < b or there are spans. a: the smallest id that has the string, b: the largest. Each task sorts
    its buckets and works on about `most` strings at a time, never parting a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for part in slices(batches, "packed", 1 << 20):
            part = pa.Table.from_batches([part])
            table = part if table is None else pa.concat_tables([table, part])
            m = table["m"].to_numpy()
            done = int(np.searchsorted(m, m[-1]))  # the last bucket may go on
            if done and (table.num_rows >= most or pa.compute.sum(pa.compute.binary_length(table["packed"])).as_py() >= 1 << 21):
                yield work(table.slice(0, done))
                table = table.slice(done)
        if table is not None:
            yield work(table)

    def work(table: pa.Table) -> pa.RecordBatch:
        ids = table["a"].to_numpy()
        of, at = repeated_windows(ids, table["packed"].to_pylist(), window)
        order = np.lexsort((at, of))
        of, at = of[order], at[order]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(fresh)
        length = np.diff(np.append(first, len(of)))
        counts = np.bincount(of[first], minlength=len(ids))
        stretches = pa.StructArray.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(length.astype(np.int32))], ["at", "n"])
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), stretches)
        keep = pa.array(np.flatnonzero((counts > 0) | (ids < table["b"].to_numpy())))
        return pa.record_batch([*(table[c].combine_chunks().take(keep) for c in "sta"), spans.take(keep)], ["s", "t", "a", "spans"])

    # All windows of equal words have one minimiser, so sorting by it brings them together.
    dealt = strings.select("m", "s", "t", "a", "b", "packed").repartition("m").sortWithinPartitions("m")
    return arrow_map(dealt, run, f"s long, t long, a long, spans {SPANS}")


def _distinct(rows: DataFrame, low: str, high: str) -> DataFrame:
    """The different strings of rows (m, s, t, packed), with a (the least of column low) and b (the greatest of high)."""
    return cut(rows.groupBy("m", "s", "t", "packed").agg(F.min(low).alias("a"), F.max(high).alias("b")))


def _spans(found: DataFrame, key: list[str]) -> DataFrame:
    """key and all spans of found (key, spans), of one string or document."""
    return found.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def _resolved(strings: DataFrame, window: int, lengths: list[int], bucket: int) -> DataFrame:
    """As _sorted_buckets; buckets of more than `bucket` strings are split by runs of the next of lengths, if any."""
    if not lengths:
        return _sorted_buckets(strings, window)
    crowded = cut(strings.groupBy("m").agg(F.count("*").alias("c")).filter(F.col("c") > bucket).select("m"))
    if crowded.isEmpty():
        return _sorted_buckets(strings, window)
    calm = _sorted_buckets(strings.join(crowded, "m", "left_anti"), window)
    large = strings.join(crowded, "m", "left_semi")
    parts = cut(_parts(large, window, lengths[0]))
    own = _distinct(parts.select("m", F.col("u").alias("s"), F.col("v").alias("t"), "packed", "a"), "a", "a")
    found = cut(_resolved(own, window, lengths[1:], bucket)).select(F.col("s").alias("u"), F.col("t").alias("v"), F.col("a").alias("first"), "spans")
    met = join_anew(parts.select("s", "t", "a", "ats", "n", "u", "v"), found, ["u", "v"])
    met = met.select("s", "t", F.flatten(F.transform("ats", lambda at: _taken("a", at))).alias("spans"))
    per = _spans(met.filter(F.size("spans") > 0), ["s", "t"])
    split = large.select("s", "t", "a", "b").join(per, ["s", "t"], "left").filter("a < b OR spans IS NOT NULL")
    return calm.unionByName(split.select("s", "t", "a", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")))


def _taken(id: str, at):
    """The spans that a place of a string (at, with n windows, of document `id`) takes over: all of it, if a smaller id (first)
    has the string, else the string's own spans."""
    moved = F.transform("spans", lambda x: F.struct((at + x["at"]).alias("at"), x["n"].alias("n")))
    return F.when(F.col("first") < F.col(id), F.array(F.struct(at.alias("at"), "n"))).otherwise(moved)


def repeats(docs: DataFrame, id: str, text: str, window: int = WINDOW, minimiser: int = MINIMISER, bucket: int = BUCKET) -> DataFrame:
    """id, row and spans (array of at, n: windows at .. at + n - 1) for the rows of docs with windows whose word
    sequence also starts in a row of smaller id."""
    source = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), row_key(text).alias("row"), F.col(text).alias("text"))
    buckets = _minimisers(source, window, minimiser).groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    shared = cut(buckets.filter("a < b").select("m"))
    passing = docs.sparkSession.sparkContext.broadcast(bloom_filter(shared, "m"))
    first, *longer = levels(window, minimiser)
    strings = _distinct(_travellers(source, passing, window, first, ["m", "s", "t", "packed", "id"]), "id", "id")
    found = cut(_resolved(strings, window, longer, bucket))
    met = join_anew(_travellers(source, passing, window, first, ["id", "row", "at", "n", "s", "t"]), found.withColumnRenamed("a", "first"), ["s", "t"])
    return _spans(met.select("id", "row", _taken("id", F.col("at")).alias("spans")).filter(F.size("spans") > 0), ["id", "row"])  # a document's own


def _without(texts: pa.Array, spans: list, window: int) -> Iterator[tuple[int, int, str]]:
    """Of each text: how many words it has, how many the spans cover, and the other words joined by spaces."""
    data, bounds = utf8(texts)
    starts, ends, first = words(data, bounds)
    raw = data.tobytes()
    for i, found in enumerate(spans):
        a, b = int(first[i]), int(first[i + 1])
        change = np.zeros(b - a + 1, np.int32)
        for s in found or ():
            change[s["at"]] += 1
            change[s["at"] + s["n"] + window - 1] -= 1
        keep = np.cumsum(change[:-1]) == 0
        own = [raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist(), strict=True)]
        yield b - a, b - a - len(own), b" ".join(own).decode()


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window that covers it has the same words as a window of a document of smaller id; windows are
    judged on the input. A null text has no words. Rows that share an id are not smaller than each other, so they lose
    nothing to each other; a row with a null id loses nothing and takes nothing. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    found = repeats(docs, id, text, window, minimiser, bucket).select(F.col("id").alias("_i"), F.col("row").alias("_r"), "spans")
    source = docs.select(F.col(id).alias("id"), row_key(text).alias("row"), F.col(text).alias("text"))
    joined = source.join(found, (F.col("id") == F.col("_i")) & (F.col("row") == F.col("_r")), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = list(_without(batch["text"], batch["spans"].to_pylist(), window))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.record_batch([batch["id"], *columns], ["id", "n_words", "n_removed", "kept"])

    kind = joined.schema["id"].dataType.simpleString()
    return arrow_map(joined, run, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
cov AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN f ON win.s = f.s WHERE m < doc_id),
wrd AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT wrd.doc_id, count(*) AS n_words, count(cov.p) AS n_removed, string_agg(CASE WHEN cov.p IS NULL THEN x END, ' ' ORDER BY wrd.p) AS kept FROM wrd LEFT JOIN cov ON wrd.doc_id = cov.doc_id AND wrd.p = cov.p GROUP BY wrd.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
