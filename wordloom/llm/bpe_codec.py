"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last WINDOW bytes says so, so passages that documents share give the same
chunks. Chunks that occur more than once in the whole table are encoded once, in a table by digest; documents refer to
them, and their ids come back by digest. What no other document has is encoded where it is, and doesn't travel unless
its document refers to a shared chunk.

Around a shared chunk the encoding may differ from that of the whole text. So the ids of a chunk count only between its
first and last place of agreement (where white space follows another character); the text around is encoded anew with
what is next to it, and the encoding of a span that reaches one stretch over the place, on either side, tells whether
both agree there. If not, the span is widened to all of the text so far.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_map, bloom_filter, bloom_passes, cut, join_anew, slices
from wordloom.llm.tokens import PATTERN, byte_names

WINDOW, MEAN_BITS, LEAST, MOST = 32, 11, 256, 16384

_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(data: bytes) -> list[int]:
    """Where the chunks of data (UTF-8) end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    rolled, width = _TABLE[raw], 1
    while width < WINDOW:  # the hash of 2 * width bytes from those of width bytes
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
        width *= 2
    named = np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + 1
    named = named[named < n]
    named = named[(raw[named] & 0xC0) != 0x80]  # not inside a character
    out, last = [], 0
    for p in [*named.tolist(), n]:
        while p - last > MOST:
            q = last + MOST
            while raw[q] & 0xC0 == 0x80:
                q -= 1
            out.append(last := q)
        if p - last >= LEAST or p == n:
            out.append(last := p)
    return out


class Chunk(NamedTuple):
    """A chunk's text before its first place of agreement, between the places, and after the last; and of what is
    between, the first and the last stretch between two places."""

    head: str
    middle: str
    tail: str
    left: str
    right: str


_AGREE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\r\n])")
_LAST = regex.compile("(?r)" + _AGREE.pattern)


class Codec:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["model"]["type"] != "BPE" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without a normalizer is needed")
        of = {c: b for b, c in enumerate(byte_names())}
        vocab = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        made = [spec["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if any(b <= a for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("identifiers must rise with the merges' ranks")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.encode_plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.bytes, self.digits = [b""] * top, [str(i) for i in range(top)]
        for token, i in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes[i] = token

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        """The stretches of a text: a special token's id and string, or None and text without special tokens."""
        if not self.specials or not self.specials.search(text):
            if text:
                yield None, text
            return
        for part in self.specials.split(text):
            if part:
                yield self.special.get(part), part

    def chunks(self, text: str) -> Iterator[str]:
        """All chunks of the stretches without special tokens."""
        for special, part in self.parts(text):
            if special is None:
                yield from chunks(part)

    def ids(self, text: str, shared: Callable[[str], bool]) -> list[list[int] | str]:
        """What a text is encoded to: ids, and in between chunks for which `shared` holds, whose middle is encoded
        elsewhere."""
        out: list[list[int] | str] = []
        for special, part in self.parts(text):
            out += [[special]] if special is not None else self.plain(part, shared)
        return out

    def plain(self, text: str, shared: Callable[[str], bool]) -> list[list[int] | str]:
        done, carry, before = 0, "", None
        out: list[list[int] | str] = []
        for part in [*chunks(text), None]:
            after = places(part) if part is not None and shared(part) else None
            if part is not None and after is None:
                carry += part
                continue
            join, carry = (carry + after.head, after.tail) if after else (carry, "")
            done += len(join) + (len(after.middle) if after else 0)
            if self.agree(before, join, after):
                out += [self.encode_plain(join)] * bool(join) + [part] * bool(after)
            else:  # widened to all of the text so far
                out = [self.encode_plain(text[:done])]
            before = after
        return out

    def agree(self, before: Chunk | None, join: str, after: Chunk | None) -> bool:
        """Whether the encoding goes through the places on either side of join: it does if that of a stretch before
        and one after a place is made up of the two stretches' own."""
        inside = [join] if join else []
        if join and (first := _AGREE.search(join)):
            inside = [join[: first.start()], join[_LAST.search(join).start() :]]
        spans = []
        if before and (inside or after):
            spans.append((before.right, inside[0] if inside else after.left))
        if after and inside:
            spans.append((inside[-1], after.left))
        return all(self.encode_plain(a + b) == self.encode_plain(a) + self.encode_plain(b) for a, b in spans)


def chunks(text: str) -> list[str]:
    data = text.encode()
    ends = cuts(data)
    return [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def places(chunk: str) -> Chunk | None:
    """The parts of a chunk; None if it hasn't two places of agreement."""
    first = _AGREE.search(chunk)
    a, b = (first.start(), _LAST.search(chunk).start()) if first else (0, 0)
    if a == b:
        return None
    middle = chunk[a:b]
    left, right = _AGREE.search(middle), _LAST.search(middle)
    return Chunk(chunk[:a], middle, chunk[b:], middle[: left.start()] if left else middle, middle[right.start() :] if right else middle)


def digest(chunk: str) -> tuple[int, int]:
    both = hashlib.blake2b(chunk.encode(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


#: Each output column: its type, and how it follows from a codec and a text's ids.
OUTPUTS = {
    "n_tokens": ("long", lambda own, ids: len(ids)),
    "ids": ("array<int>", lambda own, ids: ids),
    "ids_sha256": ("string", lambda own, ids: hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest()),
    "decoded": ("string", lambda own, ids: own.decode(ids).decode("utf-8", "replace")),
    "decoded_sha256": ("string", lambda own, ids: hashlib.sha256(own.decode(ids)).hexdigest()),
}
_ARROW = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}


def repeated_chunks(source: DataFrame, path: str) -> DataFrame:
    """s, t: the digests of the chunks that occur more than once in source (text); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "text"):
            found = [digest(c) for x in batch["text"].to_pylist() for c in own.chunks(x or "")]
            yield pa.record_batch([pa.array([d[0] for d in found], pa.int64()), pa.array([d[1] for d in found], pa.int64())], ["s", "t"])

    counts = arrow_map(source.select("text"), run, "s long, t long").groupBy("s", "t").count()
    return cut(counts.filter("count > 1").select("s", "t"))


def chunk_store(source: DataFrame, path: str, shared) -> DataFrame:
    """s, t, ids (16- or 32-bit numbers in a binary): the chunks whose digest passes `shared` (a broadcast filter), each
    encoded once between its places of agreement; written. Equal chunks of a task travel once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "text"):
            found = {c: digest(c) for x in batch["text"].to_pylist() for c in own.chunks(x or "")}
            names, keys = list(found), np.array([d[0] for d in found.values()], np.int64)
            keep = np.flatnonzero(bloom_passes(shared.value, keys)).tolist() if names else []
            kept = [names[k] for k in keep if places(names[k])]
            yield pa.record_batch([pa.array([found[c][0] for c in kept], pa.int64()), pa.array([found[c][1] for c in kept], pa.int64()), pa.array(kept, pa.string())], ["s", "t", "chunk"])

    def encode_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "chunk"):
            ids = [np.array(own.encode_plain(places(c).middle), own.kind).tobytes() for c in batch["chunk"].to_pylist()]
            yield pa.record_batch([batch["s"], batch["t"], pa.array(ids, pa.binary())], ["s", "t", "ids"])

    distinct = arrow_map(source.select("text"), find, "s long, t long, chunk string").distinct()
    return cut(arrow_map(distinct, encode_, "s long, t long, ids binary"))


def _items(source: DataFrame, path: str, shared) -> DataFrame:
    """What each row of source (id, text) is made of, written: rid (tells rows apart), id, k (place), last (the place of
    the row's last item), and either ids or s and t, the digest of a chunk in the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rid = codec(path), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            origin: list[int] = []
            for at, x in enumerate(batch["text"].to_pylist()):
                text = x or ""
                known = {c: digest(c) for c in own.chunks(text)}
                passes = dict(zip(known, bloom_passes(shared.value, np.array([d[0] for d in known.values()], np.int64)).tolist(), strict=True)) if known else {}
                merged: list[list[int] | str] = []
                for item in own.ids(text, passes.__getitem__):
                    if merged and not isinstance(item, str) and not isinstance(merged[-1], str):
                        merged[-1] = merged[-1] + item
                    else:
                        merged.append(item)
                merged = merged or [[]]
                rid += 1
                for k, item in enumerate(merged):
                    s, t = known[item] if isinstance(item, str) else (None, None)
                    rows.append((rid, k, len(merged) - 1, s, t, None if isinstance(item, str) else np.array(item, own.kind).tobytes()))
                    origin.append(at)
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([batch["id"].take(pa.array(origin, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], ["id", "rid", "k", "last", "s", "t", "ids"])

    kind = source.schema["id"].dataType.simpleString()
    return cut(arrow_map(source, run, f"id {kind}, rid long, k int, last int, s long, t long, ids binary"))


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", outputs=("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row for each row of docs: id and the outputs asked for (see OUTPUTS): ids as the library encodes the whole
    text without added special tokens (a special token's string in a text is that token), decoded what they decode to.

    Null counts as empty: no ids, decoded empty. Repeated rows and null ids each give their row; other columns are
    ignored; an empty table gives no rows. path: a tokenizers .json file, which executors find at the same place.
    """
    source = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(repeated_chunks(source, path), "s"))
    store = chunk_store(source, path, shared)
    items = _items(source, path, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items of a row stand together and in order."""
        own = codec(path)
        held: list[bytes] = []
        for batch in slices(batches, "ids"):
            ends, found = [], []
            for at, (k, last, ids) in enumerate(zip(*(batch[c].to_pylist() for c in ("k", "last", "ids")), strict=True)):
                held = [ids] if k == 0 else [*held, ids]
                if k == last:
                    ends.append(at)
                    whole = np.frombuffer(b"".join(held), own.kind).tolist()
                    found.append([OUTPUTS[o][1](own, whole) for o in outputs])
            yield pa.record_batch([batch["id"].take(pa.array(ends, pa.int64())), *(pa.array([f[j] for f in found], _ARROW[OUTPUTS[o][0]]) for j, o in enumerate(outputs))], ["id", *outputs])

    schema = ", ".join([f"id {kind}", *(f"{o} {OUTPUTS[o][0]}" for o in outputs)])
    columns = ["id", "rid", "k", "last", "ids"]
    alone = arrow_map(items.filter("last = 0 AND s IS NULL").select(columns), run, schema)
    several = items.filter("last > 0 OR s IS NOT NULL")
    referred = join_anew(several.filter("s IS NOT NULL").drop("ids"), store, ["s", "t"]).select(columns)
    together = several.filter("s IS NULL").select(columns).unionByName(referred).repartition("rid").sortWithinPartitions("rid", "k")
    return alone.unionByName(arrow_map(together, run, schema)).withColumnRenamed("id", id)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
