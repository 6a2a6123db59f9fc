"""Token counts of a byte-level BPE by heap-and-linked-list merging.

A text is cut into pieces by the tokenizer's pattern. Each piece starts as a linked list of its bytes; a heap gives
the adjacent pair of lowest rank (leftmost first) until none can merge. The count is the initial symbols minus the
merges; identifiers are never made. Pieces, and the words with their space that they come from, repeat a lot, so each
worker keeps the counts of up to CACHED of either. No piece reaches over a place where a space follows another
character than white space, so a text's count is the sum over the parts between such places.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache, partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import arrow_map, slices

# Fixed value: the pattern of byte-level BPE pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Counts that a worker keeps, of pieces and parts of up to CACHED_CHARS characters each.
CACHED, CACHED_CHARS = 1 << 20, 64

_CLOSE = re.compile(r"\s |^ ")


@cache
def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else from code point 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, others = [""] * 256, iter(range(256, 512))
    for b in range(256):
        names[b] = chr(b) if b in printing else chr(next(others))
    return names


class Parts(dict):
    """Part of a text (without the space before it) -> number of tokens of the space and it."""

    def __init__(self, pairs: "BytePairs"):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, part: str) -> int:
        n = self.pairs.whole(" " + part)
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[part] = n
        return n


class BytePairs(dict):
    """piece -> number of tokens, of the byte-level BPE that a tokenizers .json file holds."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["model"]["type"] != "BPE" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without a normalizer is needed")
        ids = spec["model"]["vocab"]
        self.symbols = [ids[x] for x in byte_names()]
        self.wide = max(ids.values()) + 1
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a] * self.wide + ids[b]] = rank
            self.made.append(ids[a + b])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.parts = Parts(self)

    def __missing__(self, piece: str) -> int:
        data = piece.encode()
        n = len(data) - self.merges(data)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n

    def merges(self, data: bytes) -> int:
        """How many merges a piece goes through."""
        n, ranks, wide, made = len(data), self.ranks, self.wide, self.made
        numbers = list if n < 1 << 14 else partial(array, "i")  # a very long piece takes little memory
        at = numbers([self.symbols[b] for b in data])
        after, before = numbers(range(1, n + 1)), numbers(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := ranks.get(at[i] * wide + at[i + 1])) is not None]
        heapify(heap)
        done = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if j >= n or at[i] < 0 or ranks.get(at[i] * wide + at[j]) != rank:
                continue  # one of the two has merged with another neighbour since
            at[i], at[j] = made[rank], -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (r := ranks.get(at[i] * wide + at[k])) is not None:
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := ranks.get(at[h] * wide + at[i])) is not None:
                heappush(heap, r * n + h)
        return done

    def count(self, text: str) -> int:
        """The number of tokens of a text; a special token's string counts as that one token."""
        parts, n = [text], 0
        if self.specials and self.specials.search(text):
            n, parts = len(self.specials.findall(text)), self.specials.split(text)
        return n + sum(map(self.plain, parts))

    def whole(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces(text)))

    def plain(self, text: str) -> int:
        """The number of tokens of a text without special tokens."""
        first, *parts = text.split(" ")
        if _CLOSE.search(text):  # a space after white space: such parts belong together
            joined, last = [[first]], first
            for x in parts:
                if last == "" or last[-1].isspace():
                    joined[-1].append(x)
                else:
                    joined.append([x])
                last = x or " "
            first, *parts = map(" ".join, joined)
        return self.whole(first) + sum(map(self.parts.__getitem__, parts))


@cache
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give their row; other columns are
    ignored; an empty table gives no rows. path: a tokenizers .json file, which executors find at the same place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path)
        for batch in slices(batches, "text"):
            texts = [x or "" for x in batch["text"].to_pylist()]
            tokens = pa.array([pairs.count(x) for x in texts], pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).cast(pa.int64())
            yield pa.record_batch([batch["id"], size, tokens, pa.compute.greater(tokens, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = arrow_map(source, count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
