"""Token counts, BPE, FLAC and quality: against the libraries, by round trip, on held-out rows."""

import hashlib
import math
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import TEXTS, rows, table
from wordloom.llm import bpe_codec, flac, quality, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = st.sampled_from([*"abcdefgh,.!'’ \n\t\r0189ÀéßЖ中文😀٣½\x1c\x1f\x85\xa0 ​", "'s", "'ll", "<|endoftext|>", " the", "  ", "\r\n", "ing"])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=400).map("".join))
def test_agrees_with_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert tokens.byte_pairs(PATH).count(text) == len(ids)
    own = bpe_codec.codec(PATH)
    for shared in (lambda c: True, lambda c: False, lambda c: len(c) % 2 == 0):
        assert resolved(own, text, shared) == ids
    assert bpe_codec.OUTPUTS["decoded"][1](own, ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def resolved(own, text, shared):
    """The ids of a text, with those of referred chunks put in."""
    return [i for x in own.ids(text, shared) for i in (own.encode_plain(bpe_codec.places(x).middle) if isinstance(x, str) else x)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the sea", " and", "\n\n", "  ", " don't", "中文", " <|endoftext|>", ". ", "\t", "12 34", "\x85", " a"]), min_size=60, max_size=600).map("".join))
def test_joins_of_chunks(text):
    own = bpe_codec.codec(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert resolved(own, text, lambda c: True) == ids == resolved(own, text, lambda c: len(c) % 3 == 0)


@pytest.mark.parametrize("text", [" " * 300_000, "\n " * 150_000, "ab " * 50_000 + " " * 100_000 + "c", "x" * 200_000])
def test_long_runs_take_time_in_proportion(text):
    pairs = tokens.byte_pairs(PATH)
    began = time.process_time()
    assert pairs.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    short = time.process_time() - began
    assert short < 20


def test_white_space_is_linear():
    pairs, took = tokens.byte_pairs(PATH), []
    for n in (200_000, 1_600_000):
        began = time.process_time()
        pairs.count(" \n" * (n // 2))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 1


def test_token_rows(spark):
    got = rows(tokens.count_tokens(table(spark), PATH))
    expected = []
    for i, t, *_ in TEXTS:
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(expected, key=str)
    assert tokens.count_tokens(table(spark).limit(0), PATH).count() == 0


def test_codec_rows(spark):
    out = bpe_codec.encode(table(spark), PATH, outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(out) == len(TEXTS)
    texts = {(i, t or "") for i, t, *_ in TEXTS}
    for r in out:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert (r["doc_id"], r["decoded"]) in texts and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert r["ids"] == LIBRARY.encode(r["decoded"], add_special_tokens=False).ids
    assert bpe_codec.encode(table(spark).limit(0), PATH).count() == 0


def test_joins_widen_until_they_agree(monkeypatch):
    """Places at which the encodings don't agree are noticed, and the result stays right."""
    own = bpe_codec.Codec(PATH)
    monkeypatch.setattr(bpe_codec, "_AGREE", regex.compile(r"(?<=\S)(?=\S)"))
    monkeypatch.setattr(bpe_codec, "_LAST", regex.compile(r"(?r)(?<=\S)(?=\S)"))
    monkeypatch.setattr(bpe_codec, "LEAST", 16)
    monkeypatch.setattr(bpe_codec, "MEAN_BITS", 4)
    text = "Understanding incomprehensibilities, they're internationalisation's counterrevolutionaries; 1234567 don't " * 6
    assert len(bpe_codec.chunks(text)) > 5
    assert resolved(own, text, lambda c: True) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_chunks_are_encoded_once(spark):
    body = " ".join(f"sentence number {i} of the shared body." for i in range(300))
    texts = [(i, f"beginning {i} {body} end {i}", "en", "a") for i in range(6)]
    source = table(spark, texts, extra=False).select(F.col("doc_id").alias("id"), "text")
    shared = spark.sparkContext.broadcast(bpe_codec.bloom_filter(bpe_codec.repeated_chunks(source, PATH), "s"))
    store = bpe_codec.chunk_store(source, PATH, shared)
    items = bpe_codec._items(source, PATH, shared)
    assert store.count() == store.select("s", "t").distinct().count() >= 2
    assert items.filter("s IS NOT NULL").count() >= 5 * store.count() and items.filter("s IS NOT NULL").join(store, ["s", "t"], "left_anti").count() == 0
    got = {r["doc_id"]: r["ids"] for r in bpe_codec.encode(table(spark, texts), PATH).collect()}
    assert got == {i: LIBRARY.encode(t, add_special_tokens=False).ids for i, t, *_ in texts}


def test_chunks_are_shared():
    body = "".join(f"sentence number {i} of the shared body. " for i in range(400)).encode()
    one, two = (x + body for x in (b"", b"a different beginning, "))
    ends = [{one[a:b] for a, b in zip([0, *bpe_codec.cuts(one)], bpe_codec.cuts(one), strict=False)}, {two[a:b] for a, b in zip([0, *bpe_codec.cuts(two)], bpe_codec.cuts(two), strict=False)}]
    assert len(ends[0] & ends[1]) >= 0.6 * len(ends[0])
    assert bpe_codec.cuts(body)[-1] == len(body) and bpe_codec.cuts(b"") == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=3000), min_size=1, max_size=4))
def test_flac_round_trip(payloads):
    padded = [np.frombuffer(p + b" " * (max(192, -(-len(p) // 192) * 192) - len(p)), np.uint8) for p in payloads]
    streams = flac.encode_payloads(padded)
    for stream, blocks, payload in zip(streams, flac.decode(streams), padded, strict=True):
        assert np.array_equal(np.concatenate([b[0] for _, b in blocks]) + 128, payload)
        info, _, at = flac.metadata(stream)
        slow = []
        while at < len(stream):
            samples, at = flac._frame(stream, at, info)
            slow.append(samples[0])
        assert np.array_equal(np.concatenate(slow) + 128, payload)
        offset, block = flac.seek(stream, len(payload) - 1)
        assert block[0][len(payload) - 1 - offset] + 128 == payload[-1]


class Writer:
    """Writes bits."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    def data(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def stereo_stream(left, right, layout):
    """A 16-bit stream of one frame: verbatim first channel, Rice-coded second with an escaped partition."""
    n = len(left)
    first, second = (left, [a - b for a, b in zip(left, right, strict=True)]) if layout == 8 else (left, right)
    head = bytes([0xFF, 0xF8, 0x70, layout << 4 | 4 << 1, 0]) + (n - 1).to_bytes(2, "big")
    w = Writer()
    for b in head + bytes([flac.crc8(head)]):
        w.put(b, 8)
    w.put(1 << 1, 8)
    for x in first:
        w.put(x, 16)
    w.put(9 << 1, 8)  # first-order predictor
    w.put(second[0], 17 if layout == 8 else 16)
    w.put(0, 2)
    w.put(1, 4)
    steps = [b - a for a, b in zip(second, second[1:], strict=False)]
    w.put(5, 4)
    for r in steps[: n // 2 - 1]:
        u = r << 1 ^ r >> 31
        w.put(1, (u >> 5) + 1)
        w.put(u, 5)
    w.put(15, 4)
    w.put(20, 5)
    for r in steps[n // 2 - 1 :]:
        w.put(r, 20)
    frame = w.data()
    crc = int(flac.crc16s(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    pcm = np.array([left, right], np.int64).T.astype("<i2").tobytes()
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame + crc.to_bytes(2, "big")


@pytest.mark.parametrize("layout", [1, 8])
def test_flac_of_others(layout):
    left, right = [100 * i % 3000 - 1500 for i in range(64)], [37 * i % 900 - 450 for i in range(64)]
    ((_, samples),) = flac.decode([stereo_stream(left, right, layout)])[0]
    assert samples.tolist() == [left, right]


def test_flac_refuses_damage():
    (stream,) = flac.encode_payloads([np.arange(1920, dtype=np.int64).astype(np.uint8)])
    for at in (-1, -100, len(stream) // 2):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(flac.BadStream):
            flac.decode([bytes(broken)])
    with pytest.raises(flac.BadStream):
        flac.decode([b"RIFF"])


def test_flac_rows(spark):
    media = flac.encode_text(table(spark))
    for r in flac.text_digests(media).collect():
        (text,) = {t or "" for i, t, *_ in TEXTS if i == r["doc_id"]}
        raw = text.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    blocks = flac.pcm_blocks(media).filter("doc_id = 10").orderBy("block").collect()
    assert [b["sample_offset"] for b in blocks] == [576 * k for k in range(len(blocks))]
    assert bytes((x + 128) & 255 for b in blocks for x in np.frombuffer(b["pcm"], np.int8).tolist()).rstrip() == TEXTS[11][1].encode().rstrip()
    assert flac.text_digests(flac.encode_text(table(spark).limit(0))).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op10_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(out) > 50 and sum((r["predicted"] == 1) == (r["quality"] == 1) for r in out) >= 0.93 * len(out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored.collect())


def test_quality_scores_by_hand(spark):
    """score against plain zstandard sizes and the curve."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    press = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score(docs.limit(60), model).collect():
        data = (r["text"] or "").encode()
        k = max(1, round(len(data) / 2048))
        blocks = [data[len(data) * i // k : len(data) * (i + 1) // k] for i in range(k)] if data else []
        g, b = ([len(p.compress(x)) for x in blocks] for p in press)
        d = (sum(b) - sum(g)) / (sum(b) + sum(g) + 160)
        shrunk = sum(math.log((len(x) + 32) / (max(u, v) + 32)) for x, u, v in zip(blocks, g, b, strict=True)) / k
        z = model.weights[0] + model.weights[1] * 10 * d + model.weights[2] * 2 * d * math.log1p(len(data))
        z += sum(w * max(0, shrunk - bend) for w, bend in zip(model.weights[3:], model.bends, strict=True))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z))))) and r["predicted"] == (r["score"] >= 0.7)


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0)], [(i, i % 2) for i in range(1, 14)] + [(1, 1), (None, 1), (2, None)]])
def test_quality_cases(spark, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    docs = table(spark)
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.count() == len(TEXTS) and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
