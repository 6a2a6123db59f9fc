"""FLAC media columns: a lossless encoder, and a decoder to PCM blocks with seekable sample offsets.

Frames are independent, so frames of one shape are worked on side by side: each step handles sample number t of
thousands of frames with a few array operations. decode() takes every stream of the format (all subframe kinds,
partition orders, channel layouts, 4 to 32 bits); frames of other shapes than the fast path's are read bit by bit.
Checksums of each frame (CRC-8 of the header, CRC-16 of all) and the MD5 of the samples are verified.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import arrow_map, slices, utf8

#: Samples in a frame, frames worked on at a time, order and precision of the encoder's linear predictor.
BLOCK, TOGETHER, ORDER, PRECISION = 576, 8192, 4, 12
UNIT = 192

# The format's predictors without stored coefficients, by order (latest sample first).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
# Block sizes by code (6 and 7: stored in the header), sample sizes by code.
SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (bits - 1) & 1, polynomial, 0)) & ((1 << bits) - 1)
    return table.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = CRC8.tolist()


class BadStream(ValueError):
    """The bytes are no FLAC stream, or a checksum is wrong."""


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = _CRC8[x ^ b]
    return x


def crc16s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of each stretch of data. Zeros before a stretch leave its CRC as it is, so all are aligned right."""
    longest = int((ends - starts).max(initial=0))
    crc = np.zeros(len(starts), np.uint16)
    base = ends - longest
    for t in range(longest):
        at = base + t
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint16)
        crc = (crc << np.uint16(8)) ^ CRC16[(crc >> np.uint16(8)) ^ byte]
    return crc


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    for size, top in ((2, 11), (3, 16), (4, 21), (5, 26), (6, 31), (7, 36)):
        if n < 1 << top:
            tail = [0x80 | n >> 6 * k & 0x3F for k in range(size - 2, -1, -1)]
            return bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1), *tail])
    raise ValueError("too many frames")


@cache
def _header(number: int, size: int) -> bytes:
    """The header of a mono frame of 8-bit samples at 8 kHz."""
    code = next((c for c, n in SIZES.items() if n == size), 7)
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1]) + _number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of ORDER for each row: coefficients and shift, by Levinson's recursion."""
    f = x.astype(np.float64) * np.hanning(x.shape[1] + 2)[1:-1]
    r = np.stack([(f[:, : x.shape[1] - k] * f[:, k:]).sum(1) for k in range(ORDER + 1)], 1)
    error, a = r[:, 0] + 1e-9, np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        b = a.copy()
        b[:, i] = k
        b[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, error = b, np.maximum(error * (1 - k * k), 1e-9)
    most = np.abs(a).max(1) + 1e-12
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(most) + 1e-6), 0, 15).astype(np.int64)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of the rows of x (samples of -128 to 127): all bytes, and where each begins (one more: the end)."""
    m, size = x.shape
    x = x.astype(np.int32)
    kinds: list[tuple[int, np.ndarray]] = [(0, x)]
    for order in (1, 2):
        kinds.append((order, np.diff(kinds[-1][1], axis=1)))
    coefficients, shift = _predictors(x)
    predicted = sum(coefficients[:, [j]] * x[:, ORDER - 1 - j : size - 1 - j] for j in range(ORDER)) >> shift[:, None]
    kinds.append((ORDER, x[:, ORDER:] - predicted.astype(np.int32)))
    costs, ks, codes = [], [], []
    for order, residual in kinds:
        u = ((residual << 1) ^ (residual >> 31)).astype(np.uint32)
        k = np.clip(np.floor(np.log2(np.maximum(u.mean(1) * np.log(2), 1))).astype(np.int64), 0, 13)
        ks.append(k)
        costs.append((u >> k[:, None].astype(np.uint32)).sum(1, dtype=np.int64) + u.shape[1] * (k + 1) + 8 * order + (9 + ORDER * PRECISION if order == ORDER else 0))
        codes.append(u)
    best = np.stack(costs, 1).argmin(1)
    headers = [_header(int(n), size) for n in numbers]
    head = np.array([len(h) for h in headers])
    order = np.array([k[0] for k in kinds])[best]
    linear = order == ORDER
    k = np.stack(ks, 1)[np.arange(m), best]
    before = np.where(linear, 9 + ORDER * PRECISION, 0) + 10  # bits between the first samples and the residuals
    cost = np.stack(costs, 1)[np.arange(m), best] - np.where(linear, 9 + ORDER * PRECISION, 0) + before
    bytes_of = head + 1 + (cost + 7) // 8 + 2
    starts = np.zeros(m + 1, np.int64)
    np.cumsum(bytes_of, out=starts[1:])
    bits = np.zeros(8 * int(starts[-1]), np.uint8)

    def put(at: np.ndarray, value: np.ndarray, n: int) -> None:
        for j in range(n):
            bits[at + j] = value >> (n - 1 - j) & 1

    begin = 8 * (starts[:-1] + head)
    put(begin, np.where(linear, 32 | ORDER - 1, 8 | order) << 1, 8)
    for i in range(ORDER):
        rows = np.flatnonzero(order > i)
        put(begin[rows] + 8 + 8 * i, x[rows, i] & 255, 8)
    at = begin + 8 + 8 * order
    rows = np.flatnonzero(linear)
    put(at[rows], np.full(len(rows), PRECISION - 1), 4)
    put(at[rows] + 4, shift[rows], 5)
    for j in range(ORDER):
        put(at[rows] + 9 + j * PRECISION, coefficients[rows, j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + before - 10
    put(at + 6, k, 4)
    at = at + 10
    for kind, low in np.unique(np.stack([best, k], 1), axis=0).tolist():
        rows = np.flatnonzero((best == kind) & (k == low))
        u = codes[kind][rows]
        last = np.cumsum((u >> np.uint32(low)).astype(np.int32) + np.int32(1 + low), axis=1) + (at[rows][:, None] - 1)
        bits[last - low] = 1
        for j in range(low):
            bits[last - j] = u >> np.uint32(j) & np.uint32(1)
    out = np.packbits(bits)
    flat = np.frombuffer(b"".join(headers), np.uint8)
    out[np.repeat(starts[:-1] - np.cumsum(head) + head, head) + np.arange(len(flat))] = flat
    crc = crc16s(out, starts[:-1], starts[1:] - 2)
    out[starts[1:] - 2], out[starts[1:] - 1] = crc >> 8, crc & 255
    return out, starts


def encode_payloads(payloads: list[np.ndarray]) -> list[bytes]:
    """A mono stream of 8-bit samples at 8 kHz for each payload (bytes, at least one; byte b is the sample b - 128),
    with a seek point for each frame."""
    where: dict[int, list[tuple[int, int, int]]] = {}
    for d, payload in enumerate(payloads):
        for n, a in enumerate(range(0, len(payload), BLOCK)):
            where.setdefault(min(BLOCK, len(payload) - a), []).append((d, n, a))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    for size, places in where.items():
        for i in range(0, len(places), TOGETHER):
            part = places[i : i + TOGETHER]
            if size <= ORDER:
                raise ValueError("a frame needs more samples than the predictor's order")
            x = np.stack([payloads[d][a : a + size] for d, _, a in part]).astype(np.int16) - 128
            data, starts = _frames(x, np.array([n for _, n, _ in part]))
            raw = data.tobytes()
            for (d, n, _), s, e in zip(part, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                frames[d][n] = raw[s:e]
    out = []
    for payload, own in zip(payloads, frames, strict=True):
        lengths = np.array([len(f) for f in own], np.int64)
        table = np.zeros(len(own), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        table["sample"] = np.arange(len(own)) * BLOCK
        table["offset"] = np.cumsum(lengths) - lengths
        table["n"] = np.minimum(BLOCK, len(payload) - table["sample"].astype(np.int64))
        points = table.tobytes()[: 18 * ((1 << 24) // 18 - 1)]  # what a block of the format holds; later frames are found by scanning
        digest = hashlib.md5((payload ^ 128).tobytes()).digest()
        fields = 8000 << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big") + struct.pack(">Q", fields) + digest
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """Of a stream: its STREAMINFO fields, its seek points (sample, byte, samples), and where its frames begin."""
    if stream[:4] != b"fLaC":
        raise BadStream("no stream marker")
    at, info, points, last = 4, None, [], False
    while not last:
        kind, size = stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = stream[at] >= 128, stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            block_least, block_most, packed = *struct.unpack(">HH", body[:4]), int.from_bytes(body[10:18], "big")
            info = {"least": block_least, "most": block_most, "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
    if info is None:
        raise BadStream("no stream information")
    return info, points, at


class _Bits:
    """Reads big-endian bits."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, 8 * at

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise BadStream("the stream ends inside a frame")
        self.at += n
        return int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at) & (1 << n) - 1

    def signed(self, n: int) -> int:
        return (self.read(n) ^ 1 << n - 1) - (1 << n - 1) if n else 0

    def unary(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def _residuals(bits: _Bits, order: int, size: int) -> list[int]:
    width = (4, 5)[bits.read(2)]
    parts = bits.read(4)
    out: list[int] = []
    for p in range(1 << parts):
        n = (size >> parts) - (order if p == 0 else 0)
        k = bits.read(width)
        if k == (1 << width) - 1:
            raw = bits.read(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.unary() << k | bits.read(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(bits: _Bits, size: int, depth: int) -> np.ndarray:
    if bits.read(1):
        raise BadStream("a subframe begins wrongly")
    kind, wasted = bits.read(6), 0
    if bits.read(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        coefficients, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision = bits.read(4) + 1
            shift = bits.signed(5)
            coefficients = [bits.signed(precision) for _ in range(order)]
        for r in _residuals(bits, order, size):
            out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coefficients)) >> shift))
    else:
        raise BadStream("a reserved subframe kind")
    return np.array(out, np.int64) << wasted


def _frame(stream: bytes, at: int, info: dict) -> tuple[np.ndarray, int]:
    """The samples (by channel) of the frame at a byte, and where it ends."""
    bits = _Bits(stream, at)
    if bits.read(15) != 0xFFF8 >> 1:
        raise BadStream("no frame where one is due")
    bits.read(1)
    size_code, rate_code, layout, depth_code = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
    bits.read(1)
    lead = bits.read(8)
    for _ in range(max(0, 8 - (lead ^ 255).bit_length() - 1)):
        bits.read(8)
    size = bits.read(8) + 1 if size_code == 6 else bits.read(16) + 1 if size_code == 7 else SIZES[size_code]
    bits.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    head = bits.at >> 3
    if crc8(stream[at:head]) != bits.read(8):
        raise BadStream("a frame header's checksum is wrong")
    depth = DEPTHS.get(depth_code, info["bits"])
    side = {8: 1, 9: 0, 10: 1}.get(layout, -1)
    channels = [_subframe(bits, size, depth + (c == side)) for c in range(2 if layout >= 8 else layout + 1)]
    end = (bits.at + 7) // 8 + 2
    data = np.frombuffer(stream, np.uint8, end - at, at) if end <= len(stream) else None
    if data is None or crc16s(data, np.array([0]), np.array([end - at]))[0]:
        raise BadStream("a frame's checksum is wrong")
    if layout == 8:
        channels[1] = channels[0] - channels[1]
    elif layout == 9:
        channels[0] = channels[0] + channels[1]
    elif layout == 10:
        mid, diff = channels[0] * 2 + (channels[1] & 1), channels[1]
        channels = [mid + diff >> 1, mid - diff >> 1]
    return np.stack(channels), end


_ZEROS = np.full(65536, 16, np.int64)
for _k in range(16):
    _ZEROS[1 << (15 - _k) : 1 << (16 - _k)] = _k


def _fast(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """The samples of frames in data, by frame number, of those that are mono, 8-bit, of one Rice partition and with a
    fixed or linear predictor; every frame's checksums are verified. Others are left out."""
    if crc16s(data, starts, ends).any():
        raise BadStream("a frame's checksum is wrong")
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    wide = np.zeros(len(data) + 8, np.uint64)
    for j in range(8):
        wide |= padded[j : j + len(wide)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def peek(at: np.ndarray) -> np.ndarray:
        return wide[at >> 3] << (at & 7).astype(np.uint64)

    b = [padded[starts + j].astype(np.int64) for j in range(5)]
    if ((b[0] != 0xFF) | (b[1] & 0xFE != 0xF8)).any():
        raise BadStream("no frame where one is due")
    number = np.select([b[4] < 0x80, b[4] < 0xE0, b[4] < 0xF0, b[4] < 0xF8, b[4] < 0xFC, b[4] < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code = b[2] >> 4
    head = 4 + number + np.select([code == 6, code == 7], [1, 2], 0)
    crc = np.zeros(len(starts), np.int64)
    for j in range(int(head.max())):
        crc = np.where(j < head, CRC8[crc ^ padded[starts + j]], crc)
    if (crc != padded[starts + head]).any():
        raise BadStream("a frame header's checksum is wrong")
    stored = padded[starts + 4 + number].astype(np.int64)
    size = np.select([code == 6, code == 7], [stored + 1, (stored << 8 | padded[starts + 5 + number]) + 1], np.array([SIZES.get(c, 0) for c in range(16)])[code])
    kind = padded[starts + head + 1].astype(np.int64)
    order = np.where(kind >= 64, (kind >> 1) - 31, (kind >> 1) - 8)
    plain = (b[2] & 15 < 12) & (b[3] == 2) & (kind & 129 == 0) & ((kind >= 64) | ((kind >= 16) & (kind <= 24)))
    out: dict[int, np.ndarray] = {}
    shapes = order << 20 | size << 1 | (kind >= 64)
    for shape in np.unique(shapes[plain]):
        rows = np.flatnonzero(plain & (shapes == shape))
        o, n, at = int(shape >> 20), int(shape >> 1 & (1 << 19) - 1), 8 * (starts[rows] + head[rows] + 2)
        x = np.zeros((n, len(rows)), np.int64)
        for i in range(o):
            x[i] = padded[(at >> 3) + i].view(np.int8)
        at = at + 8 * o
        if shape & 1:
            top = peek(at)
            precision = (top >> np.uint64(60)).astype(np.int64) + 1
            shift = (top << np.uint64(4)).view(np.int64) >> 59
            at = at + 9
            c = []
            for _ in range(o):
                c.append(peek(at).view(np.int64) >> (64 - precision))
                at = at + precision
        else:
            c, shift = [np.int64(v) for v in FIXED[o]], np.int64(0)
        top = peek(at)
        k = (top << np.uint64(6) >> np.uint64(60)).astype(np.int64)
        good = (top >> np.uint64(58) == 0) & (k < 15) & (shift >= 0)
        at, wide_k, drop = at + 10, k.astype(np.uint64), (64 - k).astype(np.uint64) & np.uint64(63)
        none = (k == 0).any() and k == 0
        for t in range(o, n):
            w = peek(at)
            zeros = _ZEROS[w >> np.uint64(48)]
            if (zeros == 16).any():
                for i in np.flatnonzero((zeros == 16) & good):
                    while not padded[(at[i] + zeros[i]) >> 3] >> (7 - (at[i] + zeros[i]) & 7) & 1:
                        zeros[i] += 1
                w = peek(at + zeros)
                low = (w << np.uint64(1)) >> drop
            else:
                low = (w << (zeros + 1).astype(np.uint64)) >> drop
            if none is not False:
                low[none] = 0
            u = (zeros << k) | low.view(np.int64)
            at = np.minimum(at + zeros + 1 + k, 8 * (len(data) + 7))
            r = (u >> 1) ^ -(u & 1)
            if o:
                p = c[0] * x[t - 1]
                for j in range(1, o):
                    p += c[j] * x[t - 1 - j]
                r += p >> shift
            x[t] = r
        for i in np.flatnonzero(good).tolist():
            out[int(rows[i])] = x[:, i]
    return out


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """The PCM blocks of each stream: (number of the first sample, samples by channel), in order.

    Raises BadStream if a checksum is wrong or the number of samples isn't the stored one.
    """
    heads = [metadata(s) for s in streams]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    places: list[tuple[int, int, int, int]] = []
    slow = []
    for d, (info, points, at) in enumerate(heads):
        whole = points and points[0][0] == 0 and sum(p[2] for p in points) == info["samples"]
        if whole and info["channels"] == 1 and info["bits"] == 8:
            offsets = [at + p[1] for p in points] + [len(streams[d])]
            places += [(d, points[i][0], offsets[i], offsets[i + 1]) for i in range(len(points))]
        else:
            slow.append(d)
    for i in range(0, len(places), TOGETHER):
        part = places[i : i + TOGETHER]
        raw = [streams[d][a:b] for d, _, a, b in part]
        lengths = np.array([len(x) for x in raw], np.int64)
        if (lengths < 8).any():
            raise BadStream("a seek point leads nowhere")
        ends = np.cumsum(lengths)
        found = _fast(np.frombuffer(b"".join(raw), np.uint8), ends - lengths, ends)
        for j, (d, sample, a, _) in enumerate(part):
            out[d].append((sample, found[j][None] if j in found else _frame(streams[d], a, heads[d][0])[0]))
    for d in slow:
        info, _, at = heads[d]
        sample = 0
        while at < len(streams[d]):
            samples, at = _frame(streams[d], at, info)
            out[d].append((sample, samples))
            sample += samples.shape[1]
    for (info, _, _), blocks in zip(heads, out, strict=True):
        if info["samples"] and sum(b.shape[1] for _, b in blocks) != info["samples"]:
            raise BadStream("the number of samples is wrong")
        width = (info["bits"] + 7) // 8
        digest = hashlib.md5()
        for _, b in blocks:
            digest.update(np.ascontiguousarray(b.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() if width > 1 else b.T.astype(np.int8).tobytes())
        if any(info["md5"]) and digest.digest() != info["md5"]:
            raise BadStream("the samples' MD5 is wrong")
    return out


def seek(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The block that holds a sample: its first sample's number and its samples, read from the nearest seek point."""
    info, points, begin = metadata(stream)
    if not 0 <= sample < info["samples"]:
        raise IndexError(sample)
    near = max((p for p in points if p[0] <= sample), default=(0, 0, 0))
    first, at = near[0], begin + near[1]
    while True:
        samples, at = _frame(stream, at, info)
        if sample < first + samples.shape[1]:
            return first, samples
        first += samples.shape[1]


def encode_text(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """One row for each row of docs: id, n_bytes (of the text in UTF-8; null: empty), media (FLAC): the text's bytes,
    filled up with spaces to a positive multiple of unit, as 8-bit samples. Equal texts give equal media. Repeated
    rows and null ids each give their row; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, bounds = utf8(batch["text"])
            sizes = np.diff(bounds)
            payloads = []
            for a, n in zip(bounds[:-1].tolist(), sizes.tolist(), strict=True):
                payload = np.full(max(unit, -(-n // unit) * unit), 32, np.uint8)
                payload[:n] = data[a : a + n]
                payloads.append(payload)
            yield pa.record_batch([batch["id"], pa.array(sizes, pa.int64()), pa.array(encode_payloads(payloads), pa.binary())], ["id", "n_bytes", "media"])

    source = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    return arrow_map(source, run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id)


def pcm_blocks(media: DataFrame, id: str = "doc_id", column: str = "media") -> DataFrame:
    """The PCM blocks of a column of FLAC streams: id, block, sample_offset (its first sample's number in the stream),
    n_samples, pcm (interleaved little-endian samples of whole bytes). A null stream has no blocks; a broken one
    raises. Repeated rows give their blocks each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows: list[list] = [[], [], [], [], []]
            present = [(i, s) for i, s in zip(batch["id"].to_pylist(), batch["media"].to_pylist(), strict=True) if s is not None]
            for (i, stream), blocks in zip(present, decode([s for _, s in present]), strict=True):
                width = (metadata(stream)[0]["bits"] + 7) // 8
                for n, (offset, samples) in enumerate(blocks):
                    pcm = np.ascontiguousarray(samples.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                    for column_, value in zip(rows, (i, n, offset, samples.shape[1], pcm), strict=True):
                        column_.append(value)
            yield pa.record_batch([pa.array(rows[0], batch["id"].type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], ["id", "block", "sample_offset", "n_samples", "pcm"])

    source = media.select(media[id].alias("id"), media[column].alias("media"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, run, f"id {kind}, block long, sample_offset long, n_samples long, pcm binary").withColumnRenamed("id", id)


def joined(blocks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The first channel's samples of PCM blocks (sample offset, samples), put together by their offsets."""
    blocks = sorted(blocks, key=lambda b: b[0])
    at = np.cumsum([0, *(b.shape[1] for _, b in blocks)])
    if [offset for offset, _ in blocks] != at[:-1].tolist():
        raise BadStream("blocks are missing or overlap")
    return np.concatenate([b[0] for _, b in blocks]) if blocks else np.zeros(0, np.int64)


def text_digests(media: DataFrame, id: str = "doc_id") -> DataFrame:
    """What the media of encode_text() hold, read back: payload and media sizes and digests, and a feature string of
    the sound (blocks, mean, root mean square, zero crossings, peak). Takes id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            streams = batch["media"].to_pylist()
            rows = []
            for stream, blocks in zip(streams, decode(streams), strict=True):
                x = joined(blocks)
                payload = (x + 128).astype(np.uint8).tobytes()
                crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                feature = f"blocks={len(blocks)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};peak={int(np.abs(x).max())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch["id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", *NAMES])

    source = media.select(media[id].alias("id"), "n_bytes", "media")
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id)


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_digests(encode_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))
