"""FLAC media columns: store bytes as 8-bit mono FLAC, decode Rice residuals and linear predictors.

Streams are ordinary FLAC files (STREAMINFO with MD5, a SEEKTABLE with one point a frame, frames with
CRC-8 and CRC-16). Samples are byte - 128. The encoder takes, frame by frame, the smallest of the fixed
predictors of orders 0 to 2 and a linear predictor of order 4 fitted to the frame, and one Rice parameter. The decoder reads mono
streams of 4 to 24 bits with constant, verbatim, fixed and LPC subframes, Rice and Rice2 residuals, any
partition order and escapes; it checks both checksums of every frame and the MD5, and gives PCM blocks
with their sample and byte offsets, so that a reader can seek to any block.

All frames of a slice of documents advance together as numpy lanes; there is no loop over samples of
one document. Slices are cut by bytes, so memory is bounded however long or many the texts are, except
that one text is always whole. The media table is written to the shared folder and read back from there; there is no shuffle.

Null and empty texts become one block of 64 zero bytes. Repeated rows give equal values. A frame with a
bad checksum raises ValueError; it is never passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.common import byte_buffer, documents, slices, written

BLOCK = 2048
RATE = 8000
LPC_ORDER = 4
SLICE = 1 << 20  # bytes of text or media at work in a task: numpy lanes need some hundred times as much
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def crc_table(bits: int, poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1), (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)
CLZ16 = np.array([16] + [16 - int(i).bit_length() for i in range(1, 1 << 16)], np.int64)


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each byte range, all ranges a step at a time."""
    table, mask = (CRC8, 0xFF) if bits == 8 else (CRC16, 0xFFFF)
    order = np.argsort(-size, kind="stable")
    crc, s, n = np.zeros(len(size), np.int64), start[order], size[order]
    active = np.searchsorted(-n, -np.arange(n.max(initial=0)), side="left")
    for i, a in enumerate(active):
        b = data[s[:a] + i]
        crc[:a] = (table[(crc[:a] >> (bits - 8)) ^ b] ^ (crc[:a] << 8)) & mask
    out = np.empty_like(crc)
    out[order] = crc
    return out


class BitWriter:
    def __init__(self, bits: int):
        self.words = np.zeros((bits >> 6) + 2, np.uint64)

    @staticmethod
    def _parts(pos, nbits, value):
        end = (pos & 63) + nbits
        over = np.maximum(end - 64, 0).astype(np.uint64)
        v = value.astype(np.uint64)
        high = np.where(end <= 64, v << np.maximum(64 - end, 0).astype(np.uint64), v >> over)
        low = np.where(end > 64, v << np.minimum(np.uint64(64) - over, np.uint64(63)), np.uint64(0))
        return pos >> 6, high, low

    def put(self, pos, nbits, value) -> None:
        """A few values, at any places; at most 32 bits each."""
        word, high, low = self._parts(np.asarray(pos, np.int64), np.asarray(nbits, np.int64), np.asarray(value))
        np.bitwise_or.at(self.words, word, high)
        np.bitwise_or.at(self.words, word + 1, low)

    def put_sorted(self, pos, nbits, value) -> None:
        """Many values in order of place."""
        if not len(pos):
            return
        word, high, low = self._parts(pos, nbits, value)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        self.words[word[first]] |= np.bitwise_or.reduceat(high, first)
        spill = low != 0
        np.bitwise_or.at(self.words, word[spill] + 1, low[spill])

    def bytes(self) -> np.ndarray:
        return self.words.byteswap().view(np.uint8)


def utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as FLAC codes them: value and bits (up to 2**21)."""
    v = np.where(n < 0x80, n, np.where(n < 0x800, 0xC080 | (n >> 6 << 8) | (n & 63), np.where(n < 0x10000, 0xE08080 | (n >> 12 << 16) | ((n >> 6 & 63) << 8) | (n & 63), 0xF0808080 | (n >> 18 << 24) | ((n >> 12 & 63) << 16) | ((n >> 6 & 63) << 8) | (n & 63))))
    return v, np.where(n < 0x80, 8, np.where(n < 0x800, 16, np.where(n < 0x10000, 24, 32)))


def fitted_lpc(s: np.ndarray, start: np.ndarray, size: np.ndarray, order: int = LPC_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame the linear predictor that its autocorrelation asks for (Levinson and Durbin), as integers and their shift."""
    r = [np.add.reduceat(s * s, start).astype(np.float64)]
    for lag in range(1, order + 1):
        both = np.zeros_like(s)
        np.multiply(s[lag:], s[:-lag], out=both[lag:])
        for i in range(lag):  # the first samples of a frame have no earlier ones
            both[start + np.minimum(i, size - 1)] = 0
        r.append(np.add.reduceat(both, start).astype(np.float64))
    a, err = np.zeros((order, len(start))), r[0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / err
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    shift = np.clip(np.floor(np.log2(16383 / np.maximum(np.abs(a).max(axis=0), 1e-9))), 0, 15).astype(np.int64)
    return np.clip(np.rint(a * 2.0**shift), -16384, 16383).astype(np.int64), shift


def rice_bits(total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter for n values of that sum, and about how many bits they take."""
    k = np.clip(np.floor(np.log2(np.maximum(total / np.maximum(n, 1), 1))), 0, 14).astype(np.int64)
    return k, n * (1 + k) + (total >> k)


def encode(payload: np.ndarray, offsets: np.ndarray, block: int = BLOCK, lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """One FLAC stream for each payload payload[offsets[i]:offsets[i + 1]] (16 bytes at least).

    lpc: (coefficients, shift) used for every frame in place of the choice by size.
    """
    count = np.diff(offsets)
    frames = -(-count // block)
    doc = np.repeat(np.arange(len(count)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = offsets[:-1][doc] + number * block
    size = np.minimum(block, offsets[1:][doc] - start)
    s = payload.astype(np.int32) - 128
    of = np.repeat(np.arange(len(doc)), size)
    within = np.arange(len(s)) - start[of]
    each = np.ones(len(doc), np.int64)
    if lpc is None:
        kinds = [(False, np.array(c, np.int64)[:, None] * each, 0 * each) for c in ([], [1], [2, -1])] + [(True, *fitted_lpc(s, start, size))]
    else:
        kinds = [(True, np.array(lpc[0], np.int64)[:, None] * each, lpc[1] * each)]
    best, us = None, []
    for j, (linear, coefs, shift) in enumerate(kinds):
        order = len(coefs)
        pred = np.zeros(len(s), np.int32)
        for i, c in enumerate(coefs.astype(np.int32)):
            pred[i + 1 :] += (np.repeat(c, size)[i + 1 :] if linear else c[0]) * s[: len(s) - i - 1]
        r = s - (pred >> np.repeat(shift.astype(np.int32), size) if linear else pred)
        for i in range(order):
            r[start + np.minimum(i, size - 1)] = 0
        v = (r << 1) ^ (r >> 31)
        us.append(v)
        k, bits = rice_bits(np.add.reduceat(v, start, dtype=np.int64), size - order)
        bits = bits + 8 * order + (9 + 15 * order if linear else 0)
        if best is None:
            best, pick, rice = bits, 0 * each, k
        else:
            less = bits < best
            best, pick, rice = np.where(less, bits, best), np.where(less, j, pick), np.where(less, k, rice)
    order = np.array([len(c) for _, c, _ in kinds])[pick]
    linear = np.array([x for x, _, _ in kinds])[pick]
    k = rice
    u = us[0]
    for j in range(1, len(kinds)):
        if (pick == j).any():
            u = np.where(np.repeat(pick == j, size), us[j], u)
    u = u.astype(np.int64)
    coded = within >= order[of]
    kk = k[of]
    length = np.where(coded, (u >> kk) + 1 + kk, 0)
    num_v, num_b = utf8_number(number)
    extra = np.where(linear, 9 + 15 * order, 0)
    head = 32 + num_b + 16
    body = head + 8 + 8 * order + extra + 10 + 8
    bits = body + np.add.reduceat(length, start)
    nbytes = (bits + 7 >> 3) + 2
    at = np.cumsum(nbytes) - nbytes
    w = BitWriter(int(nbytes.sum()) * 8)
    p = at * 8
    n = each
    w.put(p, 32 * n, n * 0xFFF87402)
    w.put(p + 32, num_b, num_v)
    w.put(p + 32 + num_b, 16 * n, size - 1)
    w.put(p + head + 8, 8 * n, np.where(linear, 31 + order, 8 + order) << 1)
    for j in range(int(order.max(initial=0))):
        has = order > j
        w.put((p + head + 16 + 8 * j)[has], (8 * n)[has], s[start[has] + j] & 0xFF)
    q = p + head + 16 + 8 * order
    for j, (is_lpc, coefs, shift) in enumerate(kinds):
        on = np.flatnonzero(pick == j)
        if is_lpc and len(on):
            w.put(q[on], 9 * n[on], 14 << 5 | shift[on])
            for i, c in enumerate(coefs):
                w.put(q[on] + 9 + 15 * i, 15 * n[on], c[on] & 0x7FFF)
    w.put(q + extra, 10 * n, k)
    total = np.cumsum(length)
    end = (p + body)[of] + total - (total - length)[start][of]
    value = (1 << kk) | (u & ((1 << kk) - 1))
    w.put_sorted((end - kk - 1)[coded], (kk + 1)[coded], value[coded])
    data = w.bytes()[: int(nbytes.sum())].copy()
    data[at + (head >> 3)] = checksums(data, at, head >> 3, 8)
    crc = checksums(data, at, nbytes - 2, 16)
    data[at + nbytes - 2], data[at + nbytes - 1] = crc >> 8, crc & 0xFF
    out = []
    first = np.cumsum(frames) - frames
    raw = data.tobytes()
    pcm = s.astype(np.int8).tobytes()
    lo, hi, wide = at.tolist(), (at + nbytes).tolist(), nbytes.tolist()
    points = np.zeros((len(doc), 18), np.uint8)
    points[:, 0:8] = (number * block).astype(">u8").view(np.uint8).reshape(-1, 8)
    points[:, 8:16] = (at - at[first[doc]]).astype(">u8").view(np.uint8).reshape(-1, 8)
    points[:, 16:18] = size.astype(">u2").view(np.uint8).reshape(-1, 2)
    for d in range(len(count)):
        a, b = int(first[d]), int(first[d] + frames[d])
        sizes = wide[a:b]
        rate = RATE << 44 | 0 << 41 | 7 << 36 | int(count[d])
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + rate.to_bytes(8, "big") + hashlib.md5(pcm[offsets[d] : offsets[d + 1]]).digest()
        seek = points[a:b].tobytes()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[lo[a] : hi[b - 1]])
    return out


class Frames:
    """Decodes the frames that start at the given bytes, all lanes a step at a time."""

    def __init__(self, data: np.ndarray, start: np.ndarray, bps: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.window = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
        self.start, self.bps = start, bps
        try:
            self._header()
            self._samples()
        except IndexError as e:
            raise ValueError("a frame runs past the end of its stream") from e
        if (self.end > len(data)).any():
            raise ValueError("a frame runs past the end of its stream")
        got = checksums(data, start, self.end - 2 - start, 16)
        if (got != (data[self.end - 2].astype(np.int64) << 8 | data[self.end - 1])).any():
            raise ValueError("a frame's CRC-16 does not match")

    def read(self, pos: np.ndarray, nbits) -> np.ndarray:
        """Up to 32 bits at each place; 0 bits give 0."""
        v = self.window[np.minimum(pos >> 3, len(self.window) - 1)] << (pos & 7).astype(np.uint64)
        n = np.asarray(nbits, np.uint64)
        return ((v >> np.uint64(1)) >> (np.uint64(63) - n)).astype(np.int64)

    def signed(self, pos, nbits):
        v, n = self.read(pos, nbits), np.asarray(nbits, np.int64)
        return np.where(v >> np.maximum(n - 1, 0) & (n > 0), v - (1 << n), v)

    def _header(self) -> None:
        p = self.start * 8
        h = self.read(p, 32)
        if ((h >> 17) != 0xFFF8 >> 1).any() or ((h >> 4 & 15) != 0).any():
            raise ValueError("not the start of a mono frame")
        code, rate, depth = h >> 12 & 15, h >> 8 & 15, h >> 1 & 7
        lead = self.read(p + 32, 8)
        ones = np.where(lead < 0x80, 1, 8 - np.array([int(x ^ 0xFF).bit_length() for x in range(256)])[lead])
        q = p + 32 + 8 * ones
        first = lead & ((1 << np.maximum(7 - ones, 0)) - 1)
        self.number = np.where(lead < 0x80, lead, first)
        for j in range(1, 7):
            more = ones > j
            self.number = np.where(more, self.number << 6 | self.read(p + 32 + 8 * j, 8) & 63, self.number)
        n = np.where(code == 1, 192, np.where(code <= 5, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)))
        n = np.where(code == 6, self.read(q, 8) + 1, np.where(code == 7, self.read(q, 16) + 1, n))
        q = q + np.where(code == 6, 8, np.where(code == 7, 16, 0)) + np.where(rate == 12, 8, np.where((rate == 13) | (rate == 14), 16, 0))
        self.size = n
        self.bps = np.where(depth == 0, self.bps, np.array([0, 8, 12, 0, 16, 20, 24, 32])[depth])
        size = (q >> 3) - self.start
        if (checksums(self.data, self.start, size, 8) != self.read(q, 8)).any():
            raise ValueError("a frame header's CRC-8 does not match")
        self.pos = q + 8

    def _samples(self) -> None:
        lanes = len(self.start)
        order = np.argsort(-self.size, kind="stable")  # lanes still at work are always the first
        size, pos, bps = self.size[order], self.pos[order].copy(), self.bps[order].copy()
        most = int(size.max(initial=0))
        kind = self.read(pos, 8) >> 1 & 63
        wasted = self.read(pos, 8) & 1
        pos += 8
        waste = np.zeros(lanes, np.int64)
        for i in np.flatnonzero(wasted):
            n = 1
            while not self.read(pos[i : i + 1], 1)[0]:
                n, pos[i] = n + 1, pos[i] + 1
            pos[i] += 1
            waste[i] = n
        bps = bps - waste
        out = np.zeros((most, lanes), np.int32)
        fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
        porder = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
        if (~(fixed | lpc | (kind < 2))).any():
            raise ValueError("a reserved subframe type")
        const = kind == 0
        if const.any():
            v = self.signed(pos, bps)
            out[:, const] = v[const]
            pos = np.where(const, pos + bps, pos)
        for i in range(int(size[kind == 1].max(initial=0))):
            on = np.flatnonzero((kind == 1) & (size > i))
            out[i, on] = self.signed(pos[on], bps[on])
            pos[on] += bps[on]
        for i in range(int(porder.max(initial=0))):
            on = np.flatnonzero(porder > i)
            out[i, on] = self.signed(pos[on], bps[on])
            pos[on] += bps[on]
        coefs, shift = np.zeros((32, lanes), np.int64), np.zeros(lanes, np.int64)
        for k, c in FIXED.items():
            for j, x in enumerate(c):
                coefs[j, fixed & (porder == k)] = x
        on = np.flatnonzero(lpc)
        if len(on):
            precision = self.read(pos[on], 4) + 1
            shift[on] = self.read(pos[on] + 4, 5)
            pos[on] += 9
            for j in range(int(porder[on].max())):
                a = porder[on] > j
                coefs[j, on[a]] = self.signed(pos[on[a]], precision[a])
                pos[on[a]] += precision[a]
        coded = fixed | lpc
        self._residuals(out, coded, size, porder, pos)
        for k in np.unique(porder[coded]):
            on = np.flatnonzero(coded & (porder == k))
            if k == 1 and fixed[on].all():
                out[:, on] = np.cumsum(out[:, on], axis=0)
            elif k:
                s, c, sh = out[:, on].astype(np.int64), coefs[:k, on], shift[on]
                for i in range(int(k), most):
                    s[i] += (c * s[i - k : i][::-1]).sum(axis=0) >> sh
                out[:, on] = s
        out = out << waste.astype(np.int32)
        end = (pos + 7 >> 3) + 2
        self.end = np.empty(lanes, np.int64)
        self.end[order] = end
        place = np.empty(lanes, np.int64)
        place[order] = np.arange(lanes)
        flat = out.T[place]
        self.samples = flat[np.arange(most)[None, :] < self.size[:, None]]

    def _residuals(self, out, coded, size, porder, pos) -> None:
        lanes = np.flatnonzero(coded)
        if not len(lanes):
            return
        method = self.read(pos[lanes], 2)
        parts = self.read(pos[lanes] + 2, 4)
        pos[lanes] += 6
        wide = np.where(method == 0, 4, 5)
        n, p0, pos_l = size[lanes], porder[lanes], pos[lanes]
        step = n >> parts
        begin: dict[int, list[int]] = {}
        for i, (o, st, total) in enumerate(zip(p0.tolist(), step.tolist(), n.tolist(), strict=True)):
            for at in [o, *range(st, total, st)]:
                begin.setdefault(at, []).append(i)
        k, raw = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), bool)
        active = np.searchsorted(-n, -np.arange(n.max(initial=0)), side="left")
        floor = int(p0.min())
        mixed = int(p0.max())
        one = np.uint64(1)
        for i in range(floor, len(active)):
            if i in begin:
                b = np.array(begin[i])
                k[b] = self.read(pos_l[b], wide[b])
                pos_l[b] += wide[b]
                esc = k[b] == (1 << wide[b]) - 1
                raw[b] = esc
                if esc.any():
                    e = b[esc]
                    k[e] = self.read(pos_l[e], 5)
                    pos_l[e] += 5
            a = active[i]
            if i < mixed:
                run = np.flatnonzero(p0[:a] <= i)
                if not len(run):
                    continue
                pa_, ka, ra = pos_l[run], k[run], raw[run]
            else:
                run = slice(0, a)
                pa_, ka, ra = pos_l[:a], k[:a], raw[:a]
            v = self.window[pa_ >> 3] << (pa_ & 7).astype(np.uint64)
            q = CLZ16[(v >> np.uint64(48)).astype(np.int64)]
            low = (((v << q.astype(np.uint64)) << one) >> one) >> (np.uint64(63) - ka.astype(np.uint64))
            value = (q << ka) | low.astype(np.int64)
            long = np.flatnonzero((q == 16) & ~ra)
            for x in long:  # a rare long unary part
                at, zeros = int(pa_[x]), 0
                while not (c := int(self.window[at + zeros >> 3]) << (at + zeros & 7) & (2**64 - 1)) >> 8:
                    zeros += 56
                zeros += 64 - c.bit_length()
                q[x] = zeros
                value[x] = zeros << int(ka[x]) | int(self.read(np.array([at + zeros + 1]), ka[x : x + 1])[0])
            res = (value >> 1) ^ -(value & 1)
            used = q + 1 + ka
            if ra.any():
                res = np.where(ra, self.signed(pa_, ka), res)
                used = np.where(ra, ka, used)
            out[i, lanes[run]] = res
            pos_l[run] = pa_ + used
        pos[lanes] = pos_l


def stream_parts(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """STREAMINFO, seek points (sample, byte, samples) and the byte at which frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last = 4, {}, [], False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            info = {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "bps": (x >> 36 & 31) + 1, "samples": x & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            points = [p for p in points if p[0] != 2**64 - 1]
        at += 4 + size
    return info, points, at


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples of all streams end to end, and of every frame: stream, first sample, samples, first byte.

    Streams whose seek table covers every frame decode at once; others frame after frame, together.
    """
    parts = [stream_parts(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    if any(p[0]["channels"] != 1 for p in parts):
        raise ValueError("only mono streams are read")
    bps = np.array([p[0]["bps"] for p in parts])
    whole = [bool(p[1]) and sum(x[2] for x in p[1]) == p[0]["samples"] for p in parts]
    got = []  # (stream, start byte, frames object, index)
    now_doc = np.array([d for d, p in enumerate(parts) if whole[d] for _ in p[1]], np.int64)
    now_at = np.array([base[d] + p[2] + x[1] for d, p in enumerate(parts) if whole[d] for x in p[1]], np.int64)
    slow = [d for d in range(len(streams)) if not whole[d] and parts[d][0]["samples"]]
    slow_at = {d: int(base[d]) + parts[d][2] for d in slow}
    left = {d: parts[d][0]["samples"] for d in slow}
    waves = [(now_doc, now_at)] if len(now_doc) else []
    while waves or slow:
        doc, at = waves.pop() if waves else (np.array(slow, np.int64), np.array([slow_at[d] for d in slow], np.int64))
        f = Frames(data, at, bps[doc])
        cut = np.cumsum(f.size)[:-1]
        for d, a, n, s, e in zip(doc.tolist(), at.tolist(), f.size.tolist(), np.split(f.samples, cut), f.end.tolist(), strict=True):
            got.append((d, a, n, s))
            if not whole[d]:
                slow_at[d], left[d] = e, left[d] - n
        slow = [d for d in slow if left[d] > 0]
    got.sort(key=lambda x: (x[0], x[1]))
    samples = np.concatenate([g[3] for g in got]) if got else np.zeros(0, np.int32)
    stream, n = np.array([g[0] for g in got], np.int64), np.array([g[2] for g in got], np.int64)
    total = np.cumsum(n) - n
    first = np.searchsorted(stream, np.arange(len(streams)))
    sample_at = total - np.where(len(total), total[first[stream]], 0) if len(got) else n
    byte_at = np.array([g[1] for g in got], np.int64) - base[stream] if len(got) else n
    return samples, stream, sample_at, n, byte_at


def payload_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes padded with zeros to a positive multiple of 64: payload, its offsets, sizes before padding."""
    data, off = byte_buffer(column)
    size = np.diff(off)
    padded = np.maximum(-(-size // 64) * 64, 64)
    to = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(int(to[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - off[:-1], size)] = data
    return out, to, size


def encode_text_column(docs: DataFrame, keep: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """keep, n_bytes, media: the text's padded bytes as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, SLICE):
            payload, to, size = payload_of(b.column(text))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(size), pa.array(encode(payload, to, block), pa.binary())], names=[keep, "n_bytes", "media"])

    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, text).mapInArrow(run, f"{keep} {kind}, n_bytes long, media binary")


def decode_blocks(media: DataFrame, keep: str = "doc_id", column: str = "media") -> DataFrame:
    """keep, block, sample_offset, samples, byte_offset, pcm: one row for each frame of each stream, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column, SLICE):
            b = b.filter(pc.is_valid(b.column(column)))
            if not b.num_rows:
                continue
            streams = b.column(column).to_pylist()
            samples, stream, sample_at, n, byte_at = decode(streams)
            end = np.cumsum(n)
            first = np.searchsorted(stream, np.arange(len(streams)))
            pcm = [samples[e - k : e].astype("<i4").tobytes() for e, k in zip(end.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(keep).take(pa.array(stream)), pa.array(np.arange(len(n)) - first[stream]), pa.array(sample_at), pa.array(n), pa.array(byte_at), pa.array(pcm, pa.binary())], names=[keep, "block", "sample_offset", "samples", "byte_offset", "pcm"])

    kind = media.schema[keep].dataType.simpleString()
    return media.select(keep, column).mapInArrow(run, f"{keep} {kind}, block long, sample_offset long, samples long, byte_offset long, pcm binary")


DIGEST = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def digest(media: DataFrame, keep: str = "doc_id") -> DataFrame:
    """Read each stored stream back, check it and describe payload, tail and signal; a null stream gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", SLICE):
            none = b.filter(pc.is_null(b.column("media")))
            if none.num_rows:
                yield pa.RecordBatch.from_arrays([none.column(keep), none.column("n_bytes"), *[pa.nulls(none.num_rows, t) for t in DIGEST.values()]], names=[keep, "n_bytes", *DIGEST])
                b = b.filter(pc.is_valid(b.column("media")))
                if not b.num_rows:
                    continue
            streams = b.column("media").to_pylist()
            samples, stream, _, n, _ = decode(streams)
            at = np.searchsorted(stream, np.arange(len(streams)))
            size = np.add.reduceat(n, at)
            end = np.cumsum(size)
            s = samples.astype(np.int64)
            energy = np.add.reduceat(s * s, end - size)
            turn = np.concatenate([[0], ((s[1:] < 0) != (s[:-1] < 0)).astype(np.int64)])
            turn[end - size] = 0
            turns, peak = np.add.reduceat(turn, end - size), np.maximum.reduceat(np.abs(s), end - size)
            raw, pcm = (s + 128).astype(np.uint8).tobytes(), s.astype(np.int8).tobytes()
            rows = []
            for i, (e, z) in enumerate(zip(end.tolist(), size.tolist(), strict=True)):
                own = raw[e - z : e]
                if hashlib.md5(pcm[e - z : e]).digest() != stream_parts_md5(streams[i]):
                    raise ValueError("a stream's MD5 does not match")
                rows.append((z, hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(streams[i]), hashlib.sha256(streams[i]).hexdigest(), f"rms={int(np.sqrt(energy[i] / z) * 1000)};turns={turns[i]};peak={peak[i]}"))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(keep), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, DIGEST.values(), strict=True)]], names=[keep, "n_bytes", *DIGEST])

    kind = media.schema[keep].dataType.simpleString()
    return media.select(keep, "n_bytes", "media").mapInArrow(run, f"{keep} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stream_parts_md5(stream: bytes) -> bytes:
    return stream[26:42]  # STREAMINFO is always the first block


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(encode_text_column(documents(spark, sf_dir)), "op2-media")
    return digest(stored).select("doc_id", "n_bytes", *DIGEST)
