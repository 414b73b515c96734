"""FLAC media columns: a numpy codec for mono 8-bit streams that works on many frames at once.

The encoder picks per frame among constant, verbatim, fixed and linear prediction with partitioned Rice residuals, and
writes a seek point for every frame. The decoder steps through the residuals of all frames of a batch together, restores
the predictors, verifies the frame and header checksums and the stream's MD5, and yields PCM blocks with their sample
offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.common import with_fields
from skein.llm.textbatch import flat_bytes, slices

BLOCK = 1024
RATE_CODE, RATE = 4, 8000  # 8 kHz
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 9, 7
PARTITION_ORDER = 2
UNIT = 64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        c = np.where(c >> (bits - 1) & 1, c << 1 ^ poly, c << 1) & ((1 << bits) - 1)
    return c


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_FAR: dict[int, np.ndarray] = {}


def _by_distance(bits: int, n: int) -> np.ndarray:
    """Row d: what a byte contributes to the checksum with d bytes behind it. A checksum is the XOR of these."""
    table = _CRC8 if bits == 8 else _CRC16
    have = _FAR.get(bits)
    if have is None or len(have) < n:
        rows = [table]
        for _ in range(1, max(n, 1400)):
            c = rows[-1]
            rows.append((c << 8 & ((1 << bits) - 1)) ^ table[c >> (bits - 8)])
        _FAR[bits] = have = np.stack(rows).astype(np.uint16)
    return have


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of the ranges [start, end) of ``data``, all at once. No range is empty."""
    n = end - start
    table = _by_distance(bits, int(n.max(initial=1)))
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first, n)
    return np.bitwise_xor.reduceat(table[np.repeat(n, n) - 1 - at, data[at + np.repeat(start, n)]], first)


def _put(bits: np.ndarray, pos: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[pos + j] = value >> (width - 1 - j) & 1


def _frame_heads(number: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Header bytes of each frame with their checksum, and the header lengths."""
    heads = []
    for k, n in zip(number.tolist(), size.tolist(), strict=True):
        full = n == BLOCK
        h = bytes([0xFF, 0xF8, (10 if full else 7) << 4 | RATE_CODE, 0x02])
        h += chr(k).encode("utf-8", "surrogatepass") if k < 0x10000 else _long_number(k)
        if not full:
            h += struct.pack(">H", n - 1)
        heads.append(h)
    n = np.array([len(h) for h in heads], np.int64)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    ends = np.cumsum(n)
    crc = checksums(flat, ends - n, ends, 8)
    return np.frombuffer(b"".join(h + bytes([c]) for h, c in zip(heads, crc.tolist(), strict=True)), np.uint8), n + 1


def _long_number(k: int) -> bytes:
    """The extended UTF-8 form of numbers up to 36 bits."""
    tail = []
    room = 6
    while k >= 1 << room:
        tail.append(0x80 | k & 0x3F)
        k >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1)) & 0xFF | k, *reversed(tail)])


def _predictions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (frames by order) and their residuals (frames by block) for whole frames ``x``."""
    f = x.astype(np.float64)
    p = LPC_ORDER
    auto = np.stack([(f[:, : f.shape[1] - d] * f[:, d:]).sum(axis=1) for d in range(p + 1)], axis=1)
    lag = np.abs(np.arange(p)[:, None] - np.arange(p)[None, :])
    m = auto[:, lag] + (np.eye(p) * (1e-3 * auto[:, :1, None] + 1.0))
    coef = np.linalg.solve(m, auto[:, 1:, None])[:, :, 0]
    limit = (1 << (LPC_PRECISION - 1)) - 1
    q = np.clip(np.rint(coef * (1 << LPC_SHIFT)), -limit, limit).astype(np.int64)
    guess = np.zeros((len(x), x.shape[1] - p), np.int64)
    for j in range(p):
        guess += q[:, j : j + 1] * x[:, p - 1 - j : x.shape[1] - 1 - j]
    res = np.zeros_like(x)
    res[:, p:] = x[:, p:] - (guess >> LPC_SHIFT)
    return q, res


def _encode_group(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of frames of one block size: their bytes in a row, and bytes per frame."""
    n_f, n = x.shape
    po = PARTITION_ORDER if n % (1 << PARTITION_ORDER) == 0 and n >> PARTITION_ORDER > LPC_ORDER else 0
    plen = n >> po
    kinds, residuals = [0, 1, 2], [x]
    for _ in (1, 2):
        r = np.zeros_like(x)
        r[:, 1:] = residuals[-1][:, 1:] - residuals[-1][:, :-1]
        residuals.append(r)
    lpc = None
    if n > 4 * LPC_ORDER:
        lpc, r = _predictions(x)
        kinds.append(-1)
        residuals.append(r)
    order = np.array([*range(3), LPC_ORDER][: len(kinds)])
    cost, ks = [], []
    for o, r in zip(order, residuals, strict=True):
        u = (r << 1) ^ (r >> 63)
        u[:, :o] = 0
        u = u.reshape(n_f, -1, plen)
        mean = u.sum(axis=2) / plen
        k = np.clip(np.ceil(np.log2(np.maximum(mean * 0.7, 1e-9))), 0, 14).astype(np.int64)
        k = np.maximum(k, np.ceil(np.log2(np.maximum(u.max(axis=2) / 32, 1e-9))).astype(np.int64).clip(0, 14))
        ks.append(k)
        cost.append((u >> k[:, :, None]).sum(axis=(1, 2)) + (1 + k).sum(axis=1) * plen - o * (1 + k[:, 0]) + 8 * o + (LPC_PRECISION * o + 9 if o == LPC_ORDER else 0))
    cost = np.stack(cost, axis=1)
    best = cost.argmin(axis=1)
    body = cost[np.arange(n_f), best] + 8 + 6 + (4 << po)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (body >= 8 + 8 * n)
    coded = ~constant & ~verbatim
    bits_of = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    bytes_of = (bits_of + 7) // 8
    at = (np.cumsum(bytes_of) - bytes_of) * 8
    bits = np.zeros(int(bytes_of.sum()) * 8, np.uint8)
    if constant.any():
        _put(bits, at[constant] + 8, x[constant, 0] & 255, 8)
    if verbatim.any():
        _put(bits, at[verbatim], np.full(int(verbatim.sum()), 2), 8)
        _put(bits, (at[verbatim] + 8)[:, None] + 8 * np.arange(n), x[verbatim] & 255, 8)
    for b, o in enumerate(order.tolist()):
        sel = np.flatnonzero(coded & (best == b))
        if not len(sel):
            continue
        is_lpc = kinds[b] < 0
        pos = at[sel]
        _put(bits, pos, np.full(len(sel), (32 | o - 1 if is_lpc else 8 | o) << 1), 8)
        pos = pos + 8
        if o:
            _put(bits, pos[:, None] + 8 * np.arange(o), x[sel, :o] & 255, 8)
        pos = pos + 8 * o
        if is_lpc:
            _put(bits, pos, np.full(len(sel), LPC_PRECISION - 1), 4)
            _put(bits, pos + 4, np.full(len(sel), LPC_SHIFT), 5)
            _put(bits, (pos + 9)[:, None] + LPC_PRECISION * np.arange(o), lpc[sel] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
            pos = pos + 9 + LPC_PRECISION * o
        _put(bits, pos, np.full(len(sel), po), 6)
        pos = pos + 6
        r = residuals[b][sel]
        u = (r << 1) ^ (r >> 63)
        k = np.repeat(ks[b][sel], plen, axis=1)
        width = (u >> k) + 1 + k
        width[:, :o] = 0
        width[:, ::plen] += 4  # the parameter stands before the partition's first code
        start = pos[:, None] + np.cumsum(width, axis=1) - width
        _put(bits, start[:, ::plen], ks[b][sel], 4)
        start[:, ::plen] += 4
        live = np.ones(n, bool)
        live[:o] = False
        start, u, k = start[:, live], u[:, live], k[:, live]
        stop = start + (u >> k)
        bits[stop] = 1
        for j in range(int(k.max(initial=0))):
            m = k > j
            bits[stop[m] + 1 + j] = u[m] >> (k[m] - 1 - j) & 1
    return np.packbits(bits), bytes_of


def encode_many(payload: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A FLAC stream for each range of ``payload`` (bytes; 128 is silence). No range is empty."""
    n = np.diff(at)
    frames = (n + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(n)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = at[owner] + number * BLOCK
    size = np.minimum(at[owner + 1] - start, BLOCK)
    bodies: list[np.ndarray] = []
    where, length = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    done = 0
    for s in np.unique(size).tolist():
        sel = np.flatnonzero(size == s)
        x = payload[start[sel][:, None] + np.arange(s)].astype(np.int64) - 128
        data, took = _encode_group(x)
        where[sel], length[sel] = done + np.cumsum(took) - took, took
        done += len(data)
        bodies.append(data)
    body = np.concatenate(bodies) if bodies else np.zeros(0, np.uint8)
    heads, head_len = _frame_heads(number, size)
    total = head_len + length + 2
    first = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)

    def copy(src: np.ndarray, frm: np.ndarray, to: np.ndarray, count: np.ndarray) -> None:
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(to, count) + step] = src[np.repeat(frm, count) + step]

    copy(heads, np.cumsum(head_len) - head_len, first, head_len)
    copy(body, where, first + head_len, length)
    crc = checksums(out, first, first + total - 2, 16)
    out[first + total - 2], out[first + total - 1] = crc >> 8, crc & 255
    streams = []
    raw = out.tobytes()
    f0 = np.cumsum(frames) - frames
    for i in range(len(n)):
        a, b = int(f0[i]), int(f0[i] + frames[i])
        samples = int(n[i])
        md5 = hashlib.md5((payload[at[i] : at[i + 1]] ^ 0x80).tobytes()).digest()
        block = BLOCK if samples >= BLOCK else samples
        info = struct.pack(">HH", block, block) + int(total[a:b].min()).to_bytes(3, "big") + int(total[a:b].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + md5
        begin = int(first[a])
        points = np.zeros(b - a, dtype=[("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
        points["s"], points["o"], points["n"] = number[a:b] * BLOCK, first[a:b] - begin, size[a:b]
        seek = points.tobytes()
        end = int(first[b - 1] + total[b - 1])
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[begin:end])
    return streams


class FlacError(ValueError):
    """A stream that is damaged or beyond mono 8-bit."""


class _Bits:
    """Big-endian bit windows at any position of a buffer."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(16, np.uint8)])
        w = np.zeros(len(d) - 8, np.uint64)
        for j in range(8):
            w = w << np.uint64(8) | d[j : j + len(w)].astype(np.uint64)
        self.w = w

    def window(self, pos: np.ndarray) -> np.ndarray:
        return self.w[pos >> 3] << (pos & 7).astype(np.uint64)  # 57 good bits at least

    def take(self, pos: np.ndarray, width: int) -> np.ndarray:
        return (self.window(pos) >> np.uint64(64 - width)).astype(np.int64)

    def signed(self, pos: np.ndarray, width: int) -> np.ndarray:
        v = self.take(pos, width)
        return v - ((v >> (width - 1)) << width)


def _decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames by largest block), block sizes and ends of the frames that begin at ``start``."""
    bits = _Bits(data)
    n_f = len(start)
    pos = start * 8
    if (bits.take(pos, 15) != 0x7FFC).any():
        raise FlacError("no frame where one should begin")
    size_code, rate_code = bits.take(pos + 16, 4), bits.take(pos + 20, 4)
    if (bits.take(pos + 24, 8) & 0xFE != 2).any():
        raise FlacError("only mono streams of 8-bit samples")
    pos = pos + 32
    lead = bits.take(pos, 8)
    more = np.zeros(n_f, np.int64)
    for ones in range(2, 8):
        more = np.where(lead >> (8 - ones) == (1 << ones) - 1, ones - 1, more)
    pos = pos + 8 * (1 + more)
    block = np.where(size_code == 1, 192, np.where(size_code < 6, 576 << np.clip(size_code - 2, 0, 3), 256 << np.clip(size_code - 8, 0, 7)))
    block = np.where(size_code == 6, bits.take(pos, 8) + 1, np.where(size_code == 7, bits.take(pos, 16) + 1, block))
    pos = pos + np.where(size_code == 6, 8, np.where(size_code == 7, 16, 0)) + np.where(rate_code == 12, 8, np.where(rate_code > 12, 16, 0))
    if (checksums(data, start, pos // 8, 8) != bits.take(pos, 8)).any():
        raise FlacError("a frame header's checksum is wrong")
    pos = pos + 8
    kind = bits.take(pos, 8) >> 1
    pos = pos + 8
    width = int(block.max(initial=1))
    x = np.zeros((n_f, width), np.int64)
    constant, verbatim = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise FlacError("a reserved kind of subframe")
    x[constant] = bits.signed(pos[constant], 8)[:, None]
    pos = pos + np.where(constant, 8, 0)
    for i in np.flatnonzero(verbatim).tolist():
        x[i, : block[i]] = bits.signed(pos[i] + 8 * np.arange(block[i]), 8)
        pos[i] += 8 * block[i]
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    for j in range(int(order.max(initial=0))):
        m = order > j
        x[m, j] = bits.signed(pos[m], 8)
        pos = pos + np.where(m, 8, 0)
    shift = np.zeros(n_f, np.int64)
    coef = np.zeros((n_f, int(order[lpc].max(initial=0))), np.int64)
    if lpc.any():
        precision = np.where(lpc, bits.take(pos, 4) + 1, 0)
        shift = np.where(lpc, bits.signed(pos + 4, 5), 0)
        pos = pos + np.where(lpc, 9, 0)
        for j in range(coef.shape[1]):
            m = lpc & (order > j)
            for p in np.unique(precision[m]).tolist():
                mm = m & (precision == p)
                coef[mm, j] = bits.signed(pos[mm], p)
            pos = pos + np.where(m, precision, 0)
    live = np.flatnonzero(fixed | lpc)
    if len(live):
        pos[live] = _residuals(bits, pos[live], block[live], order[live], x, live)
        _restore(x, live, block, order, fixed, coef, shift)
    stop = (pos + 7) // 8
    if end is not None and (stop + 2 != end).any():
        raise FlacError("a frame ends elsewhere than its seek point says")
    if (checksums(data, start, stop, 16) != bits.take(stop * 8, 16)).any():
        raise FlacError("a frame's checksum is wrong")
    return x, block, stop + 2


def _residuals(bits: _Bits, pos: np.ndarray, block: np.ndarray, order: np.ndarray, x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Rice residuals of all frames, one sample of each at a time, into ``x``; returns the positions behind them."""
    method, po = bits.take(pos, 2), bits.take(pos + 2, 4)
    if (method > 1).any():
        raise FlacError("a reserved residual coding")
    pos = pos + 6
    plen = block >> po
    pbits = 4 + method
    k, raw = np.zeros(len(pos), np.int64), np.full(len(pos), -1)
    step = int(np.gcd.reduce(plen))
    idx = np.arange(len(pos))
    order_min, order_max, block_min = int(order.min()), int(order.max()), int(block.min())
    for t in range(int(block.max())):
        if t % step == 0:
            m = (t % plen == 0) & (t < block)
            if m.any():
                b = pbits[m]
                v = bits.take(pos[m], 5) >> (5 - b)
                esc = v == (1 << b) - 1
                pos[m] += b
                k[m] = v
                raw[m] = np.where(esc, bits.take(pos[m], 5), -1)
                pos[m] += np.where(esc, 5, 0)
        if order_max <= t < block_min:
            a, p, kk, rr = live, pos, k, raw
            m = None
        else:
            m = idx[(t >= order) & (t < block)]
            if not len(m):
                continue
            a, p, kk, rr = live[m], pos[m], k[m], raw[m]
        w = bits.window(p)
        top = (w >> np.uint64(11)).astype(np.float64)
        q = 53 - np.frexp(top)[1].astype(np.int64)
        slow = q + 1 + kk > 56
        if slow.any():
            for i in np.flatnonzero(slow & (rr < 0)).tolist():
                c = int(p[i])
                while not int(bits.take(np.array([c]), 1)[0]):
                    c += 1
                q[i] = c - p[i]
            at = p + np.minimum(q, 1 << 40) + 1
            low = np.where(kk > 0, bits.window(np.where(rr < 0, at, p)) >> (64 - np.maximum(kk, 1)).astype(np.uint64), np.uint64(0))
        else:
            low = w << (q + 1).astype(np.uint64) >> np.uint64(1) >> (63 - kk).astype(np.uint64)
        u = q << kk | low.astype(np.int64)
        value = (u >> 1) ^ -(u & 1)
        took = q + 1 + kk
        if (rr >= 0).any():
            e = np.flatnonzero(rr >= 0)
            for b in np.unique(rr[e]).tolist():
                s = e[rr[e] == b]
                value[s] = bits.signed(p[s], b) if b else 0
            took[e] = rr[e]
        x[a, t] = value
        if m is None:
            pos = p + took
        else:
            pos[m] = p + took
    return pos


def _restore(x: np.ndarray, live: np.ndarray, block: np.ndarray, order: np.ndarray, fixed: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> None:
    """Samples from residuals: differences are summed up again; linear predictors run over all frames together."""
    for o in range(1, 5):
        f = live[fixed[live] & (order[live] == o)]
        if not len(f):
            continue
        y = x[f]
        warm = y[:, :o].copy()
        for d in range(o, 0, -1):
            head = np.diff(warm, n=d - 1, axis=1)[:, -1:]  # the (d-1)th difference where the residuals begin
            y[:, o:] = np.cumsum(np.concatenate([head, y[:, o:]], axis=1), axis=1)[:, 1:]
        x[f] = y
    f = live[~fixed[live]]
    for o in np.unique(order[f]).tolist():
        g = f[order[f] == o]
        y = x[g].T.copy()
        c, s = coef[g, :o].T.copy(), shift[g]
        for t in range(o, y.shape[0]):
            y[t] += (c * y[t - o : t][::-1]).sum(axis=0) >> s
        x[g] = y.T
    for i in live[block[live] < x.shape[1]].tolist():
        x[i, block[i] :] = 0


def _layout(stream: bytes) -> tuple[int, bytes, int, list[tuple[int, int, int]]]:
    """Total samples, MD5, where the frames begin, and the seek points."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, samples, md5, points, last = 4, 0, b"", [], False
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise FlacError("only mono streams of 8-bit samples")
            samples, md5 = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + n
    return samples, md5, at, points


def decode_many(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bytes and block offsets (in samples) of each stream.

    Streams with a seek point per frame are decoded together; others frame by frame.
    """
    out: list = [None] * len(streams)
    layouts = [_layout(s) for s in streams]
    starts, ends, owner, chunks, base = [], [], [], [], 0
    for i, (s, (samples, _, at, points)) in enumerate(zip(streams, layouts, strict=True)):
        whole = points and points[0][1] == 0 and sum(p[2] for p in points) == samples
        if whole:
            a = [at + p[1] for p in points]
            starts += [base + v for v in a]
            ends += [base + v for v in [*a[1:], len(s)]]
            owner += [i] * len(a)
            chunks.append(s)
            base += len(s)
        else:
            data, parts, pos = np.frombuffer(s, np.uint8), [], at
            while pos < len(s) and sum(map(len, parts)) < samples:
                x, block, stop = _decode_frames(data, np.array([pos]), None)
                parts.append(x[0, : block[0]])
                pos = int(stop[0])
            out[i] = (np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum([0, *map(len, parts)])[:-1])
    if starts:
        x, block, _ = _decode_frames(np.frombuffer(b"".join(chunks), np.uint8), np.array(starts, np.int64), np.array(ends, np.int64))
        own = np.array(owner)
        flat = x[np.arange(x.shape[1])[None, :] < block[:, None]]
        edge = np.r_[0, np.cumsum(block)]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
            out[owner[a]] = (flat[edge[a] : edge[b]], edge[a:b] - edge[a])
    done = []
    for (x, offsets), (samples, md5, _, _) in zip(out, layouts, strict=True):
        pcm = (x + 128).astype(np.uint8)
        if len(pcm) != samples or hashlib.md5((pcm ^ 0x80).tobytes()).digest() != md5:
            raise FlacError("the samples differ from the stream's MD5")
        done.append((pcm, offsets))
    return done


def padded(raw: np.ndarray, at: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Each range with zero bytes behind it up to a positive multiple of ``unit``."""
    n = np.diff(at)
    full = np.maximum(unit, (n + unit - 1) // unit * unit)
    to = np.r_[0, np.cumsum(full)]
    out = np.zeros(int(to[-1]), np.uint8)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to[:-1], n) + step] = raw
    return out, to


def encode_text(docs: DataFrame, column: str = "text", max_bytes: int = 1_000_000) -> DataFrame:
    """Adds ``n_bytes`` and ``media``: the whole text's UTF-8 bytes, padded with zeros to a multiple of 64, as FLAC.

    Null and empty texts become 64 zero bytes. The stream depends on the text alone. Other columns are kept, but for
    those of the two names and ``column``.
    """
    keep = [c for c in docs.columns if c not in (column, "n_bytes", "media")]
    base = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)), F.col(f"`{column}`").alias("text"))
    schema = with_fields(docs.select(*(F.col(f"`{c}`") for c in keep)), "n_bytes long, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), max_bytes):
                raw, at = flat_bytes(part.column(len(keep)))
                media = encode_many(*padded(raw, at))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(at)), pa.array(media, pa.binary())], schema.names)

    return base.mapInArrow(run, schema)


def features(pcm: np.ndarray, offsets: np.ndarray) -> str:
    """Blocks, mean, energy and sign changes of a decoded stream."""
    x = pcm.astype(np.int64) - 128
    return f"blocks={len(offsets)};mean={x.sum() / len(x):.4f};energy={(x * x).sum() / len(x):.4f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}" if len(x) else "blocks=0"


def _decoded(table: DataFrame, make, added: str, max_bytes: int) -> DataFrame:
    schema = with_fields(table, added)
    at, n_own = table.columns.index("media"), len(table.columns)
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields[n_own:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, max_bytes):
                media = part.column(at).to_pylist()
                some = [i for i, m in enumerate(media) if m is not None]
                got = dict(zip(some, decode_many([media[i] for i in some]), strict=True))
                rows = [make(media[i], *got[i]) if i in got else (None,) * len(types) for i in range(len(media))]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names)

    return table.mapInArrow(run, schema)


def decode_media(table: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """Adds ``pcm`` (unsigned 8-bit samples) and ``block_offsets`` (first sample of each block) to ``media`` streams.

    Null media give nulls. A damaged stream fails the query: its checksums don't hold.
    """
    return _decoded(table, lambda media, pcm, offsets: (pcm.tobytes(), offsets.tolist()), "pcm binary, block_offsets array<long>", max_bytes)


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """A row per block of ``decode_media``: ``sample_offset``, ``samples`` and the block's ``pcm``; other columns are kept."""
    keep = [c for c in decoded.columns if c not in ("pcm", "block_offsets", "media")]
    ends = F.concat(F.slice("block_offsets", F.lit(2), F.greatest(F.size("block_offsets") - 1, F.lit(0))), F.array(F.length("pcm").cast("long")))
    rows = decoded.select(*(F.col(f"`{c}`") for c in keep), "pcm", F.explode(F.arrays_zip(F.col("block_offsets").alias("a"), ends.alias("b"))).alias("s"))
    n = F.col("s.b") - F.col("s.a")
    return rows.select(*(F.col(f"`{c}`") for c in keep), F.col("s.a").alias("sample_offset"), n.alias("samples"), F.substring(F.col("pcm"), (F.col("s.a") + 1).cast("int"), n.cast("int")).alias("block_pcm"))


def media_digests(table: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """Adds digests and features of what ``media`` decodes to, without bringing the samples back to the JVM."""

    def make(media: bytes, pcm: np.ndarray, offsets: np.ndarray) -> tuple:
        raw = pcm.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(pcm, offsets)

    return _decoded(table, make, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", max_bytes)
