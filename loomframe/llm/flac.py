"""FLAC media columns: encode and decode, checksums verified, PCM in seekable blocks.

The decoder finds frames by their sync code, accepts a header only if its CRC-8 holds
and a frame only if its CRC-16 does, decodes Rice residuals of many frames in step, runs the
linear predictors, and checks the sample count and MD5 of the stream header.
It reads constant, verbatim, fixed and LPC subframes, partitioned and escaped
residuals, wasted bits and the stereo modes; damage raises ValueError.  The encoder
writes mono 8-bit frames with fixed predictors up to the order asked for (4 at most), or LPC, and one seek point
per frame.  `read_blocks` gives the PCM blocks with their sample offsets; `read_ranges` goes by the seek table and decodes
only the frames that hold the asked samples.

Defined cases: null bytes count as empty; an empty payload is a stream without
frames; equal payloads give equal streams whatever batch they stand in.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1024
PIECE = 1 << 19
#: Rows that a worker encodes or decodes at a time.
ROWS = 128
RATE = 8000


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), np.array(_crc_table(0x8005, 16), np.uint16)
_far: list[np.ndarray] = [np.zeros((0, 256), np.uint16)]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def _crc16_far(n: int) -> np.ndarray:
    """What a byte adds to the CRC-16 if d bytes follow it: [d, byte]."""
    t = _far[0]
    if len(t) < n:
        rows = list(t) or [_CRC16]
        while len(rows) < n:
            p = rows[-1]
            rows.append((p << np.uint16(8)) ^ _CRC16[p >> np.uint16(8)])
        t = _far[0] = np.array(rows)
    return t


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[starts[i]:ends[i]] for spans that are in order and do not overlap."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint16)
    t = _crc16_far(int(size.max()))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    part = t[size[row] - 1 - at, data[starts[row] + at]]
    return np.bitwise_xor.reduceat(part, np.cumsum(size) - size)


def _utf8(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(~(2 * room + 1) & 0xFF) | n, *reversed(tail)])


def _levinson(x: np.ndarray, order: int) -> tuple[list[int], int]:
    """Quantised LPC coefficients (12 bits) and their shift."""
    r = [float(np.dot(x[: len(x) - i], x[i:])) for i in range(order + 1)]
    a, e = np.zeros(order), r[0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (r[i + 1] - np.dot(a[:i], r[i:0:-1])) / e
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        e *= 1 - k * k
    top = max(float(np.abs(a).max()), 1e-9)
    shift = int(np.clip(np.floor(np.log2(2047 / top)), 0, 14))
    return [int(v) for v in np.clip(np.round(a * 2**shift), -2048, 2047)], shift


def encode(payloads: list[bytes], block: int = BLOCK, lpc: int = 0, orders: int = 2) -> list[bytes]:
    """A mono 8-bit stream for every payload; byte b is sample b - 128."""
    out: list[bytes] = []
    at = 0
    while at < len(payloads):  # about PIECE bytes at a time
        to, size = at, 0
        while to < len(payloads) and (to == at or size + len(payloads[to]) <= PIECE):
            size += len(payloads[to])
            to += 1
        out += _encode_piece(payloads[at:to], block, lpc, orders)
        at = to
    return out


def _encode_piece(payloads: list[bytes], block: int, lpc: int, orders: int) -> list[bytes]:
    size = np.array([len(p) for p in payloads], np.int64)
    per = -(-size // block)
    doc = np.repeat(np.arange(len(size)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    frames: list[bytes] = []
    count = np.minimum(block, size[doc] - number * block)
    start = (np.cumsum(size) - size)[doc] + number * block
    for a in range(0, len(doc), 1024):
        frames += _encode_frames(raw, start[a : a + 1024], count[a : a + 1024], number[a : a + 1024], block, lpc, orders)
    streams, f = [], 0
    for p, n in zip(payloads, per):
        mine = frames[f : f + n]
        f += n
        lens = [len(x) for x in mine]
        # 16 is the least block size a header may name; the last block may be shorter
        info = struct.pack(">HH", block, block) + min(lens, default=0).to_bytes(3, "big") + max(lens, default=0).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        offset, points = 0, []
        for k, x in enumerate(mine):
            points.append(struct.pack(">QQH", k * block, offset, min(block, len(p) - k * block)))
            offset += len(x)
        seek = b"".join(points)
        streams.append(b"fLaC" + (b"\0" if seek else b"\x80") + len(info).to_bytes(3, "big") + info + (b"\x83" + len(seek).to_bytes(3, "big") + seek if seek else b"") + b"".join(mine))
    return streams


def _encode_frames(raw: np.ndarray, start: np.ndarray, count: np.ndarray, number: np.ndarray, block: int, lpc: int, orders: int) -> list[bytes]:
    col = np.arange(block)
    valid = col < count[:, None]
    x = np.where(valid, raw[np.minimum(start[:, None] + col, len(raw) - 1)].astype(np.int32) - 128, 0)
    n_frames = len(count)
    order, best, code = np.zeros(n_frames, np.int64), np.full(n_frames, 1 << 60), np.zeros_like(x)
    r = x
    for o in range(orders + 1):  # fixed predictors: repeated differences
        u = (r << 1) ^ (r >> 31)
        u *= valid
        u[:, :o] = 0
        total = u.sum(1, dtype=np.int64)
        take = (total < best) & (count > o)
        order[take], best[take], code[take] = o, total[take], u[take]
        d = np.zeros_like(r)
        d[:, 1:] = r[:, 1:] - r[:, :-1]
        r = d
    plans: dict[int, tuple[list[int], int]] = {}
    if lpc:
        for i in np.flatnonzero(count > lpc):
            s = x[i, : count[i]].astype(np.int64)
            coef, shift = _levinson(s.astype(float), lpc)
            guess = sum(c * s[lpc - 1 - j : count[i] - 1 - j] for j, c in enumerate(coef)) >> shift
            e = s[lpc:] - guess
            u = (e << 1) ^ (e >> 63)
            plans[i] = (coef, shift)
            order[i], best[i] = lpc, int(u.sum())
            code[i] = 0
            code[i, lpc : count[i]] = u
    left = count - order
    k0 = np.clip(np.floor(np.log2(np.maximum(best / np.maximum(left, 1) * 0.7, 1))).astype(np.int64), 0, 14)
    k, bits = k0, np.full(n_frames, 1 << 60)
    for step in (-1, 0, 1):
        kk = np.clip(k0 + step, 0, 14)
        b = left * (kk + 1) + (code >> kk[:, None].astype(np.int32)).sum(1, dtype=np.int64)
        k, bits = np.where(b < bits, kk, k), np.minimum(bits, b)
    constant = ((x == x[:, :1]) | ~valid).all(1)
    verbatim = ~constant & (bits + 10 + 8 * order >= 8 * count)
    rice = ~constant & ~verbatim
    # the residual part of each Rice frame, in whole 32-bit words
    extra = np.zeros(n_frames, np.int64)  # LPC: precision, shift and coefficients stand before it
    extra[list(plans)] = 9 + 12 * lpc
    width = np.where(rice, bits + 10 + extra, 0)
    words = -(-width // 32)
    base = np.cumsum(words) - words
    out = np.zeros(int(words.sum()) + 2, np.int64)
    on = valid & (col >= order[:, None]) & rice[:, None]
    flat = np.flatnonzero(on)
    row = flat // block
    u, kf = code.reshape(-1)[flat].astype(np.int64), k[row]
    ln = (u >> kf) + 1 + kf
    upto = np.cumsum(ln)
    per = np.searchsorted(row, np.arange(n_frames))
    before = np.concatenate([[0], upto])[per]
    upto += (base * 32 + extra + 10 - before)[row]  # where each code ends
    fields = [(u & ((1 << kf) - 1) | (1 << kf), upto - kf - 1, kf + 1)]
    fields.append((k[rice], base[rice] * 32 + extra[rice] + 6, np.full(int(rice.sum()), 4)))
    for i, (coef, shift) in plans.items():
        if rice[i]:
            at = base[i] * 32 + np.array([0, 4] + [9 + 12 * j for j in range(lpc)])
            fields.append((np.array([11, shift] + [c & 0xFFF for c in coef]), at, np.array([4, 5] + [12] * lpc)))
    for value, at, size in fields:  # each field lies in two words at most
        if not len(value):
            continue
        w = at >> 5
        value = value << (63 - (at & 31) - size)  # the top bit stays clear: 63 bits, words of 32 and 31
        starts = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])
        out[w[starts]] += np.add.reduceat(value >> 31, starts)
        out[w[starts] + 1] += np.add.reduceat((value & ((1 << 31) - 1)) << 1, starts)
    packed = out.astype(">u4").tobytes()
    width = (width + 7) // 8
    frames = []
    for i in range(n_frames):
        n = int(count[i])
        head_bytes = b"\xff\xf8" + bytes([0x74, 0x02]) + _utf8(int(number[i])) + (n - 1).to_bytes(2, "big")
        samples = (raw[start[i] : start[i] + n] ^ 0x80).tobytes()
        if constant[i]:
            body = b"\0" + samples[:1]
        elif verbatim[i]:
            body = b"\x02" + samples
        else:
            o = int(order[i])
            kind = 0x20 + o - 1 if i in plans else 0x08 + o
            body = bytes([kind << 1]) + samples[:o] + packed[4 * base[i] : 4 * base[i] + width[i]]
        frames.append(head_bytes + bytes([crc8(head_bytes)]) + body)
    whole = np.frombuffer(b"".join(frames), np.uint8)
    ends = np.cumsum([len(f) for f in frames])
    sums = crc16_many(whole, np.concatenate([[0], ends[:-1]]), ends)
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, sums)]


_RATES = {12: 1, 13: 2, 14: 2}
_BLOCKS = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame_header(s: bytes, at: int):
    """(end, number, block size, channel code, depth code) of a valid header at `at`, else None."""
    if at + 6 > len(s) or s[at] != 0xFF or s[at + 1] & 0xFE != 0xF8 or s[at + 3] & 1:
        return None
    size_code, rate_code, channels, depth = s[at + 2] >> 4, s[at + 2] & 15, s[at + 3] >> 4, s[at + 3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or channels > 10 or depth == 3:
        return None
    p, lead = at + 4, s[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length() if lead < 0xFF else 99
    if more in (99,) or (lead >= 0x80 and more < 1):
        return None
    number = lead if not more else lead & ((1 << (6 - more)) - 1) if more < 6 else 0
    for b in s[p + 1 : p + 1 + more]:
        number = number << 6 | b & 0x3F
    p += 1 + more
    if size_code in (6, 7):
        n = int.from_bytes(s[p : p + size_code - 5], "big") + 1
        p += size_code - 5
    else:
        n = _BLOCKS[size_code]
    p += _RATES.get(rate_code, 0)
    if p >= len(s) or crc8(s[at:p]) != s[p]:
        return None
    return p + 1, number, n, channels, depth


def parse(stream: bytes):
    """(header dict, frames): a frame is (start, body start, end before its CRC, samples, channel code, depth)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, None
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + n]
        at += 4 + n
    if info is None or len(info) < 34:
        raise ValueError("no stream header")
    packed = int.from_bytes(info[10:18], "big")
    head = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": info[18:34]}
    data = np.frombuffer(stream, np.uint8)
    marks = np.flatnonzero((data[at:-1] == 0xFF) & (data[at + 1 :] & 0xFE == 0xF8)) + at
    heads = [(int(m), h) for m in marks if (h := _frame_header(stream, int(m))) is not None]
    frames, i = [], 0
    if heads and heads[0][0] != at or not heads and at < len(stream):
        raise ValueError("no frame where one is due")
    while i < len(heads):
        start, (body, _, n, channels, depth) = heads[i]
        j = i + 1
        while True:  # a sync code within a frame is told from a real one by the checksum
            end = heads[j][0] if j < len(heads) else len(stream)
            if j == i + 1:
                frames.append([start, body, end - 2, n, channels, _DEPTHS.get(depth, head["depth"])])
            else:
                frames[-1][2] = end - 2
            want = int.from_bytes(stream[end - 2 : end], "big")
            if _crc_ok(data, start, end - 2, want):
                break
            j += 1
            if j > len(heads):
                raise ValueError("frame checksum does not hold")
        i = j
    return head, frames


def _crc_ok(data: np.ndarray, start: int, end: int, want: int) -> bool:
    t = _crc16_far(end - start)
    n = end - start
    part = t[np.arange(n - 1, -1, -1), data[start:end]]
    return int(np.bitwise_xor.reduce(part)) == want


class _Bits:
    """A plain bit reader for the rarer kinds of frames."""

    def __init__(self, data: bytes):
        self.v, self.n, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > self.n:
            raise ValueError("frame ends early")
        return self.v >> (self.n - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
        return q


def _subframe(b: _Bits, n: int, depth: int) -> np.ndarray:
    b.take(1)
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [b.signed(depth)] * n
    elif kind == 1:
        out = [b.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(depth) for _ in range(order)]
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            coef = [b.signed(precision) for _ in range(order)]
        else:  # fixed predictors: 2x-y, 3x-3y+z and so on
            coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        wide, parts = 4 + b.take(2), 1 << b.take(4)
        if wide > 5:
            raise ValueError("unknown residual coding")
        for part in range(parts):
            k = b.take(wide)
            for _ in range(n // parts - (order if part == 0 else 0)):
                if part == 0 and _ == 0 or not _:
                    raw = b.take(5) if k == (1 << wide) - 1 else None
                if raw is not None:
                    r = b.signed(raw)
                else:
                    u = b.unary() << k | b.take(k)
                    r = u >> 1 ^ -(u & 1)
                out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise ValueError("reserved subframe")
    return np.array(out, np.int64) << wasted


def _frame(data: bytes, n: int, channels: int, depth: int) -> np.ndarray:
    """[channel, sample] of one frame, by the plain reader."""
    b = _Bits(data)
    if channels < 8:
        return np.array([_subframe(b, n, depth) for _ in range(channels + 1)])
    x = _subframe(b, n, depth + (channels == 9))
    y = _subframe(b, n, depth + (channels != 9))
    if channels == 8:  # left, difference
        return np.array([x, x - y])
    if channels == 9:  # difference, right
        return np.array([x + y, y])
    mid = x << 1 | y & 1
    return np.array([(mid + y) >> 1, (mid - y) >> 1])


def _in_step(data: np.ndarray, begin: np.ndarray, count: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Rice codes [sample, frame] from bit positions `begin`, all frames in step; count must not increase."""
    bits = np.unpackbits(data)
    big = np.int32(len(bits))
    following = np.where(bits == 1, np.arange(len(bits), dtype=np.int32), big)
    following = np.minimum.accumulate(following[::-1])[::-1]
    following = np.append(following, big)
    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
    window = (wide[:-3] << 16) | (wide[1:-2] << 8) | wide[2:-1]
    most = int(count[0]) if len(count) else 0
    out = np.zeros((most, len(count)), np.int32)
    at, shift0, mask = begin.astype(np.int32), (24 - k).astype(np.int32), ((1 << k) - 1).astype(np.int32)
    k = k.astype(np.int32)
    active = np.searchsorted(-count, -np.arange(most), side="left")  # frames with more than i codes
    for i in range(most):
        f = active[i]
        s = at[:f]
        stop = following[s]
        q = stop - s
        p = stop + 1
        low = (window[np.minimum(p >> 3, len(window) - 1)] >> (shift0[:f] - (p & 7))) & mask[:f]
        out[i, :f] = (q << k[:f]) | low
        at[:f] = np.minimum(p + k[:f], big)
    return out


def decode(streams: list[bytes]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(header, samples [channel, n], first sample of each block) of every stream, a piece at a time in memory."""
    at = 0
    while at < len(streams):
        to, size = at, 0
        while to < len(streams) and (to == at or size + len(streams[to]) <= PIECE):
            size += len(streams[to])
            to += 1
        yield from _decode_piece(streams[at:to])
        at = to


def _decode_piece(streams: list[bytes]):
    parsed = [parse(s) for s in streams]
    out = []
    for (head, frames), parts in zip(parsed, _decode_frames(streams, [f for _, f in parsed])):
        x = np.concatenate(parts, axis=1) if parts else np.zeros((head["channels"], 0), np.int64)
        if head["samples"] and x.shape[1] != head["samples"]:
            raise ValueError("wrong number of samples")
        if any(head["md5"]) and hashlib.md5(pcm(x, head["depth"])).digest() != head["md5"]:
            raise ValueError("MD5 does not hold")
        out.append((head, x, np.cumsum([0] + [f[3] for f in frames])[:-1] if frames else np.zeros(0, np.int64)))
    return out


def _decode_frames(streams: list[bytes], of: list[list]) -> list[list[np.ndarray]]:
    """Samples [channel, n] of the given frames of every stream."""
    shift = np.cumsum([0] + [len(s) for s in streams])
    made: list[list[np.ndarray | None]] = [[None] * len(f) for f in of]
    quick = []  # (stream, frame, body bit, samples, order, k, warm-up, coefficients, shift)
    for i, (frames, s) in enumerate(zip(of, streams)):
        for j, (_, body, end, n, channels, depth) in enumerate(frames):
            kind = s[body]
            if channels == 0 and depth == 8 and not kind & 1:
                t, p = kind >> 1, body + 1
                if t == 0:
                    made[i][j] = np.full((1, n), (s[p] ^ 0x80) - 128)
                    continue
                if t == 1:
                    made[i][j] = (np.frombuffer(s, np.uint8, n, p) ^ 0x80).astype(np.int64)[None] - 128
                    continue
                if 8 <= t <= 12 or t >= 32:
                    order = t - 8 if t < 32 else t - 31
                    warm = [(b ^ 0x80) - 128 for b in s[p : p + order]]
                    bit, coef, sh = 8 * (p + order), None, 0
                    if t >= 32:
                        b = _Bits(s[p + order : end])
                        precision, sh = b.take(4) + 1, b.signed(5)
                        coef = [b.signed(precision) for _ in range(order)]
                        bit += b.at
                    word = int.from_bytes(s[bit >> 3 : (bit >> 3) + 3], "big") >> (14 - (bit & 7)) & 0x3FF
                    if word >> 4 == 0 and word & 15 != 15:  # 4-bit parameters, one partition, not escaped
                        quick.append((i, j, 8 * int(shift[i]) + bit + 10, n, order, word & 15, warm, coef, sh, int(shift[i]) + end))
                        continue
            made[i][j] = _frame(s[body:end], n, channels, depth)
    # frames lie in order; so many at a time that their bits, unpacked, stay small however long a stream is
    at, whole = 0, b"".join(streams) if quick else b""
    while at < len(quick):
        to, low = at, quick[at][2] >> 3
        while to < len(quick) and (to == at or quick[to][9] - low <= PIECE):
            to += 1
        _undo(whole, quick[at:to], low, made)
        at = to
    return made


def _undo(whole: bytes, quick: list[tuple], low: int, made: list[list]) -> None:
    """Decodes the frames and runs their predictors; bytes before `low` are not theirs."""
    high = max(q[9] for q in quick)
    quick = sorted(quick, key=lambda q: q[4] - q[3])
    count = np.array([q[3] - q[4] for q in quick])
    u = _in_step(np.frombuffer(whole, np.uint8, high - low, low), np.array([q[2] - 8 * low for q in quick]), count, np.array([q[5] for q in quick]))
    r = (u >> 1) ^ -(u & 1)
    orders = np.array([q[4] if q[7] is None else -1 for q in quick])
    for o in range(5):
        at = np.flatnonzero(orders == o)
        if len(at):
            x = r[:, at].astype(np.int64)
            warm = np.array([quick[k][6] for k in at], np.int64).reshape(len(at), o)
            for level in range(o - 1, -1, -1):  # undo one difference after the other
                x = np.cumsum(x, axis=0) + np.diff(warm, n=level, axis=1)[:, -1]
            for c, k in enumerate(at):
                i, j, _, n = quick[k][:4]
                made[i][j] = np.concatenate([warm[c], x[: n - o, c]])[None].astype(np.int32)
    for k in np.flatnonzero(orders < 0):
        i, j, _, n, order, _, warm, coef, sh, _ = quick[k]
        x = list(warm)
        for e in r[: n - order, k].tolist():
            x.append(e + (sum(c * x[-1 - m] for m, c in enumerate(coef)) >> sh))
        made[i][j] = np.array(x)[None]


def seek_table(stream: bytes) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(samples, first frame's byte, [(first sample, byte after the first frame's, samples)]) of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, points = 4, False, 0, []
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            samples = int.from_bytes(stream[at + 14 : at + 22], "big") & (1 << 36) - 1
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", stream[at + 4 : at + 4 + n]) if p[0] != (1 << 64) - 1]
        at += 4 + n
    return samples, at, points


def read_ranges(streams: list[bytes], first: list[int], last: list[int]) -> list[np.ndarray]:
    """Samples [channel, first:last] of every stream, from the frames that the seek table names and no others.

    A negative `first` counts from the end.  Every frame's checksum is verified; streams need a seek point per frame.
    """
    frames, spans = [], []
    for s, a, b in zip(streams, first, last):
        total, base, points = seek_table(s)
        a, b = max(0, a + total if a < 0 else a), min(b, total)
        mine, skip = [], 0
        for k, (sample, offset, n) in enumerate(points):
            if sample < b and sample + n > a:
                start, end = base + offset, base + points[k + 1][1] if k + 1 < len(points) else len(s)
                head = _frame_header(s, start)
                if head is None or head[2] != n or not _crc_ok(np.frombuffer(s, np.uint8), start, end - 2, int.from_bytes(s[end - 2 : end], "big")):
                    raise ValueError("no sound frame where the seek table points")
                mine.append([start, head[0], end - 2, n, head[3], _DEPTHS.get(head[4], 8)])
                skip = skip if len(mine) > 1 else a - sample
        if sum(f[3] for f in mine) < b - a:
            raise ValueError("the seek table does not cover the samples")
        frames.append(mine)
        spans.append((skip, max(0, b - a)))
    made = _decode_frames(streams, frames)
    return [np.concatenate(parts, axis=1)[:, k : k + n] if parts else np.zeros((1, 0), np.int64) for parts, (k, n) in zip(made, spans)]


def pcm(x: np.ndarray, depth: int) -> bytes:
    """Interleaved signed little-endian samples."""
    width = -(-depth // 8)
    flat = np.ascontiguousarray(x.T).reshape(-1)
    if width == 1:
        return flat.astype(np.int8).tobytes()
    return flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the FLAC stream of every text, null as empty.

    The payload is the UTF-8 text and zero bytes up to the next positive multiple of 64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                media = encode([t + bytes(-len(t) % 64 or 64 * (not t)) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, block, first_sample, n_samples, pcm: the decoded blocks of every stream, addressable by sample."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                ids, rows = batch.column(key).to_pylist(), []
                for i, (head, x, first) in zip(ids, decode([s or b"" for s in batch.column(column).to_pylist()])):
                    ends = [*first[1:], x.shape[1]]
                    rows += [(i, b, int(s), int(e - s), pcm(x[:, s:e], head["depth"])) for b, (s, e) in enumerate(zip(first, ends))]
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = [batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "block", "first_sample", "n_samples", "pcm"])

    return media.select(key, column).mapInArrow(run, f"{key} {kind}, block int, first_sample long, n_samples int, pcm binary")


def features(x: np.ndarray) -> str:
    """Peak, energy and zero crossings of 8-bit samples."""
    s = x.astype(np.int32)
    sign = s < 0
    return f"peak={int(np.abs(s).max(initial=0))};energy={int(np.dot(s.astype(np.int64), s))};crossings={int((sign[1:] != sign[:-1]).sum())}"


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text and reads the stored bytes back, whole and, for the tail, by the seek table."""
    media = store_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                stored = batch.column("media").to_pylist()
                rows = []
                tails = read_ranges(stored, [-64] * len(stored), [1 << 40] * len(stored))
                for s, tail, (_, x, first) in zip(stored, tails, decode(stored)):
                    back = (x[0] + 128).astype(np.uint8).tobytes()
                    end = (tail[0] + 128).astype(np.uint8).tobytes()
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(end), len(s), hashlib.sha256(s).hexdigest(), features(x[0]), first.tolist()))
                cols = list(zip(*rows)) if rows else [[]] * 7
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "block_starts"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "n_bytes", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, block_starts array<long>")
