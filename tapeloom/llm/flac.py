"""FLAC: lossless 8-bit mono media columns, written and read in blocks, many frames at a time.

Frames of one width are handled together: a step of the decoder reads one sample of every frame,
so Python's cost is shared by thousands of frames. Only what a task holds of one Arrow batch is in
memory, cut into groups of GROUP frames.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, trimmed

BLOCK = 1024
GROUP = 1536
RATE = 8000
LPC_ORDER, LPC_BITS = 4, 12


def _crc_table(width: int, poly: int) -> np.ndarray:
    """The table of a most-significant-bit-first CRC, from its polynomial."""
    c = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        c = np.where(c >> (width - 1) & 1, c << 1 ^ poly, c << 1) & (2**width - 1)
    return c.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16_rows(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of the first length[i] bytes of each row, column by column for all rows."""
    order = np.argsort(-length, kind="stable")
    columns = np.ascontiguousarray(data[order].T).astype(np.uint32)
    live = np.searchsorted(-length[order], -np.arange(1, len(columns) + 1), side="right")
    c = np.zeros(len(data), np.uint32)
    for col, n in zip(columns, live, strict=True):
        if not n:
            break
        c[:n] = (c[:n] << 8 & 0xFFFF) ^ _CRC16[c[:n] >> 8 ^ col[:n]]
    out = np.zeros_like(c)
    out[order] = c
    return out


def utf8_number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >> (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size) & 0xFF) | n, *reversed(tail)])


def frame_header(number: int, samples: int) -> bytes:
    """Header of a mono 8-bit frame of fixed-size blocks; the size is written out unless it is BLOCK."""
    coded, extra = (0b1010, b"") if samples == 1024 else (0b0110, bytes([samples - 1])) if samples <= 256 else (0b0111, struct.pack(">H", samples - 1))
    head = bytes([0xFF, 0xF8, coded << 4, 0x02]) + utf8_number(number) + extra
    return head + bytes([crc8(head)])


def fixed_residual(x: np.ndarray, order: int) -> np.ndarray:
    """Residual of the fixed predictor (repeated differences), without the warm-up samples."""
    return np.diff(x, n=order, axis=1) if order else x


def lpc_coefficients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of LPC_ORDER for each row, and their shifts, by Levinson recursion."""
    n, order = x.shape[1], LPC_ORDER
    y = x * np.hanning(n + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, : n - k], y[:, k:]) for k in range(order + 1)], axis=1).astype(np.float64)
    a, err = np.zeros((len(x), order)), np.maximum(r[:, 0], 1e-9) * (1 + 1e-9)
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.abs(a).max(axis=1)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(np.maximum(top, 1e-6))), 0, 15).astype(np.int32)
    limit = 2 ** (LPC_BITS - 1)
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -limit, limit - 1).astype(np.int32), shift


def lpc_residual(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    n, order = x.shape[1], coef.shape[1]
    predicted = sum(coef[:, j, None] * x[:, order - 1 - j : n - 1 - j] for j in range(order))
    return x[:, order:] - (predicted >> shift[:, None])


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residual, and for each row the better of two Rice parameters near its mean, with its bits."""
    u = (residual << 1) ^ (residual >> 31)
    n = u.shape[1]
    mean = u.sum(axis=1, dtype=np.int64) / n
    guess = np.clip(np.floor(np.log2(np.maximum(mean * np.log(2), 1))).astype(np.int32), 0, 13)
    cost = np.stack([(u >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (k + 1) for k in (guess, guess + 1)], axis=1)
    return u, guess + cost.argmin(axis=1).astype(np.int32), cost.min(axis=1)


def _bits(value: np.ndarray | int, width: int) -> np.ndarray:
    return (np.asarray(value, np.int64)[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def encode_subframes(x: np.ndarray, lpc: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of equal sample counts: (bits as 0/1 in rows, number of bits of each row).

    The cheapest of: constant, verbatim, fixed predictors of order 0 to 2, a linear predictor;
    residuals are Rice-coded in one partition.
    """
    rows, n = x.shape
    choices = []
    if n > 8:
        for order in range(3):
            choices.append((order, *_rice(fixed_residual(x, order))))
    costs = [8 + 8 * o + 10 + bits for o, _, _, bits in choices]
    coef = shift = None
    if lpc and n > 64:
        coef, shift = lpc_coefficients(x)
        choices.append((LPC_ORDER, *_rice(lpc_residual(x, coef, shift))))
        costs.append(8 + 8 * LPC_ORDER + 9 + LPC_BITS * LPC_ORDER + 10 + choices[-1][3])
    costs.append(np.full(rows, 8 + 8 * n))
    costs.append(np.where((x == x[:, :1]).all(axis=1), 16, 1 << 40))
    best = np.stack(costs, axis=1).argmin(axis=1)
    total = np.stack(costs, axis=1).min(axis=1)
    out = np.zeros((rows, int(total.max())), np.uint8)
    for c in np.unique(best):
        own = np.flatnonzero(best == c)
        if c == len(costs) - 1:
            out[own, :16] = np.hstack([_bits(np.zeros(len(own)), 8), _bits(x[own, 0] & 255, 8)])
        elif c == len(costs) - 2:
            out[own, : 8 + 8 * n] = np.hstack([_bits(np.full(len(own), 2), 8), np.unpackbits((x[own] & 255).astype(np.uint8), axis=1)])
        else:
            order, u, k, _ = choices[c]
            linear = c == 3
            kind = 64 + 2 * (order - 1) if linear else 16 + 2 * order
            head = [_bits(np.full(len(own), kind), 8)]
            if order:
                head.append(np.unpackbits((x[own, :order] & 255).astype(np.uint8), axis=1))
            if linear:
                head += [_bits(np.full(len(own), LPC_BITS - 1), 4), _bits(shift[own], 5)]
                head += [_bits(coef[own, j] & (2**LPC_BITS - 1), LPC_BITS) for j in range(order)]
            head += [_bits(np.zeros(len(own)), 6), _bits(k[own], 4)]
            head = np.hstack(head)
            out[own, : head.shape[1]] = head
            u, k = u[own], k[own][:, None]
            stop = head.shape[1] + np.cumsum((u >> k) + 1 + k, axis=1) - k - 1
            flat, at = out.reshape(-1), own[:, None] * out.shape[1] + stop
            flat[at] = 1
            for b in range(int(k.max())):
                with_bit = k[:, 0] > b
                flat[at[with_bit] + k[with_bit] - b] = u[with_bit] >> b & 1
    return out, total


def encode(payloads: list[bytes], lpc: bool = True) -> list[bytes]:
    """A FLAC file (with a seek table of all frames) for each payload of 8-bit samples, byte - 128.

    Payloads may be of any length from 0.
    """
    owner, number, parts = [], [], []
    for i, p in enumerate(payloads):
        for j, at in enumerate(range(0, len(p), BLOCK)):
            owner.append(i)
            number.append(j)
            parts.append(p[at : at + BLOCK])
    frames: list[bytes] = [b""] * len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for lo in range(0, len(same), GROUP):
            group = same[lo : lo + GROUP]
            x = np.frombuffer(b"".join(parts[i] for i in group), np.uint8).reshape(len(group), n).astype(np.int32) - 128
            bits, total = encode_subframes(x, lpc)
            packed = np.packbits(bits, axis=1)
            width = (total + 7) // 8
            heads = [frame_header(number[i], int(n)) for i in group]
            head = np.array([len(h) for h in heads])
            whole = np.zeros((len(group), packed.shape[1] + int(head.max())), np.uint8)
            for size in np.unique(head):
                own = np.flatnonzero(head == size)
                whole[own, :size] = np.frombuffer(b"".join(heads[i] for i in own), np.uint8).reshape(-1, size)
                whole[own, size : size + packed.shape[1]] = packed[own]
            length = head + width
            check = crc16_rows(whole, length)
            for r, i in enumerate(group):
                frames[i] = whole[r, : length[r]].tobytes() + struct.pack(">H", check[r])
    out, at = [], 0
    for i, p in enumerate(payloads):
        own = []
        while at < len(parts) and owner[at] == i:
            own.append(frames[at])
            at += 1
        least, most = (min(map(len, own)), max(map(len, own))) if own else (0, 0)
        info = struct.pack(">HH", BLOCK, BLOCK) + least.to_bytes(3, "big") + most.to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(_signed(p)).digest()
        seek, offset = [], 0
        for j, f in enumerate(own):
            seek.append(struct.pack(">QQH", j * BLOCK, offset, min(BLOCK, len(p) - j * BLOCK)))
            offset += len(f)
        table = b"".join(seek)
        head = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table
        out.append(head + b"".join(own))
    return out


def _signed(p: bytes) -> bytes:
    """The samples as signed bytes: the top bit turned."""
    return (np.frombuffer(p, np.uint8) ^ 128).tobytes()


def read_header(media: bytes) -> dict:
    """Stream facts and the seek table: samples, md5, where frames begin, and (sample, offset, count) of each frame."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, out = 4, False, {"seek": []}
    while not last:
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            bits = int.from_bytes(body[10:18], "big")
            out |= {"block": struct.unpack(">H", body[2:4])[0], "rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "depth": (bits >> 36 & 31) + 1, "samples": bits & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
            out["seek"] = [p for p in points if p[0] != 2**64 - 1]
        at += 4 + size
    return out | {"frames": at}


class _Reader:
    """A bit position in each row of a byte matrix; reads the same number of bits from many rows at once."""

    def __init__(self, data: np.ndarray):
        rows, width = data.shape
        padded = np.zeros((rows, width + 16), np.uint8)
        padded[:, :width] = data
        self.width = width + 8
        self.words = np.zeros((rows, self.width), np.uint64)
        for b in range(8):
            self.words = self.words << np.uint64(8) | padded[:, b : b + self.width]
        self.words = self.words.reshape(-1)
        self.base = np.arange(rows) * self.width
        self.at = np.zeros(rows, np.int64)

    def window(self, rows) -> np.ndarray:
        """The next 57 bits or more of rows, at the top of 64."""
        at = self.at[rows]
        return self.words[self.base[rows] + np.minimum(at >> 3, self.width - 1)] << (at & 7).astype(np.uint64)

    def take(self, rows, width) -> np.ndarray:
        """The next bits as unsigned numbers; width up to 32, one for all or one a row."""
        w = np.broadcast_to(np.asarray(width, np.uint64), len(rows))
        value = np.where(w > 0, self.window(rows) >> np.minimum(np.uint64(64) - w, np.uint64(63)), np.uint64(0))
        self.at[rows] += w.astype(np.int64)
        return value.astype(np.int64)

    def signed(self, rows, width) -> np.ndarray:
        w = np.broadcast_to(np.asarray(width, np.int64), len(rows))
        v = self.take(rows, w)
        return np.where(v >> np.maximum(w - 1, 0) & 1, v - (1 << w), v)

    def zeros(self, rows) -> np.ndarray:
        """Length of the run of zero bits before the next one bit; both are consumed."""
        count = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            top = (self.window(rows[left]) >> np.uint64(32)).astype(np.float64)
            run = np.where(top > 0, 32 - np.frexp(top)[1], 32).astype(np.int64)
            count[left] += run
            self.at[rows[left]] += np.where(top > 0, run + 1, 32)
            left = left[top == 0]
            if len(left) and (self.at[rows[left]] >> 3).max() >= self.width:
                raise ValueError("a frame ends within a residual")
        return count


def decode_frames(frames: list[bytes], samples: np.ndarray) -> np.ndarray:
    """Samples of mono frames, row i with samples[i] of them; raises ValueError on a wrong header or checksum."""
    length = np.array([len(f) for f in frames])
    data = np.zeros((len(frames), int(length.max())), np.uint8)
    for i, f in enumerate(frames):
        data[i, : len(f)] = np.frombuffer(f, np.uint8)
    if (length < 8).any() or (data[:, 0] != 0xFF).any() or (data[:, 1] & 0xFE != 0xF8).any():
        raise ValueError("a frame does not begin with the sync code")
    every = np.arange(len(frames))
    if (crc16_rows(data, length - 2) != (data[every, length - 2].astype(np.uint32) << 8 | data[every, length - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    coded, lead = data[:, 2] >> 4, data[:, 4]
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    extra = np.where(coded == 6, 1, np.where(coded == 7, 2, 0))
    size = 4 + number + extra
    for i, f in enumerate(frames):
        if crc8(f[: size[i]]) != f[size[i]]:
            raise ValueError("a frame header's checksum is wrong")
    if (data[:, 3] >> 4 != 0).any() or not np.isin(data[:, 3] >> 1 & 7, (0, 1)).all():
        raise ValueError("only mono 8-bit frames are read")
    r = _Reader(data)
    r.at = (size + 1) * 8
    kind = r.take(every, 8)
    if (kind & 0x81).any():
        raise ValueError("padding or wasted bits in a subframe header")
    kind >>= 1
    out = np.zeros((len(frames), int(samples.max())), np.int64)
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if len(constant):
        out[constant] = r.signed(constant, 8)[:, None]
    for i in verbatim:
        start = int(r.at[i]) >> 3
        out[i, : samples[i]] = data[i, start : start + samples[i]].view(np.int8)
    rows = np.flatnonzero(kind > 1)
    rows = rows[np.argsort(-samples[rows], kind="stable")]
    linear = kind >= 32
    order = np.where(linear, kind - 31, kind - 8)
    if ((~linear & (kind > 1)) & ((kind < 8) | (kind > 12))).any():
        raise ValueError("a reserved kind of subframe")
    if not len(rows):
        return out
    for i in range(int(order[rows].max())):
        own = rows[order[rows] > i]
        out[own, i] = r.signed(own, 8)
    coef, shift = np.zeros((len(frames), 32), np.int64), np.zeros(len(frames), np.int64)
    own = rows[linear[rows]]
    if len(own):
        precision = r.take(own, 4) + 1
        shift[own] = r.signed(own, 5)
        for j in range(int(order[own].max())):
            with_j = order[own] > j
            coef[own[with_j], j] = r.signed(own[with_j], precision[with_j])
    out[rows] = _residuals(r, rows, order[rows], samples[rows], out[rows])
    _restore(out, rows, linear, order, coef, shift)
    return out


def _residuals(r: _Reader, rows: np.ndarray, first: np.ndarray, samples: np.ndarray, warm: np.ndarray) -> np.ndarray:
    """Warm-up samples and Rice residuals of rows, which come with the most samples first.

    A step reads sample i of every row that has it; each row has its own partitions and parameters.
    """
    wide = r.take(rows, 2)
    if (wide > 1).any():
        raise ValueError("a reserved residual coding")
    out = np.ascontiguousarray(warm.T)
    part = samples >> r.take(rows, 4)
    live = np.searchsorted(-samples, -np.arange(1, len(out) + 1), side="right")
    k, raw = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    words, base, at = r.words, r.base[rows], r.at[rows]
    due = np.unique(np.concatenate([first, *(np.arange(p, n, p) for p, n in set(zip(part.tolist(), samples.tolist(), strict=True)) if p)]))
    settled, low_shift, fast = int(first.max()), 63 - k, False
    one, top_half = np.uint64(1), np.uint64(32)
    for i, n in enumerate(live[: int(samples[0])]):
        if len(due) and i == due[0]:
            due = due[1:]
            fresh = np.flatnonzero((i >= first) & ((i == first) | (i % part == 0)) & (i < samples))
            r.at[rows] = at
            k[fresh] = r.take(rows[fresh], 4 + wide[fresh])
            escape = fresh[k[fresh] == 15 + 16 * wide[fresh]]
            if len(escape):
                raw[escape] = r.take(rows[escape], 5)
                k[escape] = -1
            at = r.at[rows]
            fast, low_shift = bool(((k >= 0) & (k <= 24)).all()), (63 - k).astype(np.uint64)
        if fast and i >= settled:
            w = words[base[:n] + (at[:n] >> 3)] << (at[:n] & 7).astype(np.uint64)
            run = 1054 - ((w >> top_half).astype(np.float64).view(np.int64) >> 52)  # leading zeros, from the exponent
            if run.max() < 32:
                low = (w << (run + 1).view(np.uint64)) >> one >> low_shift[:n]
                at[:n] += run + (k[:n] + 1)
                u = run << k[:n] | low.view(np.int64)
                out[i, :n] = u >> 1 ^ -(u & 1)
                continue
        own = np.flatnonzero((i >= first[:n]) & (k[:n] >= 0))
        r.at[rows] = at
        if len(own):
            u = r.zeros(rows[own]) << k[own]
            u |= r.take(rows[own], k[own])
            out[i, own] = u >> 1 ^ -(u & 1)
        own = np.flatnonzero((i >= first[:n]) & (k[:n] < 0))
        if len(own):
            out[i, own] = r.signed(rows[own], raw[own])
        at = r.at[rows]
    if (at >> 3 > r.width).any():
        raise ValueError("a frame ends within a residual")
    return out.T


def _restore(out: np.ndarray, rows: np.ndarray, linear: np.ndarray, order: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> None:
    """Samples from residuals: running sums undo the fixed predictors, a loop over samples the linear ones."""
    for o in np.unique(order[rows]):
        own = rows[(order[rows] == o) & ~linear[rows]]
        if o and len(own):
            x = out[own]
            for level in range(int(o), 0, -1):  # the warm-up gives each difference's first value
                start = np.diff(out[own, :o], n=level - 1, axis=1)[:, -1] if level > 1 else out[own, o - 1]
                x[:, o - 1] = start
                x[:, o - 1 :] = np.cumsum(x[:, o - 1 :], axis=1)
            x[:, :o] = out[own, :o]
            out[own] = x
        own = rows[(order[rows] == o) & linear[rows]]
        if len(own):
            x, c, s = out[own], coef[own, :o][:, ::-1], shift[own]
            for i in range(int(o), x.shape[1]):
                x[:, i] += (c * x[:, i - o : i]).sum(axis=1) >> s
            out[own] = x


def decode_blocks(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each FLAC file with a full seek table its PCM blocks (sample offset, samples + 128), one a frame.

    Raises ValueError if a frame or the whole is damaged.
    """
    heads = [read_header(m) for m in media]
    frames, samples = [], []
    for m, h in zip(media, heads, strict=True):
        ends = [p[1] for p in h["seek"][1:]] + [len(m) - h["frames"]]
        if sum(p[2] for p in h["seek"]) != h["samples"]:
            raise ValueError("the seek table does not list every frame")
        for (_, offset, count), end in zip(h["seek"], ends, strict=False):
            frames.append(m[h["frames"] + offset : h["frames"] + end])
            samples.append(count)
    blocks: list[bytes] = []
    for lo in range(0, len(frames), GROUP):
        count = np.array(samples[lo : lo + GROUP])
        x = (decode_frames(frames[lo : lo + GROUP], count) + 128).astype(np.uint8)
        blocks += [row[:n].tobytes() for row, n in zip(x, count, strict=True)]
    out, at = [], 0
    for h in heads:
        own = [(p[0], b) for p, b in zip(h["seek"], blocks[at : at + len(h["seek"])], strict=True)]
        at += len(h["seek"])
        if hashlib.md5(_signed(b"".join(b for _, b in own))).digest() != h["md5"]:
            raise ValueError("the samples' digest is wrong")
        out.append(own)
    return out


def decode(media: list[bytes]) -> list[bytes]:
    """The payloads of FLAC files with full seek tables; raises ValueError if one is damaged."""
    return [b"".join(b for _, b in own) for own in decode_blocks(media)]


def features(payload: bytes) -> str:
    """Facts of the samples: mean, mean square, crossings of 0 and peak, as exact integers where sums."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "n=0"
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={np.abs(x).max()}"


def _groups(items: list[bytes], limit: int = 1_200_000) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, b in enumerate(items):
        if i > first and size + len(b) > limit:
            yield first, i
            first, size = i, 0
        size += len(b)
    if first < len(items):
        yield first, len(items)


BLOCKS = "array<struct<sample_offset:bigint,pcm_block:binary>>"


def _block_lists(found: list[list[tuple[int, bytes]] | None]) -> pa.Array:
    """Arrow lists of blocks, null for None."""
    flat = [x for own in found for x in own or ()]
    blocks = pa.StructArray.from_arrays([pa.array([o for o, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.binary())], ["sample_offset", "pcm_block"])
    ends = np.cumsum([0, *(len(own or ()) for own in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks, mask=pa.array([own is None for own in found]))


def encode_column(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """df with a binary column of FLAC files for its binary payload column; null payloads give null."""
    payload, df = F.col(payload_col), small_batches(df)

    @F.arrow_udf("binary")
    @trimmed
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.to_pylist()
            some = [b for b in rows if b is not None]
            done = iter([m for lo, hi in _groups(some) for m in encode(some[lo:hi])])
            yield pa.array([None if b is None else next(done) for b in rows], pa.binary())

    return df.withColumn(media_col, run(payload))


def decode_column(df: DataFrame, media_col: str = "media", blocks_col: str = "blocks") -> DataFrame:
    """df with its FLAC column decoded to PCM blocks, each with its sample offset; null gives null, a damaged file raises."""
    df = small_batches(df)

    @F.arrow_udf(BLOCKS)
    @trimmed
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.to_pylist()
            some = [b for b in rows if b is not None]
            done = iter([p for lo, hi in _groups(some) for p in decode_blocks(some[lo:hi])])
            yield _block_lists([None if b is None else next(done) for b in rows])

    return df.withColumn(blocks_col, run(F.col(media_col)))


def pcm_blocks(df: DataFrame, blocks_col: str = "blocks") -> DataFrame:
    """A row for each PCM block: df's other columns, ``block, sample_offset, pcm_block``; null and empty lists give none.

    Repeated rows give their blocks each; an empty table gives no rows. df has no columns of these names.
    """
    rest = [c for c in df.columns if c != blocks_col]
    return df.select(*rest, F.posexplode(blocks_col).alias("block", "b")).select(*rest, "block", "b.*")


def joined(blocks: str | F.Column) -> F.Column:
    """All samples of a column of blocks as one binary."""
    text = F.transform(blocks, lambda b: F.decode(b["pcm_block"], "ISO-8859-1"))
    return F.encode(F.array_join(text, ""), "ISO-8859-1")


def samples_at(blocks: str | F.Column, start: F.Column, count: int) -> F.Column:
    """`count` samples from a sample offset on, found by the blocks' offsets; they must lie in one block."""
    inside = F.filter(blocks, lambda b: (b["sample_offset"] <= start) & (b["sample_offset"] + F.octet_length(b["pcm_block"]) > start))
    block = F.get(inside, 0)
    return F.substring(block["pcm_block"], (start - block["sample_offset"]).cast("int") + 1, F.lit(count))


def text_payload(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, payload``: the whole text's UTF-8 and bytes 0 up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    short = F.pmod(-n, F.lit(64)) + F.when(n == 0, 64).otherwise(0)
    pad = F.substring(F.lit(bytes(64)), F.lit(1), short)
    return docs.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("n_bytes"), F.concat(raw, pad).alias("payload"))


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as FLAC, read back and digested; rows in, rows out.

    A worker encodes and decodes a group of texts and hands on PCM blocks with sample offsets. They are
    written to the shared folder and digested as read back: the whole from all blocks in order, the
    tail from the block that holds its sample offset. A block has 64 samples' multiples, so the tail lies in one.

    Null texts count as empty, and an empty text is 64 zero bytes. Rows that repeat get equal values
    each; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    @F.arrow_udf(f"media_bytes long, media_sha256 string, feature string, blocks {BLOCKS}")
    @trimmed
    def stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            payloads = batch.to_pylist()
            size, sha, feature, blocks = [], [], [], []
            for lo, hi in _groups(payloads):
                media = encode(payloads[lo:hi])
                for m, own in zip(media, decode_blocks(media), strict=True):
                    size.append(len(m))
                    sha.append(hashlib.sha256(m).hexdigest())
                    feature.append(features(b"".join(b for _, b in own)))
                    blocks.append(own)
            columns = [pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(feature, pa.string()), _block_lists(blocks)]
            yield pa.StructArray.from_arrays(columns, ["media_bytes", "media_sha256", "feature", "blocks"])

    rows = text_payload(small_batches(docs), id_col, text_col).select("doc_id", "n_bytes", stored("payload").alias("s")).select("doc_id", "n_bytes", "s.*")
    rows = materialise(rows, "pcm", compression="zstd")
    rows = rows.withColumn("payload_bytes", F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b["pcm_block"])))
    tail = F.crc32(samples_at("blocks", F.col("payload_bytes") - 64, 64))
    return rows.select("doc_id", "n_bytes", "payload_bytes", F.sha2(joined("blocks"), 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
