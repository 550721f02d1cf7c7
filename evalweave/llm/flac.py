"""FLAC streams of mono 8-bit samples: encoder and decoder over many frames at once.

Numpy works on all frames of a batch in step: sample i of every frame, then sample i + 1. Frames
hold at most ``BLOCK`` samples, so a batch is bounded whatever the length of its streams. The
encoder picks per frame the cheapest of a constant, verbatim samples, fixed predictors and a
quantised linear predictor, with Rice-coded residuals. The decoder reads those and, one frame at a
time, also partitioned residuals, escapes and wasted bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BLOCK = 4096
RATE = 8000
LPC_ORDER = 4
PRECISION = 12
# Fixed values of the format: predictors, code numbers, checksum polynomials.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
BITS_OF_CODE = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
POLY8, POLY16 = 0x07, 0x8005


class FlacError(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _table(poly: int, width: int, bits: int) -> np.ndarray:
    """Checksum of every value of ``bits`` leading bits."""
    value = np.arange(1 << bits, dtype=np.uint32) << max(0, width - bits)
    top = np.uint32(1 << (width - 1))
    for _ in range(bits):
        value = np.where(value & top, (value << 1) ^ poly, value << 1) & ((1 << width) - 1)
    return value


# The batch decoder reads runs of fewer zeros than this; the encoder writes no longer ones.
UNARY_LIMIT = 16
LEADING_ZEROS = np.array([UNARY_LIMIT - v.bit_length() for v in range(1 << UNARY_LIMIT)], np.uint8)
CRC8 = _table(POLY8, 8, 8).tolist()
CRC16_BYTE = _table(POLY16, 16, 8).astype(np.uint16)
CRC16_PAIR = _table(POLY16, 16, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = CRC8[crc ^ b]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many runs of ``data``, two bytes of each run per step."""
    order = np.argsort(-lengths, kind="stable")
    at, pairs = starts[order], lengths[order] // 2
    crc = np.zeros(len(order), np.uint16)
    padded = np.append(data, np.zeros(1, np.uint8)).astype(np.uint16)
    both = (padded[:-1] << np.uint16(8)) | padded[1:]
    left = np.searchsorted(-pairs, -np.arange(int(pairs.max(initial=0))), "left")
    for step, m in enumerate(left.tolist()):
        crc[:m] = CRC16_PAIR[crc[:m] ^ both[at[:m] + 2 * step]]
    odd = np.flatnonzero(lengths[order] % 2)
    tail = data[at[odd] + lengths[order][odd] - 1]
    crc[odd] = (crc[odd] << np.uint16(8)) ^ CRC16_BYTE[(crc[odd] >> np.uint16(8)) ^ tail]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x3F
    while n > limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


# ---- encoder -----------------------------------------------------------------------------------


def _grid(samples: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Samples as (time, frame) with frames in falling length, padded with zeros, and the lengths."""
    sizes = np.array([len(s) for s in samples])
    grid = np.zeros((max(int(sizes.max()), LPC_ORDER), len(samples)), np.int32)
    for f, s in enumerate(samples):
        grid[: len(s), f] = s
    return grid, sizes


def _coefficients(grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor (order, frame) and shift per frame, by least squares on autocorrelation."""
    x = grid  # squares of 8-bit samples over one block fit 32 bits
    lags = np.stack([np.einsum("tf,tf->f", x[k:], x[: max(0, len(x) - k)]) for k in range(LPC_ORDER + 1)]).astype(np.float64)
    index = np.abs(np.arange(LPC_ORDER)[:, None] - np.arange(LPC_ORDER)[None, :])
    normal = lags[index].transpose(2, 0, 1) + np.eye(LPC_ORDER) * (lags[0] * 1e-6 + 1e-3)[:, None, None]
    coefs = np.linalg.solve(normal, lags[1:].T[:, :, None])[:, :, 0].T
    top = np.abs(coefs).max(0)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.maximum(top, 2.0**-12))).astype(int), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(coefs * (1 << shift)), -limit, limit).astype(np.int64), shift


def _residuals(grid: np.ndarray, kind: str, coefs=None, shift=None) -> np.ndarray:
    if kind == "lpc":
        guess = np.zeros(grid.shape, np.int32)
        for j in range(LPC_ORDER):
            guess[LPC_ORDER:] += coefs[j].astype(np.int32) * grid[LPC_ORDER - 1 - j : len(grid) - 1 - j]
        return grid - (guess >> shift.astype(np.int32))
    order = int(kind)
    return grid if order == 0 else np.vstack([grid[:order], np.diff(grid, n=order, axis=0)]).astype(np.int32)


@dataclass
class _Plan:
    """How a batch of frames is coded."""

    kind: np.ndarray  # 0 or 1 fixed order, 3 linear predictor, 4 verbatim, 5 constant
    rice: np.ndarray
    folded: np.ndarray  # residuals as unsigned numbers, (time, frame)
    coefs: np.ndarray
    shift: np.ndarray


ORDERS = np.array([0, 1, 2, LPC_ORDER, 0, 0])


def _plan(grid: np.ndarray, sizes: np.ndarray) -> _Plan:
    frames = grid.shape[1]
    valid = np.arange(len(grid))[:, None] < sizes
    coefs, shift = _coefficients(grid, sizes)
    best, kind = (np.abs(grid)).sum(0), np.zeros(frames, np.int64)
    chosen = grid.copy()
    for k, name in ((1, "1"), (3, "lpc")):
        order = ORDERS[k]
        res = _residuals(grid, name, coefs, shift)
        total = np.abs(res, where=valid, out=np.zeros_like(res))[order:].sum(0)
        better = (total + 8 * order < best) & (sizes > order)
        best = np.where(better, total + 8 * order, best)
        kind[better] = k
        chosen[:, better] = res[:, better]
    order = ORDERS[kind]
    coded = valid & (np.arange(len(grid))[:, None] >= order)
    folded = np.where(coded, (chosen << 1) ^ (chosen >> 31), 0)
    count = coded.sum(0)
    cost = np.full(frames, np.iinfo(np.int64).max)
    rice = np.zeros(frames, np.int32)
    guess = np.floor(np.log2(np.maximum(folded.sum(0) / np.maximum(count, 1) * 0.7, 1))).astype(int)
    least = np.ceil(np.log2((folded.max(0) + 1) / UNARY_LIMIT)).astype(int)
    for delta in (-1, 0, 1):
        k = np.clip(np.maximum(guess + delta, least), 0, 14).astype(np.int32)
        bits = (folded >> k).sum(0) + count * (1 + k)
        better = bits < cost
        cost, rice = np.where(better, bits, cost), np.where(better, k, rice)
    cost = cost + order * 8 + 10 + (kind == 3) * (9 + LPC_ORDER * PRECISION)
    kind = np.where(cost >= 8 * sizes, 4, kind)
    flat = ((grid == grid[0]) | ~valid).all(0)
    return _Plan(np.where(flat, 5, kind), rice, folded, coefs, shift)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _bodies(grid: np.ndarray, sizes: np.ndarray, plan: _Plan) -> tuple[np.ndarray, np.ndarray]:
    """Subframes as bytes, and their starts (one more than frames)."""
    frames = len(sizes)
    kind, order = plan.kind, ORDERS[plan.kind]
    time = np.arange(len(grid))[:, None]
    riced = kind <= 3
    lpc = kind == 3
    coded = (time < sizes) & (time >= order) & riced
    lengths = np.where(coded, (plan.folded >> plan.rice) + 1 + plan.rice, 0)
    head = np.where(riced, 8 + order * 8 + lpc * (9 + LPC_ORDER * PRECISION) + 10, 8)
    body = np.where(riced, lengths.sum(0), np.where(kind == 4, 8 * sizes, 8))
    starts = np.concatenate([[0], np.cumsum((head + body + 7) // 8)])
    bits = np.zeros(int(starts[-1]) * 8, np.uint8)
    at = starts[:-1] * 8
    types = np.select([kind == 5, kind == 4, lpc], [0, 1, 32 + LPC_ORDER - 1], 8 + order)
    _put(bits, at, types << 1, 8)
    _put(bits, (at + 8)[kind == 5], grid[0][kind == 5] & 0xFF, 8)
    plain = np.flatnonzero(kind == 4)
    if len(plain):
        t, f = np.nonzero(time < sizes[plain])
        _put(bits, (at + 8)[plain][f] + 8 * t, grid[:, plain][t, f] & 0xFF, 8)
    for j in range(LPC_ORDER):
        warm = riced & (order > j)
        _put(bits, (at + 8 + 8 * j)[warm], grid[j][warm] & 0xFF, 8)
    base = at + 8 + 8 * order
    _put(bits, base[lpc], np.full(int(lpc.sum()), PRECISION - 1), 4)
    _put(bits, base[lpc] + 4, plan.shift[lpc], 5)
    for j in range(LPC_ORDER):
        _put(bits, base[lpc] + 9 + j * PRECISION, plan.coefs[j][lpc], PRECISION)
    base = base + lpc * (9 + LPC_ORDER * PRECISION)
    _put(bits, base[riced], np.zeros(int(riced.sum()), int), 6)
    _put(bits, base[riced] + 6, plan.rice[riced], 4)
    ends = np.cumsum(lengths, axis=0)
    where = (base + 10)[None, :] + ends - lengths
    for k in np.unique(plan.rice[riced]).tolist():
        mine = np.flatnonzero(riced & (plan.rice == k))
        sel = coded[:, mine]
        value = plan.folded[:, mine][sel]
        stop = where[:, mine][sel] + (value >> k)
        bits[stop] = 1
        _put(bits, stop + 1, value, k)
    return np.packbits(bits), starts


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """One FLAC stream per payload; a byte b is the signed sample b - 128. No payload is empty."""
    frames: list[tuple[int, int, np.ndarray]] = []
    for d, raw in enumerate(payloads):
        samples = (np.frombuffer(raw, np.uint8).astype(np.int32)) - 128
        frames += [(d, i, samples[i * BLOCK : (i + 1) * BLOCK]) for i in range(-(-len(samples) // BLOCK))]
    frames.sort(key=lambda f: -len(f[2]))
    coded: dict[tuple[int, int], bytes] = {}
    for part in _batches(frames, lambda f: len(f[2])):
        grid, sizes = _grid([f[2] for f in part])
        body, starts = _bodies(grid, sizes, _plan(grid, sizes))
        raw = body.tobytes()
        heads = []
        for (_, number, s) in part:
            head = bytes([0xFF, 0xF8, 0x74, 0x02]) + _utf8(number) + (len(s) - 1).to_bytes(2, "big")
            heads.append(head + bytes([crc8(head)]))
        whole = [h + raw[a:b] for h, a, b in zip(heads, starts[:-1].tolist(), starts[1:].tolist())]
        lengths = np.array([len(w) for w in whole])
        sums = crc16(np.frombuffer(b"".join(whole), np.uint8), np.cumsum(lengths) - lengths, lengths)
        for (d, number, _), w, crc in zip(part, whole, sums.tolist()):
            coded[d, number] = w + crc.to_bytes(2, "big")
    return [_stream(raw, [coded[d, i] for i in range(-(-len(raw) // BLOCK))]) for d, raw in enumerate(payloads)]


def _batches(items: list, size, most: int = 1 << 21):
    """Runs of items, longest first, that fill at most ``most`` cells of a (time, frame) grid."""
    at = 0
    while at < len(items):
        count = max(1, most // max(1, size(items[at])))
        yield items[at : at + count]
        at += count


def _stream(raw: bytes, frames: list[bytes]) -> bytes:
    block = min(BLOCK, len(raw))
    sizes = [len(f) for f in frames]
    fields = RATE << 44 | 0 << 41 | 7 << 36 | len(raw)
    signed = (np.frombuffer(raw, np.uint8) ^ np.uint8(0x80)).tobytes()
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + fields.to_bytes(8, "big") + hashlib.md5(signed).digest()
    seek, at = [], 0
    for i, s in enumerate(sizes):
        seek.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(raw) - i * BLOCK).to_bytes(2, "big"))
        at += s
    table = b"".join(seek)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


# ---- decoder -----------------------------------------------------------------------------------


@dataclass
class Stream:
    """What the metadata of a stream says."""

    total: int
    md5: bytes
    bits: int
    first: int  # byte offset of the first frame
    seek: list[tuple[int, int, int]]  # sample, byte offset after ``first``, samples


def parse_stream(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, last, info, seek = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        if kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size - 17, 18)]
            seek = [p for p in points if p[0] != (1 << 64) - 1]
        at += 4 + size
    if info is None or len(info) < 34:
        raise FlacError("no stream info")
    fields = int.from_bytes(info[10:18], "big")
    if (fields >> 41 & 7) != 0:
        raise FlacError("only mono streams are read")
    return Stream(fields & (1 << 36) - 1, info[18:34], (fields >> 36 & 31) + 1, at, seek)


@dataclass
class _Head:
    size: int
    body: int  # byte offset of the subframe in its stream
    bits: int


def _frame_head(data: bytes, at: int, stream: Stream) -> _Head:
    start = at
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame sync")
    size_code, rate_code, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 1 & 7
    if data[at + 3] >> 4 != 0:
        raise FlacError("only mono frames are read")
    at += 4
    lead = data[at]
    at += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if size_code == 1:
        size = 192
    elif 2 <= size_code <= 5:
        size = 576 << (size_code - 2)
    elif size_code >= 8:
        size = 256 << (size_code - 8)
    elif size_code in (6, 7):
        size = int.from_bytes(data[at : at + size_code - 5], "big") + 1
        at += size_code - 5
    else:
        raise FlacError("reserved block size")
    at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[start:at]) != data[at]:
        raise FlacError("header checksum")
    return _Head(size, at + 1, BITS_OF_CODE.get(bits_code, stream.bits))


class _Bits:
    """Reads one frame bit by bit."""

    def __init__(self, data: bytes, byte: int):
        self.value, self.size, self.at = int.from_bytes(data[byte:], "big"), 8 * (len(data) - byte), 0

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise FlacError("frame ends early")
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_frame(data: bytes, head: _Head, end: int | None = None) -> tuple[np.ndarray, int]:
    """Samples of one frame and the byte after its subframe: any mono subframe, one bit at a time."""
    limit = end or min(len(data), head.body + 8 * (head.size + 64))
    bits = _Bits(data[:limit], head.body)
    bits.take(1)
    kind, wasted = bits.take(6), bits.take(1)
    if wasted:
        wasted = 1 + bits.zeros()
    width = head.bits - wasted
    if kind == 0:
        out = [bits.signed(width)] * head.size
    elif kind == 1:
        out = [bits.signed(width) for _ in range(head.size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        coefs, shift = FIXED.get(order, []), 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            coefs = [bits.signed(precision) for _ in range(order)]
        method, parts = bits.take(2), 1 << bits.take(4)
        for p in range(parts):
            rice = bits.take(5 if method else 4)
            raw = bits.take(5) if rice == (31 if method else 15) else None
            for _ in range(head.size // parts - (order if p == 0 else 0)):
                if raw is not None:
                    res = bits.signed(raw)
                else:
                    folded = bits.zeros() << rice
                    folded |= bits.take(rice) if rice else 0
                    res = (folded >> 1) ^ -(folded & 1)
                out.append(res + (sum(c * out[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise FlacError("reserved subframe")
    return np.array(out, np.int64) << wasted, head.body + (bits.at + 7) // 8


def _simple(data: bytes, head: _Head) -> bool:
    """Whether the batch decoder reads the frame: 8 bits, one Rice partition, orders up to LPC_ORDER."""
    kind = data[head.body] >> 1
    if head.bits != 8 or data[head.body] & 1:
        return False
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if not 0 <= order <= LPC_ORDER or order > head.size:
        return False
    return True


def decode(streams: Sequence[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Per stream the payload and its blocks ``(sample offset, samples, byte offset of the frame)``.

    Checks every frame's CRC-8 and CRC-16, the number of samples and the stream's MD5.
    """
    infos = [parse_stream(s) for s in streams]
    out: list[list[tuple[int, np.ndarray, int]]] = [[] for _ in streams]
    items = []  # stream, byte offset, head, byte after the frame where the seek table tells
    for d, (data, info) in enumerate(zip(streams, infos)):
        offsets = [info.first + p[1] for p in info.seek]
        if sum(p[2] for p in info.seek) != info.total or not offsets:
            _walk(data, info, out[d])
            continue
        for at, end in zip(offsets, [*offsets[1:], len(data)]):
            head = _frame_head(data, at, info)
            if _simple(data, head):
                items.append((d, at, head, end))
            else:
                out[d].append((at, *_checked(data, at, head, end)[:1]))
    items.sort(key=lambda i: -i[2].size)
    for part in _batches(items, lambda i: i[2].size):
        for (d, at, _, _), samples in zip(part, _decode_batch(streams, part)):
            out[d].append((at, samples))
    return [_joined(info, sorted(frames, key=lambda f: f[0])) for info, frames in zip(infos, out)]


def _checked(data: bytes, at: int, head: _Head, end: int | None) -> tuple[np.ndarray, int]:
    samples, stop = decode_frame(data, head, end)
    crc = crc16(np.frombuffer(data[at:stop], np.uint8), np.array([0]), np.array([stop - at]))[0]
    if int(crc) != int.from_bytes(data[stop : stop + 2], "big") or (end is not None and stop + 2 != end):
        raise FlacError("frame checksum")
    return samples, stop + 2


def _walk(data: bytes, info: Stream, frames: list) -> None:
    """Frames of a stream without a full seek table, in order."""
    at, seen = info.first, 0
    while at < len(data):
        head = _frame_head(data, at, info)
        samples, stop = _checked(data, at, head, None)
        frames.append((at, samples))
        at, seen = stop, seen + head.size


def _joined(info: Stream, frames: list) -> tuple[bytes, list[tuple[int, int, int]]]:
    if info.bits != 8:
        raise FlacError("only 8-bit samples are unpacked to bytes")
    samples = np.concatenate([f[1] for f in frames]) if frames else np.zeros(0, np.int64)
    signed = samples.astype(np.int8).tobytes()
    if len(samples) != info.total or (any(info.md5) and hashlib.md5(signed).digest() != info.md5):
        raise FlacError("stream checksum")
    sizes = [len(f[1]) for f in frames]
    starts = np.cumsum([0, *sizes[:-1]]).tolist() if sizes else []
    payload = (np.frombuffer(signed, np.uint8) ^ np.uint8(0x80)).tobytes()
    return payload, [(s, n, f[0]) for s, n, f in zip(starts, sizes, frames)]


def _field(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` (at most 16) bits from bit ``at``; ``words`` has 32 bits from every byte."""
    return (words[at >> 3] >> (32 - width - (at & 7)).astype(np.uint32)).astype(np.int64) & ((1 << width) - 1)


def _signed(value: np.ndarray, width: int) -> np.ndarray:
    return value - ((value >> (width - 1)) << width)


def _decode_batch(streams: Sequence[bytes], part: list) -> list[np.ndarray]:
    """Samples of frames in falling length, all in step."""
    raw = b"".join(streams[d][at:end] for d, at, _, end in part)
    data = np.frombuffer(raw + bytes(8), np.uint8)
    lengths = np.array([end - at for _, at, _, end in part])
    starts = np.cumsum(lengths) - lengths
    wide = data.astype(np.uint32)
    words = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    sums = crc16(data, starts, lengths - 2)
    if (_field(words, (starts + lengths - 2) * 8, 16) != sums).any():
        raise FlacError("frame checksum")
    sizes = np.array([h.size for _, _, h, _ in part])
    body = (starts + np.array([h.body - at for _, at, h, _ in part])) * 8
    kind = _field(words, body, 8) >> 1
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, kind - 8)
    at = body + 8
    samples = np.zeros((max(int(sizes.max()), LPC_ORDER), len(part)), np.int32)
    for j in range(LPC_ORDER):
        warm = order > j
        samples[j, warm] = _signed(_field(words, (at + 8 * j)[warm], 8), 8)
    at = at + 8 * order
    coefs, shift = np.zeros((LPC_ORDER, len(part)), np.int32), np.zeros(len(part), np.int32)
    for o in range(1, LPC_ORDER + 1):
        for j, c in enumerate(FIXED[o]):
            coefs[j, ~lpc & (order == o)] = c
    precision = np.where(lpc, _field(words, at, 4) + 1, 0)
    shift[lpc] = _field(words, at[lpc] + 4, 5)
    for p in np.unique(precision[lpc]).tolist():
        for j in range(LPC_ORDER):
            mine = lpc & (precision == p) & (order > j)
            coefs[j, mine] = _signed(_field(words, at[mine] + 9 + j * p, p), p)
    at = at + lpc * (9 + order * precision)
    method, parts, rice = _field(words, at, 2), _field(words, at + 2, 4), _field(words, at + 6, 4)
    odd = (method != 0) | (parts != 0) | (rice == 15)
    counts = np.where(odd, 0, sizes - order)
    rank = np.argsort(-counts, kind="stable")
    step = (1 + rice)[rank]
    pos = (at + 10)[rank].copy()
    unary = np.zeros((int(counts.max(initial=0)), len(part)), np.uint8)
    active = np.searchsorted(-counts[rank], -np.arange(len(unary)), "left").tolist()
    for i, m in enumerate(active):
        at_now, here = pos[:m], unary[i, :m]
        head = np.take(words, at_now >> 3, mode="clip") << (at_now & 7).astype(np.uint32)
        np.take(LEADING_ZEROS, head >> np.uint32(16), out=here)
        at_now += here
        at_now += step[:m]
    long = np.zeros(len(part), bool)
    long[rank] = (unary == UNARY_LIMIT).any(0) if len(unary) else False
    odd = odd | long  # such frames are read bit by bit
    stops = (at + 10)[rank] + np.cumsum(unary + step, axis=0) - step
    k = rice[rank]
    value = np.zeros(stops.shape, np.int32)
    for width in np.unique(k).tolist():
        mine = np.flatnonzero(k == width)
        low = _field(words, np.minimum(stops[:, mine] + 1, 8 * (len(words) - 1)), width) if width else 0
        value[:, mine] = (unary[:, mine].astype(np.int32) << width) | low
    value = (value >> 1) ^ -(value & 1)
    for o in np.unique(order[rank]).tolist():
        mine = rank[order[rank] == o]
        rows = min(len(samples) - o, len(value))
        samples[o : o + rows, mine] = value[:rows, order[rank] == o]
    for o in range(1, LPC_ORDER + 1):
        mine = np.flatnonzero((order == o) & ~odd)
        if len(mine):
            own = np.ascontiguousarray(samples[:, mine])
            c, s = coefs[:o, mine], shift[mine]
            # Rows beyond a frame's own length hold no residuals and are cut off below.
            guess, term = np.empty_like(s), np.empty_like(s)
            for i in range(o, len(own)):
                np.multiply(c[0], own[i - 1], out=guess)
                for j in range(1, o):
                    np.multiply(c[j], own[i - 1 - j], out=term)
                    guess += term
                guess >>= s
                own[i] += guess
            samples[:, mine] = own
    out = [samples[:n, f].copy() for f, n in enumerate(sizes.tolist())]
    for f in np.flatnonzero(odd).tolist():
        d, start, head, end = part[f]
        out[f] = _checked(streams[d], start, head, end)[0]
    return out
