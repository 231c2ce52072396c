"""A codec for the FLAC format as RFC 9639 describes it. Decodes every subframe kind; encodes fixed predictors and verbatim blocks."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np

#: Samples of a block that the encoder writes.
BLOCK = 4096
# Block sizes and sample sizes by their codes in a frame header, and the fixed predictors' weights.
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{c: 256 << (c - 8) for c in range(8, 16)}}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
WEIGHTS = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class FlacError(ValueError):
    """Bytes that are not a FLAC stream this codec knows."""


def _crc(data: bytes, width: int, polynomial: int) -> int:
    table, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ polynomial if r & top else r << 1) & mask
        table.append(r)
    r = 0
    for b in data:
        r = ((r << 8) & mask) ^ table[(r >> (width - 8)) ^ b]
    return r


class _Bits:
    """A reader of bits, with the places of all ones known so that unary numbers take one step."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.ones: list[int] = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8))).tolist()
        self.one = 0

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        end = self.at + n
        if end > 8 * len(self.data):
            raise FlacError("the stream ends inside a frame")
        value = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7)
        self.at = end
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        if self.one >= len(self.ones) or self.ones[self.one] < self.at or (self.one and self.ones[self.one - 1] >= self.at):
            self.one = bisect.bisect_left(self.ones, self.at)
        if self.one >= len(self.ones):
            raise FlacError("the stream ends inside a frame")
        n = self.ones[self.one] - self.at
        self.at += n + 1
        return n


def _residual(bits: _Bits, block: int, order: int) -> list[int]:
    method, partitions = bits.read(2), 1 << bits.read(4)
    if method > 1:
        raise FlacError("unknown residual coding")
    width, out = (5 if method else 4), []
    for p in range(partitions):
        n = block // partitions - (order if p == 0 else 0)
        k = bits.read(width)
        if k == (1 << width) - 1:
            size = bits.read(5)
            out += [bits.signed(size) for _ in range(n)]
            continue
        for _ in range(n):
            value = bits.unary() << k | bits.read(k)
            out.append(value >> 1 ^ -(value & 1))
    return out


def _subframe(bits: _Bits, block: int, depth: int) -> np.ndarray:
    if bits.read(1):
        raise FlacError("no subframe here")
    kind = bits.read(6)
    wasted = 1 + bits.unary() if bits.read(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * block
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            weights, shift = WEIGHTS[order], 0
        else:
            precision = bits.read(4) + 1
            shift = bits.signed(5)
            weights = tuple(bits.signed(precision) for _ in range(order))
        for r in _residual(bits, block, order):
            past = sum(w * out[-1 - i] for i, w in enumerate(weights))
            out.append(r + (past >> shift if shift >= 0 else past << -shift))
    else:
        raise FlacError("reserved subframe kind")
    return np.array(out, dtype=np.int64) << wasted


def decode(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Channels, rate, bits of a sample, and the samples as integers (frames x channels)."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise FlacError("metadata without end")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
        if last:
            break
    if info is None or len(info) < 18:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    bits, blocks = _Bits(data[at:]), []
    while bits.at + 48 <= 8 * len(bits.data):
        if bits.read(14) != 0x3FFE:
            raise FlacError("lost synchronisation")
        bits.read(2)
        size_code, rate_code, layout, depth_code = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
        bits.read(1)
        lead = bits.read(8)
        more = 0
        while lead & (0x80 >> more):
            more += 1
        bits.read(8 * max(0, more - 1))
        block = bits.read(8) + 1 if size_code == 6 else bits.read(16) + 1 if size_code == 7 else SIZES.get(size_code)
        bits.read({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        bits.read(8)
        here = BITS.get(depth_code, depth)
        if block is None or layout > 10:
            raise FlacError("reserved value in a frame header")
        if layout < 8:
            parts = [_subframe(bits, block, here) for _ in range(layout + 1)]
        else:
            a = _subframe(bits, block, here + (layout == 9))
            b = _subframe(bits, block, here + (layout != 9))
            if layout == 8:
                parts = [a, a - b]
            elif layout == 9:
                parts = [a + b, b]
            else:
                middle = (a << 1) | (b & 1)
                parts = [(middle + b) >> 1, (middle - b) >> 1]
        bits.at = (bits.at + 7) // 8 * 8
        bits.read(16)
        blocks.append(np.stack(parts, axis=1))
    out = np.concatenate(blocks) if blocks else np.zeros((0, channels), dtype=np.int64)
    if total and len(out) != total:
        raise FlacError(f"{len(out)} samples where {total} are promised")
    return channels, rate, depth, out


def _field(value: int, n: int) -> np.ndarray:
    return np.array([value >> (n - 1 - i) & 1 for i in range(n)], dtype=np.uint8)


def _fields(values: np.ndarray, n: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _rice(residual: np.ndarray) -> np.ndarray:
    """Residuals in one partition: method 0 (or 1 for large parameters), order 0, the parameter, the codes."""
    folded = (residual << 1) ^ (residual >> 63)
    k = max(0, int(np.log2(max(1.0, float(folded.mean()))))) if len(folded) else 0
    k = min(k, 30)
    high = folded >> k
    ends = np.cumsum(high + 1 + k)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    mark = ends - 1 - k
    out[mark] = 1
    for i in range(k):
        out[mark + 1 + i] = folded >> (k - 1 - i) & 1
    return np.concatenate((_field(int(k > 14), 2), _field(0, 4), _field(k, 5 if k > 14 else 4), out))


def _encoded(x: np.ndarray, depth: int) -> np.ndarray:
    plain = np.concatenate((_field(0, 1), _field(1, 6), _field(0, 1), _fields(x, depth)))
    if len(x) <= 4 or depth > 25:
        return plain
    order = min(range(5), key=lambda n: float(np.abs(np.diff(x, n)[4 - n :]).sum()))
    short = np.concatenate((_field(0, 1), _field(8 + order, 6), _field(0, 1), _fields(x[:order], depth) if order else plain[:0], _rice(np.diff(x, order) if order else x)))
    return min(short, plain, key=len)


def _number(n: int) -> bytes:
    """A frame number, coded as UTF-8 would code it, up to 36 bits."""
    if n < 128:
        return bytes([n])
    more = next(m for m in range(1, 7) if n < 1 << (6 * m + 6 - m))
    return bytes([(0xFF00 >> (more + 1)) & 0xFF | n >> (6 * more), *[0x80 | n >> (6 * i) & 63 for i in range(more - 1, -1, -1)]])


def encode(samples: np.ndarray, rate: int, depth: int) -> bytes:
    """A stream from integer samples (frames x channels, 1 to 8 channels; 16, 24 or 32 bits)."""
    n, channels = samples.shape
    if not 1 <= channels <= 8:
        raise FlacError("FLAC holds 1 to 8 channels")
    x = samples.astype(np.int64)
    raw = x.astype("<i4").view(np.uint8).reshape(n, channels, 4)[:, :, : depth // 8].tobytes() if n else b""
    head = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | (channels - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    out = [b"fLaC", bytes([0x80]), len(head).to_bytes(3, "big"), head]
    code = {v: k for k, v in BITS.items()}[depth]
    for number, at in enumerate(range(0, n, BLOCK)):
        part = x[at : at + BLOCK]
        begin = bytes([0xFF, 0xF8, 0x70, (channels - 1) << 4 | code << 1]) + _number(number) + (len(part) - 1).to_bytes(2, "big")
        begin += bytes([_crc(begin, 8, 0x07)])
        frame = begin + np.packbits(np.concatenate([_encoded(part[:, c], depth) for c in range(channels)])).tobytes()
        out += [frame, _crc(frame, 16, 0x8005).to_bytes(2, "big")]
    return b"".join(out)
