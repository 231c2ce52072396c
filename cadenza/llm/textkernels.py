"""Vectorised text kernels over Arrow string buffers: words, their 64-bit hashes and per-document sums, without Python loops over words.

All kernels work on UTF-8 bytes. Separator classes hold ASCII characters only, so splitting bytes splits characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one kernel call handles; a single longer text is handled alone, whole.
BLOCK_BYTES = 1 << 20
#: Bases of the two independent rolling hashes, and their inverses.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator, on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = (mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93)), mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F)))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept per worker process for the block size."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, BLOCK_BYTES) + 1, base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= BLOCK_BYTES:
            _powers[base] = have
    return have


def byte_class(chars: bytes, inverse: bool = False) -> np.ndarray:
    """A table of 256 booleans: which bytes are in ``chars``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return ~table if inverse else table


#: Words separated by white space: every byte but space and \t \n \v \f \r.
SPACED = byte_class(b" \t\n\v\f\r", inverse=True)
#: Words of letters and digits: ASCII 0-9 A-Z a-z and everything outside ASCII.
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), inverse=True)
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """A block of documents: one byte array and the offsets of the texts in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._sums: dict[int, np.ndarray] = {}

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """The sum of ``flags`` (one for each byte) in each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of words in each text."""
        inside = table[self.data]
        before, after = np.zeros(len(inside) + 1, dtype=bool), np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        after[:-1] = inside
        before[self.offsets] = False
        after[self.offsets] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        return starts, ends, np.diff(np.searchsorted(starts, self.offsets))

    def _values(self, which: int) -> np.ndarray:
        return _BYTES[which][self.data]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes have equal hashes wherever they stand. ``which``: of two independent ones."""
        n = len(self.data)
        if which not in self._sums:
            sums = self._sums[which] = np.zeros(n + 1, dtype=U)
            np.cumsum(self._values(which) * powers(_BASES[which], n)[:n], out=sums[1:])
        sums = self._sums[which]
        raw = (sums[ends] - sums[starts]) * powers(_INVERSES[which], n)[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xA24BAED4963EE407))

    def sliding(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each byte on; near the end of the block, the largest value."""
        n = len(self.data)
        self.hashes(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        out = np.full(n, ~U(0))
        if n >= k:
            out[: n - k + 1] = mix((self._sums[0][k:] - self._sums[0][:-k]) * powers(_INVERSES[0], n)[: n - k + 1])
        return out


class WordTexts(Texts):
    """The same for words: one array of 64-bit word hashes (white space separates words and plays no other part)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data.view(U), offsets)

    @staticmethod
    def of(texts: Texts) -> WordTexts:
        starts, ends, counts = texts.words(SPACED)
        return WordTexts(texts.hashes(starts, ends), np.append(0, np.cumsum(counts)))

    def _values(self, which: int) -> np.ndarray:
        return mix(self.data + U((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)[which]))


def windowed_min(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values, by the least of two runs that end and begin inside it."""
    n = len(values) - span + 1
    padded = np.full(-(-len(values) // span) * span, ~U(0))
    padded[: len(values)] = values
    rows = padded.reshape(-1, span)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[span - 1 : span - 1 + n])


def blocks(batch: pa.RecordBatch, column: str | int = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """The batch's texts in runs of about ``limit`` bytes: first row, row after the last, texts. Null is an empty text."""
    arr = batch.column(column)
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if not n:
        return
    _, ends, data = arr.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, last, Texts(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def doc_of(counts: np.ndarray) -> np.ndarray:
    """The text's number for each of its items, from the number of items in each text."""
    return np.repeat(np.arange(len(counts)), counts)


def shingles(words: np.ndarray, counts: np.ndarray, k: int, short_as_one: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside a text, the text of each, and the word each begins at.

    With ``short_as_one`` a text of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    n, doc = len(words), doc_of(counts)
    if not n:
        return np.zeros(0, dtype=U), doc, np.zeros(0, dtype=np.int64)
    begin = np.cumsum(counts) - counts
    left = (begin + counts)[doc] - np.arange(n)
    here = left >= k
    key = np.full(n, k, dtype=U)
    if short_as_one:
        short = (counts < k)[doc]
        first = np.arange(n) == begin[doc]
        here |= short & first
        key = np.where(short, counts[doc], k).astype(U)
    at = np.flatnonzero(here)
    out = key[at] * U(0x8CB92BA72F3D8DD7)
    for j in range(k):
        use = left[at] > j
        out = mix(out * U(0x9FB21C651E98DF25) + np.where(use, words[np.minimum(at + j, n - 1)], U(j)))
    return out, doc[at], at


def in_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between texts: a hash of the key and its text's number."""
    return mix(keys + doc.astype(U) * U(0xD1342543DE82EF95))
