"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The packing is planned on the histogram of piece lengths, which has at most one entry for each length up to the
capacity, however large the corpus: pieces above a third of the capacity are matched in pairs, greedily from the
longest; the smaller ones then go, longest first, to the fullest sequence with room. The plan says which ranks of each
length go where, so pieces find their places in parallel by their rank among pieces of the same length.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_texts, written
from .textkernels import Texts

CAPACITY = 2048
#: Id that ends a document.
END_ID = 0
#: Pre-tokens whose ids a worker process keeps; the memory is emptied when it is full.
CACHE_ENTRIES = 300_000
#: Longer pre-tokens are not kept.
CACHE_CHARS = 48
#: Pieces of one length that are ranked together.
RANKED_TOGETHER = 100_000

#: Texts with a letter from here on are left to the tokenizer library whole.
_LATIN_END = 0x180
_HAS_CONTROL = re.compile("[\x1c-\x1f]")
_HAS_OTHER = re.compile(f"[{chr(_LATIN_END)}-{chr(0x10FFFF)}]")


def _latin(kind: str) -> str:
    """A character class of the characters below U+0180 of a Unicode category."""
    return "".join(re.escape(chr(c)) for c in range(_LATIN_END) if unicodedata.category(chr(c))[0] == kind)


#: The pre-token pattern of the tokenizer file, as it reads for characters below U+0180.
_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|[^\s\x85{_latin('L')}{_latin('N')}]+")
_SPACE = re.compile(r"\s")
#: Characters whose pre-tokens are held at once, about.
SLICE_CHARS = 1 << 18
#: Pre-tokens in one call of the tokenizer.
_AT_ONCE = 512


class WordTokenizer:
    """A tokenizer that normalises and encodes each pre-token by itself, with the ids of pre-tokens kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # executors run one task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.separator_id, self.separator = next((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        whole, texts = len(texts), list(texts)
        owner = list(range(whole))
        if any(len(t) > SLICE_CHARS for t in texts):
            owner, texts = zip(*((i, part) for i, t in enumerate(texts) for part in self._slices(t)), strict=True)
        parts = [None if "<|" in t or _HAS_CONTROL.search(t) or not t.isascii() and _HAS_OTHER.search(t) else _PRE_TOKENS.findall(t.lower()) for t in texts]
        new = list(set().union(*filter(None, parts)).difference(self.known))
        self.known.update(zip(new, self._joined(new), strict=True))
        find = self.known.__getitem__
        out = [self._whole(t) if p is None else b"".join(map(find, p)) for t, p in zip(texts, parts, strict=True)]
        for x in new:
            if len(x) > CACHE_CHARS:
                del self.known[x]
        if whole == len(out):
            return out
        joined: list[list[bytes]] = [[] for _ in range(whole)]
        for i, ids in zip(owner, out, strict=True):
            joined[i].append(ids)
        return [b"".join(x) for x in joined]

    @staticmethod
    def _slices(text: str) -> Iterator[str]:
        """A text cut before white space, so that its pre-tokens need not all be held at once. Texts that go to the tokenizer whole are not cut."""
        if len(text) <= SLICE_CHARS or "<|" in text or _HAS_CONTROL.search(text) or _HAS_OTHER.search(text):
            yield text
            return
        begin = 0
        while begin < len(text):
            end = _SPACE.search(text, begin + SLICE_CHARS)
            yield text[begin : end.start() if end else len(text)]
            begin = end.start() if end else len(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _joined(self, parts: list[str]) -> list[bytes]:
        """The ids of each pre-token: many at once, between separators, as a call costs more than a short text."""
        out: list[bytes] = []
        groups = [parts[k : k + _AT_ONCE] for k in range(0, len(parts), _AT_ONCE)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.separator.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = [-1, *np.flatnonzero(ids == self.separator_id).tolist(), len(ids)]
            out += [ids[i + 1 : j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(cuts) != len(group) + 1:
                raise ValueError("the separator is not a token of its own")
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece: a document's ids and the end id, cut only if longer than the capacity.

    ``tokenizer_path`` is a file on every machine; by default the public word-level BPE of the installed tokenizer package.
    """

    def run(texts: Texts, rows) -> list:
        import public_tokenizers

        words = tokenizer(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([END_ID], dtype="<u4").tobytes()
        out = []
        for ids in words.encode([t or "" for t in rows.column(rows.num_columns - 1).to_pylist()]):
            ids += end
            step = 4 * capacity
            out.append([{"piece": k // step, "start": k // 4, "length": (min(k + step, len(ids)) - k) // 4, "ids_crc32": zlib.crc32(ids[k : k + step])} for k in range(0, len(ids), step)])
        import pyarrow as pa

        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        return [pa.array(out, type=kind)]

    cut = map_texts(documents.select("doc_id", "text"), ["doc_id"], "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>", run)
    return cut.select("doc_id", F.inline("pieces"))


@dataclass
class Plan:
    """Where each length's ranks go: from rank ``first`` on, ``each`` in a sequence, at ``offset``, from sequence ``base`` on."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of ``histogram`` (length -> number of pieces). Equal sequences are planned as one group with a number."""
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: dict[int, list[tuple[int, tuple]]] = {}  # gap -> (sequences, pattern of (length, number))
    open_gaps: list[int] = []

    def put(gap: int, sequences: int, pattern: tuple) -> None:
        if sequences:
            if gap not in groups:
                bisect.insort(open_gaps, gap)
                groups[gap] = []
            groups[gap].append((sequences, pattern))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        c = left[n]
        k = bisect.bisect_right(large, capacity - n) - 1
        if k < 0:
            put(capacity - n, c, ((n, 1),))
            large.pop()
            continue
        p = large[k]
        pairs = c // 2 if p == n else min(c, left[p])
        if p == n:
            put(capacity - 2 * n, pairs, ((n, 2),))
            put(capacity - n, c % 2, ((n, 1),))
            large.pop()
            continue
        put(capacity - n - p, pairs, ((n, 1), (p, 1)))
        left[p] -= pairs
        left[n] -= pairs
        large = [m for m in large if left[m] > 0] if pairs else large

    for n in sorted((m for m in left if 3 * m <= capacity), reverse=True):
        c = left[n]
        while c:
            k = bisect.bisect_left(open_gaps, n)
            if k == len(open_gaps):
                fit = capacity // n
                put(capacity - fit * n, c // fit, ((n, fit),))
                put(capacity - c % fit * n, int(c % fit > 0), ((n, c % fit),))
                break
            gap = open_gaps[k]
            sequences, pattern = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], open_gaps[k]
            fit = gap // n
            full = min(sequences, c // fit)
            put(gap - fit * n, full, (*pattern, (n, fit)))
            c -= full * fit
            if full < sequences and c:
                put(gap - c * n, 1, (*pattern, (n, c)))
                full, c = full + 1, 0
            put(gap, sequences - full, pattern)

    used: dict[int, int] = {}
    rows, base = [], 0
    for gap in open_gaps:
        for sequences, pattern in groups[gap]:
            offset = 0
            for n, each in pattern:
                rows.append((n, used.get(n, 0), each, base, offset))
                used[n] = used.get(n, 0) + sequences * each
                offset += n * each
            base += sequences
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=base)


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """``cut`` (a written table) with each piece's rank (from 0) among the pieces of its length, without gathering a length in one task.

    Its partition deals a piece too, so that many rows of one id (or none) don't meet either.
    """
    buckets = max(1, total // RANKED_TOGETHER)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.spark_partition_id()), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = sizes.select("length", "bucket", (F.sum("size").over(Window.partitionBy("length").orderBy("bucket")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return dealt.withColumn("place", place).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "before", "place")


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(documents: DataFrame, *, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Texts longer than the capacity are cut into full pieces and a rest; all
    others stay whole. Repeated rows are packed each by itself. An empty table gives no rows. Null doc_ids are kept.
    Other columns play no part.
    """
    cut = written(pieces(documents, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    shared = cut.sparkSession.sparkContext.broadcast(plan(histogram, capacity))  # its size follows the capacity, not the corpus

    def place(batches):
        import pyarrow as pa

        p = shared.value
        starts = (p.length << 44) + p.first
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: B023, E731
            length, rank = get("length").to_numpy(), get("rank").to_numpy()
            at = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            nth = rank - p.first[at]
            sequence, offset = p.base[at] + nth // p.each[at], p.offset[at] + nth % p.each[at] * length
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("piece"), get("start"), get("length"), get("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(cut, sum(histogram.values())).mapInArrow(place, PACKED)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
