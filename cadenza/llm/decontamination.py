"""Benchmark decontamination with suffix arrays of the training text.

Each block of documents is a shard. Its word suffixes are sorted into a suffix array, and every suffix of the benchmark
is binary-searched in it, which gives its longest verbatim match and all places of that match. The shard's array is
sparse: it holds the suffixes that begin with words some benchmark suffix begins with, since no other suffix can
match. Documents are never shuffled; the benchmark travels in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, map_texts, written
from .textkernels import ALNUM, Texts, U, blocks, doc_of, mix

WINDOW = 10
#: Bytes of benchmark text that one broadcast holds. A larger benchmark is searched in several passes, each whole.
BLOCK_BENCHMARK_BYTES = 32 << 20
#: Words that a suffix must share with a benchmark suffix to enter the sparse array (fewer where an item is shorter).
SEED = 3


class BenchmarkIndex:
    """The suffixes of one block of benchmark items, with each suffix's required length and item."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        arr = pa.array(texts, type=pa.large_string())
        self.ids = np.array([str(i) for i in ids], dtype=object)
        parts = [(a, b, t) for a, b, t in blocks(pa.record_batch([arr], ["text"]), limit=1 << 62)]
        words, counts = (np.zeros(0, dtype=U), np.zeros(len(ids), dtype=np.int64)) if not parts else word_hashes(parts[0][2])
        self.window, self.words = window, words
        doc = doc_of(counts)
        end = np.cumsum(counts)[doc] if len(words) else np.zeros(0, dtype=np.int64)
        at = np.arange(len(words))
        need = np.minimum(window, counts)[doc] if len(words) else at
        keep = end - at >= need
        self.at, self.need, self.item, self.end = at[keep], need[keep], doc[keep], end[keep]
        self.seed = int(min(SEED, self.need.min())) if len(self.at) else 0
        self.seeds, self.seed_of = np.unique(seed_hashes(words, self.at, self.seed), return_inverse=True) if self.seed else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    low = texts.lowered()
    starts, ends, counts = low.words(ALNUM)
    return low.hashes(starts, ends), counts


def seed_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=U)
    for j in range(k):
        out = mix(out * U(0x9FB21C651E98DF25) + words[at + j])
    return out


def suffix_array(words: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that begin at ``at``, in the order of their first ``depth`` words' hashes; past its text's end a suffix has 0s."""
    columns = [padded(words, end, at, j) for j in range(depth)]
    return at[np.lexsort(columns[::-1])] if len(at) else at


def padded(words: np.ndarray, end: np.ndarray, at: np.ndarray, j: int) -> np.ndarray:
    inside = at + j < end[at]
    return np.where(inside, words[np.minimum(at + j, len(words) - 1)], U(0))


def search(words: np.ndarray, end: np.ndarray, array: np.ndarray, index: BenchmarkIndex, suffix: np.ndarray, upper: bool) -> np.ndarray:
    """For each benchmark suffix of ``suffix`` the first place in ``array`` whose suffix is not below it (or, ``upper``, above it) on its required words."""
    begin, need = index.at[suffix], index.need[suffix]
    lo, hi = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(array), dtype=np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        at = array[np.minimum(mid, len(array) - 1)]
        below, level = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
        for j in range(index.window):
            used = level & (j < need)
            there = padded(words, end, at, j)
            mine = index.words[np.minimum(begin + j, len(index.words) - 1)]
            below |= used & (there < mine)
            level &= ~used | (there == mine)
        right = (below | (level & upper)) & (lo < hi)
        lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
    return lo


def matches(words: np.ndarray, counts: np.ndarray, index: BenchmarkIndex) -> tuple[np.ndarray, np.ndarray]:
    """All verbatim matches of required length in a shard: the word each begins at, and the benchmark suffix's number."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words) or not index.seed:
        return none, none
    end = np.cumsum(counts)[doc_of(counts)]
    at = np.flatnonzero(end - np.arange(len(words)) >= index.seed)
    hashes = seed_hashes(words, at, index.seed)
    place = np.minimum(np.searchsorted(index.seeds, hashes), len(index.seeds) - 1)
    known = index.seeds[place] == hashes
    array = suffix_array(words, end, at[known], index.window)
    # A suffix whose first words are not in the shard has no place in it.
    here = np.zeros(len(index.seeds), dtype=bool)
    here[place[known]] = True
    sought = np.flatnonzero(here[index.seed_of])
    lo, hi = search(words, end, array, index, sought, False), search(words, end, array, index, sought, True)
    n = hi - lo
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return array[np.repeat(lo, n) + nth], np.repeat(sought, n)


def longest(words: np.ndarray, counts: np.ndarray, index: BenchmarkIndex, at: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The full verbatim length in words of each match, which may be more than the required length."""
    end = np.cumsum(counts)[doc_of(counts)] if len(words) else at
    length, live = index.need[suffix].astype(np.int64), np.arange(len(at))
    while len(live):
        p, q = at[live] + length[live], index.at[suffix[live]] + length[live]
        ok = (p < end[at[live]]) & (q < index.end[suffix[live]])
        live, p, q = live[ok], p[ok], q[ok]
        live = live[words[p] == index.words[q]]
        length[live] += 1
    return length


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int = BLOCK_BENCHMARK_BYTES) -> Iterator[BenchmarkIndex]:
    """The benchmark in blocks of about ``block_bytes``; each is fetched when its pass is planned."""
    b = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    size = b.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = (b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)).collect()
        yield BenchmarkIndex([r["item"] for r in rows], [r["text"] for r in rows], window)


SPANS = "doc_id long, n_words long, hits array<struct<start:long,length:long,item:string>>"


def find_matches(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BENCHMARK_BYTES) -> list[DataFrame]:
    """One frame for each benchmark block: the document, its number of words, and its matches (first word, longest length, item)."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return [docs.mapInArrow(_spans(docs.sparkSession.sparkContext.broadcast(index)), SPANS) for index in benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)]


def _spans(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for first, last, texts in blocks(batch):
                words, counts = word_hashes(texts)
                at, suffix = matches(words, counts, index)
                length = longest(words, counts, index, at, suffix)
                begin, doc = np.cumsum(counts) - counts, doc_of(counts)
                order = np.lexsort((suffix, at))
                at, suffix, length = at[order], suffix[order], length[order]
                where = doc[at] if len(at) else at
                cuts = np.searchsorted(where, np.arange(len(counts) + 1))
                struct = pa.StructArray.from_arrays([pa.array(at - begin[where] if len(at) else at), pa.array(length), pa.array(index.ids[index.item[suffix]].tolist(), type=pa.string())], fields=list(schema.field("hits").type.value_type))
                hits = pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.int64()), pa.array(counts.astype(np.int64)), hits], schema=schema)

    return run


def _covered(words: np.ndarray, counts: np.ndarray, index: BenchmarkIndex) -> tuple[np.ndarray, list[set]]:
    """Which words the longest matches cover, and each text's items."""
    at, suffix = matches(words, counts, index)
    # All windows inside a longest match are matches too, so it covers what they cover.
    length = longest(words, counts, index, at, suffix)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    found: list[set] = [set() for _ in counts]
    doc = doc_of(counts)
    for d, item in zip(doc[at].tolist() if len(at) else [], index.ids[index.item[suffix]].tolist(), strict=True):
        found[d].add(item)
    return np.cumsum(cover[:-1]) > 0, found


PASS = "doc_id long, text string, hit binary, items array<string>"
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _pass(shared, last: bool):
    """One benchmark block over rows of PASS: its hit words and items join those of earlier blocks. The last pass reports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for first, end, texts in blocks(batch, 1):
                words, counts = word_hashes(texts)
                hit, items = _covered(words, counts, index)
                cuts = np.append(0, np.cumsum(counts))
                rows = batch.slice(first, end - first)
                for d, (bits, names) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                    if names:
                        hit[cuts[d] : cuts[d + 1]] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=int(counts[d])).astype(bool)
                        items[d].update(names)
                if not last:
                    bits = [np.packbits(hit[a:b]).tobytes() if i else None for a, b, i in zip(cuts[:-1].tolist(), cuts[1:].tolist(), items, strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(bits, type=pa.binary()), pa.array([sorted(x) for x in items], type=pa.list_(pa.string()))], names=["doc_id", "text", "hit", "items"])
                    continue
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = (total[cuts[1:]] - total[cuts[:-1]]).astype(np.int64)
                shas = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in items], type=pa.int64()), pa.array(shas, type=pa.string()), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BENCHMARK_BYTES) -> DataFrame:
    """A report for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are lower-cased letters and digits. A benchmark window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. A document word inside any occurrence of a window counts as hit.

    Null or empty text, in documents or benchmark, has no words: such a document is not contaminated and such an item
    never occurs. Texts are taken whole, however long. A null id is kept as null. Repeated rows are judged each by
    itself. An empty benchmark marks nothing. Two items with the same id count once. Other columns of either table,
    whatever their names, play no part.

    A benchmark of more than ``block_bytes`` takes a pass for each block. Only one block is held at a time; between
    passes the rows are written with what was found so far.
    """
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    sc, shared = rows.sparkSession.sparkContext, None
    for index in benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes):
        if shared is not None:
            rows = written(rows.mapInArrow(_pass(shared, False), PASS), "hits")
            shared.unpersist()
        shared = sc.broadcast(index)
    return rows.mapInArrow(_pass(shared, True), REPORT)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BENCHMARK_BYTES) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark window; all columns as they are.

    Each row is judged by its own text, so ids may be null or repeated. A pass for each benchmark block, as in :func:`contamination`.
    """
    sc, shared = documents.sparkSession.sparkContext, None
    name = free_name("clean", documents.columns)

    def clean(rows: DataFrame, index) -> DataFrame:
        def run(texts: Texts, _rows) -> list:
            words, counts = word_hashes(texts)
            at, _ = matches(words, counts, index.value)
            return [np.bincount(doc_of(counts)[at], minlength=texts.n) == 0 if len(at) else np.ones(texts.n, dtype=bool)]

        return map_texts(rows, rows.columns, f"`{name}` boolean", run, text_col=text_col).where(F.col(name)).drop(name)

    for index in benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes):
        if shared is not None:
            documents = written(clean(documents, shared), "clean")
            shared.unpersist()
        shared = sc.broadcast(index)
    return clean(documents, shared)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
