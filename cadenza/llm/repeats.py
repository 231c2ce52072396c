"""Exact removal of long repeated byte strings, and passages of many words that repeat.

A string of 400 bytes that starts anywhere else too is found without sorting suffixes. In each 400-byte window the
least k-gram hash marks an anchor; equal windows have equal anchors at the same place, so only windows of one anchor
class are ever compared. Neighbouring windows with one anchor form a run, and equal runs are counted by hash as one
type. A type seen twice is repeated as a whole. A type seen once, in a class with other types, is compared with them
window by window; that happens once for each end of a repeat, not for each byte.

Passages of more than 50 words are found the same way, with words for bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_right, forget, map_texts, written
from .textkernels import Texts, U, WordTexts, windowed_min

WIDTH = 400
#: Bytes of the anchor's k-gram.
GRAM = 48
#: Words of a passage, and of its anchor's k-gram.
PASSAGE, PASSAGE_GRAM = 51, 6
#: Classes of at most so many types are compared inside one task; larger ones by a distributed count of their windows.
MAX_CLASS = 20_000
#: Windows whose anchors are found at once; an anchor's place takes 24 bits.
_SPAN = 1 << 22
#: Bytes of types that one comparison takes, besides the class that passes it.
_COMPARE_BYTES = 2 << 20


def _window_anchors(texts: Texts, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all windows inside texts, each one's anchor, and the k-gram hash at each byte."""
    n, hashes = len(texts.data), texts.sliding(gram)
    valid = np.zeros(n + 1, dtype=np.int64)
    some = np.diff(texts.offsets) >= width
    np.add.at(valid, texts.offsets[:-1][some], 1)
    np.add.at(valid, texts.offsets[1:][some] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    anchors = np.zeros(len(starts), dtype=np.int64)
    for base in range(0, n, _SPAN):
        lo, hi = np.searchsorted(starts, (base, base + _SPAN))
        if lo == hi:
            continue
        span = width - gram + 1
        least = hashes[base : base + _SPAN + span - 1]
        least = windowed_min((least >> U(24) << U(24)) | np.arange(len(least), dtype=U), span)
        anchors[lo:hi] = (least[starts[lo:hi] - base] & U((1 << 24) - 1)).astype(np.int64) + base
    return starts, anchors, hashes


def runs(texts: Texts, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run, and its anchor's hash."""
    starts, anchors, hashes = _window_anchors(texts, width, gram)
    if not len(starts):
        return starts, starts, hashes[:0]
    cut = np.flatnonzero((anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1) | (starts[1:] % _SPAN == 0)) + 1
    first, last = np.append(0, cut), np.append(cut, len(starts)) - 1
    return starts[first], starts[last], hashes[anchors[first]]


def _lists(counts: np.ndarray, **columns) -> pa.ListArray:
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), type=pa.int32()), pa.StructArray.from_arrays(list(arrays.values()), names=list(arrays)))


def _runs_of(unit: type[Texts], width: int, gram: int):
    def run(texts: Texts, _rows) -> list:
        units = unit.of(texts) if unit is WordTexts else texts
        first, last, anchor = runs(units, width, gram)
        counts = np.diff(np.searchsorted(first, units.offsets))
        begin = np.repeat(units.offsets[:-1], counts)
        found = _lists(counts, h=anchor.view(np.int64), r=units.hashes(first, last + width).view(np.int64), p=(first - begin).astype(np.int32), q=(last - begin).astype(np.int32))
        return [found]

    return run


def _strings(unit: type[Texts], width: int):
    """The bytes or words of the runs that a text has to show, from its rows' column ``shown``."""

    def run(texts: Texts, rows) -> list:
        units = unit.of(texts) if unit is WordTexts else texts
        out = []
        for begin, shown in zip(units.offsets[:-1].tolist(), rows.column(0).to_pylist(), strict=True):
            out.append([{"h": x["h"], "big": x["big"], "open": x["open"], "p": x["p"], "s": units.data[begin + x["p"] : begin + x["q"] + width].tobytes()} for x in shown])
        return [pa.array(out, type=pa.list_(pa.struct([("h", pa.int64()), ("big", pa.bool_()), ("open", pa.bool_()), ("p", pa.int32()), ("s", pa.binary())])))]

    return run


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _type_windows(unit: type[Texts], strings: pa.Array, width: int) -> tuple[Texts, np.ndarray, np.ndarray]:
    """The types as a block, the start of each window in it, and the number of windows of each type."""
    _, ends, data = strings.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data, size = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], 8 if unit is WordTexts else 1
    block = unit(data, (offsets - offsets[0]) // size)
    n = np.diff(block.offsets) - width + 1
    starts = np.repeat(block.offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return block, starts, n


COMPARED = "t1 long, t2 long, first long, last long"


def _compare(unit: type[Texts], width: int):
    """Batches sorted by class in; for each open type the stretches of its windows that another type of its class has too."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        get = lambda k: table.column(k).combine_chunks()
        strings = get("s")
        block, starts, n = _type_windows(unit, strings, width)
        key = block.hashes(starts, starts + width)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        of = np.repeat(np.arange(len(n)), n)
        twice &= get("open").to_numpy(zero_copy_only=False)[of]
        a, b = _ranges(twice)
        # A stretch may run on into the next type; it is cut where types begin.
        heads = np.cumsum(n) - n
        cuts = np.unique(np.concatenate((a, heads[twice[np.minimum(heads, len(twice) - 1)]])))
        ends = np.minimum(b[np.searchsorted(b, cuts, side="right")], (heads + n)[of[cuts]]) if len(cuts) else cuts
        t = of[cuts] if len(cuts) else cuts
        shift = get("p").to_numpy()[t] - heads[t] if len(cuts) else cuts
        return pa.RecordBatch.from_arrays([pa.array(get("t1").to_numpy()[t]), pa.array(get("t2").to_numpy()[t]), pa.array(cuts + shift), pa.array(ends - 1 + shift)], names=["t1", "t2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(batch.schema.get_field_index("h")).to_numpy()
            edges = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            if held and held[-1].column(held[-1].schema.get_field_index("h"))[-1].as_py() != h[0] and size > _COMPARE_BYTES:
                yield finish(pa.Table.from_batches(held))
                held, size = [], 0
            begin = 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                size += int(pc.sum(pc.binary_length(part.column(part.schema.get_field_index("s")))).as_py())
                if size > _COMPARE_BYTES and b < len(h):
                    yield finish(pa.Table.from_batches([*held, batch.slice(begin, b - begin)]))
                    held, size, begin = [], 0, b
            if begin < len(h):
                held.append(batch.slice(begin))
        if held:
            yield finish(pa.Table.from_batches(held))

    return run


def _leaves(unit: type[Texts], width: int):
    """Every window of the types of large classes: its 128-bit hash, and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: B023, E731
            if not batch.num_rows:
                continue
            block, starts, n = _type_windows(unit, get("s"), width)
            of = np.repeat(np.arange(len(n)), n)
            at = starts - block.offsets[:-1][of] + get("p").to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(block.hashes(starts, starts + width, w).view(np.int64)) for w in (0, 1)] + [pa.array(get(k).to_numpy()[of]) for k in ("t1", "t2")] + [pa.array(at), pa.array(get("open").to_numpy(zero_copy_only=False)[of])], names=["w1", "w2", "t1", "t2", "first", "open"])

    return run


def _cut(width: int):
    """What is left of each text when its repeated windows' bytes are taken out."""

    def run(texts: Texts, rows) -> list:
        removed, spans, shas, kept = [], [], [], []
        for begin, end, windows in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), rows.column(2).to_pylist(), strict=True):
            cover = np.zeros(end - begin + 1, dtype=np.int32)
            for w in windows or ():
                cover[w["first"]] += 1
                cover[w["last"] + width] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            left = texts.data[begin:end][~gone].tobytes()
            removed.append(int(gone.sum()))
            spans.append(len(_ranges(gone)[0]))
            shas.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return [removed, spans, shas, pa.array(kept, type=pa.binary())]

    return run


class Windows:
    """The windows of ``width`` bytes or words that start elsewhere too, by text."""

    def __init__(self, docs: DataFrame, unit: type[Texts], width: int, gram: int, max_class: int):
        self.tables: list[DataFrame] = []
        long_enough = docs.where(F.octet_length("text") >= (width if unit is Texts else 2 * width - 1))
        every = map_texts(long_enough, ["t1", "t2"], "runs array<struct<h:long,r:long,p:int,q:int>>", _runs_of(unit, width, gram)).select("t1", "t2", F.inline("runs"))

        # The text that shows a type is named by one of its two hashes: a type seen once is in one text, and others are not compared for themselves.
        types = every.groupBy("h", "r").agg(F.count("*").alias("c"), F.min("t1").alias("shower"))
        # max(shower) keeps both uses of the types alike, so that they are computed and shuffled once.
        classes = types.groupBy("h").agg(F.count("*").alias("types"), F.sum("c").alias("n"), F.min("c").alias("fewest"), F.max("shower").alias("one")).where("n > 1 and one is not null").drop("one")
        wanted = self.kept(types.join(classes, "h").select("h", "r", "shower", (F.col("c") == 1).alias("open"), ((F.col("types") > 1) & (F.col("fewest") == 1)).alias("compared"), (F.col("types") > max_class).alias("big")), "types")

        shown = F.col("compared") & (F.col("t1") == F.col("shower"))
        marked = every.join(wanted, ["h", "r"]).select("t1", "t2", "h", "p", "q", "open", "big", shown.alias("shown")).where("shown or not open").distinct()
        by_text = marked.groupBy("t1", "t2").agg(
            F.collect_list(F.when(~F.col("open"), F.struct(F.col("p").alias("first"), F.col("q").alias("last")))).alias("whole"),
            F.collect_list(F.when(F.col("shown"), F.struct("h", "big", "open", "p", "q"))).alias("shown"),
        )
        by_text = by_text.select("t1", "t2", F.transform("whole", lambda x: F.struct(x["first"].cast("long").alias("first"), x["last"].cast("long").alias("last"))).alias("whole"), "shown")
        by_text = self.kept(by_text, "texts")
        texts = docs.join(bounded_right(by_text.select("t1").distinct()), "t1", "left_semi").select("text", "t1", "t2").dropDuplicates(["t1", "t2"])
        affected = self.kept(texts.join(by_text, ["t1", "t2"]), "affected")

        strings = self.kept(map_texts(affected.where(F.size("shown") > 0), ["shown", "t1", "t2"], "strings array<struct<h:long,big:boolean,open:boolean,p:int,s:binary>>", _strings(unit, width)).select("t1", "t2", F.inline("strings")), "strings")
        small = strings.where("not big").repartition("h").sortWithinPartitions("h").mapInArrow(_compare(unit, width), COMPARED)
        leaves = strings.where("big").mapInArrow(_leaves(unit, width), "w1 long, w2 long, t1 long, t2 long, first long, open boolean")
        twice = leaves.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        large = leaves.where("open").join(twice, ["w1", "w2"]).select("t1", "t2", "first", F.col("first").alias("last"))
        ends = small.unionByName(large).groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("ends"))
        joined = affected.join(ends, ["t1", "t2"], "left").withColumn("windows", F.concat("whole", F.coalesce("ends", F.array().cast("array<struct<first:long,last:long>>"))))
        self.found = joined.where(F.size("windows") > 0)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(df := written(df, name))
        return df

    def forget(self) -> None:
        for table in self.tables:
            forget(table)


def _covered(width: int):
    """Words in repeated windows, and their maximal runs, from the rows' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, spans = [], []
            for windows in batch.column(2).to_pylist():
                total = runs_ = end = 0
                for a, b in sorted((w["first"], w["last"] + width) for w in windows):
                    total += max(0, b - max(a, end))
                    runs_ += a > end or not runs_
                    end = max(end, b)
                words.append(total)
                spans.append(runs_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, type=pa.int64()), pa.array(spans, type=pa.int64())], names=["t1", "t2", "n_passage_words", "n_passages"])

    return run


def repeats(documents: DataFrame, *, width: int = WIDTH, passage: int = PASSAGE, max_class: int = MAX_CLASS, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, n_passages (and, ``with_kept``, the bytes left) of each row of ``documents``.

    Every byte covered by a ``width``-byte string that also starts anywhere else in the corpus, in the same text or
    another, is removed; strings are judged on the input. n_passage_words counts the words covered by ``passage`` words
    in a row that stand anywhere else too, n_passages their maximal runs; words end at white space, which may differ.
    Passages are reported, not removed, so those shorter than ``width`` bytes show there alone.

    Null counts as empty; texts shorter than ``width`` lose nothing. Repeated rows are repeats of each other. Null ids
    are kept as they are. Texts are taken whole, however long. An empty table gives no rows. Other columns play no part.
    Removal is by bytes, so what is left need not be whole characters.
    """
    text = F.col("text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    whole = F.coalesce(text, F.lit("")).cast("binary")
    digests = docs.select("doc_id", "t1", "t2", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"))
    strings = Windows(docs, Texts, width, GRAM if width > GRAM else max(1, width // 2), max_class)
    cut = written(map_texts(strings.found, ["t1", "t2", "windows"], "n_removed long, n_spans long, kept_sha256 string, kept binary", _cut(width)).drop("windows", *([] if with_kept else ["kept"])), "cut")
    strings.forget()
    words = Windows(docs, WordTexts, passage, PASSAGE_GRAM if passage > PASSAGE_GRAM else 1, max_class)
    passages = written(words.found.select("t1", "t2", "windows").mapInArrow(_covered(passage), "t1 long, t2 long, n_passage_words long, n_passages long"), "passages")
    words.forget()
    out = digests.join(cut, ["t1", "t2"], "left").join(passages, ["t1", "t2"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans", "n_passage_words", "n_passages")]
    columns = ["doc_id", "n_bytes", *counts[:2], F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *counts[2:]]
    return out.select(*columns, "kept") if with_kept else out.select(*columns)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
