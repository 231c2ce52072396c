"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one vertex. Every vertex has a vector of minwise values. A tree's root deals
vertices to nodes by the minwise value at one chosen coordinate (at some nodes, two), so that a pair of the threshold's
similarity is expected to share one node at every depth; nodes with one vertex end there, large nodes branch again by
coordinates chosen from their path, and small nodes are compared exhaustively inside tasks, on 64-byte sketches.
Independent trees repeat this to reach the target recall.

What the sketches connect are candidate groups, much like the groups of near-duplicates looked for but somewhat larger.
Each vertex is in one candidate group only, so each full shingle set is read and sent once, and the links that count are
those that full sets of one candidate group confirm.

A group too large for a task, of nodes or of candidates, is first compared in blocks of its vertices; only vertices that
stay outside the group's main component are then compared with all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_right, forget, free_name, map_texts, merged_with, whole_groups, written
from .textkernels import LOWER, SPACED, Texts, U, in_doc, mix, shingles

#: Links: 100 * shared shingles >= THRESHOLD * all shingles of the two.
THRESHOLD = 80
#: Words of a shingle where no contract says otherwise.
WORDS = 5
#: Coordinates of the minwise vector; a sketch keeps a byte of each.
COORDINATES = 64
#: Independent trees, and how often a node chooses a second coordinate: 1 + 1/4 = 1/0.8 children a vertex, on average.
#: So the roots choose 15 coordinates, and a pair at the threshold shares none of their children with probability 0.2^15 = 3e-11.
TREES, SECOND = 12, 4
#: Nodes of at most so many vertices (0.7 MB of sketches) are compared exhaustively in a task; larger ones branch, at most DEPTH times.
SMALL, DEPTH = 8192, 3
#: Equal bytes of two sketches that make a candidate pair: at the threshold 51 of 64 are expected, under 32 has probability 2e-8.
AGREE = 32
#: Vertices and shingles of a candidate group that one task compares on full sets (a single set may be larger).
GROUP_VERTICES, GROUP_SHINGLES = 4000, 1_000_000

_SALTS = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))
_FACTORS = mix(_SALTS) | U(1)
#: (tree, coordinate) of each choice at the roots.
_ROOTS = [(t, c) for c, t in enumerate(t for t in range(TREES) for _ in range(1 + (t % SECOND == 0)))]


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in text order, and their number in each. A-Z is lower-cased; words end at white space."""
    low = Texts(LOWER[texts.data], texts.offsets)
    starts, ends, counts = low.words(SPACED)
    hashes, doc, _ = shingles(low.hashes(starts, ends), counts, words, short_as_one=True)
    _, first = np.unique(in_doc(hashes, doc), return_index=True)
    first.sort()
    return hashes[first], np.bincount(doc[first], minlength=texts.n)


def _names(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """A 64-bit name of each text's set; null for the empty set."""
    begin = np.cumsum(n) - n
    total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(hashes ^ U(0x5851F42D4C957F2D)), dtype=U)))
    return pa.array(mix(total[begin + n] - total[begin] + n.astype(U)).view(np.int64), mask=n == 0)


def minwise(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The minwise vector (uint32) of each set that is not empty."""
    begin = (np.cumsum(n) - n)[n > 0]
    mins = np.zeros((len(begin), COORDINATES), dtype=np.uint32)
    for j in range(COORDINATES) if len(begin) else ():
        mins[:, j] = np.minimum.reduceat((((hashes ^ _SALTS[j]) * _FACTORS[j]) >> U(32)).astype(np.uint32), begin)
    return mins


def root_keys(mins: np.ndarray) -> np.ndarray:
    """The children of all trees' roots that each vector goes to."""
    return np.stack([mix(mins[:, c].astype(U) + U(((t + 1) << 40) + (c << 34))) for t, c in _ROOTS], axis=1).view(np.int64)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), type=pa.int32()), pa.array(values))


def _sketch(words: int):
    def run(texts: Texts, _rows) -> list:
        hashes, n = shingle_sets(texts, words)
        some = n > 0
        mins = minwise(hashes, n)
        keys = root_keys(mins) if len(mins) else np.zeros((0, len(_ROOTS)), dtype=np.int64)
        sketch = np.zeros((texts.n, COORDINATES), dtype=np.uint8)
        sketch[some] = (mins & np.uint32(255)).astype(np.uint8)
        m = pa.Array.from_buffers(pa.binary(COORDINATES), texts.n, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
        return [n, _names(hashes, n), _lists(some * len(_ROOTS), keys.ravel()), m]

    return run


def _sets(words: int):
    def run(texts: Texts, _rows) -> list:
        hashes, n = shingle_sets(texts, words)
        return [_names(hashes, n), _lists(n, hashes.view(np.int64))]

    return run


class Sketches:
    """Sketches of one batch of vertices: which pairs agree enough to be candidates."""

    columns = ("n", "m")

    def __init__(self, n: pa.Array, m: pa.Array, threshold: int, agree: int):
        self.n = n.to_numpy()
        joined = b"".join(m.to_pylist())
        self.m = np.frombuffer(joined, dtype=np.uint8).reshape(len(self.n), COORDINATES)
        self.threshold, self.agree = threshold, agree

    def row_by_row(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For vertices ``a`` and ``b`` of equal number: whether the first is near the first, the second the second, and so on."""
        enough = 100 * np.minimum(self.n[a], self.n[b]) >= self.threshold * np.maximum(self.n[a], self.n[b])
        return enough & ((self.m[a] == self.m[b]).sum(axis=1) >= self.agree)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the vertices ``a`` (rows) are near which of ``b`` (columns)."""
        out = np.empty((len(a), len(b)), dtype=bool)
        for k in range(0, len(a), 32):
            x = a[k : k + 32]
            enough = 100 * np.minimum.outer(self.n[x], self.n[b]) >= self.threshold * np.maximum.outer(self.n[x], self.n[b])
            out[k : k + 32] = enough & ((self.m[x][:, None, :] == self.m[b][None, :, :]).sum(axis=2, dtype=np.uint8) >= self.agree)
        return out

    def components(self, at: np.ndarray) -> np.ndarray:
        """The component of each vertex of ``at``, as the place of its first vertex. Those reached are compared with those not reached yet only."""
        label, rest = np.full(len(at), -1), np.arange(len(at))
        while len(rest):
            label[rest[0]], new, rest = (i := rest[0]), rest[:1], rest[1:]
            while len(new) and len(rest):
                hit = self.near(at[new[:32]], at[rest]).any(axis=0)
                label[rest[hit]] = i
                new, rest = np.concatenate((new[32:], rest[hit])), rest[~hit]
        return label


class Sets:
    """Full shingle sets of one batch of vertices: which pairs reach the threshold."""

    columns = ("s",)

    def __init__(self, s: pa.Array, threshold: int, _agree: int):
        self.values = s.flatten().to_numpy()
        self.size = s.value_lengths().to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.threshold = threshold

    def _of(self, v: int) -> np.ndarray:
        return self.values[self.begin[v] : self.begin[v] + self.size[v]]

    def row_by_row(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if 100 * min(self.size[x], self.size[y]) >= self.threshold * max(self.size[x], self.size[y]):
                shared = len(np.intersect1d(self._of(x), self._of(y), assume_unique=True))
                out[k] = 100 * shared >= self.threshold * (self.size[x] + self.size[y] - shared)
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shared shingles of all pairs are counted by products of incidence matrices, a slice of the shingles at a time."""
        both = np.unique(np.concatenate((a, b)))
        n = len(both)
        of = np.repeat(np.arange(n), self.size[both])
        values = np.concatenate([self._of(x) for x in both.tolist()])
        order = np.argsort(values, kind="stable")
        values, of = values[order], of[order]
        column = np.cumsum(np.append(False, values[1:] != values[:-1]))
        several = np.bincount(column)[column] > 1
        of, column = of[several], np.unique(column[several], return_inverse=True)[1]
        at_a, at_b = np.searchsorted(both, a), np.searchsorted(both, b)
        shared, step = np.zeros((len(a), len(b)), dtype=np.float32), 2048
        edges = np.searchsorted(column, np.arange(0, int(column.max()) + 1 + step, step)) if len(column) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            slab = np.zeros((n, step), dtype=np.float32)
            slab[of[lo:hi], column[lo:hi] % step] = 1
            shared += slab[at_a] @ slab[at_b].T
        out = np.empty(shared.shape, dtype=bool)
        for k in range(0, len(a), 256):
            some = shared[k : k + 256].astype(np.float64)
            out[k : k + 256] = 100 * some >= self.threshold * (self.size[a[k : k + 256]][:, None] + self.size[b][None, :] - some)
        return out

    def components(self, at: np.ndarray) -> np.ndarray:
        return connected(self.near(at, at))


def connected(near: np.ndarray) -> np.ndarray:
    """The component of each vertex of a symmetric matrix of links, as the place of its first vertex."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            label[i], new = i, np.array([i])
            while len(new):
                new = np.flatnonzero(near[new].any(axis=0) & (label < 0))
                label[new] = i
    return label


def stars(key: np.ndarray, v: np.ndarray, items) -> tuple[np.ndarray, np.ndarray]:
    """What links within groups of equal ``key`` connect, as (vertex, least vertex of its component in the group)."""
    if not len(key):
        return v, v
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    component = np.repeat(first, count)
    alike = items.row_by_row(np.arange(len(key)), component) | (np.arange(len(key)) == component)
    for g in np.flatnonzero(~np.logical_and.reduceat(alike, first)).tolist():
        at = np.arange(first[g], first[g] + count[g])
        component[at] = at[items.components(at)]
    order = np.lexsort((v, component))
    head = np.append(True, component[order][1:] != component[order][:-1])
    least = v[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    other = least != v[order]
    return v[order][other], least[other]


LINKS = "a long, b long"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


class Groups:
    """Groups (key, v, the kind's columns) of vertices, and the links that connect what is near within each group."""

    def __init__(self, kind: type[Sketches] | type[Sets], threshold: int, agree: int, limit: int):
        self.kind, self.threshold, self.agree, self.limit = kind, threshold, agree, limit

    def items(self, table: pa.Table, prefix: str = ""):
        return self.kind(*(table.column(prefix + c).combine_chunks() for c in self.kind.columns), self.threshold, self.agree)

    def dealt(self, rows: DataFrame, by: list[str], columns: list[str], run: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
        """``run`` over tables that hold whole groups of ``by``."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, len(by)):
                yield run(table)

        return rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, "v").mapInArrow(each, LINKS)

    def small(self, groups: DataFrame) -> DataFrame:
        """Links of groups that fit in a task."""

        def run(table: pa.Table) -> pa.RecordBatch:
            return _pairs(*stars(table.column("key").to_numpy(), table.column("v").to_numpy(), self.items(table)))

        return self.dealt(groups, ["key"], ["v", *self.kind.columns], run)

    def in_blocks(self, groups: DataFrame) -> DataFrame:
        """Links within blocks of the vertices of large groups."""
        weigh = self.weight(groups)
        cut = groups.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / self.limit), F.ceil(F.sum(weigh) / GROUP_SHINGLES)).alias("blocks"))
        block = F.xxhash64("key", F.pmod(F.xxhash64("v", "key"), "blocks"))
        return self.small(groups.join(merged_with(cut), "key").select(block.alias("key"), "v", *self.kind.columns))

    def weight(self, groups: DataFrame) -> Column:
        """Shingles that a vertex brings to a task."""
        return F.size("s") if self.kind is Sets else F.lit(0)

    def mixed(self, groups: DataFrame, labels: DataFrame) -> DataFrame:
        """``groups`` with each vertex's label, without the groups that hold a single component; main: the group's most frequent label; outside: its vertices of other labels."""
        full = groups.join(merged_with(labels), "v", "left").withColumn("label", F.coalesce("label", "v"))
        main = full.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
        return full.join(merged_with(main), "key")

    def rest(self, groups: DataFrame) -> DataFrame:
        """Links between the labels of mixed groups: vertices outside the main component against all others, in blocks."""
        out = F.col("label") != F.col("main")
        weigh = self.weight(groups)
        blocks = lambda who: F.greatest(F.lit(1), F.ceil(F.count(F.when(who, 1)) / self.limit), F.ceil(F.sum(F.when(who, weigh)) / GROUP_SHINGLES)).cast("int")
        cut = groups.groupBy("key").agg(blocks(out).alias("left"), blocks(F.lit(True)).alias("all"))
        placed = groups.join(merged_with(cut), "key")
        columns = ["v", "label", *self.kind.columns]
        every = placed.select("key", *columns, F.pmod(F.xxhash64("v"), F.col("all")).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"), F.lit(False).alias("outer"))
        outer = placed.where(out).select("key", *columns, F.pmod(F.xxhash64("v", F.lit(1)), F.col("left")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(True).alias("outer"))

        def run(table: pa.Table) -> pa.RecordBatch:
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            items, v, label, outside = self.items(table), table.column("v").to_numpy(), table.column("label").to_numpy(), table.column("outer").to_numpy()
            a, b = [], []
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), key.shape[1]]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = np.arange(lo, hi)
                x, y = at[outside[lo:hi]], at[~outside[lo:hi]]
                if len(x) and len(y):
                    p, q = np.nonzero(items.near(x, y) & (label[x][:, None] != label[y][None, :]))
                    pair = np.sort(np.stack([label[x][p], label[y][q]], axis=1), axis=1)
                    # Labels are vertices, so one link between two labels stands for all of them.
                    pair = np.unique(pair, axis=0)
                    a.append(pair[:, 0])
                    b.append(pair[:, 1])
            none = np.zeros(0, dtype=np.int64)
            return _pairs(np.concatenate([none, *a]), np.concatenate([none, *b]))

        return self.dealt(every.unionByName(outer), ["key", "i", "j"], [*columns, "outer"], run)


class Join:
    """One run of the join: the tables it builds and their removal."""

    def __init__(self, documents: DataFrame, words: int, threshold: int, agree: int):
        self.words, self.threshold = words, threshold
        self.documents = documents
        self.nodes, self.candidates = Groups(Sketches, threshold, agree, SMALL), Groups(Sets, threshold, agree, GROUP_VERTICES)
        self.tables: list[DataFrame] = []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(df := written(df, name))
        return df

    def run(self) -> DataFrame:
        """doc_id, t (name of id and text), n_shingles, component_id, kept for every row."""
        rows = written(map_texts(self.documents, ["doc_id", "t"], "n_shingles long, v long, keys array<long>, m binary", _sketch(self.words)), "sketches")
        named = rows.where("v is not null and doc_id is not null")
        self.vertices = self.kept(named.groupBy("v").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("m").alias("m")), "vertices")
        labels = self.confirmed(self.candidate_groups())
        several = labels.unionByName(labels.select(F.col("label").alias("v"), "label").distinct())
        ids = several.join(merged_with(self.vertices.select("v", "least")), "v")
        least = ids.groupBy("label").agg(F.min("least").alias("component_id"))
        found = self.vertices.select("v", "least").join(merged_with(ids.select("v", "label").join(merged_with(least), "label").select("v", "component_id")), "v", "left").select("v", F.coalesce("component_id", "least").alias("component_id"))
        found = written(rows.select("doc_id", "t", "n_shingles", "v").join(merged_with(found), "v", "left").select("doc_id", "t", "n_shingles", *self.report()), "near")
        for table in (rows, *self.tables):
            forget(table)
        return found

    @staticmethod
    def report() -> list[Column]:
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return [component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")]

    def shared(self, dealt: DataFrame) -> DataFrame:
        """Nodes (key, v) of at least two vertices, with their size and the sketches."""
        sizes = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        return self.kept(dealt.join(merged_with(sizes), "key").join(merged_with(self.vertices.select("v", "n", "m")), "v").select("key", "v", "n", "m", "size"), "nodes")

    def candidate_groups(self) -> DataFrame:
        """Labels (v, label) of what candidate pairs in the trees' nodes connect; vertices that are their own label left out."""
        level = self.shared(self.vertices.select("v", F.explode("keys").alias("key")))
        links = self.kept(self.nodes.small(level.where(F.col("size") <= SMALL)), "links")
        large = level.where(F.col("size") > SMALL).select("key", "v", "n", "m")
        if large.isEmpty():
            return self.labels(links)
        links = self.kept(links.unionByName(self.nodes.in_blocks(large)), "links")
        for depth in range(DEPTH + 1):
            mixed = self.kept(self.nodes.mixed(large, self.labels(links)), "mixed")
            far = F.col("outside") > SMALL if depth < DEPTH else F.lit(False)
            # Few vertices outside the main component are compared with all others; a node with many branches.
            links = self.kept(links.unionByName(self.nodes.rest(mixed.where(~far))), "links")
            if mixed.where(far).isEmpty():
                return self.labels(links)
            second = F.when(F.pmod(F.xxhash64("key", F.lit("second")), F.lit(SECOND)) == 0, self.choice("key", 1))
            chosen = F.explode(F.array_compact(F.array(self.choice("key", 0), second)))
            dealt = mixed.where(far).select("v", "key", "m", chosen.alias("c"))
            level = self.shared(dealt.select("v", F.xxhash64("key", "c", F.substring("m", F.col("c") + 1, F.lit(1))).alias("key")))
            links = self.kept(links.unionByName(self.nodes.small(level.where(F.col("size") <= SMALL))), "links")
            large = level.where(F.col("size") > SMALL).select("key", "v", "n", "m")

    @staticmethod
    def choice(key: str, nth: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(nth)), F.lit(COORDINATES)).cast("int")

    def labels(self, links: DataFrame) -> DataFrame:
        self.tables.append(found := components(links))
        return found

    def confirmed(self, labels: DataFrame) -> DataFrame:
        """Labels (v, label) of what links confirmed on full sets connect within the groups that ``labels`` tells."""
        groups = labels.unionByName(labels.select(F.col("label").alias("v"), "label").distinct()).withColumnRenamed("label", "key")
        sized = groups.join(merged_with(self.vertices.select("v", "n", "least")), "v")
        weight = sized.groupBy("key").agg(((F.count("*") > GROUP_VERTICES) | ((F.sum("n") > GROUP_SHINGLES) & (F.count("*") > 2))).alias("large"))
        members = self.kept(sized.join(merged_with(weight), "key").select("key", "v", "n", "least", "large"), "members")
        links = self.kept(self.candidates.small(self.with_sets(members.where("not large"))), "links")
        if not members.where("large").isEmpty():
            large = self.kept(self.with_sets(members.where("large")), "sets")
            links = self.kept(links.unionByName(self.candidates.in_blocks(large)), "links")
            mixed = self.kept(self.candidates.mixed(large, self.labels(links)), "large")
            links = self.kept(links.unionByName(self.candidates.rest(mixed)), "links")
        return self.labels(links)

    def with_sets(self, members: DataFrame) -> DataFrame:
        """key, v and full set s of the vertices ``members``; their texts are read again, once."""
        ids = bounded_right(members.select(F.col("least").alias("doc_id")))
        read = map_texts(self.documents.join(ids, "doc_id", "left_semi"), [], "v long, s array<long>", _sets(self.words)).where("v is not null").dropDuplicates(["v"])
        return read.join(merged_with(members.select("v", "key")), "v").select("key", "v", "s")


def _found(documents: DataFrame, id_col: str, text_col: str, words: int, threshold: int, agree: int) -> DataFrame:
    doc_id, text = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    return Join(documents.select(doc_id, text, _row_name(id_col, text_col).alias("t")), words, threshold, agree).run()


def _row_name(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``documents``.

    A document's set holds its distinct ``words``-word shingles; a shorter text, but not none, is its whole sequence.
    Documents are linked when 100 * shared >= ``threshold`` * all, so a pair at the threshold itself is linked; a
    component's id is its smallest doc_id, and that document is kept. With ``agree`` 0 sketches rule out nothing, and all
    that share a node are compared on full sets.

    Null and empty texts have empty sets, are linked with nothing and are kept. Texts are taken whole, however long. Rows
    with a null doc_id are linked with nothing, get a null component and are kept. Repeated rows share a component; with
    one doc_id, all of them are kept. An empty table gives no rows. Other columns play no part.
    """
    return _found(documents, id_col, text_col, words, threshold, agree).drop("t")


def drop_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, agree: int = AGREE) -> DataFrame:
    """``documents`` with one document of each component; all columns as they are.

    Rows go by their id and text, so another text under the same id stays. Rows with a null id stay.
    """
    name = free_name("name", documents.columns)
    gone = _found(documents, id_col, text_col, words, threshold, agree).where("not kept").select(F.col("t").alias(name)).distinct()
    return documents.join(bounded_right(gone), _row_name(id_col, text_col) == F.col(name), "left_anti")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM d),
c AS (SELECT s, min(doc_id) AS v, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT v, n, hash(unnest(s)) AS h FROM c),
p AS (SELECT a.v AS a, b.v AS b FROM x a JOIN x b ON a.h = b.h AND a.v < b.v AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT v, v AS t FROM c UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a),
k AS (SELECT v, min(t) AS component FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k ON k.v = c.v
"""
