"""Helpers that the training-data operators share: the scratch folder, written tables and bounded label samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``. Where that is unset a temporary folder serves, in local mode only: on a
    cluster a machine-local folder would lose rows, so that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    spark.sparkContext.setCheckpointDir(root)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table from :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def merged_with(df: DataFrame) -> DataFrame:
    """``df`` as a join's right side, never broadcast: its size follows the corpus, and a table's files tell too little of its size in memory."""
    return df.hint("merge")


#: Rows of one 64-bit column that are broadcast at most: some 32 MB as a hash table.
BROADCAST_IDS = 1_000_000


def bounded_right(ids: DataFrame) -> DataFrame:
    """``ids`` (one 64-bit column) as the right side of a semi or anti join: broadcast if they are counted to be few enough, else merged."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else merged_with(ids)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it while a column has that name (in any case of letters)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


#: Bytes of whole groups that are handed on at once.
_GROUP_BYTES = 1 << 20


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first ``keys`` columns (integers); a table ends where a group does."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(keys)])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if last is not None and (key[:, 0] != last).any():
            edges = np.append(0, edges)
        begin = 0
        if len(edges) and size + batch.nbytes >= _GROUP_BYTES:
            # Large batches end a table at every so many rows, so that no table is much larger than the bound.
            step = max(1, int(batch.num_rows * _GROUP_BYTES / max(batch.nbytes, 1)))
            for at in edges[np.unique(np.minimum(np.searchsorted(edges, np.arange(0, batch.num_rows + step, step)), len(edges) - 1))].tolist():
                if held or at > begin:
                    yield pa.Table.from_batches([*held, *([batch.slice(begin, at - begin)] if at > begin else [])])
                held, size, begin = [], 0, at
        held.append(batch.slice(begin))
        size += held[-1].nbytes
        last = key[:, -1]
    if held:
        yield pa.Table.from_batches(held)


#: Bytes of rows that go to a Python worker at once: a few blocks of texts (``textkernels.BLOCK_BYTES``).
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch for the session's plans, unless it has a bound already.

    Spark counts the rows of a batch alone, so its memory would follow the length of the texts: 10,000 rows of 2 KB are
    20 MB, which both sides hold several times, and rows of 100 KB are 1 GB. A longer row is a batch of its own. Plans
    read the setting when they run, so it stays set.
    """
    if int(spark.conf.get(_BATCH_CONF, None) or -1) <= 0:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``: the fold a document belongs to."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def bounded_ids(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``ids``, chosen by the hash of doc_id: repeatable, and small enough to broadcast by construction."""
    return F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def map_texts(df: DataFrame, keep: list[str], made: str, fn, text_col: str = "text", limit: int | None = None) -> DataFrame:
    """Arrow-batched map over texts: ``keep`` columns unchanged, then the columns of DDL ``made`` as ``fn(texts, rows)`` gives them.

    ``fn`` gets a block of texts and the record batch of its rows, the text last, and returns a list or array for each
    made column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [F.col(f"`{k}`") for k in keep]
    source = df.select(*kept, F.col(f"`{text_col}`").alias(free_name("text", keep)))
    out = StructType([*df.select(*kept).schema.fields, *StructType.fromDDL(made).fields])
    schema = to_arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        from .textkernels import BLOCK_BYTES, blocks

        for batch in batches:
            for first, last, texts in blocks(batch, len(keep), limit=limit or BLOCK_BYTES):
                rows = batch.slice(first, last - first)
                columns = [rows.column(i) for i in range(len(keep))] + [pa.array(x) if not isinstance(x, pa.Array) else x for x in fn(texts, rows)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return source.mapInArrow(run, out)
