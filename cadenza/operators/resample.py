"""Resampling of DataFrames of signals.

Two forms give the same samples. ``resample`` works on planar rows, one for each track and channel with its samples as
an array: a map without a shuffle, right when tracks fit in a task's memory. ``resample_long`` works on one row for each
sample: frames become independent rows, so one long track spreads over the cluster, and overlap-add is a grouped sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.plans.config import Config, ResampleError

from .kernel import last_frame, resample_signal, start_context, transform


def _arrow_map(source: DataFrame, keep: list[str], work, out_type: str = "array<double>", out_name: str = "samples") -> DataFrame:
    """Maps rows to one new array column in Arrow batches; ``work`` gets a row's other columns as NumPy arrays (or None)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    others = [c for c in source.columns if c not in keep]
    out = StructType([*source.select(*keep).schema.fields, *StructType.fromDDL(f"`{out_name}` {out_type}").fields])
    schema = to_arrow_schema(out)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            made = [work(*[None if not c[i].is_valid else (c[i].values.to_numpy(zero_copy_only=False) if hasattr(c[i], "values") else c[i].as_py()) for c in columns]) for i in range(batch.num_rows)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, pa.array(made, type=schema.field(out_name).type)], schema, strict=True)], schema=schema)

    return source.mapInArrow(run, out)


def resample(planar: DataFrame, config: Config, *, samples: str = "samples", pre: str | None = None, post: str | None = None, channels: str | None = None) -> DataFrame:
    """``planar`` with the array column ``samples`` resampled; ``pre`` and ``post`` name array columns of context, which go.

    Null arrays stay null, empty ones empty. With equal rates and no phase the plan is the input itself. If ``channels``
    names a column, a row whose number there is not the configuration's ends the job with WrongChannelCount.
    """
    config.validated()
    if channels:
        wrong = F.raise_error(F.concat(F.lit("WrongChannelCount: a track has "), F.col(channels), F.lit(f" channels, the configuration {config.channels}")))
        planar = planar.withColumn(channels, F.when(F.col(channels) == config.channels, F.col(channels)).otherwise(wrong.cast(planar.schema[channels].dataType)))
    context = [c for c in (pre, post) if c]
    if config.passthrough:
        return planar.drop(*context)
    keep = [c for c in planar.columns if c not in (samples, *context)]
    source = planar.select(*keep, F.col(samples).cast("array<double>").alias("__x"), *[(F.col(c).cast("array<double>") if c else F.lit(None).cast("array<double>")).alias(n) for c, n in ((pre, "__pre"), (post, "__post"))])
    out = _arrow_map(source, keep, lambda x, a, b: None if x is None else resample_signal(x, config, a, b), out_name=samples)
    return out.select(*[c for c in planar.columns if c not in context])


def with_context(planar: DataFrame, config: Config, *, album: list[str], order: str, samples: str = "samples") -> DataFrame:
    """Adds columns pre and post: the end of the previous track and the head of the next one of the album.

    The window's rows hold a track's first and last chunk, not its samples; those meet again by album and order, which
    must name a track (of several of one name, one gives the context).
    """
    c = config.geometry.chunk_in
    n = F.least(F.lit(c), F.size(samples))
    ends = planar.select(*album, order, F.when(n > 0, F.slice(samples, -n, n)).otherwise(F.col(samples)).alias("__tail"), F.slice(samples, 1, c).alias("__head")).dropDuplicates([*album, order])
    w = Window.partitionBy(*album).orderBy(order)
    names = {k: f"__{k}" for k in (*album, order)}
    context = ends.select(*[F.col(k).alias(v) for k, v in names.items()], F.lag("__tail").over(w).alias("pre"), F.lead("__head").over(w).alias("post"))
    return planar.drop("pre", "post").join(context, _same(names), "left").drop(*names.values())


def _same(names: dict[str, str]) -> Column:
    """Equal in all columns, nulls included."""
    out = F.lit(True)
    for a, b in names.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def resample_gapless(planar: DataFrame, config: Config, *, album: list[str], order: str, samples: str = "samples") -> DataFrame:
    """Every track resampled with its neighbours in the album as context, so that joints are seamless."""
    return resample(with_context(planar, config, album=album, order=order, samples=samples), config, samples=samples, pre="pre", post="post")


def resample_groups(planar: DataFrame, configs: dict[tuple[int, int], Config], *, channels: str = "channels", rate: str = "input_rate", samples: str = "samples", pre: str | None = None, post: str | None = None) -> DataFrame:
    """Tracks of mixed formats in one job: each row takes the configuration of its (channels, rate)."""
    keep = [c for c in planar.columns if c not in (samples, *(x for x in (pre, post) if x))]
    source = planar.select(*keep, F.col(samples).cast("array<double>").alias("__x"), *[(F.col(c).cast("array<double>") if c else F.lit(None).cast("array<double>")).alias(n) for c, n in ((pre, "__pre"), (post, "__post"))], F.col(channels).alias("__c"), F.col(rate).alias("__r"))

    def work(x, a, b, c, r):
        if (c, r) not in configs:
            raise ResampleError("WrongFormat", f"no configuration for {c} channels at {r}")
        return None if x is None else resample_signal(x, configs[c, r], a, b)

    return _arrow_map(source, keep, work, out_name=samples).select(*[c for c in planar.columns if c not in (pre, post)])


def chunked(long: DataFrame, config: Config, *, keys: list[str], index: str, sample: str) -> DataFrame:
    """Rows of one sample as rows of one chunk: keys, chunk_idx, seg (in order; the last may be short)."""
    c = config.geometry.chunk_in
    dealt = long.select(*keys, F.expr(f"`{index}` div {c}").alias("chunk_idx"), F.struct(F.col(index).alias("i"), F.col(sample).cast("double").alias("x")).alias("s"))
    # A group never holds more than one chunk.
    return dealt.groupBy(*keys, "chunk_idx").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("seg"))


#: Tracks whose lengths are broadcast at most.
BROADCAST_TRACKS = 500_000


def with_sizes(long: DataFrame, keys: list[str]) -> DataFrame:
    """``long`` (keys, i, x) with n, the samples of its track.

    The lengths are a partial sum in each task and one row a track; they are broadcast if the tracks are counted to be
    few. Beyond that the samples meet them in a join, where Spark splits a track of many samples.
    """
    names = {k: f"__{k}" for k in keys}
    n = long.groupBy(*keys).agg((F.max("i") + 1).alias("n")).select(*[F.col(k).alias(v) for k, v in names.items()], "n")
    few = n.limit(BROADCAST_TRACKS + 1).count() <= BROADCAST_TRACKS
    return long.join(F.broadcast(n) if few else n.hint("merge"), _same(names)).drop(*names.values())


def resample_long(long: DataFrame, config: Config, *, keys: list[str], index: str = "frame_idx", sample: str = "sample") -> DataFrame:
    """One row for each output sample: keys, index, sample. ``index`` must count from 0 without gaps in each track.

    Samples are shuffled to chunks and halves to blocks, each by track and number, so that no task holds a track. Planning
    counts the tracks. An empty table gives no rows; null samples count as not a number.
    """
    config.validated()
    if config.passthrough:
        return long.select(*keys, index, F.col(sample).cast("double").alias(sample))
    g, names = config.geometry, [*keys]
    c = g.chunk_in
    sized = with_sizes(long.select(*keys, F.col(index).alias("i"), F.col(sample).cast("double").alias("x")), keys)
    # The last chunk's prediction needs the chunk before it, whose samples go to both. A group never holds more than two chunks.
    own, last = F.expr(f"i div {c}"), F.expr(f"(n - 1) div {c}")
    dealt = sized.select(*keys, "n", F.explode(F.when(own + 1 == last, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk_idx"), F.struct("i", "x").alias("s"))
    chunks = dealt.groupBy(*keys, "chunk_idx").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("s")).alias("s"))
    part = lambda keep: F.transform(F.filter("s", keep), lambda s: s["x"])
    source = chunks.select(*keys, "chunk_idx", "n", part(lambda s: s["i"] >= F.col("chunk_idx") * c).alias("seg"), part(lambda s: s["i"] < F.col("chunk_idx") * c).alias("before"), (F.col("chunk_idx") == last).alias("last"))

    def frames(batches):
        import pyarrow as pa

        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            idx, last = get("chunk_idx").to_pylist(), get("last").to_pylist()
            rows, at, block = [], [], []
            for i in range(batch.num_rows):
                seg = get("seg")[i].values.to_numpy(zero_copy_only=False).astype(config.numpy_dtype)
                if idx[i] == 0:
                    rows.append(np.concatenate((np.zeros(g.chunk_in - g.offset_in), start_context(seg[: g.chunk_in], None, config))))
                    at.append(i)
                    block.append(-1)
                if len(seg) == g.chunk_in:
                    rows.append(seg)
                    at.append(i)
                    block.append(idx[i])
                if last[i]:
                    before = get("before")[i].values.to_numpy(zero_copy_only=False).astype(config.numpy_dtype)
                    short = len(seg) % g.chunk_in
                    rows.append(last_frame(np.concatenate((before, seg)) if short else seg, int(len(before) > 0 or not short), short, None, config))
                    at.append(i)
                    block.append(idx[i] + (0 if short else 1))
            out = transform(np.vstack(rows), config).astype(np.float64)
            halves = pa.ListArray.from_arrays(pa.array(np.arange(2 * len(rows) + 1) * g.chunk_out, type=pa.int32()), pa.array(out.ravel()))
            take = pa.array(np.repeat(at, 2))
            kept = [get(n).take(take) for n in names]
            number = np.repeat(block, 2) + np.tile([0, 1], len(rows))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(number, type=pa.int64()), halves, get("n").take(take)], names=[*names, "block", "y", "n"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema.fields)
    halves = source.mapInArrow(frames, f"{fields}, block long, y array<double>, n long")
    # Two halves meet in each block; adding them is a grouped sum with at most two rows a group.
    blocks = halves.where("block >= 0").groupBy(*keys, "block").agg(F.collect_list("y").alias("ys"), F.max("n").alias("n"))
    added = F.when(F.size("ys") > 1, F.zip_with(F.element_at("ys", 1), F.try_element_at("ys", F.lit(2)), lambda a, b: a + b)).otherwise(F.element_at("ys", 1))
    long_out = blocks.select(*keys, "block", added.alias("y"), "n").select(*keys, "block", "n", F.posexplode("y").alias("pos", sample))
    place = F.col("block") * g.chunk_out + F.col("pos") - g.offset_out
    size = F.expr(f"(n * {config.output_rate} + {config.input_rate - 1}) div {config.input_rate}")
    return long_out.withColumn(index, place).where((F.col(index) >= 0) & (F.col(index) < size)).select(*keys, index, sample)
