"""Between interleaved, planar and long layouts of multi-channel signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deinterleave(df: DataFrame, channels: int, *, samples: str = "samples") -> DataFrame:
    """One row for each channel: all other columns, channel (from 0), samples. The length must be a multiple of the channels."""
    whole = F.assert_true(F.size(samples) % channels == 0, F.lit("MalformedInputLength: the length is not a multiple of the channels"))
    one = lambda c: F.transform(F.when(F.size(samples) >= channels, F.sequence(F.lit(0), (F.size(samples) / channels).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(samples, i * channels + c))
    checked = df.where(F.coalesce(whole.cast("boolean"), F.lit(True)))
    others = [c for c in df.columns if c != samples]
    return checked.select(*others, F.posexplode(F.array(*[one(c) for c in range(channels)])).alias("channel", samples))


def deinterleave_long(df: DataFrame, channels: int, *, keys: list[str], samples: str = "samples") -> DataFrame:
    """One row for each sample: keys, channel, frame_idx, sample."""
    return df.select(*keys, F.posexplode(samples).alias("p", "sample")).select(*keys, (F.col("p") % channels).alias("channel"), F.expr(f"cast(p div {channels} as int)").alias("frame_idx"), "sample")


def interleave(planar: DataFrame, *, keys: list[str], channel: str = "channel", samples: str = "samples", sample: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each track: keys, samples merged frame by frame, each passed through ``sample`` if given. Channels must be of one length."""
    rows = planar.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(samples).alias("s")))), lambda x: x["s"]).alias("chs"))
    frames = F.size(F.element_at("chs", 1))
    merged = F.flatten(F.transform(F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.transform("chs", lambda c: F.get(c, i))))
    level = F.assert_true(F.size(F.array_distinct(F.transform("chs", F.size))) == 1, F.lit("WrongFrameCount: channels differ in length"))
    return rows.where(F.coalesce(level.cast("boolean"), F.lit(True))).select(*keys, (F.transform(merged, sample) if sample else merged).alias(samples))


def to_long(planar: DataFrame, *, keys: list[str], samples: str = "samples") -> DataFrame:
    """Planar rows as one row for each sample: keys, frame_idx, sample."""
    return planar.select(*keys, F.posexplode(samples).alias("frame_idx", "sample"))
