"""Spans: stretches of a stream with one format, in order of arrival, and the arithmetic of playing across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_spans(df: DataFrame, *, keys: list[str], order: list[str], fmt: list[str]) -> DataFrame:
    """Adds span_id, which counts the changes of format in each stream from 0, and frame_idx within the span."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in fmt:
        changed = changed | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("__new", F.when(first, 0).otherwise(F.when(changed, 1).otherwise(0)))
    spans = marked.withColumn("span_id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return spans.withColumn("frame_idx", F.row_number().over(Window.partitionBy(*keys, "span_id").orderBy(*order)) - 1)


def span_lengths(spans: DataFrame, *, keys: list[str], fmt: list[str]) -> DataFrame:
    return spans.groupBy(*keys, "span_id").agg(*[F.first(c).alias(c) for c in fmt], F.count("*").alias("n_frames"))


def samples_left(size: Column, read: Column, closed: Column, last: Column) -> Column:
    """What a reader knows of the rest of a span: a number once the span is closed, end_of_stream after the last, else unknown."""
    left = size - read
    return F.when(closed & (left > 0), left.cast("string")).when(closed & last, "end_of_stream").when(closed, "0").otherwise("unknown")


def pulls(out_count: Column, in_count: Column, input_rate: Column, output_rate: Column, pending: Column, ended: Column) -> Column:
    """Input samples to pull before the next output sample: what the rates demand, one at least while a change of span is pending, none after the end."""
    wanted = F.greatest(F.lit(0), F.ceil(out_count * input_rate / output_rate) - in_count)
    return F.when(ended, F.lit(0)).when(pending, F.greatest(F.lit(1), wanted)).otherwise(wanted).cast("long")


def output_span_length(n: Column, input_rate: Column, output_rate: Column) -> Column:
    """Output samples of a span where the rates make that exact (a whole ratio), else null."""
    exact = (n * output_rate) % input_rate == 0
    return F.when(exact, F.floor(n * output_rate / input_rate).cast("long"))
