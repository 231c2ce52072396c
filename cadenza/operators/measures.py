"""Measures of signals and of the difference between two of them, as grouped aggregates over long rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def sanitised(x: Column) -> Column:
    """The sample, or 0 where it is not finite."""
    return F.when(finite(x), x).otherwise(F.lit(0.0))


def seed_peak(x: Column) -> Column:
    """Aggregate: the largest magnitude, NaN left out; 0 for nothing."""
    return F.coalesce(F.max(F.when(~F.isnan(x), F.abs(x))), F.lit(0.0))


def edge_trimmed_error(pairs: DataFrame, *, keys: list[str], index: str, a: str, b: str) -> DataFrame:
    """Mean and peak absolute error with min(max(n div 100, 64), n div 4) frames left out at each end."""
    sized = pairs.groupBy(*keys).agg(F.count("*").alias("n"))
    trim = F.expr("least(greatest(n div 100, 64), n div 4)")
    inner = pairs.join(sized, keys).where((F.col(index) >= trim) & (F.col(index) < F.col("n") - trim))
    error = F.abs(F.col(a) - F.col(b))
    return inner.groupBy(*keys).agg(F.avg(error).alias("mean_error"), F.max(error).alias("peak_error"))


def autocorrelation(long: DataFrame, depth: int, *, keys: list[str], index: str = "frame_idx", sample: str = "sample") -> DataFrame:
    """Sums of products at the lags 0 to depth: keys, lag, r. An equi-join on the shifted index, so work is depth times the samples."""
    left = long.select(*keys, F.col(index).alias("i"), F.col(sample).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    right = long.select(*keys, F.col(index).alias("j"), F.col(sample).alias("y"))
    return left.join(right, [*keys, "j"]).groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("r"))


def channel_md5(samples: Column) -> Column:
    """The MD5 of an array of samples as little-endian 32-bit floats: equal only if all samples are, bit for bit."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def digest(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else hashlib.md5(np.asarray(x, dtype="<f4").tobytes()).hexdigest())

    return digest(samples)
