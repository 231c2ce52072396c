"""The resampler in SQL, as a table function: SELECT * FROM tracks, LATERAL resample(samples, 44100, 48000, 'good')."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cadenza.operators.kernel import resample_signal
from cadenza.plans.config import preset


@udtf(returnType="pos: long, sample: double")
class Resample:
    """One row for each output sample of one channel. A null array gives no rows; wrong arguments end the query with their error."""

    def eval(self, samples, input_rate: int, output_rate: int, name: str = "good"):
        import numpy as np

        config = preset(name).with_rates(input_rate, output_rate).with_channels(1).validated()
        if samples is not None:
            for pos, sample in enumerate(resample_signal(np.asarray(samples, dtype=np.float64), config).tolist()):
                yield pos, sample


def register(spark: SparkSession, name: str = "resample") -> None:
    """Makes the table function known to ``spark``'s SQL."""
    spark.udtf.register(name, Resample)
