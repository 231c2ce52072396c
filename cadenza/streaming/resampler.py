"""Resampling of streams: samples arrive in batches of any size, state carries what the block transform needs across them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.kernel import Stream
from cadenza.plans.config import Config


def resample_stream(stream: DataFrame, config: Config, *, keys: list[str], order: list[str], sample: str, end: str | None = None, fmt: str | None = None, configs: dict | None = None) -> DataFrame:
    """A streaming DataFrame of output samples: keys, span_id, n (place in the span's output), sample, is_underrun.

    Rows of a track are taken by arrival, and by ``order`` within a batch. A row whose ``end`` column is true closes the
    track after its sample (null: no sample) and flushes what is left; rows after it begin a new span. A change of the
    column ``fmt`` closes the span and begins one with the configuration that ``configs`` has for the new value.
    Memory and state of a track are a chunk, its predecessor and half a window, however long the stream is.
    """
    config.validated()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*keys).schema.fields)
    rows = stream.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(sample).cast("double").alias("__x"), (F.col(end) if end else F.lit(False)).alias("__end"), (F.col(fmt) if fmt else F.lit(None).cast("string")).alias("__fmt"))
    by = [f"__o{i}" for i in range(len(order))]

    def work(key: tuple, batches: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        live, span, form = pickle.loads(state.get[0]) if state.exists else (None, -1, None)
        taken = pd.concat(list(batches), ignore_index=True)
        taken = taken.sort_values(by, kind="stable") if by else taken
        out = []

        def emit(samples: np.ndarray, primed: bool) -> None:
            if len(samples):
                out.append(pd.DataFrame({**{k: [v] * len(samples) for k, v in zip(keys, key, strict=True)}, "span_id": span, "n": np.arange(live.n_out - len(samples), live.n_out), "sample": samples.astype(np.float64), "is_underrun": not primed}))

        x, stop, kind = taken["__x"].to_numpy(dtype=float), taken["__end"].fillna(False).to_numpy(dtype=bool), taken["__fmt"].to_numpy(dtype=object)
        cut = np.flatnonzero(stop[:-1] | (kind[1:] != kind[:-1])) + 1 if len(x) > 1 else []
        for part in np.split(np.arange(len(x)), cut):
            if live is not None and live.n_in and fmt and kind[part[0]] != form:
                emit(_finish(live, config), True)
                live = None
            if live is None:
                live, span, form = Stream((configs or {}).get(kind[part[0]], config)), span + 1, kind[part[0]]
            given = x[part][~pd.isna(taken["__x"].to_numpy()[part])]
            before = live.n_out
            emit(live.push(given), live.primed or before > 0)
            if stop[part[-1]]:
                emit(_finish(live, config), True)
                live = None
        state.update((pickle.dumps((live, span, form)),))
        yield from out

    def _finish(live: Stream, _config: Config):
        samples = live.finish()
        if live.config.passthrough:
            return samples[:0]
        live.n_out = live.config.output_size(live.n_in)
        return samples

    return rows.groupBy(*keys).applyInPandasWithState(work, f"{fields}, span_id long, n long, sample double, is_underrun boolean", "state binary", "append", "NoTimeout")


def run_available(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything there is now, written to ``path`` and read from it. A later call with the same ``checkpoint`` goes on from there."""
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)
