"""Resampling in SQL alone: samples joined with a table of kernel weights, and a grouped sum.

The kernel table has chunk_in x 2 chunk_out rows, which the configuration bounds. It is built by SQL from the spectrum
definition, so the whole plan is Catalyst's; for chunks too large for a table the frame transform is the way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans.config import Config, ResampleError

#: Kernel rows that are broadcast at most.
MAX_KERNEL_ROWS = 2_000_000


def kernel_sql(config: Config, engine: str = "spark") -> str:
    """A query for the kernel: j (place in the chunk), n (place in the two output chunks), w (weight).

    Output n is the cosine sum of the tapered spectrum of a unit sample at j; bin 0 and the last output bin count once,
    the others twice.
    """
    g = config.geometry
    bins = min(g.chunk_in, g.chunk_out) + 1
    numbers = (lambda n: f"(SELECT explode(sequence(0, {n - 1})) AS v)") if engine == "spark" else (lambda n: f"(SELECT unnest(range({n})) AS v)")
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    curve = "CASE k.v " + " ".join(f"WHEN {i} THEN {d(float(v))}" for i, v in enumerate(config.taper_curve[:bins])) + " END"
    time = f"2 * pi() * k.v * (CAST(n.v AS DOUBLE) / {g.fft_out} - (CAST(j.v AS DOUBLE) + {g.offset_in}) / {g.fft_in})"
    wave = f"cos({time})"
    if config.rotation is not None:
        angle = "CASE k.v " + " ".join(f"WHEN {i} THEN {d(float(v))}" for i, v in enumerate(np.angle(config.rotation[:bins]))) + " ELSE 0 END"
        # Of bin 0 and the last output bin only the real part counts, and their output wave is real.
        wave = f"CASE WHEN k.v = 0 THEN cos({angle}) WHEN k.v = {g.chunk_out} THEN cos(pi() * n.v) * cos(({angle}) - 2 * pi() * k.v * (CAST(j.v AS DOUBLE) + {g.offset_in}) / {g.fft_in}) ELSE cos({time} + {angle}) END"
    return f"""SELECT j.v AS j, n.v AS n, sum(CASE WHEN k.v = 0 OR k.v = {g.chunk_out} THEN 1 ELSE 2 END * ({curve}) * {wave}) / {g.fft_out} * {d(g.scale)} AS w
FROM {numbers(g.chunk_in)} j CROSS JOIN {numbers(g.fft_out)} n CROSS JOIN {numbers(bins)} k GROUP BY j.v, n.v"""


def resample_sql(config: Config, source: str, keys: list[str], engine: str = "spark") -> str:
    """Output samples of ``source`` (keys, frame_idx, sample) that depend on whole chunks alone: keys, out_idx, sample.

    Block b needs the chunks b - 1 and b; the blocks at a signal's edges, which need prediction, are not returned.
    """
    g, by = config.geometry, ", ".join(keys)
    div = (lambda a, b: f"({a} div {b})") if engine == "spark" else (lambda a, b: f"({a} // {b})")
    return f"""WITH src AS ({source}), size AS (SELECT {by}, {div('count(*)', g.chunk_in)} AS chunks FROM src GROUP BY {by}), kernel AS ({kernel_sql(config, engine)}),
part AS (SELECT {', '.join('s.' + k for k in keys)}, {div('s.frame_idx', g.chunk_in)} + {div('k.n', g.chunk_out)} AS block, k.n % {g.chunk_out} AS m, z.chunks, s.sample * k.w AS y FROM src s JOIN kernel k ON s.frame_idx % {g.chunk_in} = k.j JOIN size z ON {' AND '.join(f's.{k} = z.{k}' for k in keys)} WHERE {div('s.frame_idx', g.chunk_in)} < z.chunks)
SELECT {by}, block * {g.chunk_out} + m - {g.offset_out} AS out_idx, sum(y) AS sample FROM part WHERE block >= 1 AND block < chunks GROUP BY {by}, block, m"""


def resample_by_join(spark: SparkSession, long: DataFrame, config: Config, keys: list[str]) -> DataFrame:
    """The kernel join as a DataFrame plan over ``long`` (keys, frame_idx, sample): each sample meets its 2 chunk_out weights, then a grouped sum.

    To shuffle chunks rather than products, a chunk's samples are gathered and multiplied by the kernel's rows as arrays.
    """
    g = config.geometry
    if g.chunk_in * g.fft_out > MAX_KERNEL_ROWS:
        raise ResampleError("KernelTooLarge", "the chunk is too large for a kernel table; use resample_long")
    rows = spark.sql(kernel_sql(config)).groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda s: s["w"]).alias("ws")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ws"))), lambda s: s["ws"]).alias("kernel"))
    chunks = long.groupBy(*keys, F.expr(f"frame_idx div {g.chunk_in}").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "sample"))), lambda s: s["sample"]).alias("seg")).where(F.size("seg") == g.chunk_in)
    dot = lambda ws: F.aggregate(F.zip_with("seg", ws, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    made = chunks.crossJoin(F.broadcast(rows)).select(*keys, "chunk", F.transform("kernel", dot).alias("y"))  # one row on the right
    halves = made.select(*keys, F.explode(F.array(F.struct(F.col("chunk").alias("block"), F.lit(0).alias("half"), F.slice("y", 1, g.chunk_out).alias("y")), F.struct((F.col("chunk") + 1).alias("block"), F.lit(1).alias("half"), F.slice("y", g.chunk_out + 1, g.chunk_out).alias("y")))).alias("h")).select(*keys, "h.*")
    blocks = halves.groupBy(*keys, "block").agg(F.collect_list("y").alias("ys")).where((F.size("ys") == 2))
    added = F.zip_with(F.element_at("ys", 1), F.try_element_at("ys", F.lit(2)), lambda a, b: a + b)
    return blocks.select(*keys, "block", F.posexplode(added).alias("m", "sample")).select(*keys, (F.col("block") * g.chunk_out + F.col("m") - g.offset_out).alias("out_idx"), "sample")
