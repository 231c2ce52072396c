"""DataFrame operators: layouts, resampling in both forms, spans, streams and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import pcm
from cadenza.functions.tapers import Taper
from cadenza.operators import layout, measures, spans
from cadenza.operators.kernel import resample_signal
from cadenza.operators.resample import resample, resample_gapless, resample_groups, resample_long
from cadenza.plans.config import Config

UP = Config(2, 3, 1, 8, 0.6, Taper("cosine", 3.45))


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(0)
    return {k: rng.normal(size=n).tolist() for k, n in enumerate((0, 1, 3, 8, 9, 16, 40, 100))}


def planar(spark, signals):
    return spark.createDataFrame([(k, "a" if k < 4 else "b", v) for k, v in signals.items()] + [(99, "c", None)], "track int, album string, samples array<double>")


def test_planar_form(spark, signals):
    out = {r.track: r.samples for r in resample(planar(spark, signals), UP).collect()}
    assert out.pop(99) is None
    for k, v in signals.items():
        assert np.allclose(out[k], resample_signal(np.array(v), UP))


@pytest.mark.parametrize("config", [UP, UP.with_rates(3, 2), UP.with_rates(4, 4).with_phase(0.4), UP.with_rates(6, 6)])
def test_long_form_equals_planar(spark, signals, config):
    long = planar(spark, signals).select("track", F.posexplode("samples").alias("frame_idx", "sample")).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    rows = resample_long(long, config, keys=["track"]).collect()
    for k, v in signals.items():
        got = [x for _, x in sorted((r.frame_idx, r.sample) for r in rows if r.track == k)]
        want = resample_signal(np.array(v), config)
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-10)


def test_gapless_equals_neighbours_by_hand(spark, signals):
    tracks = planar(spark, {k: v for k, v in signals.items() if v})
    out = {r.track: r.samples for r in resample_gapless(tracks.where("track < 99"), UP, album=["album"], order="track").collect()}
    assert np.allclose(out[5], resample_signal(np.array(signals[5]), UP, np.array(signals[4]), np.array(signals[6])))
    assert np.allclose(out[4], resample_signal(np.array(signals[4]), UP, None, np.array(signals[5])))


def test_mixed_formats(spark, signals):
    df = planar(spark, signals).where("track < 99").withColumn("channels", F.lit(1)).withColumn("input_rate", F.when(F.col("track") % 2 == 0, 2).otherwise(3))
    down = UP.with_rates(3, 2)
    out = {r.track: r.samples for r in resample_groups(df, {(1, 2): UP, (1, 3): down}).collect()}
    assert all(np.allclose(out[k], resample_signal(np.array(v), down if k % 2 else UP)) for k, v in signals.items())


def test_layouts(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2, [])], "id int, samples array<double>")
    parts = layout.deinterleave(df, 3)
    assert sorted((r.id, r.channel, r.samples) for r in parts.where("id = 1").collect()) == [(1, 0, [1.0, 4.0]), (1, 1, [2.0, 5.0]), (1, 2, [3.0, 6.0])]
    assert {r.id: r.samples for r in layout.interleave(parts, keys=["id"]).collect()} == {1: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 2: []}
    with pytest.raises(Exception, match="MalformedInputLength"):
        layout.deinterleave(df, 4).collect()
    uneven = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [])], "id int, channel int, samples array<double>")
    with pytest.raises(Exception, match="WrongFrameCount"):
        layout.interleave(uneven, keys=["id"]).collect()


def test_integer_samples(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, -1.0, 2.0, -3.0, 0.5 / 32767, -0.5 / 32767, float("nan"))], "x double")
    assert [r[0] for r in df.select(pcm.encode(F.col("x"), 16)).collect()] == [0, 32767, -32767, 32767, -32767, 1, -1, 0]


def test_measures(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i) + (5.0 if i in (0, 99) else 0.25)) for i in range(100)], "k int, i long, a double, b double")
    row = measures.edge_trimmed_error(df, keys=["k"], index="i", a="a", b="b").first()
    assert row.mean_error == row.peak_error == 0.25
    odd = spark.createDataFrame([(float("nan"),), (-2.0,), (1.0,)], "x double")
    assert odd.agg(measures.seed_peak(F.col("x"))).first()[0] == 2.0


def test_spans(spark):
    df = spark.createDataFrame([(1, t, f) for t, f in enumerate("aabbba")] + [(2, 0, None), (2, 1, None), (2, 2, "a")], "k int, t int, f string")
    rows = sorted((r.k, r.t, r.span_id, r.frame_idx) for r in spans.with_spans(df, keys=["k"], order=["t"], fmt=["f"]).collect())
    assert [r[2] for r in rows] == [0, 0, 1, 1, 1, 2, 0, 0, 1] and [r[3] for r in rows] == [0, 1, 0, 1, 2, 0, 0, 1, 0]


def test_stream_spans_and_end(spark, tmp_path):
    from cadenza.streaming.resampler import resample_stream, run_available

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=21), rng.normal(size=13)
    rows = [(1, i, float(v), "a", False) for i, v in enumerate(x)] + [(1, 21 + i, float(v), "b", False) for i, v in enumerate(y)] + [(1, 40, None, "b", True)]
    schema = "k int, t int, x double, f string, last boolean"
    for cut in (slice(0, 10), slice(10, 30), slice(30, None)):
        spark.createDataFrame(rows[cut], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    down = UP.with_rates(3, 2)
    out = run_available(resample_stream(stream, UP, keys=["k"], order=["t"], sample="x", end="last", fmt="f", configs={"b": down}), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    for span, want in ((0, resample_signal(x, UP)), (1, resample_signal(y, down))):
        got = sorted((r.n, r.sample) for r in out if r.span_id == span)
        assert [n for n, _ in got] == list(range(len(want))) and np.allclose([v for _, v in got], want)


@pytest.mark.parametrize("fmt", ["i16", "i24", "i32", "f32", "f64"])
def test_wav_files(spark, tmp_path, fmt):
    from cadenza.sources.wav import build, parse, read_wav, write_wav

    x = np.random.default_rng(2).uniform(-1.2, 1.2, size=(37, 2))
    channels, rate, name, back = parse(build(x, 22050, fmt))
    assert (channels, rate, name) == (2, 22050, fmt)
    want = np.clip(x, -1, 1) if fmt[0] == "i" else x
    assert np.abs(back - want).max() <= {"i16": 2e-5, "i24": 7e-8, "i32": 3e-10, "f32": 1e-7, "f64": 0}[fmt]
    df = spark.createDataFrame([("one", 8000, fmt, x.T.tolist()), ("two", 8000, fmt, [[], []])], "name string, rate int, fmt string, samples array<array<double>>")
    folder = f"file://{tmp_path}/wav"
    assert all(r.error is None for r in write_wav(df, folder, name="name", rate="rate", fmt="fmt", samples="samples").collect())
    (tmp_path / "wav" / "broken.WAV").write_bytes(b"RIFFnothing")
    rows = read_wav(spark, folder).collect()
    assert sum(r.error is not None for r in rows) == 1 and sum(r.frames == 37 for r in rows) == 2 and sum(r.frames == 0 for r in rows) == 2


def test_queries_return_every_sample(spark, tmp_path):
    """Edges and joints of the registered queries against the whole signal."""
    from datetime import datetime, timedelta

    from cadenza.queries import DOWN, QUERIES
    from cadenza.queries import UP as UP_QUERY

    rng = np.random.default_rng(1)
    tracks = {i: rng.normal(size=64) for i in range(5)}
    spark.createDataFrame([(i, i // 3, v.tolist()) for i, v in tracks.items()], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    users = {u: rng.normal(size=n) for u, n in enumerate((5, 8, 61))}
    rows = [(u, 100 * u + i, datetime(2024, 1, 1) + timedelta(seconds=i), float(x)) for u, v in users.items() for i, x in enumerate(v)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")

    def got(name, *keys):
        found = {}
        for r in sorted(QUERIES[name](spark, str(tmp_path)).collect(), key=lambda r: (*[r[k] for k in keys], r.frame_idx)):
            found.setdefault(tuple(r[k] for k in keys), []).append(r.sample)
        return found

    for name, config in (("resample_up_all", UP_QUERY), ("resample_down_all", DOWN)):
        out = got(name, "user_id")
        assert all(np.allclose(out[(u,)], resample_signal(v, config)) for u, v in users.items())
    out = got("resample_planar_all", "vec_id")
    assert all(len(out[(i,)]) == 96 and np.allclose(out[(i,)], resample_signal(v, UP_QUERY)) for i, v in tracks.items())
    out = got("resample_gapless_all", "label", "vec_id")
    for label, ids in ((0, (0, 1, 2)), (1, (3, 4))):
        for at, i in enumerate(ids):
            pre, post = (tracks[ids[at - 1]] if at else None), (tracks[ids[at + 1]] if at + 1 < len(ids) else None)
            assert len(out[(label, i)]) == 96 and np.allclose(out[(label, i)], resample_signal(tracks[i], UP_QUERY, pre, post))
        # A track's first and last half block are made with one chunk of context, so they differ from the album as one signal.
        whole, joined = resample_signal(np.concatenate([tracks[i] for i in ids]), UP_QUERY), np.concatenate([out[(label, i)] for i in ids])
        at = np.arange(len(whole))
        inside = (at < 90) | (at >= len(whole) - 90) | ((at % 96 >= 6) & (at % 96 < 90))
        assert np.allclose(joined[inside], whole[inside])


def test_long_form_uses_many_tasks(spark):
    """One long track: no stage puts its samples in one task, and no window goes over it."""
    n = 200_000
    long = spark.range(n).select(F.lit(1).alias("track"), F.col("id").alias("frame_idx"), F.sin(F.col("id") * 0.01).alias("sample"))
    out = resample_long(long, UP, keys=["track"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.groupBy(F.spark_partition_id()).count().count() > 1 and out.count() == UP.output_size(n)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sizes_of_many_tracks(spark, signals, monkeypatch):
    """Lengths too many to broadcast give the same samples, and a null key is a track."""
    from cadenza.operators import resample as module

    rows = [(k if k else None, i, x) for k, v in ((0, signals[40 // 8 + 1]), (7, signals[7])) for i, x in enumerate(v)]
    long = spark.createDataFrame(rows, "track int, frame_idx long, sample double")
    want = sorted((r.track or 0, r.frame_idx, round(r.sample, 9)) for r in resample_long(long, UP, keys=["track"]).collect())
    monkeypatch.setattr(module, "BROADCAST_TRACKS", 0)
    assert sorted((r.track or 0, r.frame_idx, round(r.sample, 9)) for r in resample_long(long, UP, keys=["track"]).collect()) == want
    assert {t for t, _, _ in want} == {0, 7}


def test_channel_count(spark, signals):
    from pyspark.errors import PySparkException

    df = planar(spark, signals).withColumn("channels", F.lit(5))
    assert resample(df, UP.with_channels(5), channels="channels").count() == df.count()
    with pytest.raises(PySparkException, match="WrongChannelCount"):
        resample(df, UP.with_channels(2), channels="channels").collect()


def test_no_intensity_is_no_phase(spark, signals):
    config = UP.with_rates(4, 4).with_phase(0.5, 0.0)
    assert config.passthrough and config.latency == 0
    assert UP.with_phase(0.5, 0.0).rotation is None


def test_live_handoff(spark):
    """A stream that is told what follows ends as the offline form with that context."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=45), rng.normal(size=33)
    from cadenza.operators.kernel import Stream

    stream = Stream(UP)
    got = [stream.push(a[:20]), stream.push(a[20:])]
    assert stream.counters()["held"] == 45 % 8 and stream.counters()["primed"]
    stream.follow(b)
    got.append(stream.finish())
    assert np.allclose(np.concatenate(got), resample_signal(a, UP, None, b))
    stream.reset()
    assert stream.counters()["n_in"] == 0 and not stream.primed


def test_table_function_and_md5(spark, signals):
    from cadenza.functions.sql import register
    from cadenza.operators.measures import channel_md5
    from cadenza.plans.config import preset

    register(spark)
    planar(spark, signals).createOrReplaceTempView("tracks")
    rows = spark.sql("SELECT track, r.* FROM tracks, LATERAL resample(samples, 2, 3, 'fast') r").collect()
    config = preset("fast").with_rates(2, 3).with_channels(1)
    for k, v in signals.items():
        got = [x for _, x in sorted((r.pos, r.sample) for r in rows if r.track == k)]
        assert np.allclose(got, resample_signal(np.array(v), config))
    import hashlib

    for r in planar(spark, signals).select("samples", channel_md5(F.col("samples")).alias("md5")).collect():
        assert r.md5 == (None if r.samples is None else hashlib.md5(np.array(r.samples, dtype="<f4").tobytes()).hexdigest())


def test_taper_defaults():
    from cadenza.cli import config_for, parser

    want = {"cosine": (3.4375, 1.0), "beta": (10.0, 10.0), "bessel": (6.0, 1.0)}
    for kind, (alpha, beta) in want.items():
        t = config_for(parser().parse_args(["-i", "a.wav", "-o", "b.wav", "-r", "48000", "--taper", kind]), 44100, 1).taper
        assert (t.kind, t.alpha, t.beta) == (kind, alpha, beta)
    t = config_for(parser().parse_args(["-i", "a.wav", "-o", "b.wav", "-r", "48000", "--taper", "beta", "--beta", "3"]), 44100, 1).taper
    assert (t.alpha, t.beta) == (10.0, 3.0)
