"""FLAC streams and the command line."""

import numpy as np
import pytest

from cadenza import cli
from cadenza.operators.kernel import resample_signal
from cadenza.plans.config import ResampleError
from cadenza.sources import audio, flac


@pytest.mark.parametrize("depth", [16, 24, 32])
@pytest.mark.parametrize("n", [0, 1, 4, 5, 4096, 9000])
def test_flac_round_trip(depth, n):
    top = 2 ** (depth - 1) - 1
    t = np.arange(n)
    x = np.stack([np.round(0.4 * top * np.sin(0.01 * t)), np.random.default_rng(n).integers(-top, top, size=n), np.full(n, -3)], axis=1).astype(np.int64)
    channels, rate, bits, back = flac.decode(flac.encode(x, 44100, depth))
    assert (channels, rate, bits) == (3, 44100, depth) and (back == x).all() and back.shape == x.shape


def test_flac_is_smaller_and_checked():
    x = np.round(20000 * np.sin(0.01 * np.arange(20000))).astype(np.int64)[:, None]
    data = flac.encode(x, 8000, 16)
    assert len(data) < 20000
    for bad in (b"", b"fLaC", data[:40], data[:-700]):
        with pytest.raises(flac.FlacError):
            flac.decode(bad)
    assert [flac._number(n) for n in (0, 127, 128, 2047, 2048)] == [b"\0", b"\x7f", b"\xc2\x80", b"\xdf\xbf", b"\xe0\xa0\x80"]


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-0.5, 0.5, size=(700, 2)), rng.uniform(-0.5, 0.5, size=(500, 2))
    (tmp_path / "a.wav").write_bytes(audio.build("a.wav", x, 44100, "i24"))
    (tmp_path / "b.flac").write_bytes(audio.build("b.flac", y, 44100, "i16"))
    flat = ["-i", f"{tmp_path}/a.wav", "-i", f"{tmp_path}/b.flac", "-o", f"{tmp_path}/out/a.flac", "-o", f"{tmp_path}/out/b.wav", "-r", "48000", "--preset", "fast"]
    for extra in ([], ["--gapless"]):
        args = cli.checked(cli.parser().parse_args([*flat, *extra]))
        assert [r.error for r in cli.convert(spark, args).collect()] == [None, None]
        config = cli.config_for(args, 44100, 2)
        channels, rate, fmt, a = audio.parse((tmp_path / "out/a.flac").read_bytes())
        assert (channels, rate, fmt) == (2, 48000, "i24") and len(a) == config.output_size(700)
        assert np.allclose(a[:, 1], resample_signal(x[:, 1], config, None, y[:, 1] if extra else None), atol=1e-4)
        _, _, fmt, b = audio.parse((tmp_path / "out/b.wav").read_bytes())
        assert fmt == "i16" and np.allclose(b[:, 0], resample_signal(y[:, 0], config, x[:, 0] if extra else None), atol=1e-4)


@pytest.mark.parametrize("change", [["-i", "c.wav"], ["-r", "0"], ["-o", "x.mp3", "-i", "c.wav"], ["-i", "a.wav", "-o", "o.wav"], ["--beta", "1"], ["--taper", "planck", "--alpha", "2"]])
def test_arguments(change):
    with pytest.raises(ResampleError):
        cli.checked(cli.parser().parse_args(["-i", "a.wav", "-o", "o.wav", "-r", "48000", *change]))


@pytest.mark.parametrize("name", ["wav_roundtrip", "flac_roundtrip"])
def test_round_trips_keep_the_sign_of_zeros(spark, tmp_path, name):
    import duckdb

    from cadenza.queries import ORACLES, QUERIES

    rows = [(7, [-1e-9, 1e-9, -0.0, 0.0, -0.25, 0.25, 1e-9, -1e-9], 1), (12, [1.5, -1.5, -1e-5, 2e-5], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(f"WITH embeddings AS (FROM '{tmp_path}/embeddings.parquet/*.parquet') SELECT vec_id, channel, samples FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert "-0.0" in repr(want) and sorted(map(repr, got)) == sorted(map(repr, want))
