"""The block transform, prediction and configurations, without Spark."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.functions import lpc, tapers
from cadenza.functions.tapers import Taper
from cadenza.operators.kernel import Stream, resample_signal
from cadenza.plans.config import PRESETS, Config, ResampleError, preset

STANDARD = Config(44100, 48000, 1, 64, 0.95, Taper("cosine", 3.45))


def test_geometry_anchors():
    g = preset("good").with_rates(44100, 48000).with_channels(2).geometry
    assert (g.chunk_in, g.chunk_out, g.fft_in, g.fft_out // 2, g.offset_in, g.offset_out, g.cutoff_bins, g.taper_bins) == (2058, 2240, 4116, 2240, 1029, 1120, 2059, 183)
    assert [preset(p).with_rates(44100, 48000).with_channels(1).geometry.chunk_in for p in PRESETS] == [588, 2058, 73794, 524790]


def test_prediction_vectors():
    x = np.array([2, 3, -1, -2, 1, 4, 1.0])
    assert np.allclose(lpc.autocorrelation(x), [36, 11, -16, -7, 13, 11, 2])
    assert np.allclose(lpc.levinson(x, 3), [-0.6919053749597684, 0.7615062761506278, -0.3457515288059223], atol=1e-12)
    assert np.allclose(lpc.burg(x, 3), [-1.0650404360323664, 1.157238171254371, -0.5771692748969812], atol=1e-12)
    assert lpc.burg(np.zeros(8), 3) is None and lpc.burg(np.zeros(2), 3) is None
    assert lpc.extrapolate(np.zeros(0), 3).tolist() == [0, 0, 0] and lpc.extrapolate(np.full(1, 0.5), 0).tolist() == []


def test_divergent_prediction_is_bounded():
    seed = 1e-9 * 1.05 ** np.arange(512)
    out = lpc.extrapolate(seed, 20_000)
    assert np.isfinite(out).all() and np.abs(out).max() <= 8 * np.abs(seed).max()


def test_prediction_survives_odd_samples():
    x = np.array([1.0, np.nan, np.inf, -1.0, 0.5, 0.25])
    assert np.isfinite(lpc.damped(x, 3)).all()
    assert np.isfinite(lpc.extrapolate(np.where(np.isinf(x), 1.0, x), 50)).all()


@pytest.mark.parametrize("taper", [Taper("cosine", 3.45), Taper("planck"), Taper("beta", 2.5, 1.5), Taper("bessel", 2.5)])
def test_tapers_fall_from_one_to_zero(taper):
    curve = tapers.taper_curve(taper, 2058, 2059, 183)
    assert len(curve) == 2059 and curve[0] == 1 and (curve >= 0).all() and (curve <= 1).all() and (np.diff(curve) <= 1e-12).all()
    assert (tapers.taper_curve(taper, 10, 11, 0) == 1).all() and (tapers.taper_curve(taper, 10, 11, 3, flat=True) == 1).all()


def test_special_functions():
    assert np.allclose(np.i0([0, 1, 2]), [1, 1.2660658777520082, 2.2795853023360673])
    for a, b, x in ((2, 3, 0.4), (5, 1, 0.9), (1, 5, 0.05)):
        exact = sum(math.comb(a + b - 1, i) * x**i * (1 - x) ** (a + b - 1 - i) for i in range(a, a + b))
        assert abs(tapers.incomplete_beta(a, b, x) - exact) < 1e-13
    assert abs(tapers.incomplete_beta(0.5, 0.5, 0.5) - 0.5) < 1e-13
    turn = tapers.phase_rotation(64, 0.25, 20)
    assert np.allclose(abs(turn), 1) and turn[0] == 1 and np.allclose(tapers.phase_rotation(64, -0.25, 20), turn.conj())


@pytest.mark.parametrize(("change", "code"), [
    ({"input_rate": 0}, "MustSetInputSampleRate"), ({"output_rate": 0}, "MustSetOutputSampleRate"), ({"channels": 0}, "InvalidChannels"), ({"quality": 0}, "InvalidQuality"), ({"bandwidth": math.nan}, "InvalidBandwidth"),
    ({"phase": 1.5}, "InvalidPhase"), ({"phase_intensity": math.inf}, "InvalidPhaseIntensity"), ({"taper": Taper("cosine", 0.0)}, "InvalidAlpha"), ({"taper": Taper("beta", 1.0, math.nan)}, "InvalidBeta"), ({"dtype": "f32", "quality": 8193}, "QualityTooHighForF32"),
])
def test_validation(change, code):
    from dataclasses import replace

    with pytest.raises(ResampleError) as e:
        replace(STANDARD, **change).validated()
    assert e.value.code == code


def test_unset_preset():
    with pytest.raises(ResampleError) as e:
        preset("fast").validated()
    assert e.value.code == "PresetNotConfigured"
    with pytest.raises(ResampleError):
        preset("best")


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([(2, 3), (3, 2), (44100, 48000), (96000, 44100), (5, 5)]), st.integers(0, 900), st.sampled_from([0.0, -0.3]), st.lists(st.integers(1, 400), min_size=1, max_size=8), st.integers(0, 2**32 - 1))
def test_stream_equals_whole(rates, n, phase, cuts, seed):
    config = Config(*rates, 1, 64, 0.95, Taper("cosine", 3.45), phase)
    x = np.random.default_rng(seed).normal(size=n)
    whole = resample_signal(x, config)
    assert len(whole) == config.output_size(n)
    stream, out, at = Stream(config), [], 0
    for k in [*cuts, n]:
        out.append(stream.push(x[at : at + k]))
        at = min(n, at + k)
    out.append(stream.finish())
    assert np.allclose(np.concatenate(out), whole, atol=1e-10)
    with pytest.raises(ResampleError):
        stream.finish()


def test_silence_and_passthrough():
    assert (resample_signal(np.zeros(500), STANDARD) == 0).all()
    x = np.cos(0.013 * np.arange(600))
    assert (resample_signal(x, STANDARD.with_rates(7, 7)) == x).all()
    assert not np.allclose(resample_signal(x, STANDARD.with_rates(7, 7).with_phase(0.5)), x)


def test_context_makes_joints_seamless():
    config = STANDARD.with_taper(Taper("cosine", 1.55))
    x = np.random.default_rng(5).normal(size=294 * 60)
    parts = np.split(x, 3)
    whole = resample_signal(x, config)
    along = np.concatenate([resample_signal(p, config, parts[i - 1] if i else None, parts[i + 1] if i < 2 else None) for i, p in enumerate(parts)])
    alone = np.concatenate([resample_signal(p, config) for p in parts])
    middle = slice(1000, len(whole) - 1000)
    assert np.abs(along - whole)[middle].max() < np.abs(alone - whole)[middle].max() / 20


def test_f32_stays_close():
    x = np.random.default_rng(3).normal(size=1500)
    a, b = resample_signal(x, STANDARD.with_dtype("f32")), resample_signal(x, STANDARD)
    assert a.dtype == np.float32 and np.abs(a - b).max() < 1e-5
