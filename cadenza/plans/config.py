"""Resampling configurations: parameters, their validation, presets, and the block geometry derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np

from cadenza.functions.tapers import Taper, phase_rotation, taper_curve

#: Largest transform length that block sizes are allowed to reach.
MAX_TRANSFORM = 2**31 - 1
#: 32-bit computation is refused above this quality.
MAX_F32_QUALITY = 8192


class ResampleError(ValueError):
    """A configuration or an input that can't be resampled. ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def single(x: float) -> float:
    """A parameter that is held in 32 bits, as a double."""
    return float(np.float32(x))


@dataclass(frozen=True)
class Geometry:
    """Block sizes of one configuration: samples of a chunk in and out, offsets, and spectrum bins."""

    chunk_in: int
    chunk_out: int
    cutoff_bins: int
    taper_bins: int

    @property
    def fft_in(self) -> int:
        return 2 * self.chunk_in

    @property
    def fft_out(self) -> int:
        return 2 * self.chunk_out

    @property
    def offset_in(self) -> int:
        return self.chunk_in // 2

    @property
    def offset_out(self) -> int:
        return self.chunk_out // 2

    @property
    def scale(self) -> float:
        return self.chunk_out / self.chunk_in


def derive_geometry(input_rate: int, output_rate: int, quality: int, bandwidth: float) -> Geometry:
    """Rates reduced by their greatest common divisor, times an even factor that reaches the quality."""
    g = math.gcd(input_rate, output_rate)
    small, large = sorted((input_rate // g, output_rate // g))
    factor = min(-(-quality // small), MAX_TRANSFORM // (2 * large))
    factor += factor % 2
    chunk_in, chunk_out = input_rate // g * factor, output_rate // g * factor
    cutoff = min(chunk_in, chunk_out) + 1
    return Geometry(chunk_in, chunk_out, cutoff, math.ceil(cutoff * (1.0 - single(bandwidth))))


@dataclass(frozen=True)
class Config:
    """What to resample and how. Instances are immutable; the ``with_*`` methods return changed copies."""

    input_rate: int = 0
    output_rate: int = 0
    channels: int = 2
    quality: int = 1878
    bandwidth: float = 0.9114534
    taper: Taper = field(default_factory=lambda: Taper("cosine", 3.4375))
    phase: float = 0.0
    phase_intensity: float = 50.0
    dtype: str = "f64"

    def with_rates(self, input_rate: int, output_rate: int) -> Config:
        return replace(self, input_rate=input_rate, output_rate=output_rate)

    def with_input_rate(self, rate: int) -> Config:
        return replace(self, input_rate=rate)

    def with_output_rate(self, rate: int) -> Config:
        return replace(self, output_rate=rate)

    def with_channels(self, channels: int) -> Config:
        return replace(self, channels=channels)

    def with_quality(self, quality: int) -> Config:
        return replace(self, quality=quality)

    def with_bandwidth(self, bandwidth: float) -> Config:
        return replace(self, bandwidth=bandwidth)

    def with_taper(self, taper: Taper) -> Config:
        return replace(self, taper=taper)

    def with_phase(self, phase: float, intensity: float | None = None) -> Config:
        return replace(self, phase=phase, phase_intensity=self.phase_intensity if intensity is None else intensity)

    def with_dtype(self, dtype: str) -> Config:
        return replace(self, dtype=dtype)

    def validated(self) -> Config:
        """This configuration, or a ResampleError that says what is wrong with it."""
        if not (self.input_rate or self.output_rate or self.channels):
            raise ResampleError("PresetNotConfigured", "set the rates and the number of channels first")
        for code, bad, message in (
            ("MustSetInputSampleRate", self.input_rate <= 0, "the input rate must be positive"),
            ("MustSetOutputSampleRate", self.output_rate <= 0, "the output rate must be positive"),
            ("InvalidChannels", self.channels <= 0, "there must be a channel"),
            ("InvalidQuality", self.quality <= 0, "the quality must be positive"),
            ("InvalidBandwidth", not 0.0 <= self.bandwidth <= 1.0, "the bandwidth must be from 0 to 1"),
            ("InvalidPhase", not -1.0 <= self.phase <= 1.0, "the phase must be from -1 to 1"),
            ("InvalidPhaseIntensity", not 0.0 <= self.phase_intensity <= 100.0, "the phase intensity must be from 0 to 100"),
            ("InvalidAlpha", not (self.taper.alpha > 0 and math.isfinite(self.taper.alpha)), "alpha must be positive and finite"),
            ("InvalidBeta", self.taper.kind == "beta" and not (self.taper.beta > 0 and math.isfinite(self.taper.beta)), "beta must be positive and finite"),
            ("QualityTooHighForF32", self.dtype == "f32" and self.quality > MAX_F32_QUALITY, f"32-bit computation takes a quality of {MAX_F32_QUALITY} at most"),
        ):
            if bad:
                raise ResampleError(code, message)
        return self

    @cached_property
    def geometry(self) -> Geometry:
        self.validated()
        return derive_geometry(self.input_rate, self.output_rate, self.quality, self.bandwidth)

    @property
    def passthrough(self) -> bool:
        """Equal rates and no phase rotation: the output is the input."""
        return self.input_rate == self.output_rate and not self.rotated

    @property
    def rotated(self) -> bool:
        return self.phase != 0.0 and self.phase_intensity != 0.0

    @property
    def latency(self) -> int:
        """Output samples that a stream lags behind its input."""
        return 0 if self.passthrough else self.geometry.offset_out

    def output_size(self, n: int) -> int:
        """Output samples for n input samples."""
        return n if self.passthrough else -(-n * self.output_rate // self.input_rate)

    @cached_property
    def taper_curve(self) -> np.ndarray:
        g = self.geometry
        return taper_curve(self.taper, g.chunk_in, g.cutoff_bins, g.taper_bins, flat=self.input_rate == self.output_rate).astype(self.numpy_dtype)

    @cached_property
    def rotation(self) -> np.ndarray | None:
        return None if not self.rotated else phase_rotation(self.geometry.cutoff_bins, single(self.phase), single(self.phase_intensity))

    @property
    def numpy_dtype(self) -> type:
        return np.float32 if self.dtype == "f32" else np.float64


#: Quality and bandwidth of the presets; all have a cosine taper of 3.4375.
PRESETS = {"fast": (512, 0.8323), "good": (1878, 0.9114534), "high": (73622, 0.9873534), "extreme": (524514, 0.9952346)}


def preset(name: str) -> Config:
    """A preset by name; rates and channels are still to be set."""
    if name not in PRESETS:
        raise ResampleError("UnknownPreset", f"presets are {', '.join(PRESETS)}")
    quality, bandwidth = PRESETS[name]
    return Config(channels=0, quality=quality, bandwidth=bandwidth)
