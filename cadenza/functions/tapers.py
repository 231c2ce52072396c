"""Spectral tapers and phase rotation: NumPy tables for the transform, and the same curves as Spark columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("cosine", "planck", "beta", "bessel")


@dataclass(frozen=True)
class Taper:
    """A transition curve: cosine(alpha), planck, beta(alpha, beta) or the cumulative Bessel curve bessel(alpha)."""

    kind: str = "cosine"
    alpha: float = 3.4375
    beta: float = 1.0


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised lower incomplete beta function by its continued fraction, evaluated with the modified Lentz method."""
    if a <= 0 or b <= 0 or not 0 <= x <= 1:
        raise ValueError("needs a > 0, b > 0 and 0 <= x <= 1")
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    value, num, den = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        den = 1.0 / (1.0 + term * den or tiny)
        num = 1.0 + term / num or tiny
        value *= num * den
        if abs(num * den - 1.0) < 1e-16:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * (value - 1.0)


def ln_gamma(x: float) -> float:
    return math.lgamma(x)


def transition(taper: Taper, bins: int) -> np.ndarray:
    """The raw curve from 1 to 0 over ``bins`` bins."""
    if bins == 1:
        return np.ones(1)
    alpha, k = float(np.float32(taper.alpha)), np.arange(bins, dtype=np.float64)
    if taper.kind == "bessel":
        steps = np.i0(np.sqrt(k * (bins - k)) * 2.0 * alpha * math.pi / bins)
        return np.cumsum(steps[::-1])[::-1] / (steps.sum() + 1.0)
    x = k / (bins - 1)
    if taper.kind == "cosine":
        w = x**alpha / (x**alpha + (1.0 - x) ** alpha)
        out = (1.0 + np.cos(math.pi * w)) / 2.0
    elif taper.kind == "planck":
        out = np.zeros(bins)
        inner = x[1:-1]
        with np.errstate(over="ignore"):
            out[1:-1] = 1.0 - 1.0 / (np.exp(1.0 / inner - 1.0 / (1.0 - inner)) + 1.0)
        out[0] = 1.0
    elif taper.kind == "beta":
        beta = float(np.float32(taper.beta))
        out = np.array([1.0 - incomplete_beta(alpha, beta, v) for v in x])
    else:
        raise ValueError(f"tapers are {', '.join(KINDS)}")
    return np.where(np.abs(out) < np.finfo(np.float64).tiny, 0.0, out)


def taper_curve(taper: Taper, chunk_in: int, cutoff_bins: int, taper_bins: int, flat: bool = False) -> np.ndarray:
    """The gain of each of the chunk_in + 1 bins: ones, the transition, zeros from the cutoff on. Flat for equal rates."""
    if flat:
        return np.ones(chunk_in + 1)
    raw = transition(taper, taper_bins) if taper_bins > 0 else np.zeros(0)
    if len(raw) > 1 or taper.kind == "bessel":
        below, above = np.flatnonzero(raw < 1.0), np.flatnonzero(raw > 0.0)
        first = below[0] if len(below) else len(raw)
        raw = raw[first : above[-1] + 1 if len(above) else 0]
    out = np.zeros(chunk_in + 1)
    out[: cutoff_bins - len(raw)] = 1.0
    out[cutoff_bins - len(raw) : cutoff_bins] = raw
    return out


def phase_rotation(bins: int, phase: float, intensity: float) -> np.ndarray:
    """The unit complex factor of each bin below the cutoff."""
    angle = np.arcsin(abs(phase) * np.arange(bins) / bins) * intensity * (-1.0 if phase < 0 else 1.0)
    return np.exp(1j * angle)


# The same curves as columns over an index column, for plans that stay in SQL.


def cosine_column(k: Column, bins: int, alpha: float) -> Column:
    x = k / F.lit(float(bins - 1))
    a = F.lit(float(np.float32(alpha)))
    w = F.pow(x, a) / (F.pow(x, a) + F.pow(F.lit(1.0) - x, a))
    return (F.lit(1.0) + F.cos(F.lit(math.pi) * w)) / F.lit(2.0)


def planck_column(k: Column, bins: int) -> Column:
    x = k / F.lit(float(bins - 1))
    inner = F.lit(1.0) - F.lit(1.0) / (F.exp(F.lit(1.0) / x - F.lit(1.0) / (F.lit(1.0) - x)) + F.lit(1.0))
    return F.when(k == 0, 1.0).when(k == bins - 1, 0.0).otherwise(inner)


def beta_column(k: Column, bins: int, alpha: int, beta: int) -> Column:
    """For whole alpha and beta the incomplete beta function is a binomial tail: P(B(alpha + beta - 1, x) >= alpha)."""
    x, n = k / F.lit(float(bins - 1)), alpha + beta - 1
    tail = F.lit(0.0)
    for i in range(alpha, n + 1):
        tail = tail + F.lit(float(math.comb(n, i))) * F.pow(x, F.lit(float(i))) * F.pow(F.lit(1.0) - x, F.lit(float(n - i)))
    return F.lit(1.0) - tail


def bessel_i0_column(x: Column, terms: int = 40) -> Column:
    """I0 by its power series."""
    q = x * x / F.lit(4.0)
    step = lambda s, i: F.struct((s["t"] * q / (i.cast("double") * i.cast("double"))).alias("t"), (s["s"] + s["t"] * q / (i.cast("double") * i.cast("double"))).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda s: s["s"])


def phase_columns(k: Column, bins: int, phase: float, intensity: float) -> tuple[Column, Column]:
    """Real and imaginary part of the rotation of bin k."""
    p, i = float(np.float32(phase)), float(np.float32(intensity))
    angle = F.asin(F.lit(abs(p)) * k / F.lit(float(bins))) * F.lit(i) * F.lit(-1.0 if p < 0 else 1.0)
    return F.cos(angle), F.sin(angle)
