"""Linear prediction: fits (Burg, Levinson-Durbin), damping, and extrapolation of a signal past its ends."""

from __future__ import annotations

import math

import numpy as np

#: Largest order of a predictor.
MAX_ORDER = 64
#: The k-th coefficient is multiplied by this to the k-th power.
DAMPING = 0.999
#: A prediction beyond so many times the seed's peak has diverged; from there on it is silence.
HEADROOM = 8.0


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """The sum of products at each lag."""
    return np.correlate(x, x, mode="full")[len(x) - 1 :] if len(x) else np.zeros(0)


def levinson(x: np.ndarray, depth: int) -> np.ndarray | None:
    """Coefficients from the autocorrelation by Levinson's recursion, or None where it breaks down."""
    r = autocorrelation(np.asarray(x, dtype=np.float64))
    if depth == 0:
        return np.zeros(0)
    if len(r) <= depth - 1 or not len(r) or r[0] == 0:
        return None
    r = np.append(r, np.zeros(max(0, depth + 1 - len(r))))
    a, error = np.array([1.0]), r[0]
    for m in range(1, depth + 1):
        k = -(a @ r[m:0:-1]) / error
        a = np.append(a, 0.0)
        a = a + k * a[::-1]
        error *= 1.0 - k * k
        if not np.isfinite(k) or error == 0:
            return None
    return a[1:]


def burg(x: np.ndarray, depth: int) -> np.ndarray | None:
    """Coefficients by Burg's method, or None where the energy is zero or not finite."""
    x = np.asarray(x)
    if depth == 0:
        return np.zeros(0, dtype=x.dtype)
    if len(x) < depth:
        return None
    a = np.ones(1, dtype=x.dtype)
    forward, backward = x[1:], x[:-1]
    with np.errstate(all="ignore"):
        for _ in range(depth):
            energy = forward @ forward + backward @ backward
            if energy == 0 or not np.isfinite(energy):
                return None
            k = -2 * (forward @ backward) / energy
            if not np.isfinite(k):
                return None
            a = np.append(a, np.zeros(1, dtype=x.dtype))
            a = a + k * a[::-1]
            forward, backward = (forward + k * backward)[1:], (backward + k * forward)[:-1]
    return a[1:]


def damped(x: np.ndarray, order: int, hold: bool = True) -> np.ndarray:
    """Burg coefficients of the sanitised input, damped. Where there is no fit: hold the last sample, or silence."""
    if order == 0:
        return np.zeros(0)
    x = np.where(np.isfinite(x), x, 0)
    a = burg(x, max(1, min(order, len(x))))
    if a is None or not len(a):
        return np.array([-1.0 if hold else 0.0], dtype=x.dtype)
    a = a * (DAMPING ** np.arange(1, len(a) + 1)).astype(a.dtype)
    return np.where(np.isfinite(a), a, 0)


def order_for(n: int) -> int:
    return max(1, min(MAX_ORDER, -(-n // 2)))


def extrapolate(x: np.ndarray, extra: int, hold: bool = True) -> np.ndarray:
    """``extra`` samples after x. Each is predicted from those before it, predictions included."""
    x = np.asarray(x)
    if extra <= 0 or not len(x):
        return np.zeros(max(0, extra), dtype=x.dtype)
    weights = -damped(x, order_for(len(x)), hold)[::-1]
    p = len(weights)
    work = np.zeros(max(p - len(x), 0) + len(x) + extra, dtype=x.dtype)
    at = len(work) - extra
    work[at - len(x) : at] = x
    bound = HEADROOM * np.nanmax(np.abs(x)) if np.isfinite(x).any() or np.isinf(x).any() else 0.0
    with np.errstate(all="ignore"):
        for i in range(at, at + extra):
            value = float(weights.dot(work[i - p : i]))
            if -bound <= value <= bound:
                work[i] = value
            elif math.isfinite(value):
                break
    return work[at:]


def extrapolate_back(x: np.ndarray, extra: int, hold: bool = True) -> np.ndarray:
    """``extra`` samples before x."""
    return extrapolate(np.asarray(x)[::-1], extra, hold)[::-1]
