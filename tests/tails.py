"""Student-t and F tails in numpy, to compare the library's SQL functions with."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def _lgamma(values: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in values], dtype=float)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta (modified Lentz method)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    steps = 300 + int(12 * math.sqrt(float(np.max(np.maximum(a, b), initial=1.0))))
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return h


def log_gamma_ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """log(gamma(p + q) / gamma(p)); for large p from Stirling's series, whose
    large terms are cancelled by hand."""
    large = p > 1e3
    safe = np.where(large, p, 1e3)
    series = (
        (safe + q - 0.5) * np.log1p(q / safe)
        + q * np.log(safe)
        - q
        + 1.0 / (12.0 * (safe + q))
        - 1.0 / (12.0 * safe)
        - 1.0 / (360.0 * (safe + q) ** 3)
        + 1.0 / (360.0 * safe**3)
    )
    small = np.where(large, 1.0, p)
    return np.where(large, series, _lgamma(small + q) - _lgamma(small))


def _log_beta(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    high, low = np.maximum(p, q), np.minimum(p, q)
    return _lgamma(low) - log_gamma_ratio(high, low)


def regularized_beta(a, b, x, rest=None) -> np.ndarray:
    """I_x(a, b) for finite arrays with a, b > 0; ``rest`` is 1 - x where it is
    known to more digits than the difference."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    rest = 1.0 - x if rest is None else np.asarray(rest, dtype=float)
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    inner = ok & (x > 0) & (x < 1)
    if inner.any():
        a, b, x, rest = a[inner], b[inner], x[inner], rest[inner]
        flip = x >= (a + 1.0) / (a + b + 2.0)
        p, q = np.where(flip, b, a), np.where(flip, a, b)
        z = np.where(flip, rest, x)
        other = np.where(flip, x, rest)
        # The logarithm of a number near 1 comes from its distance to 1.
        log_z = np.where(z > 0.5, np.log1p(-np.where(z > 0.5, other, 0.0)), np.log(z))
        log_other = np.where(z > 0.5, np.log(other), np.log1p(-np.where(z > 0.5, 0.0, z)))
        front = np.exp(p * log_z + q * log_other - _log_beta(p, q))
        part = front * _beta_fraction(p, q, z) / p
        out[inner] = np.clip(np.where(flip, 1.0 - part, part), 0.0, 1.0)
    return out


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        square = t * t
        p = regularized_beta(df / 2.0, np.full(t.shape, 0.5), df / (df + square), square / (df + square))
    # Beyond 1e8 degrees of freedom the normal limit is right to more digits than the series.
    flat = np.broadcast_to(np.abs(t), p.shape)
    normal = np.array([math.erfc(v / math.sqrt(2.0)) for v in flat.ravel()]).reshape(p.shape)
    p = np.where((df > 1e8) & np.isfinite(t), normal, p)
    return np.where(np.isinf(t) & (df > 0), 0.0, p)


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    with np.errstate(invalid="ignore"):
        p = regularized_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))
    return np.where(np.isposinf(f) & (d1 > 0) & (d2 > 0), 0.0, p)
