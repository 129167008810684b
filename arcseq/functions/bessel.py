"""Bessel helpers for the few concentration parameters of a fit (driver side, NumPy)."""

from __future__ import annotations

import numpy as np

from arcseq.columns import LOG_TWO_PI


def i1_over_i0(kappa):
    kappa = np.maximum(np.asarray(kappa, dtype=float), 1e-300)
    ratio = np.zeros_like(kappa)
    # the backward recurrence forgets its start like exp(-n^2 / kappa)
    depth = int(7 * np.sqrt(kappa.max(initial=1.0))) + 25
    for n in range(depth, 0, -1):
        ratio = 1.0 / (2.0 * n / kappa + ratio)
    return ratio


def log_i0(kappa):
    kappa = np.asarray(kappa, dtype=float)
    z = np.minimum(kappa, 20.0) ** 2 / 4.0
    series = np.ones_like(kappa)
    for k in range(60, 0, -1):
        series = 1.0 + z / (k * k) * series
    large = np.maximum(kappa, 20.0)
    tail = np.ones_like(kappa)
    for k in range(25, 0, -1):
        tail = 1.0 + (2 * k - 1) ** 2 / (8.0 * k * large) * tail
    return np.where(kappa < 20.0, np.log(series), large - 0.5 * np.log(2 * np.pi * large) + np.log(tail))


def log_norm(kappa):
    return LOG_TWO_PI + log_i0(kappa)


def kappa_approx(r):
    """Same piecewise estimate as `circular.kappa_from_r`."""
    r = np.clip(np.asarray(r, dtype=float), 0.0, 0.999999999)
    low = 2 * r + r**3 + 5 * r**5 / 6
    mid = -0.4 + 1.39 * r + 0.43 / (1 - r)
    high = 1.0 / np.maximum(r**3 - 4 * r**2 + 3 * r, 1e-12)
    value = np.where(r < 1e-8, 1e-8, np.where(r < 0.53, low, np.where(r < 0.85, mid, high)))
    return np.clip(value, 1e-8, 5000.0)


def kappa_exact(r, low: float = 1e-6, high: float = 500.0):
    """Invert I1/I0 on [low, high]: Newton steps kept inside a shrinking bracket."""
    r = np.nan_to_num(np.asarray(r, dtype=float), nan=0.0)
    lo, hi = np.full_like(r, low), np.full_like(r, high)
    k = np.clip(kappa_approx(r), low, high)
    for _ in range(60):
        ratio = i1_over_i0(k)
        gap = ratio - r
        lo, hi = np.where(gap < 0, k, lo), np.where(gap < 0, hi, k)
        step = k - gap / np.maximum(1.0 - ratio / k - ratio * ratio, 1e-12)
        new = np.where((step > lo) & (step < hi), step, np.sqrt(lo * hi))
        done = np.abs(new - k) <= 1e-13 * k
        k = new
        if done.all():
            break
    top, bottom = i1_over_i0(np.array(high)), i1_over_i0(np.array(low))
    return np.where(r >= top, high, np.where(r <= bottom, low, k))
