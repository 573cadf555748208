"""Statistics of one series, on NumPy arrays: unit roots, seasonal strength, period, Box-Cox."""

from __future__ import annotations

import numpy as np

#: Fixed value: 5 % critical value of the KPSS test for level stationarity (Kwiatkowski et al. 1992, table 1).
KPSS_5 = 0.463
#: Fixed value: least seasonal strength that calls for a seasonal difference (Wang, Smith and Hyndman 2006).
SEASONAL_STRENGTH = 0.64


def kpss(x: np.ndarray) -> float:
    n = len(x)
    e = x - x.mean()
    s = np.cumsum(e)
    lags = int(np.ceil(3 * np.sqrt(n) / 13)) if n > 1 else 0
    var = (e @ e) / n
    for k in range(1, lags + 1):
        var += 2 / n * (1 - k / (lags + 1)) * (e[k:] @ e[:-k])
    return float((s @ s) / (n * n) / var) if var > 1e-12 else 0.0


def n_differences(x: np.ndarray, most: int) -> int:
    """First differences until the KPSS test no longer rejects; none for constant or very short series."""
    x = np.asarray(x, float)
    d = 0
    while d < most and len(x) > 3 and np.ptp(x) > 1e-12 and kpss(x) > KPSS_5:
        x = np.diff(x)
        d += 1
    return d


def seasonal_strength(x: np.ndarray, period: int) -> float:
    """1 - var(remainder) / var(seasonal + remainder) after a centred moving average; 0 for under two periods."""
    n = len(x)
    if period < 2 or n < 2 * period:
        return 0.0
    weights = np.ones(period) / period if period % 2 else np.concatenate([[0.5], np.ones(period - 1), [0.5]]) / period
    half = len(weights) // 2
    detrended = x[half : n - half] - np.convolve(x, weights, "valid")
    at = np.arange(half, n - half) % period
    season = np.array([detrended[at == k].mean() if (at == k).any() else 0.0 for k in range(period)])
    remainder = detrended - (season - season.mean())[at]
    total = detrended.var()
    return float(max(0.0, 1 - remainder.var() / total)) if total > 1e-12 else 0.0


def n_seasonal_differences(x: np.ndarray, period: int, most: int) -> int:
    d = 0
    x = np.asarray(x, float)
    while d < most and seasonal_strength(x, period) > SEASONAL_STRENGTH:
        x = x[period:] - x[:-period]
        d += 1
    return d


def find_period(x: np.ndarray, longest: int) -> int:
    """The lag over 1 at which the detrended series' autocorrelation has its highest local peak; 1 where none stands out."""
    n = len(x)
    longest = min(longest, n // 2)
    if longest < 2:
        return 1
    t = np.arange(n)
    e = x - np.polyval(np.polyfit(t, x, 1), t)
    var = e @ e
    if var < 1e-12:
        return 1
    acf = np.array([1.0] + [e[k:] @ e[:-k] / var for k in range(1, min(longest + 2, n))])
    peaks = [k for k in range(2, longest + 1) if k + 1 < len(acf) and acf[k] > acf[k - 1] and acf[k] >= acf[k + 1] and acf[k] > 1.96 / np.sqrt(n)]
    return max(peaks, key=lambda k: acf[k]) if peaks else 1


def box_cox_lambda(x: np.ndarray, low: float = 0.0, high: float = 2.0) -> float:
    """The power of the highest likelihood, by golden section; 1 (no change) for series that are not positive."""
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    if len(x) < 3 or x.min() <= 0 or np.ptp(x) < 1e-12:
        return 1.0
    logs = np.log(x)

    def loss(power: float) -> float:
        z = logs if abs(power) < 1e-9 else np.expm1(power * logs) / power
        return 0.5 * len(x) * np.log(max(z.var(), 1e-300)) - (power - 1) * logs.sum()

    ratio = (np.sqrt(5) - 1) / 2
    a, b = low, high
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float((a + b) / 2)
