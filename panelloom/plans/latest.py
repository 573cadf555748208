"""The next value of a local lag transform, from a series' values in NumPy: the counterpart of the windows for rolling forward."""

from __future__ import annotations

import numpy as np

from ..operators.lag_transforms import Combine, LagTransform, Offset


def _stat(x: np.ndarray, tfm: LagTransform) -> float:
    x = x[~np.isnan(x)]
    if len(x) < max(tfm.least, 1):
        return np.nan
    if tfm.stat == "mean":
        return x.mean()
    if tfm.stat == "std":
        return x.std(ddof=1) if len(x) > 1 else np.nan
    if tfm.stat == "min":
        return x.min()
    if tfm.stat == "max":
        return x.max()
    return np.quantile(x, tfm.p)


def latest(values: np.ndarray, tfm: LagTransform, lag: int) -> float:
    """The feature of the row that would come after values; NaN where it has none."""
    if isinstance(tfm, Offset):
        return latest(values, tfm.tfm, lag + tfm.n)
    if isinstance(tfm, Combine):
        a, b = latest(values, tfm.tfm1, lag), latest(values, tfm.tfm2, lag)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = tfm.operator(np.float64(a), np.float64(b))
        return out if np.isfinite(out) else np.nan
    seen = values[: max(0, len(values) - lag + 1)]
    if not len(seen):
        return np.nan
    if tfm.kind == "lag":
        return seen[-1]
    if tfm.kind == "rolling":
        return _stat(seen[-tfm.window_size :], tfm)
    if tfm.kind == "expanding":
        return _stat(seen, tfm)
    if tfm.kind == "seasonal":
        return _stat(seen[::-1][:: tfm.season_length][: tfm.window_size], tfm)
    state = np.nan
    for x in seen[~np.isnan(seen)]:
        state = x if np.isnan(state) else tfm.alpha * x + (1 - tfm.alpha) * state
    return state
