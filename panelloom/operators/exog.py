"""Lags and lag transforms of columns other than the target."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..plans.features import Features, Roles, add_lag_features, q
from .lag_transforms import Lag, as_transform


def transform_exog(df: DataFrame, lags: list[int] | None = None, lag_transforms: dict[int, list[Any]] | None = None, id_col: str = "unique_id", time_col: str = "ds") -> DataFrame:
    """df with <column>_<feature> for each column but the keys; all share one exchange and sort by series."""
    if not lags and not lag_transforms:
        raise ValueError("give lags or lag_transforms")
    features: Features = {}
    for lag in lags or []:
        features[Lag().name(lag)] = (Lag(), lag)
    for lag, tfms in (lag_transforms or {}).items():
        for t in map(as_transform, tfms):
            features[t.name(lag)] = (t, lag)
    if any(not t.scope.is_local for t, _ in features.values()):
        raise ValueError("only local transforms apply to exogenous columns")
    columns = [c for c in df.columns if c not in (id_col, time_col)]
    out = df
    for c in columns:
        named = {f"{c}_{n}": f for n, f in features.items()}
        out = add_lag_features(out, Roles(id_col, time_col, c), named)
    return out.select(*(q(c) for c in df.columns), *(q(f"{c}_{n}") for c in columns for n in features))
