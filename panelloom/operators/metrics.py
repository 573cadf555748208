"""Losses: a value for each series, then the mean over series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.features import Roles, q


def _by_series(df: DataFrame, roles: Roles, error: Column, weight: str | None, root: bool = False) -> float:
    rows = df.select(q(roles.id).alias("id"), error.alias("e"), (q(weight) if weight else F.lit(1.0)).alias("w")).filter("e is not null")
    by_id = rows.groupBy("id").agg(F.avg("e").alias("e"), F.sum("w").alias("w"))
    if weight:
        found = by_id.agg((F.sum(F.col("e") * F.col("w")) / F.sum("w")).alias("v")).first()["v"]
    else:
        found = by_id.agg(F.avg("e").alias("v")).first()["v"]
    found = float("nan") if found is None else float(found)
    return found**0.5 if root else found


def mape(df: DataFrame, roles: Roles, model: str, weight: str | None = None) -> float:
    return _by_series(df, roles, F.abs(F.try_divide(q(roles.target) - q(model), q(roles.target))), weight)


def rmse(df: DataFrame, roles: Roles, model: str, weight: str | None = None) -> float:
    """Root of the mean over series of their mean squared errors."""
    return _by_series(df, roles, F.pow(q(roles.target) - q(model), 2), weight, root=True)


def smape(df: DataFrame, roles: Roles, model: str, weight: str | None = None) -> float:
    bottom = F.abs(q(roles.target)) + F.abs(q(model))
    return _by_series(df, roles, F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(q(roles.target) - q(model)), bottom)), weight)


METRICS = {"mape": mape, "rmse": rmse, "smape": smape}
