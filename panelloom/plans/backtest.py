"""Rolling-origin evaluation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import Roles, q
from .lineage import cut

BACK = "__back"


def with_back(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows numbered from each series' end, from 1: on a gap-free grid a window is a range of this number."""
    return df.withColumn(BACK, F.row_number().over(Window.partitionBy(q(roles.id)).orderBy(q(roles.time).desc())))


def windows(n_windows: int, h: int, step_size: int | None) -> list[int]:
    """Rows after each window's last validation row, the oldest window first."""
    if n_windows < 1 or h < 1:
        raise ValueError("n_windows and h must be positive")
    step = step_size or h
    return [step * (n_windows - 1 - i) for i in range(n_windows)]


def split(numbered: DataFrame, after: int, h: int, input_size: int | None) -> tuple[DataFrame, DataFrame]:
    train = F.col(BACK) > after + h
    if input_size:
        train = train & (F.col(BACK) <= after + h + input_size)
    valid = (F.col(BACK) > after) & (F.col(BACK) <= after + h)
    return numbered.filter(train).drop(BACK), numbered.filter(valid).drop(BACK)


def cross_validation(
    panel: Any, df: DataFrame, n_windows: int, h: int, step_size: int | None = None, refit: bool | int = True, input_size: int | None = None,
    static_features=None, dropna=True, keep_last_n=None, max_horizon=None, horizons=None, fitted=False, level=None, prediction_intervals=None,
    weight_col=None, validate=True, before_predict_callback=None, after_predict_callback=None,
) -> DataFrame:
    """id, time, cutoff, target and a column for each model: predictions of the last h steps of each window.

    Window i trains on rows up to each series' own cutoff. refit: at each window, never after the first, or at every so many.
    """
    from . import validate as checks

    r = panel.roles
    if validate:
        checks.validate(df, r, panel.plan.step)
    numbered = cut(with_back(df, r))
    short = numbered.groupBy(q(r.id)).agg(F.max(BACK).alias("n")).filter(F.col("n") <= h + windows(n_windows, h, step_size)[0])
    if validate and not short.isEmpty():
        raise ValueError("some series are too short for these windows")
    results, in_sample = [], []
    for i, after in enumerate(windows(n_windows, h, step_size)):
        train, valid = split(numbered, after, h, input_size)
        again = i == 0 or (refit is True) or (refit is not False and refit > 0 and i % refit == 0)
        if again:
            panel.fit(
                train, static_features=static_features, dropna=dropna, keep_last_n=keep_last_n, max_horizon=max_horizon, horizons=horizons,
                fitted=fitted, weight_col=weight_col, validate=False, prediction_intervals=prediction_intervals if level else None,
            )
            if fitted:
                in_sample.append(panel.forecast_fitted_values().withColumn("fold", F.lit(i)))
        needed = [c for c in panel.plan.dynamics if c in panel.plan.inputs] + panel.plan.partition_columns
        needed = list(dict.fromkeys(needed))
        given = valid.select(q(r.id), q(r.time), *(q(c) for c in needed)) if needed else None
        found = panel.predict(
            h, X_df=given, new_df=None if again else train, level=level, before_predict_callback=before_predict_callback,
            after_predict_callback=after_predict_callback,
        )
        cutoffs = train.groupBy(q(r.id)).agg(F.max(q(r.time)).alias("cutoff"))
        actual = valid.select(q(r.id), q(r.time), q(r.target))
        rows = found.join(actual, [r.id, r.time]).join(cutoffs, r.id)
        names = [c for c in found.columns if c not in (r.id, r.time)]
        results.append(rows.select(q(r.id), q(r.time), "cutoff", q(r.target), *(q(n) for n in names)))
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    if fitted:
        panel.cv_fitted = in_sample[0]
        for x in in_sample[1:]:
            panel.cv_fitted = panel.cv_fitted.unionByName(x)
    return out
