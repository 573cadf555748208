"""Invertible target transforms. Each fits its state as a small DataFrame and maps the target with Columns.

Order: transforms apply from left to right before any feature is computed, and are undone from right to left.
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tests_of_series as ts
from ..plans.features import Roles, q

S = "__pt_"


class TargetTransform:
    """fit_transform(df), inverse(predictions, columns) and inverse_fitted(in-sample predictions, columns)."""

    roles: Roles

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        raise NotImplementedError

    def inverse(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        """pred has one row per series and step; step counts from 1."""
        raise NotImplementedError

    def inverse_fitted(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        return self.inverse(pred, columns)

    def update(self, history: DataFrame) -> DataFrame:
        """Maps a longer history with the state of the fit; differences keep their tails from it."""
        return self.fit_transform(history, self.roles)


class _Scaler(TargetTransform):
    """(y - shift) / scale with one shift and scale per series; a scale of 0 counts as 1. Null series values stay null."""

    state: DataFrame | None = None

    def _stats(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        self.roles = roles
        self.state = self._stats(df).select(
            F.col("id").alias(f"{S}id"), F.col("shift").alias(f"{S}shift"), F.when(F.abs("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)).alias(f"{S}scale")
        )
        return self.update(df)

    def _map(self, df: DataFrame, columns: list[str], back: bool) -> DataFrame:
        names = df.columns
        out = df.join(self.state, q(self.roles.id) == F.col(f"{S}id"), "left")
        shift, scale = F.col(f"{S}shift"), F.col(f"{S}scale")
        return out.select(*((q(c) * scale + shift if back else (q(c) - shift) / scale).alias(c) if c in columns else q(c) for c in names))

    def update(self, history: DataFrame) -> DataFrame:
        return self._map(history, [self.roles.target], False)

    def inverse(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        return self._map(pred, columns, True)


class LocalStandardScaler(_Scaler):
    def _stats(self, df):
        y = q(self.roles.target)
        return df.groupBy(q(self.roles.id).alias("id")).agg(F.avg(y).alias("shift"), F.stddev_pop(y).alias("scale"))


class LocalMinMaxScaler(_Scaler):
    def _stats(self, df):
        y = q(self.roles.target)
        return df.groupBy(q(self.roles.id).alias("id")).agg(F.min(y).cast("double").alias("shift"), (F.max(y) - F.min(y)).cast("double").alias("scale"))


class LocalRobustScaler(_Scaler):
    """Median, and the interquartile range or the median absolute deviation."""

    def __init__(self, scale: str = "iqr"):
        if scale not in ("iqr", "mad"):
            raise ValueError("scale must be iqr or mad")
        self.scale = scale

    def _stats(self, df):
        y, uid = q(self.roles.target), q(self.roles.id)
        quarters = df.groupBy(uid.alias("id")).agg(F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
        if self.scale == "iqr":
            return quarters.select("id", F.col("p")[1].alias("shift"), (F.col("p")[2] - F.col("p")[0]).alias("scale"))
        centred = df.select(uid.alias("id"), y.alias("y")).join(quarters.select("id", F.col("p")[1].alias("m")), "id")
        return centred.groupBy("id").agg(F.first("m").alias("shift"), F.percentile(F.abs(F.col("y") - F.col("m")), F.lit(0.5)).alias("scale"))


class LocalBoxCox(TargetTransform):
    """Box-Cox with the power of the highest likelihood for each series (0 to 2); series that are not positive stay as they are."""

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        self.roles = roles
        self.state = _per_series(df, roles, lambda x: [ts.box_cox_lambda(x)], ["power"]).select(F.col("id").alias(f"{S}id"), F.col("power").alias(f"{S}power"))
        return self.update(df)

    def _map(self, df, columns, fn):
        names = df.columns
        out = df.join(self.state, q(self.roles.id) == F.col(f"{S}id"), "left")
        power = F.coalesce(F.col(f"{S}power"), F.lit(1.0))
        return out.select(*(fn(q(c), power).alias(c) if c in columns else q(c) for c in names))

    def update(self, history):
        return self._map(
            history, [self.roles.target],
            lambda y, p: F.when(p == 1.0, y - 1.0).when(F.abs(p) < 1e-9, F.log(y)).otherwise((F.pow(y, p) - 1) / p),
        )

    def inverse(self, pred, columns):
        return self._map(
            pred, columns,
            lambda y, p: F.when(p == 1.0, y + 1.0).when(F.abs(p) < 1e-9, F.exp(y)).otherwise(F.pow(F.greatest(y * p + 1, F.lit(0.0)), F.lit(1.0) / p)),
        )


class GlobalFunction(TargetTransform):
    """One pair of functions of Columns for all series, such as log1p and expm1."""

    def __init__(self, forward: Callable[[Column], Column], backward: Callable[[Column], Column]):
        self.forward, self.backward = forward, backward

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        self.roles = roles
        return df.withColumn(roles.target, self.forward(q(roles.target)))

    def inverse(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        return pred.withColumns({c: self.backward(q(c)) for c in columns})


class GlobalFitted(TargetTransform):
    """One transformer for all series, with fit, transform and inverse_transform over arrays of one column.

    It is fitted on the driver, on all values or not at all: more than most_rows are an error.
    """

    def __init__(self, transformer: Any, most_rows: int = 1_000_000):
        self.transformer, self.most_rows = transformer, most_rows

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        self.roles = roles
        y = q(roles.target).cast("double")
        values = df.select(y.alias("y")).filter("y is not null and not isnan(y)").limit(self.most_rows + 1).toPandas()
        if len(values) > self.most_rows:
            raise ValueError(f"more than {self.most_rows} values to fit one transformer on")
        fitted = copy.deepcopy(self.transformer)
        self.fitted = fitted.fit(values.to_numpy()) or fitted
        return self.update(df)

    def _map(self, df: DataFrame, columns: list[str], method: str) -> DataFrame:
        apply = getattr(self.fitted, method)

        @F.pandas_udf("double")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                out, known = np.full(len(batch), np.nan), batch.notna().to_numpy()
                if known.any():
                    out[known] = np.asarray(apply(batch.to_numpy(float)[known][:, None]), float)[:, 0]
                yield pd.Series(out).where(known)

        return df.withColumns({c: mapped(q(c).cast("double")) for c in columns})

    def update(self, history: DataFrame) -> DataFrame:
        return self._map(history, [self.roles.target], "transform")

    def inverse(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        return self._map(pred, columns, "inverse_transform")


class Differences(TargetTransform):
    """y less y of d steps before, for each d in turn. The first sum(d) values of a series become null."""

    def __init__(self, differences: list[int]):
        self.differences = list(differences)

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        self.roles = roles
        need = sum(self.differences)
        short = df.groupBy(q(roles.id).alias("id")).count().filter(F.col("count") < need).limit(5).collect()
        if short:
            raise ValueError(f"series shorter than {need}: " + ", ".join(str(r["id"]) for r in short))
        by_id = Window.partitionBy(q(roles.id)).orderBy(q(roles.time))
        self.stages = []
        out = df
        for d in self.differences:
            self.stages.append((d, out.select(q(roles.id).alias(f"{S}id"), q(roles.time).alias(f"{S}t"), q(roles.target).cast("double").alias(f"{S}y"))))
            out = out.withColumn(roles.target, q(roles.target) - F.lag(q(roles.target), d).over(by_id))
        return out

    def inverse(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        """In each class of steps modulo d the forecast sums up on the last value of that class."""
        for d, stage in reversed(self.stages):
            back = F.row_number().over(Window.partitionBy(f"{S}id").orderBy(F.col(f"{S}t").desc()))
            tail = stage.withColumn(f"{S}b", back).filter(F.col(f"{S}b") <= d).select(f"{S}id", (F.lit(d) - F.col(f"{S}b")).alias(f"{S}r"), f"{S}y")
            names = pred.columns
            rest = F.pmod(F.col("step") - 1, F.lit(d))
            out = pred.withColumn(f"{S}c", rest)
            out = out.join(tail, (q(self.roles.id) == F.col(f"{S}id")) & (F.col(f"{S}c") == F.col(f"{S}r")), "left")
            run = Window.partitionBy(q(self.roles.id), f"{S}c").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
            pred = out.select(*((F.col(f"{S}y") + F.sum(q(c)).over(run)).alias(c) if c in columns else q(c) for c in names))
        return pred

    def inverse_fitted(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        for d, stage in reversed(self.stages):
            before = stage.select(
                f"{S}id", f"{S}t", F.lag(f"{S}y", d).over(Window.partitionBy(f"{S}id").orderBy(f"{S}t")).alias(f"{S}y")
            )
            names = pred.columns
            out = pred.join(before, (q(self.roles.id) == F.col(f"{S}id")) & (q(self.roles.time) == F.col(f"{S}t")), "left")
            pred = out.select(*((q(c) + F.col(f"{S}y")).alias(c) if c in columns else q(c) for c in names))
        return pred


class _AutoDiff(TargetTransform):
    """A number of differences at one lag for each series; all series run through the same stages, each as far as it needs."""

    max_diffs: int

    def _choose(self, x: np.ndarray) -> list[float]:
        """[lag, number] for a series."""
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        self.roles = roles
        self.state = _per_series(df, roles, self._choose, ["lag", "number"]).select(
            F.col("id").alias(f"{S}id"), F.col("lag").cast("int").alias(f"{S}lag"), F.col("number").cast("int").alias(f"{S}number")
        )
        return self.update(df)

    def update(self, history: DataFrame) -> DataFrame:
        roles, names = self.roles, history.columns
        by_id = Window.partitionBy(q(roles.id)).orderBy(q(roles.time))
        out = history.join(self.state, q(roles.id) == F.col(f"{S}id"), "left")
        out = out.withColumn(f"{S}n", F.row_number().over(by_id)).withColumn(roles.target, q(roles.target).cast("double"))
        self.stages = []
        for k in range(1, self.max_diffs + 1):
            self.stages.append((k, out.select(f"{S}id", q(roles.time).alias(f"{S}t"), q(roles.target).alias(f"{S}y"), f"{S}lag", f"{S}number", f"{S}n")))
            # The lag differs by series, so rows of one class of the row number modulo the lag follow each other.
            within = Window.partitionBy(q(roles.id), F.pmod(F.col(f"{S}n"), F.col(f"{S}lag"))).orderBy(q(roles.time))
            gone = q(roles.target) - F.lag(q(roles.target), 1).over(within)
            out = out.withColumn(roles.target, F.when(F.col(f"{S}number") >= k, gone).otherwise(q(roles.target)))
        return out.select(*(q(c) for c in names))

    def inverse(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        for k, stage in reversed(self.stages):
            back = F.row_number().over(Window.partitionBy(f"{S}id").orderBy(F.col(f"{S}t").desc()))
            tail = stage.filter(F.col(f"{S}number") >= k).withColumn(f"{S}b", back).filter(F.col(f"{S}b") <= F.col(f"{S}lag"))
            tail = tail.select(f"{S}id", (F.col(f"{S}lag") - F.col(f"{S}b")).alias(f"{S}r"), f"{S}y")
            lags = self.state.select(F.col(f"{S}id").alias(f"{S}i"), f"{S}lag")
            names = pred.columns
            out = pred.join(lags, q(self.roles.id) == F.col(f"{S}i"), "left").withColumn(f"{S}c", F.pmod(F.col("step") - 1, F.col(f"{S}lag")))
            out = out.join(tail, (q(self.roles.id) == F.col(f"{S}id")) & (F.col(f"{S}c") == F.col(f"{S}r")), "left")
            run = Window.partitionBy(q(self.roles.id), f"{S}c").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
            summed = lambda c: F.when(F.col(f"{S}y").isNotNull(), F.col(f"{S}y") + F.sum(q(c)).over(run)).otherwise(q(c))
            pred = out.select(*(summed(c).alias(c) if c in columns else q(c) for c in names))
        return pred

    def inverse_fitted(self, pred: DataFrame, columns: list[str]) -> DataFrame:
        for k, stage in reversed(self.stages):
            within = Window.partitionBy(f"{S}id", F.pmod(F.col(f"{S}n"), F.col(f"{S}lag"))).orderBy(f"{S}t")
            before = stage.select(f"{S}id", f"{S}t", F.when(F.col(f"{S}number") >= k, F.lag(f"{S}y", 1).over(within)).otherwise(F.lit(0.0)).alias(f"{S}y"))
            names = pred.columns
            out = pred.join(before, (q(self.roles.id) == F.col(f"{S}id")) & (q(self.roles.time) == F.col(f"{S}t")), "left")
            pred = out.select(*((q(c) + F.col(f"{S}y")).alias(c) if c in columns else q(c) for c in names))
        return pred


class AutoDifferences(_AutoDiff):
    """As many first differences as a KPSS test asks for."""

    def __init__(self, max_diffs: int):
        self.max_diffs = max_diffs

    def _choose(self, x):
        return [1, ts.n_differences(x, self.max_diffs)]


class AutoSeasonalDifferences(_AutoDiff):
    """As many seasonal differences as the season's strength asks for, judged on the last n_seasons seasons."""

    def __init__(self, season_length: int, max_diffs: int, n_seasons: int | None = 10):
        self.season_length, self.max_diffs, self.n_seasons = season_length, max_diffs, n_seasons

    def _choose(self, x):
        tail = x[-self.season_length * self.n_seasons :] if self.n_seasons else x
        return [self.season_length, ts.n_seasonal_differences(tail, self.season_length, self.max_diffs)]


class AutoSeasonalityAndDifferences(_AutoDiff):
    """Finds each series' period up to max_season_length, then differences at it."""

    def __init__(self, max_season_length: int, max_diffs: int, n_seasons: int | None = 10):
        self.max_season_length, self.max_diffs, self.n_seasons = max_season_length, max_diffs, n_seasons

    def _choose(self, x):
        tail = x[-self.max_season_length * self.n_seasons :] if self.n_seasons else x
        period = ts.find_period(tail, self.max_season_length)
        if period > 1 and (d := ts.n_seasonal_differences(tail, period, self.max_diffs)):
            return [period, d]
        return [1, ts.n_differences(tail, self.max_diffs)]


def _per_series(df: DataFrame, roles: Roles, fn: Callable[[np.ndarray], list[float]], names: list[str]) -> DataFrame:
    """id and fn's values for each series, in one Arrow pass."""
    kind = dict(df.dtypes)[roles.id]
    slim = df.select(q(roles.id).alias("id"), q(roles.time).alias("t"), q(roles.target).cast("double").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        values = table["y"].to_numpy(zero_copy_only=False)
        found = fn(values[~np.isnan(values)])
        return pa.table({"id": table["id"].slice(0, 1), **{n: pa.array([float(v)]) for n, v in zip(names, found, strict=True)}})

    return slim.groupBy("id").applyInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in names))


def fresh(transform: Any) -> Any:
    """The same transform without what it learnt."""
    out = copy.copy(transform)
    for name in ("state", "stages", "roles", "fitted"):
        out.__dict__.pop(name, None)
    return out


def apply_all(transforms: list[Any], df: DataFrame, roles: Roles) -> DataFrame:
    return functools.reduce(lambda d, t: t.fit_transform(d, roles), transforms, df)


def undo_all(transforms: list[Any], pred: DataFrame, columns: list[str], fitted: bool = False) -> DataFrame:
    return functools.reduce(lambda d, t: (t.inverse_fitted if fitted else t.inverse)(d, columns), reversed(transforms), pred)
