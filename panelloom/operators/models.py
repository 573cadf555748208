"""Models: estimators of pyspark.ml, estimators over arrays, and forecasts that are a feature themselves."""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.features import q

VECTOR = "__pm_features"


def name_models(models: Any) -> dict[str, Any]:
    """Models by name; of unnamed ones of a class the second is called Name2, and so on."""
    if isinstance(models, dict):
        return dict(models)
    models = list(models) if isinstance(models, (list, tuple)) else [models]
    seen: Counter = Counter()
    out = {}
    for m in models:
        name = type(m.estimator if isinstance(m, ArrayModel) else m).__name__
        seen[name] += 1
        out[name if seen[name] == 1 else f"{name}{seen[name]}"] = m
    return out


class FeatureModel:
    """The forecast is one of the features, such as lag12 for a seasonal naive forecast."""

    def __init__(self, feature: str):
        self.feature = feature


class ArrayModel:
    """An estimator with fit(X, y) and predict(X) over NumPy arrays, fitted on the driver and applied by the executors.

    It is fitted on all rows or not at all: more than most_rows are an error, and need an estimator that Spark distributes.
    """

    def __init__(self, estimator: Any, most_rows: int = 1_000_000):
        self.estimator, self.most_rows = estimator, most_rows

    def fit(self, df: DataFrame, features: list[str], target: str, weight: str | None, params: dict) -> ArrayModel:
        wanted = [F.coalesce(q(f).cast("double"), F.lit(float("nan"))).alias(f"__pm_{i}") for i, f in enumerate(features)]
        more = [q(weight).cast("double").alias("__pm_weight")] if weight else []
        rows = df.select(*wanted, q(target).cast("double").alias("__pm_label"), *more).limit(self.most_rows + 1).toPandas()
        if len(rows) > self.most_rows:
            raise ValueError(f"more than {self.most_rows} rows to fit an estimator over arrays on: raise most_rows or take a distributed estimator")
        own = copy.deepcopy(self.estimator)
        weights = {"sample_weight": rows["__pm_weight"].to_numpy()} if weight else {}
        own.fit(rows.iloc[:, : len(features)].to_numpy(), rows["__pm_label"].to_numpy(), **weights, **params)
        return ArrayModel(own, self.most_rows)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.estimator.predict(x), float).ravel()


class Fitted:
    """A fitted model over an ordered list of features."""

    def __init__(self, model: Any, features: list[str]):
        self.model, self.features = model, features

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if isinstance(self.model, FeatureModel):
            return df.withColumn(out, q(self.model.feature).cast("double"))
        if isinstance(self.model, ArrayModel):
            model = self.model

            @F.pandas_udf("double")
            def scored_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
                for x in batches:
                    yield pd.Series(model.predict(x.to_numpy(float)) if len(x) else np.empty(0))

            return df.withColumn(out, scored_rows(F.struct(*(F.coalesce(q(f).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(self.features)))))
        rows, own = assembled(df, self.features)
        scored = self.model.transform(rows)
        return scored.select(*own, q(self.model.getOrDefault("predictionCol")).alias(out))

    def row_function(self) -> Callable[[np.ndarray], float] | None:
        """The model on one row of features in NumPy, for models that are that simple."""
        if isinstance(self.model, FeatureModel):
            at = self.features.index(self.model.feature)
            return lambda x: x[at]
        if isinstance(self.model, LinearRegressionModel):
            weights, intercept = np.array(self.model.coefficients.toArray()), float(self.model.intercept)
            return lambda x: float(x @ weights + intercept)
        if isinstance(self.model, ArrayModel):
            model = self.model
            return lambda x: float(model.predict(x[None])[0])
        return None


def assembled(df: DataFrame, features: list[str]) -> tuple[DataFrame, list]:
    """df with a vector of the features (null as NaN), and df's own columns."""
    own = [q(c) for c in df.columns]
    names = [f"__pm_{i}" for i in range(len(features))]
    cast = df.select(*own, *(F.coalesce(q(f).cast("double"), F.lit(float("nan"))).alias(n) for f, n in zip(features, names, strict=True)))
    return VectorAssembler(inputCols=names, outputCol=VECTOR, handleInvalid="keep").transform(cast).drop(*names), own


def fit_model(model: Any, df: DataFrame, features: list[str], target: str, weight: str | None = None, params: dict | None = None) -> Fitted:
    """Fits an estimator (or takes a feature) on rows with a target; the estimator that was given stays as it is.

    Anything with fit and predict that is no estimator of Spark's is one over arrays. params are Spark params by name, or arguments of its fit.
    """
    if isinstance(model, FeatureModel) or isinstance(model, Model) and not isinstance(model, Estimator):
        return Fitted(model, features)
    if not features:
        raise ValueError("there are no features to fit a model on")
    known = df.filter(q(target).isNotNull())
    if not isinstance(model, Estimator):
        own = model if isinstance(model, ArrayModel) else ArrayModel(model)
        return Fitted(own.fit(known, features, target, weight, params or {}), features)
    rows, _ = assembled(known.withColumn("__pm_label", q(target).cast("double")), features)
    own = model.copy({model.getParam("featuresCol"): VECTOR, model.getParam("labelCol"): "__pm_label"})
    if weight:
        own.set(own.getParam("weightCol"), weight)
    return Fitted(own.fit(rows, {own.getParam(k): v for k, v in (params or {}).items()}), features)
