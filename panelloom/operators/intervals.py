"""Conformal prediction intervals from back-test errors, and their transfer to series that were not trained on.

Scores are rows (id, step, window, an error for each model); every interval is a grouped exact percentile of them.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import Any

from pyspark import SparkContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.features import Roles, q
from ..plans.lineage import cut

METHODS = ("conformal_distribution", "conformal_error", "weighted_conformal_distribution", "weighted_conformal_error")
TRANSFER_METHODS = ("recalibrate", "weighted_conformal", "scale_aligned", "scale_aligned_weighted", "error_scaled")


@dataclass(frozen=True)
class PredictionIntervals:
    n_windows: int = 2
    h: int = 1
    method: str = "conformal_distribution"

    def __post_init__(self):
        if self.n_windows < 2:
            raise ValueError("n_windows must be at least 2")
        if self.h < 1:
            raise ValueError("h must be positive")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")


@dataclass(frozen=True)
class TransferConformal:
    """How intervals move to new series: see TRANSFER_METHODS; n_windows for those that back-test on the target."""

    method: str = "recalibrate"
    n_windows: int = 2
    scale: str = "mad"
    cv: int = 5
    clip_quantile: float = 0.99

    def __post_init__(self):
        if self.method not in TRANSFER_METHODS:
            raise ValueError(f"method must be one of {', '.join(TRANSFER_METHODS)}")
        if self.method in ("recalibrate", "error_scaled") and self.n_windows < 2:
            raise ValueError("a back-test on the target needs at least 2 windows")
        if self.scale not in ("mad", "std"):
            raise ValueError("scale must be mad or std")


def scores_of(cv: DataFrame, roles: Roles, models: list[str], signed: bool = False) -> DataFrame:
    """Errors of back-test rows with their step within the window."""
    step = F.row_number().over(Window.partitionBy(q(roles.id), "cutoff").orderBy(q(roles.time)))
    error = lambda m: (q(roles.target) - q(m)) if signed else F.abs(q(roles.target) - q(m))
    return cv.select(q(roles.id), "cutoff", step.alias("step"), *(error(m).alias(m) for m in models))


def conformity_scores(panel: Any, df: DataFrame, intervals: PredictionIntervals, options: dict, signed: bool = False) -> DataFrame:
    """Scores of a back-test whose models are fitted on its first window only."""
    own = panel.clone()
    r = panel.roles
    need = intervals.h * intervals.n_windows + 1
    if not df.groupBy(q(r.id)).count().filter(F.col("count") < need).isEmpty():
        raise ValueError(f"intervals need at least {need} rows for each series")
    cv = own.cross_validation(df, intervals.n_windows, intervals.h, refit=False, validate=False, **options)
    return scores_of(cv, r, list(own.fitted), signed)


def level_name(level: float) -> str:
    return f"{level:g}"


def _named(model: str, levels: list[float], low: dict[float, Column], high: dict[float, Column]) -> list[Column]:
    """Lower bounds with falling levels, then upper bounds with rising ones."""
    return [low[v].alias(f"{model}-lo-{level_name(v)}") for v in reversed(levels)] + [high[v].alias(f"{model}-hi-{level_name(v)}") for v in levels]


def error_quantiles(scores: DataFrame, keys: list[str], model: str, levels: list[float], distribution: bool) -> DataFrame:
    """keys, w0, w1...: half-widths for each level. The distribution method takes quantiles of forecast plus and less error."""
    if distribution:
        both = scores.select(*(q(k) for k in keys), F.explode(F.array(q(model), -q(model))).alias("e"))
        shares = [1 - (100 - v) / 200 for v in levels]
    else:
        both, shares = scores.select(*(q(k) for k in keys), q(model).alias("e")), [v / 100 for v in levels]
    wanted = F.percentile("e", F.array(*(F.lit(float(s)) for s in shares))).alias("w")
    grouped = both.groupBy(*(q(k) for k in keys)).agg(wanted) if keys else both.agg(wanted)
    return grouped.select(*(q(k) for k in keys), *(F.col("w")[i].alias(f"w{i}") for i in range(len(levels))))


def with_step(pred: DataFrame, roles: Roles) -> DataFrame:
    if "step" in pred.columns:
        return pred
    return pred.withColumn("step", F.row_number().over(Window.partitionBy(q(roles.id)).orderBy(q(roles.time))))


def conformal(pred: DataFrame, scores: DataFrame, roles: Roles, models: list[str], levels: list[float], method: str, h: int, fitted_h: int, pooled: bool = False) -> DataFrame:
    """pred with bounds. One step of scores serves all steps; otherwise scores must reach as far as pred. pooled: over all ids."""
    if fitted_h == 1 and h > 1:
        warnings.warn("scores of one step are used for all steps", stacklevel=2)
        keys = [] if pooled else [roles.id]
    elif fitted_h < h:
        raise ValueError(f"intervals were calibrated for up to {fitted_h} steps")
    else:
        keys = ["step"] if pooled else [roles.id, "step"]
    out = with_step(pred, roles)
    for m in models:
        widths = error_quantiles(scores, keys, m, levels, "distribution" in method)
        names = out.columns
        out = out.join(F.broadcast(widths), keys, "left") if keys and pooled else out.join(widths, keys, "left") if keys else out.join(F.broadcast(widths))
        low = {v: q(m) - F.col(f"w{i}") for i, v in enumerate(levels)}
        high = {v: q(m) + F.col(f"w{i}") for i, v in enumerate(levels)}
        out = out.select(*(q(c) for c in names), *_named(m, levels, low, high))
    return out


def signed_intervals(pred: DataFrame, scores: DataFrame, roles: Roles, models: list[str], levels: list[float], one_step: bool) -> DataFrame:
    """Forecast plus quantiles of signed errors for each step: bounds need not be symmetric."""
    out, keys = with_step(pred, roles), [] if one_step else ["step"]
    shares = [s for v in levels for s in ((100 - v) / 200, 1 - (100 - v) / 200)]
    for m in models:
        wanted = F.percentile(q(m), F.array(*(F.lit(float(s)) for s in shares))).alias("w")
        found = scores.groupBy(*keys).agg(wanted) if keys else scores.agg(wanted)
        names = out.columns
        out = out.join(F.broadcast(found), keys, "left") if keys else out.join(F.broadcast(found))
        low = {v: q(m) + F.col("w")[2 * i] for i, v in enumerate(levels)}
        high = {v: q(m) + F.col("w")[2 * i + 1] for i, v in enumerate(levels)}
        out = out.select(*(q(c) for c in names), *_named(m, levels, low, high))
    return out


def weighted_quantiles(scores: DataFrame, keys: list[str], value: str, weight: str, shares: list[float], test_weight: Column | float) -> DataFrame:
    """keys, w0, w1...: the least value whose share of the weight, with the test point's at infinity, reaches each share; null for infinity."""
    by_key = Window.partitionBy(*(q(k) for k in keys))
    so_far = F.sum(q(weight)).over(by_key.orderBy(q(value)).rangeBetween(Window.unboundedPreceding, 0))
    extra = F.lit(test_weight) if isinstance(test_weight, (int, float)) else test_weight
    total = F.sum(q(weight)).over(by_key) + extra
    rows = scores.select(*(q(k) for k in keys), q(value).alias("__v"), (so_far / total).alias("__s"))
    wanted = [F.min(F.when(F.col("__s") >= s - 1e-12, F.col("__v"))).alias(f"w{i}") for i, s in enumerate(shares)]
    return rows.groupBy(*(q(k) for k in keys)).agg(*wanted) if keys else rows.agg(*wanted)


def weighted_conformal(pred: DataFrame, scores: DataFrame, roles: Roles, models: list[str], levels: list[float], distribution: bool, test_weight: float = 1.0) -> DataFrame:
    """Bounds from scores with a column weight, pooled over series for each step."""
    size = scores.agg((F.pow(F.sum("weight"), 2) / F.sum(F.col("weight") * F.col("weight"))).alias("n")).first()["n"]
    if size is not None and size < 100 / (100 - max(levels)) - 1:
        warnings.warn("the weights leave too few effective scores for the highest level", stacklevel=2)
    out = with_step(pred, roles)
    for m in models:
        rows = scores.select("step", "weight", q(m).alias("e"))
        if distribution:
            rows = rows.select("step", (F.col("weight") / 2).alias("weight"), F.explode(F.array("e", -F.col("e"))).alias("e"))
        shares = [1 - (100 - v) / 200 if distribution else v / 100 for v in levels]
        found = weighted_quantiles(rows, ["step"], "e", "weight", shares, test_weight)
        names = out.columns
        out = out.join(F.broadcast(found), "step", "left")
        low = {v: q(m) - F.col(f"w{i}") for i, v in enumerate(levels)}
        high = {v: q(m) + F.col(f"w{i}") for i, v in enumerate(levels)}
        out = out.select(*(q(c) for c in names), *_named(m, levels, low, high))
    return out


def series_scales(df: DataFrame, roles: Roles, method: str = "mad", floor_factor: float = 1e-3) -> DataFrame:
    """id, scale: spread of a series' steps. One row: its size; a zero spread gets a floor from the median of all."""
    by_id = Window.partitionBy(q(roles.id)).orderBy(q(roles.time))
    y = q(roles.target).cast("double")
    rows = df.select(q(roles.id).alias("id"), y.alias("y"), (y - F.lag(y).over(by_id)).alias("d"))
    if method == "mad":
        middle = rows.groupBy("id").agg(F.percentile("d", F.lit(0.5)).alias("m"), F.avg(F.abs("y")).alias("size"), F.count("d").alias("n"))
        spread = rows.join(middle, "id").groupBy("id").agg(
            F.percentile(F.abs(F.col("d") - F.col("m")), F.lit(0.5)).alias("s"), F.first("size").alias("size"), F.first("n").alias("n"))
        scale = F.when(F.col("n") == 0, F.col("size")).otherwise(F.col("s"))
    else:
        spread = rows.groupBy("id").agg(F.stddev_samp("d").alias("s"), F.max(F.abs("d")).alias("one"), F.avg(F.abs("y")).alias("size"), F.count("d").alias("n"))
        scale = F.when(F.col("n") == 0, F.col("size")).when(F.col("n") == 1, F.col("one")).otherwise(F.col("s"))
    found = spread.select("id", scale.alias("scale"))
    floor = found.agg(F.greatest(F.percentile("scale", F.lit(0.5)) * floor_factor, F.lit(1e-8)).alias("floor"))
    return found.join(F.broadcast(floor)).select("id", F.greatest("scale", "floor").alias("scale"))


def robust_ratio(target: DataFrame, source: DataFrame, column: str) -> float:
    """Ratio of interquartile ranges of absolute errors, else of deviations, else 1."""

    def spreads(df: DataFrame) -> tuple[float, float]:
        p = df.agg(F.percentile(F.abs(q(column)), F.array(F.lit(0.25), F.lit(0.75))).alias("p"), F.stddev_pop(F.abs(q(column))).alias("s")).first()
        return (p["p"][1] - p["p"][0] if p["p"] else 0.0), p["s"] or 0.0

    (a, sa), (b, sb) = spreads(target), spreads(source)
    return a / b if b > 0 and a > 0 else sa / sb if sb > 0 and sa > 0 else 1.0


def _without_summary(model: Any) -> Any:
    """A copy without the summary of its training, which holds the session: executors can't be sent that once it has seen an Observation."""
    if not getattr(model, "hasSummary", False):
        return model
    out = model.copy()
    out._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return out


def estimate_density_ratio(source: DataFrame, target: DataFrame, features: list[str], cv: int = 5, clip_quantile: float = 0.99, classifier: Any = None) -> DataFrame:
    """source with weight: cross-fitted odds that a row belongs to the target, capped at a quantile. Folds are dealt by a hash of the features."""
    both = source.select("*", F.lit(0.0).alias("__y")).unionByName(target.select("*", F.lit(1.0).alias("__y")), allowMissingColumns=True)
    filled = both.select("*", *(F.coalesce(q(f).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, f in enumerate(features)))
    rows = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__raw").transform(filled)
    rows = StandardScaler(inputCol="__raw", outputCol="__v", withMean=True).fit(rows).transform(rows)
    rows = cut(rows.withColumn("__fold", F.pmod(F.xxhash64(*(q(f) for f in features), "__y"), F.lit(cv))))
    model = classifier or LogisticRegression(maxIter=100)
    model = model.copy({model.getParam("featuresCol"): "__v", model.getParam("labelCol"): "__y"})
    from pyspark.ml.functions import vector_to_array

    parts = None
    for k in range(cv):
        fitted = _without_summary(model.fit(rows.filter(F.col("__fold") != k)))
        p = vector_to_array(F.col("probability"))[1]
        own = fitted.transform(rows.filter((F.col("__fold") == k) & (F.col("__y") == 0)))
        own = own.withColumn("weight", F.greatest(p / F.greatest(1 - p, F.lit(1e-12)), F.lit(1e-10)))
        own = own.select(*(q(c) for c in source.columns), "weight")
        parts = own if parts is None else parts.unionByName(own)
    cap = parts.agg(F.percentile("weight", F.lit(clip_quantile)).alias("cap"))
    return parts.join(F.broadcast(cap)).withColumn("weight", F.least("weight", "cap")).drop("cap")


def add_intervals(panel: Any, pred: DataFrame, levels: list[float], h: int, transfer: TransferConformal | None, weights: Any = None, ids: list | None = None) -> DataFrame:
    """Bounds for a fitted panel's predictions."""
    if panel.scores is None:
        raise ValueError("fit with prediction_intervals first")
    r, names, own = panel.roles, list(panel.fitted), panel.intervals
    if any(v <= 0 or v >= 100 for v in levels):
        raise ValueError("levels must lie between 0 and 100")
    if weights is not None:
        if not own.method.startswith("weighted") or ids is not None or transfer is not None:
            raise ValueError("weights need a weighted method, all ids and no transfer")
        found = weights(panel.scores) if callable(weights) else weights
        rows = panel.scores.join(found.select(q(r.id), "weight"), r.id)
        mean = rows.agg(F.avg("weight")).first()[0] or 1.0
        out = weighted_conformal(pred, rows, r, names, levels, "distribution" in own.method, float(mean))
    elif transfer is not None:
        out = _transferred(panel, pred, levels, h, transfer)
    else:
        out = conformal(pred, panel.scores, r, names, levels, own.method, h, own.h)
    bounds = [c for c in out.columns if any(c.startswith(f"{m}-{s}-") for m in names for s in ("lo", "hi"))]
    return out.select(q(r.id), q(r.time), *(q(n) for n in names), *(q(b) for b in bounds))


def frozen_backtest(panel: Any, n_windows: int, h: int, step_size: int = 1) -> DataFrame:
    """Back-test of the fitted models, without fitting, over the panel's own series."""
    from ..plans.backtest import split, windows, with_back

    r = panel.roles
    numbered = cut(with_back(panel.plan.original, r))
    out = None
    for after in windows(n_windows, h, step_size):
        train, valid = split(numbered, after, h, None)
        own = panel.clone()
        own.fitted, own.steps = panel.fitted, panel.steps
        own.plan.prepare(train, static_features=[c for c in panel.plan.statics if c in train.columns], validate=False)
        own.plan.inputs = panel.plan.inputs
        found = own.predict(h)
        ends = train.groupBy(q(r.id)).agg(F.max(q(r.time)).alias("cutoff"))
        rows = found.join(valid.select(q(r.id), q(r.time), q(r.target)), [r.id, r.time]).join(ends, r.id)
        out = rows if out is None else out.unionByName(rows)
    return out


def _transferred(panel: Any, pred: DataFrame, levels: list[float], h: int, transfer: TransferConformal) -> DataFrame:
    r, names, own = panel.roles, list(panel.fitted), panel.intervals
    if own.h == 1 and h > 1 and transfer.method != "recalibrate":
        raise ValueError("scores of one step can't be moved to more steps")
    if transfer.method == "recalibrate":
        scores = scores_of(frozen_backtest(panel, transfer.n_windows, h), r, names, signed=True)
        return signed_intervals(pred, scores, r, names, levels, False)
    if transfer.method == "error_scaled":
        target = scores_of(frozen_backtest(panel, transfer.n_windows, h), r, names)
        out = pred
        for m in names:
            ratio = robust_ratio(target, panel.scores, m)
            out = conformal(out, panel.scores.withColumn(m, q(m) * ratio), r, [m], levels, own.method, h, own.h, pooled=True)
        return out
    scores = panel.scores
    if transfer.method.startswith("scale_aligned"):
        source_scale = series_scales(panel.source, r, transfer.scale).select(F.col("id").alias("__i"), F.col("scale").alias("__s"))
        scores = scores.join(source_scale, q(r.id) == F.col("__i")).select(*(q(c) if c not in names else (q(c) / F.col("__s")).alias(c) for c in scores.columns))
    if transfer.method.endswith("weighted") or transfer.method == "weighted_conformal":
        features = list(panel.plan.features)
        source = panel.clone().plan.prepare(panel.source, validate=False).select(q(r.id).alias("__i"), *(q(f) for f in features))
        target = panel.clone().plan.prepare(panel.plan.original, validate=False).select(*(q(f) for f in features))
        weights = estimate_density_ratio(source, target, features, transfer.cv, transfer.clip_quantile).groupBy("__i").agg(F.avg("weight").alias("weight"))
        scores = scores.join(weights, q(r.id) == F.col("__i")).drop("__i")
        mean = scores.agg(F.avg("weight")).first()[0] or 1.0
        out = weighted_conformal(pred, scores, r, names, levels, "distribution" in own.method, float(mean))
    else:
        out = conformal(pred, scores, r, names, levels, own.method, h, own.h, pooled=True)
    if transfer.method.startswith("scale_aligned"):
        scale = series_scales(panel.plan.original, r, transfer.scale).select(F.col("id").alias("__i"), F.col("scale").alias("__s"))
        bounds = {c: m for m in names for c in out.columns if c.startswith((f"{m}-lo-", f"{m}-hi-"))}
        out = out.join(scale, q(r.id) == F.col("__i"), "left")
        out = out.select(*(q(bounds[c]).__add__((q(c) - q(bounds[c])) * F.col("__s")).alias(c) if c in bounds else q(c) for c in out.columns if c not in ("__i", "__s")))
    return out


def add_fitted_intervals(panel: Any, fitted: DataFrame, levels: list[float]) -> DataFrame:
    """In-sample predictions plus and less normal quantiles times each series' in-sample deviation."""
    from statistics import NormalDist

    r, names = panel.roles, list(panel.fitted)
    by_id = Window.partitionBy(q(r.id), "h")
    out = fitted
    for m in names:
        sd = F.sqrt(F.avg(F.pow(q(r.target) - q(m), 2)).over(by_id))
        z = {v: NormalDist().inv_cdf(0.5 + v / 200) for v in levels}
        out = out.select("*", *_named(m, levels, {v: q(m) - z[v] * sd for v in levels}, {v: q(m) + z[v] * sd for v in levels}))
    return out
