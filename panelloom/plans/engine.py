"""Fitting and prediction of panels."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DateFeature, date_dummies, date_feature, feature_name
from ..functions.freq import Freq
from ..operators.lag_transforms import Custom, Lag, LagTransform, Scope, as_transform, keep_last
from ..operators.models import FeatureModel, Fitted, fit_model, name_models
from ..operators.targets import apply_all, fresh, undo_all
from . import validate as checks
from .features import Features, Roles, add_lag_features, q
from .latest import latest
from .lineage import cut

Frame = Callable[[DataFrame], DataFrame]


def horizons_of(max_horizon: int | None, horizons: list[int] | None) -> list[int] | None:
    """Steps (from 1) that direct models are fitted for; None for one recursive model."""
    if max_horizon is not None and horizons is not None:
        raise ValueError("give max_horizon or horizons, not both")
    if max_horizon is not None:
        if max_horizon < 1:
            raise ValueError("max_horizon must be positive")
        return list(range(1, max_horizon + 1))
    if horizons is None:
        return None
    if not horizons or any(not isinstance(h, int) or h < 1 for h in horizons):
        raise ValueError("horizons must be positive integers")
    return sorted(set(horizons))


@dataclass
class Plan:
    """What turns a panel into model inputs, and the state that prediction starts from."""

    freq: int | str | Freq
    lags: list[int] | None = None
    lag_transforms: dict[int, list[Any]] | None = None
    date_features: list[DateFeature] | None = None
    date_dummies: list[str] | None = None
    target_transforms: list[Any] | None = None
    lag_namer: Callable[[LagTransform, int], str] | None = None
    roles: Roles = field(default_factory=Roles)

    def __post_init__(self):
        self.step = Freq.of(self.freq)
        self.features: Features = {}
        for lag in self.lags or []:
            self._add(Lag(), lag)
        for lag, tfms in (self.lag_transforms or {}).items():
            for t in tfms:
                self._add(as_transform(t), lag)
        self.date_names = [feature_name(f) for f in self.date_features or []]
        for d in self.date_dummies or []:
            self.date_names += list(date_dummies(d, F.col("x")))
        self.transforms = list(self.target_transforms or [])
        self.history: DataFrame | None = None

    def _add(self, tfm: LagTransform, lag: int):
        if not isinstance(lag, int) or lag < 1:
            raise ValueError("lags must be positive integers")
        name = (self.lag_namer or (lambda t, n: t.name(n)))(tfm, lag)
        self.features[name] = (tfm, lag)

    @property
    def scopes(self) -> list[Scope]:
        return list(dict.fromkeys(t.scope for t, _ in self.features.values()))

    @property
    def is_local(self) -> bool:
        return all(s.is_local for s in self.scopes)

    @property
    def group_columns(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.scopes for c in s.groupby or ()))

    @property
    def partition_columns(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.scopes for c in s.partition_by or ()))

    def assign(self, df: DataFrame, static_features: list[str] | None, weight: str | None, drop_auxiliary: bool | list[str], check_statics: bool) -> None:
        """Column roles. Without a list all other columns but those that partition are static."""
        r = self.roles
        keys = [r.id, r.time, r.target, *([weight] if weight else [])]
        others = [c for c in df.columns if c not in keys]
        if static_features is None:
            self.statics = [c for c in others if c not in self.partition_columns]
        else:
            missing = [c for c in static_features if c not in df.columns]
            if missing:
                raise ValueError(f"static features not found: {', '.join(missing)}")
            self.statics = [c for c in static_features if c not in keys]
        loose = [c for c in self.group_columns if c not in self.statics]
        if loose:
            raise ValueError(f"groupby columns must be static: {', '.join(loose)}")
        if check_statics and (moving := checks.changing_statics(df, r, self.statics)):
            raise ValueError(f"static features change over time: {', '.join(moving)}")
        self.dynamics = [c for c in others if c not in self.statics and c not in self.features and c not in self.date_names]
        auxiliary = self.group_columns + self.partition_columns
        dropped = auxiliary if drop_auxiliary is True else [] if drop_auxiliary is False else list(drop_auxiliary)
        if isinstance(drop_auxiliary, (list, tuple)) and (unknown := [c for c in dropped if c not in auxiliary]):
            warnings.warn(f"not auxiliary columns: {', '.join(unknown)}", stacklevel=3)
        made = [n for n in [*self.features, *self.date_names] if n not in others]
        numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
        self.inputs = [c for c in others if c not in dropped and c in numeric] + made
        self.shown = [c for c in others if c not in dropped] + made
        self.weight = weight

    def with_dates(self, df: DataFrame) -> DataFrame:
        made = {feature_name(f): date_feature(f, q(self.roles.time)) for f in self.date_features or []}
        for d in self.date_dummies or []:
            made |= date_dummies(d, q(self.roles.time))
        made = {n: c for n, c in made.items() if n not in df.columns}
        return df.withColumns(made) if made else df

    def remember(self, df: DataFrame, transformed: DataFrame, keep_last_n: int | None) -> None:
        """State for prediction: original and transformed target, statics and partition columns."""
        r = self.roles
        columns = [r.id, r.time, r.target, *self.statics, *(c for c in self.partition_columns if c in df.columns)]
        self.original = df.select(*(q(c) for c in dict.fromkeys(columns)))
        self.history = transformed.select(*(q(c) for c in dict.fromkeys(columns)))
        self.keep = keep_last_n or keep_last(self.features)
        self.kind = checks.time_type(df, r)

    def bounded(self, history: DataFrame | None = None) -> DataFrame:
        """The rows of history that the next step's features can see."""
        history = self.history if history is None else history
        needed = keep_last(self.features)
        if needed is None or any(not s.is_local for s in self.scopes):
            return history if not (self.keep and needed) else checks.last_rows(history, self.roles, max(self.keep, needed) + 1)
        return checks.last_rows(history, self.roles, max(self.keep or needed, needed))

    def ends(self) -> DataFrame:
        r = self.roles
        return self.history.groupBy(q(r.id)).agg(F.max(q(r.time)).alias("__last"), *(F.max_by(q(c), q(r.time)).alias(c) for c in self.statics))

    def future(self, h: int, ids: list | None = None) -> DataFrame:
        """id, time and step of the next h steps, with statics."""
        ends = self.ends()
        if ids is not None:
            ends = ends.filter(q(self.roles.id).isin(list(ids)))
        grid = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
        return grid.select(
            q(self.roles.id), self.step.shift(F.col("__last"), F.col("step"), self.kind).alias(self.roles.time), "step", *(q(c) for c in self.statics)
        )

    def prepare(
        self, df: DataFrame, static_features=None, dropna=True, keep_last_n=None, max_horizon=None, horizons=None, weight_col=None, validate=True,
        drop_auxiliary_columns=True,
    ) -> DataFrame:
        """Training frame: input columns, features, and the target or, for direct models, y0, y1..."""
        r = self.roles
        checks.check_columns(df, r)
        if validate:
            checks.validate(df, r, self.step)
        self.assign(df, static_features, weight_col, drop_auxiliary_columns, validate)
        if validate and any(s.pools_series for s in self.scopes) and not checks.equal_ends(df, r):
            raise ValueError("pooled features need series that end at the same time")
        steps = horizons_of(max_horizon, horizons)
        transformed = apply_all(self.transforms, df, r) if self.transforms else df
        self.remember(df, transformed, keep_last_n)
        self.transformed = transformed
        out = add_lag_features(transformed, r, self.features)
        made = [n for n in self.features if n not in df.columns]
        if steps:
            by_id = Window.partitionBy(q(r.id)).orderBy(q(r.time))
            leads = {f"{r.target}{h - 1}": F.lead(q(r.target), h - 1).over(by_id) for h in steps}
            leads |= {f"__x{h}_{c}": F.lead(q(c), h - 1).over(by_id) for h in steps if h > 1 for c in self.dynamics}
            out = out.withColumns(leads)
        out = self.with_dates(out)
        targets = [f"{r.target}{h - 1}" for h in steps] if steps else [r.target]
        if dropna:
            for name in made:
                out = out.filter(q(name).isNotNull() & ~F.isnan(q(name)))
            some = F.coalesce(*(q(t).cast("double") for t in targets))
            out = out.filter(some.isNotNull())
        return out


def is_missing(df: DataFrame, name: str) -> Column:
    """Whether a value is null or NaN."""
    return q(name).isNull() | F.isnan(q(name)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else q(name).isNull()


class Panel:
    """Facade over a plan and its models: preprocess, fit, predict, cross_validation and the rest."""

    def __init__(
        self, models: Any, freq: int | str | Freq, lags=None, lag_transforms=None, date_features=None, date_dummies=None, target_transforms=None,
        lag_namer=None, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y",
    ):
        self.models = name_models(models)
        self.options = dict(freq=freq, lags=lags, lag_transforms=lag_transforms, date_features=date_features, date_dummies=date_dummies,
                            target_transforms=target_transforms, lag_namer=lag_namer)
        self.roles = Roles(id_col, time_col, target_col)
        self.plan = Plan(**self.options, roles=self.roles)
        self.fitted: dict[str, Any] = {}
        self.steps: list[int] | None = None
        self.scores: DataFrame | None = None
        self.source: DataFrame | None = None

    def clone(self) -> Panel:
        return Panel(dict(self.models), **self._fresh_options(), id_col=self.roles.id, time_col=self.roles.time, target_col=self.roles.target)

    def _fresh_options(self) -> dict:
        return self.options | {"target_transforms": [fresh(t) for t in self.options["target_transforms"] or []] or None}

    # -- training -------------------------------------------------------------------------------------------------

    def preprocess(self, df: DataFrame, **options) -> DataFrame:
        """Keys, columns that stay, features and target(s)."""
        frame = self.plan.prepare(df, **options)
        r, steps = self.roles, horizons_of(options.get("max_horizon"), options.get("horizons"))
        targets = [f"{r.target}{h - 1}" for h in steps] if steps else [r.target]
        weight = [options["weight_col"]] if options.get("weight_col") else []
        return frame.select(q(r.id), q(r.time), *(q(t) for t in targets), *(q(w) for w in weight), *(q(c) for c in self.plan.shown))

    def history_warmup(self, df: DataFrame, **options) -> Panel:
        """State without features or models, so that given models can predict."""
        self.plan.prepare(df, **options)
        return self

    def fit_models(self, frame: DataFrame, steps: list[int] | None = None, horizon_features: dict[int, list[str]] | None = None, params: dict[str, dict] | None = None) -> Panel:
        """params: for models by name, Spark params or arguments of their fit that hold for this fit only."""
        r, inputs, params = self.roles, self.plan.inputs, params or {}
        if unknown := set(params) - set(self.models):
            raise ValueError(f"not models of the panel: {', '.join(sorted(unknown))}")
        self.steps = steps
        if steps is None:
            self.fitted = {n: fit_model(m, frame, inputs, r.target, self.plan.weight, params.get(n)) for n, m in self.models.items()}
            return self
        self.fitted = {}
        for name, model in self.models.items():
            own = {}
            for h in steps:
                wanted = self._inputs_at(h, horizon_features)
                rows = frame.select(*(q(c) for c in frame.columns if c not in self.plan.dynamics), *(q(f"__x{h}_{c}" if h > 1 else c).alias(c) for c in self.plan.dynamics))
                for c in self.plan.dynamics:
                    if c in wanted:
                        rows = rows.filter(q(c).isNotNull())
                own[h] = fit_model(model, rows, wanted, f"{r.target}{h - 1}", self.plan.weight, params.get(name))
            self.fitted[name] = own
        return self

    def _inputs_at(self, h: int, horizon_features: dict[int, list[str]] | None) -> list[str]:
        if not horizon_features:
            return self.plan.inputs
        routed = {c for cols in horizon_features.values() for c in cols}
        unknown = routed - set(self.plan.dynamics)
        if unknown:
            raise ValueError(f"not dynamic columns: {', '.join(sorted(unknown))}")
        mine = set(horizon_features.get(h, []))
        return [c for c in self.plan.inputs if c not in routed or c in mine]

    def fit(
        self, df: DataFrame, static_features=None, dropna=True, keep_last_n=None, max_horizon=None, horizons=None, prediction_intervals=None,
        fitted=False, weight_col=None, validate=True, drop_auxiliary_columns=True, horizon_features=None, horizon_feature_templates=None,
        models_fit_kwargs=None,
    ) -> Panel:
        steps = horizons_of(max_horizon, horizons)
        options = dict(static_features=static_features, dropna=dropna, max_horizon=max_horizon, horizons=horizons, weight_col=weight_col)
        if prediction_intervals is not None:
            from ..operators.intervals import conformity_scores

            self.scores = cut(conformity_scores(self, df, prediction_intervals, options))
            self.intervals = prediction_intervals
        frame = self.plan.prepare(df, keep_last_n=keep_last_n, validate=validate, drop_auxiliary_columns=drop_auxiliary_columns, **options)
        if horizon_feature_templates:
            horizon_features = self._routed(horizon_feature_templates, steps)
        self.horizon_features = horizon_features
        self.fit_models(frame, steps, horizon_features, models_fit_kwargs)
        self.source = self.plan.original
        self.frame = frame if fitted else None
        self.source_rows = self.plan.transformed if fitted else None
        return self

    def _routed(self, templates: list[str], steps: list[int] | None) -> dict[int, list[str]]:
        if not steps:
            raise ValueError("horizon features need direct models")
        out: dict[int, list[str]] = {}
        for template in templates:
            if template.count("{h}") != 1:
                raise ValueError(f"{template!r} must hold {{h}} once")
            found = {h: template.replace("{h}", str(h)) for h in steps}
            found = {h: c for h, c in found.items() if c in self.plan.dynamics}
            if not found:
                raise ValueError(f"no column matches {template!r}")
            for h, c in found.items():
                out.setdefault(h, []).append(c)
        return out

    # -- prediction -----------------------------------------------------------------------------------------------

    def make_future_dataframe(self, h: int) -> DataFrame:
        return self.plan.future(h).select(q(self.roles.id), q(self.roles.time))

    def get_missing_future(self, h: int, X_df: DataFrame) -> DataFrame:
        return self.make_future_dataframe(h).join(X_df, [self.roles.id, self.roles.time], "left_anti")

    def predict(
        self, h: int, X_df: DataFrame | None = None, new_df: DataFrame | None = None, level: list[float] | None = None, ids: list | None = None,
        before_predict_callback: Frame | None = None, after_predict_callback: Frame | None = None, transfer: Any = None,
        weights: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """id, time and a column for each model, with intervals for the levels if asked for.

        weights (id, weight), or a function that gives them from the scores, weigh the scores of weighted interval methods.
        new_df are the rows of other series, whose forecasts are asked for; the panel's own state stays as it is.
        """
        if not self.fitted:
            raise ValueError("call fit first")
        own = self.plan
        if new_df is not None:
            plan = Plan(**self._fresh_options(), roles=self.roles)
            plan.prepare(new_df, static_features=[c for c in own.statics if c in new_df.columns], validate=True, weight_col=own.weight if own.weight in new_df.columns else None)
            plan.inputs = own.inputs
            self.plan = plan
        try:
            return self._predicted(h, X_df, level, ids, before_predict_callback, after_predict_callback, transfer, weights)
        finally:
            self.plan = own

    def _predicted(self, h, X_df, level, ids, before_predict_callback, after_predict_callback, transfer, weights) -> DataFrame:
        if ids is not None:
            if any(s.pools_series for s in self.plan.scopes):
                raise ValueError("ids can't be chosen with pooled features")
            known = {r[0] for r in self.plan.history.select(q(self.roles.id)).filter(q(self.roles.id).isin(list(ids))).distinct().collect()}
            if missing := [i for i in ids if i not in known]:
                raise ValueError(f"unknown ids: {', '.join(map(str, missing))}")
        future = self._future(h, X_df, ids)
        raw = (self._direct if self.steps else self._recursive)(h, future, before_predict_callback, after_predict_callback)
        names = list(self.fitted)
        out = undo_all(self.plan.transforms, raw, names) if self.plan.transforms else raw
        if level:
            from ..operators.intervals import add_intervals

            return add_intervals(self, out, sorted(level), h, transfer, weights, ids)
        return out.select(q(self.roles.id), q(self.roles.time), *(q(n) for n in names))

    def _future(self, h: int, X_df: DataFrame | None, ids: list | None) -> DataFrame:
        r, plan = self.roles, self.plan
        grid = plan.future(h, ids)
        needed = list(dict.fromkeys([c for c in plan.dynamics if c in plan.inputs] + plan.partition_columns))
        if not needed:
            return grid
        if X_df is None or (missing := [c for c in needed if c not in X_df.columns]):
            raise ValueError(f"X_df must have the dynamic columns: {', '.join(needed if X_df is None else missing)}")
        if again := [c for c in plan.statics if c in X_df.columns]:
            warnings.warn(f"static columns of X_df are ignored: {', '.join(again)}", stacklevel=3)
        given = X_df.select(q(r.id), q(r.time), *(q(c) for c in needed), F.lit(1).alias("__given"))
        out = grid.join(given, [r.id, r.time], "left")
        counts = out.groupBy(q(r.id)).agg(F.count("__given").alias("n"), F.count(F.lit(1)).alias("all"))
        least, found, asked = counts.agg(F.min("n"), F.sum("n"), F.sum("all")).first()
        if least == 0:
            raise ValueError("X_df needs at least one future row for each id; get_missing_future tells which it lacks")
        if found is not None and found < asked:
            warnings.warn(f"X_df has {found} of {asked} future rows; missing steps go on with the last row that is there", stacklevel=4)
        # Steps that X_df lacks go on with the last that it has.
        past = Window.partitionBy(q(r.id)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(F.col("__given").isNotNull(), F.struct(*(q(c) for c in needed))), ignorenulls=True).over(past)
        out = out.withColumn("__x", last)
        return out.select(*(q(c) for c in grid.columns), *(F.col("__x").getField(c).alias(c) for c in needed))

    def _recursive(self, h, future, before, after) -> DataFrame:
        fast = self.plan.is_local and before is None and after is None and all(f.row_function() for f in self.fitted.values())
        parts = [part for t, lag in self.plan.features.values() for part, _ in t.parts(lag)]
        fast = fast and not any(isinstance(t, Custom) or t.kind == "column" for t in parts)
        return self._in_one_pass(h, future) if fast else self._step_by_step(h, future, before, after)

    def null_inputs(self, X_df: DataFrame | None = None) -> dict[str, int]:
        """Inputs that the first step lacks, with the number of series; predict itself tells of them only where it goes step by step."""
        r, plan = self.roles, self.plan
        asked = self._future(1, X_df, None).withColumn(r.target, F.lit(None).cast("double"))
        history = plan.bounded().withColumn("step", F.lit(0)).withColumn(r.target, q(r.target).cast("double"))
        frame = add_lag_features(history.unionByName(asked, allowMissingColumns=True), r, plan.features).filter(F.col("step") == 1)
        frame = plan.with_dates(frame)
        inputs = [c for c in plan.inputs if c in frame.columns]
        if not inputs:
            return {}
        found = frame.agg(*(F.count_if(is_missing(frame, c)).alias(f"n{i}") for i, c in enumerate(inputs))).first()
        return {c: found[i] for i, c in enumerate(inputs) if found[i]}

    def _in_one_pass(self, h: int, future: DataFrame) -> DataFrame:
        """Local features and models of a row: each series rolls forward by itself, in one job over one exchange."""
        r, plan = self.roles, self.plan
        rows = plan.with_dates(future)
        history = plan.bounded().groupBy(q(r.id).alias("__id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct(q(r.time).alias("t"), q(r.target).cast("double").alias("y")))), lambda x: x["y"]).alias("__hist")
        )
        rows = rows.join(history, q(r.id) == F.col("__id"), "left").drop("__id")
        rows = rows.withColumn("__hist", F.when(F.col("step") == 1, F.col("__hist")))
        features, inputs = plan.features, plan.inputs
        models = {n: f.row_function() for n, f in self.fitted.items()}
        own = [r.id, r.time, "step"]
        schema = T.StructType([*(rows.schema[c] for c in own), *(T.StructField(n, T.DoubleType()) for n in models)])
        inputs_of = {n: f.features for n, f in self.fitted.items()}

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("step")
            history = np.array(table["__hist"][0].as_py(), float)
            given = {c: table[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in set(inputs) if c in table.column_names and c not in features}
            out = table.select(own)
            for name, model in models.items():
                values, found = history, []
                for i in range(table.num_rows):
                    x = np.array([latest(values, *features[c]) if c in features else given[c][i] for c in inputs_of[name]], float)
                    found.append(model(x))
                    values = np.append(values, found[-1])
                out = out.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
            return out

        return rows.groupBy(q(r.id)).applyInArrow(run, schema)

    def _step_by_step(self, h: int, future: DataFrame, before, after) -> DataFrame:
        """Any scope and model: a plan for each step over the history that features can see, cut from its lineage."""
        r, plan = self.roles, self.plan
        future = cut(future)
        result = None
        for name, model in self.fitted.items():
            history = cut(plan.bounded().withColumn("step", F.lit(0)))
            names = history.columns
            found = None
            for step in range(1, h + 1):
                asked = future.filter(F.col("step") == step).withColumn(r.target, F.lit(None).cast(history.schema[r.target].dataType))
                frame = add_lag_features(history.unionByName(asked.select(*(q(c) for c in names)), allowMissingColumns=True), r, plan.features)
                frame = frame.filter(F.col("step") == step)
                extra = [c for c in future.columns if c not in frame.columns]
                if extra:
                    frame = frame.join(asked.select(q(r.id), *(q(c) for c in extra)), r.id)
                frame = plan.with_dates(frame)
                if before is not None:
                    frame = before(frame)
                # Nulls of the inputs are counted by the job that computes the step.
                inputs = [c for c in (model.features if not isinstance(model.model, FeatureModel) else [model.model.feature]) if c in frame.columns]
                seen = Observation()
                frame = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(is_missing(frame, c)).alias(f"n{i}") for i, c in enumerate(inputs)))
                scored = model.predict(frame, name)
                if after is not None:
                    scored = after(scored)
                scored = cut(scored.withColumn(r.target, q(name)).select(*(q(c) for c in names), q(name)))
                if null := [c for i, c in enumerate(inputs) if seen.get[f"n{i}"]]:
                    warnings.warn(f"inputs of {name} are null at step {step}: {', '.join(null)}", stacklevel=5)
                history = history.unionByName(scored.select(*(q(c) for c in names)))
                own = scored.select(q(r.id), q(r.time), "step", q(name))
                found = own if found is None else found.unionByName(own)
            result = found if result is None else result.join(found.drop("step"), [r.id, r.time])
        return result

    def _direct(self, h: int, future: DataFrame, before, after) -> DataFrame:
        """Each step has a model of its own; lag and date features are those of the first step, dynamic columns those of the step."""
        r, plan = self.roles, self.plan
        steps = [s for s in self.steps if s <= h]
        if h > max(self.steps):
            raise ValueError(f"models were fitted for up to {max(self.steps)} steps")
        if not steps:
            raise ValueError("no model was fitted for these steps")
        asked = future.filter(F.col("step") == 1).withColumn(r.target, F.lit(None).cast("double"))
        history = plan.bounded().withColumn("step", F.lit(0)).withColumn(r.target, q(r.target).cast("double"))
        names = history.columns
        first = add_lag_features(history.unionByName(asked.select(*(q(c) for c in names))), r, plan.features).filter(F.col("step") == 1)
        first = plan.with_dates(first).drop("step")
        made = [*plan.features, *plan.date_names]
        rows = future.filter(F.col("step").isin(steps)).join(first.select(q(r.id), *(q(c) for c in made)), r.id)
        if before is not None:
            rows = before(rows)
        out = None
        for step in steps:
            own = rows.filter(F.col("step") == step)
            for name, models in self.fitted.items():
                own = models[step].predict(own, name)
            out = own if out is None else out.unionByName(own)
        return out.select(q(r.id), q(r.time), "step", *(q(n) for n in self.fitted))

    # -- in-sample, back-testing, state ---------------------------------------------------------------------------

    def dropped_series(self, frame: DataFrame) -> DataFrame:
        """Ids of series whose last row did not make it into a preprocessed frame: they are too short for the features."""
        r = self.roles
        last = self.plan.history.groupBy(q(r.id).alias(r.id)).agg(F.max(q(r.time)).alias(r.time))
        return last.join(frame.select(q(r.id), q(r.time)), [r.id, r.time], "left_anti").select(q(r.id))

    def to_local(self) -> dict[str, Any]:
        """The state as pandas frames on the driver, for panels that are small enough: history and last times."""
        return {"history": self.plan.history.toPandas(), "ends": self.plan.ends().toPandas()}

    def _rolled(self, h: int) -> DataFrame:
        """Predictions h steps ahead from every row, each series by itself: id, time, a column for each model."""
        r, plan = self.roles, self.plan
        models = {n: f.row_function() for n, f in self.fitted.items()}
        if not plan.is_local or not all(models.values()):
            raise ValueError("fitted values for more steps need local features and models of a row")
        if any(hasattr(t, "stages") for t in plan.transforms):
            raise ValueError("fitted values for more steps can't undo differences")
        features, inputs_of = plan.features, {n: f.features for n, f in self.fitted.items()}
        rows = plan.with_dates(self.source_rows)
        given = [c for c in dict.fromkeys(c for i in inputs_of.values() for c in i) if c not in features]
        rows = rows.select(q(r.id), q(r.time), q(r.target).cast("double").alias(r.target), *(q(c).cast("double").alias(c) for c in given))
        schema = T.StructType([rows.schema[r.id], rows.schema[r.time], *(T.StructField(n, T.DoubleType()) for n in models)])

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(r.time)
            values = table[r.target].to_numpy(zero_copy_only=False)
            own = {c: table[c].to_numpy(zero_copy_only=False) for c in given}
            out = table.select([r.id, r.time])
            for name, model in models.items():
                found = np.full(len(values), np.nan)
                for i in range(len(values) - h + 1):
                    seen = values[:i]
                    for j in range(i, i + h):
                        x = np.array([latest(seen, *features[c]) if c in features else own[c][j] for c in inputs_of[name]], float)
                        seen = np.append(seen, model(x))
                    found[i + h - 1] = seen[-1]
                out = out.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
            return out

        found = rows.groupBy(q(r.id)).applyInArrow(run, schema)
        some = F.coalesce(*(q(n) for n in models)).isNotNull()
        return found.filter(some)

    def forecast_fitted_values(self, level: list[float] | None = None, h: int = 1) -> DataFrame:
        """In-sample predictions of fit(fitted=True): id, time, target, models, and h, the step they were made ahead.

        Direct models give all their steps; a recursive model rolls h steps forward from every row.
        """
        if getattr(self, "frame", None) is None:
            raise ValueError("fit with fitted=True first")
        if h > 1 and not self.steps:
            r, names = self.roles, list(self.fitted)
            actual = self.plan.original.select(q(r.id), q(r.time), q(r.target).alias("__actual"))
            rows = undo_all(self.plan.transforms, self._rolled(h).withColumn("step", F.lit(1)), names, fitted=True)
            return rows.join(actual, [r.id, r.time]).select(q(r.id), q(r.time), F.col("__actual").alias(r.target), *(q(n) for n in names), F.lit(h).cast("long").alias("h"))
        r, names, parts = self.roles, list(self.fitted), []
        actual = self.plan.original.select(q(r.id), q(r.time), q(r.target).alias("__actual"))
        for h in self.steps or [1]:
            rows = self.frame
            if self.steps:
                rows = rows.select(*(q(c) for c in rows.columns if c not in self.plan.dynamics), *(q(f"__x{h}_{c}" if h > 1 else c).alias(c) for c in self.plan.dynamics))
                rows = rows.filter(q(f"{r.target}{h - 1}").isNotNull())
            for name in names:
                model: Fitted = self.fitted[name][h] if self.steps else self.fitted[name]
                rows = model.predict(rows, name)
            rows = rows.select(q(r.id), self.plan.step.shift(q(r.time), h - 1, self.plan.kind).alias(r.time), *(q(n) for n in names))
            rows = undo_all(self.plan.transforms, rows.withColumn("step", F.lit(1)), names, fitted=True)
            parts.append(rows.join(actual, [r.id, r.time]).select(q(r.id), q(r.time), F.col("__actual").alias(r.target), *(q(n) for n in names), F.lit(h).cast("long").alias("h")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if level:
            from ..operators.intervals import add_fitted_intervals

            return add_fitted_intervals(self, out, sorted(level))
        return out

    def cross_validation(self, df: DataFrame, n_windows: int, h: int, **options) -> DataFrame:
        from .backtest import cross_validation

        return cross_validation(self, df, n_windows, h, **options)

    def cross_validation_fitted_values(self) -> DataFrame:
        if getattr(self, "cv_fitted", None) is None:
            raise ValueError("call cross_validation with fitted=True first")
        return self.cv_fitted

    def update(self, new: DataFrame, validate: bool = False) -> Panel:
        """Appends observations to the state; transforms keep what they learnt in fit. Unknown series need no target transforms."""
        r, plan = self.roles, self.plan
        ends = plan.history.groupBy(q(r.id).alias("id")).agg(F.max(q(r.time)).alias("last"))
        if validate:
            checks.validate_update(new, ends, r, plan.step)
        if plan.transforms and not new.select(q(r.id).alias("id")).join(ends, "id", "left_anti").isEmpty():
            raise ValueError("new series can't be added when there are target transforms")
        if any(s.pools_series for s in plan.scopes):
            n = plan.history.select(q(r.id)).distinct().count()
            if not new.groupBy(q(r.time)).agg(F.countDistinct(q(r.id)).alias("n")).filter(F.col("n") < n).isEmpty():
                raise ValueError("pooled features need all series at each new time")
        names = plan.original.columns
        statics = [c for c in plan.statics if c not in new.columns]
        if statics:
            known = plan.ends().select(q(r.id).alias("__id"), *(q(c) for c in statics))
            new = new.join(known, q(r.id) == F.col("__id"), "left").drop("__id")
        plan.original = plan.original.unionByName(new.select(*(q(c) for c in names if c in new.columns)), allowMissingColumns=True)
        mapped = plan.original
        for t in plan.transforms:
            mapped = t.update(mapped)
        plan.history = mapped
        return self

    def save(self, path: str) -> None:
        from ..sources.store import save

        save(self, path)

    @staticmethod
    def load(spark, path: str) -> Panel:
        from ..sources.store import load

        return load(spark, path)
