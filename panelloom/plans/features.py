"""Compiles lag transforms to windows.

Local transforms share one exchange and sort by series. Pooled ones are computed on one row per bucket and time, so
the window never sees raw rows, and are joined back. Transforms that have no window form (exponential weighting, custom
functions) take one Arrow pass over the groups that the windows left in place.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import quantile_of
from ..operators.lag_transforms import Combine, LagTransform, Offset, Scope

#: Prefix of internal columns.
X = "__pf_"
Features = dict[str, tuple[LagTransform, int]]


@dataclass(frozen=True)
class Roles:
    """Which columns are the id, the time and the target."""

    id: str = "unique_id"
    time: str = "ds"
    target: str = "y"


def q(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_of(name: str) -> Column:
    """Target as double; NaN is missing."""
    y = q(name).cast("double")
    return F.when(~F.isnan(y), y)


def key_of(df: DataFrame, name: str) -> Column:
    """A grouping key in which null and NaN are one value."""
    return F.when(~F.isnan(q(name)), q(name)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else q(name)


def _operator(op, a: Column, b: Column) -> Column:
    name = getattr(op, "__name__", "")
    if name == "truediv":
        return F.try_divide(a, b)
    if name == "floordiv":
        return F.floor(F.try_divide(a, b)).cast("double")
    return op(a, b)


def add_lag_features(df: DataFrame, roles: Roles, features: Features) -> DataFrame:
    """df with a column for each feature that it does not have yet."""
    wanted = {n: f for n, f in features.items() if n not in df.columns}
    if not wanted:
        return df
    inner: dict[tuple[LagTransform, int], str] = {}
    for tfm, lag in wanted.values():
        for part in tfm.parts(lag):
            inner.setdefault(part, f"{X}{len(inner)}")
    by_scope: dict[Scope, dict[str, tuple[LagTransform, int]]] = defaultdict(dict)
    for (tfm, lag), name in inner.items():
        by_scope[tfm.scope][name] = (tfm, lag)
    out = df
    # Python passes over series come right after the local windows, whose exchange they share; joins come last.
    for scope in sorted(by_scope, key=lambda s: (s.pools_series, not s.is_local, str(s))):
        parts = by_scope[scope]
        if scope.is_local:
            out = _local(out, roles, parts)
        elif not scope.pools_series:
            out = _partition_local(out, roles, scope, parts)
        else:
            out = _pooled(out, roles, scope, parts)
    named = []
    for name, (tfm, lag) in wanted.items():
        named.append(_expression(tfm, lag, inner).alias(name))
    return out.select(*(q(c) for c in df.columns), *named)


def _expression(tfm: LagTransform, lag: int, inner: dict) -> Column:
    if isinstance(tfm, Offset):
        return _expression(tfm.tfm, tfm._lag(lag), inner)
    if isinstance(tfm, Combine):
        return _operator(tfm.operator, _expression(tfm.tfm1, lag, inner), _expression(tfm.tfm2, lag, inner))
    return F.col(inner[tfm, lag])


def _row_stat(tfm: LagTransform, y: Column, frame) -> Column:
    stat = {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "quantile": lambda c: F.percentile(c, F.lit(float(tfm.p))),
    }[tfm.stat](y).over(frame)
    least = max(tfm.least, 1)
    return F.when(F.count(y).over(frame) >= least, stat)


def _local(df: DataFrame, roles: Roles, parts: Features) -> DataFrame:
    y, by_id = value_of(roles.target), Window.partitionBy(q(roles.id)).orderBy(q(roles.time))
    made, seasonal, passes = {}, {}, {}
    for name, (tfm, lag) in parts.items():
        if tfm.kind == "lag":
            made[name] = F.lag(y, lag).over(by_id)
        elif tfm.kind == "column":
            made[name] = tfm.column(y, lag, by_id)
        elif tfm.kind == "rolling":
            made[name] = _row_stat(tfm, y, by_id.rowsBetween(-(lag + tfm.window_size - 1), -lag))
        elif tfm.kind == "expanding":
            made[name] = _row_stat(tfm, y, by_id.rowsBetween(Window.unboundedPreceding, -lag))
        elif tfm.kind == "seasonal":
            seasonal[name] = (tfm, lag)
        else:
            passes[name] = (tfm, lag)
    if seasonal:
        made[f"{X}ord"] = F.row_number().over(by_id) - 1
        for lag in {lag for _, lag in seasonal.values()}:
            made[f"{X}z{lag}"] = F.lag(y, lag).over(by_id)
    out = df.withColumns(made) if made else df
    if seasonal:
        more = {}
        for name, (tfm, lag) in seasonal.items():
            frame = Window.partitionBy(q(roles.id), F.col(f"{X}ord") % tfm.season_length).orderBy(f"{X}ord").rowsBetween(-(tfm.window_size - 1), 0)
            more[name] = _row_stat(tfm, F.col(f"{X}z{lag}"), frame)
        out = out.withColumns(more).drop(f"{X}ord", *(f"{X}z{lag}" for lag in {lag for _, lag in seasonal.values()}))
    if passes:
        schema = T.StructType([*out.schema.fields, *(T.StructField(n, T.DoubleType()) for n in passes)])

        def run(table: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table, [(roles.time, "ascending")]))
            values = table[roles.target].cast(pa.float64()).to_numpy(zero_copy_only=False)
            for name, (tfm, lag) in passes.items():
                table = table.append_column(name, _arrow(_series_pass(values, tfm, lag)))
            return table

        out = out.groupBy(q(roles.id)).applyInArrow(run, schema)
    return out


def _arrow(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, float), pa.float64(), from_pandas=True)


def _series_pass(values: np.ndarray, tfm: LagTransform, lag: int) -> np.ndarray:
    if tfm.kind == "ewm":
        state = pd.Series(values).ewm(alpha=tfm.alpha, adjust=False, ignore_na=True).mean()
        return state.shift(lag).to_numpy()
    shifted = np.concatenate([np.full(min(lag, len(values)), np.nan), values[: max(0, len(values) - lag)]])
    return np.asarray(tfm.fn(shifted, *tfm.args), float)


def _levels(parts: Features) -> set:
    return {getattr(t, "time_agg", None) if t.kind != "ewm" else t.time_agg for t, _ in parts.values()}


def _aggregates(y: Column, level: str | None, raw: bool) -> dict[str, Column]:
    """What windows need of a bucket at one time; with a level the rows count as the one value that it makes of them."""
    if level is None:
        own = {"s": F.sum(y), "c": F.count(y), "q": F.sum(y * y), "n": F.min(y), "x": F.max(y)}
        if raw:
            own["a"] = F.collect_list(y)
        return own
    return {"v": {"sum": F.sum, "count": F.count, "mean": F.avg, "min": F.min, "max": F.max}[level](y).cast("double")}


def _expanded(level: str) -> dict[str, Column]:
    v = F.col(f"{X}{level}_v")
    return {"s": v, "c": v.isNotNull().cast("long"), "q": v * v, "n": v, "x": v, "a": F.when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<double>"))}


def _column(level: str | None, what: str) -> str:
    return f"{X}{level or 'rows'}_{what}"


def _bucket_stat(tfm: LagTransform, frame) -> Column:
    level = tfm.time_agg

    def total(what: str) -> Column:
        return F.sum(_column(level, what)).over(frame)

    n = F.coalesce(total("c"), F.lit(0))
    if tfm.stat == "mean":
        stat = F.try_divide(total("s"), n)
    elif tfm.stat == "std":
        s = total("s")
        stat = F.when(n > 1, F.sqrt(F.greatest((total("q") - F.try_divide(s * s, n)) / F.greatest(n - 1, F.lit(1)), F.lit(0.0))))
    elif tfm.stat == "min":
        stat = F.min(_column(level, "n")).over(frame)
    elif tfm.stat == "max":
        stat = F.max(_column(level, "x")).over(frame)
    else:
        stat = quantile_of(F.flatten(F.collect_list(_column(level, "a")).over(frame)), tfm.p)
    return F.when(n >= max(tfm.least, 1), stat)


def _bucket_features(agg: DataFrame, keys: list[str], parts: Features, parent: DataFrame | None = None) -> DataFrame:
    """agg (keys, ord, aggregates) with the features."""
    made, seasonal, passes = {}, {}, {}
    by_key = Window.partitionBy(*keys).orderBy(f"{X}ord")
    for name, (tfm, lag) in parts.items():
        if tfm.kind == "rolling":
            made[name] = _bucket_stat(tfm, by_key.rangeBetween(-(lag + tfm.window_size - 1), -lag))
        elif tfm.kind == "expanding":
            made[name] = _bucket_stat(tfm, by_key.rangeBetween(Window.unboundedPreceding, -lag))
        elif tfm.kind == "seasonal":
            seasonal[name] = (tfm, lag)
        else:
            passes[name] = (tfm, lag)
    out = agg.withColumns(made) if made else agg
    for name, (tfm, lag) in seasonal.items():
        # Observations move ahead by the lag and meet the times of their season; a bucket may have none at the lagged time itself.
        values = [c for c in agg.columns if c not in (*keys, f"{X}ord")]
        asked = out.select(*keys, f"{X}ord", F.lit(True).alias(f"{X}asked"), *(F.lit(None).cast(agg.schema[c].dataType).alias(c) for c in values))
        given = agg.select(*keys, (F.col(f"{X}ord") + lag).alias(f"{X}ord"), F.lit(False).alias(f"{X}asked"), *values)
        season = Window.partitionBy(*keys, F.col(f"{X}ord") % tfm.season_length).orderBy(f"{X}ord").rangeBetween(-(tfm.window_size - 1) * tfm.season_length, 0)
        found = asked.unionByName(given).withColumn(name, _bucket_stat(tfm, season)).filter(f"{X}asked")
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, f"{X}ord")]
        out = out.alias("l").join(found.select(*keys, f"{X}ord", name).alias("r"), _all(same), "left").select("l.*", f"r.{name}")
    if passes:
        schema = T.StructType([*out.schema.fields, *(T.StructField(n, T.DoubleType()) for n in passes)])

        def run(table: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table, [(f"{X}ord", "ascending")]))
            at = table[f"{X}ord"].to_numpy()
            for name, (tfm, lag) in passes.items():
                values = table[_column(tfm.time_agg, "v")].to_numpy(zero_copy_only=False).astype(float)
                state = pd.Series(values).ewm(alpha=tfm.alpha, adjust=False, ignore_na=True).mean().to_numpy()
                last = np.searchsorted(at, at - lag, side="right") - 1
                table = table.append_column(name, _arrow(np.where(last >= 0, state[np.maximum(last, 0)], np.nan)))
            return table

        if keys:
            out = out.groupBy(*keys).applyInArrow(run, schema)
        else:
            schema = T.StructType([*schema.fields[: len(out.columns)], T.StructField(f"{X}one", T.IntegerType(), False), *schema.fields[len(out.columns) :]])
            out = out.withColumn(f"{X}one", F.lit(1)).groupBy(f"{X}one").applyInArrow(run, schema).drop(f"{X}one")
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _with_keys(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    keys = [f"{X}k_{i}" for i in range(len(names))]
    return df.withColumns({k: key_of(df, n) for k, n in zip(keys, names, strict=True)}) if keys else df, keys


def _raw(parts: Features, level: str | None) -> bool:
    return any(t.stat == "quantile" and getattr(t, "time_agg", None) == level for t, _ in parts.values())


def _expand_levels(agg: DataFrame, levels: set) -> DataFrame:
    more = {}
    for level in levels - {None}:
        more |= {_column(level, k): c for k, c in _expanded(level).items()}
    return agg.withColumns(more) if more else agg


def _partition_local(df: DataFrame, roles: Roles, scope: Scope, parts: Features) -> DataFrame:
    """Buckets within a series; steps are those of the series' own calendar."""
    y = value_of(roles.target)
    base, keys = _with_keys(df, scope.partition_by)
    by_id = Window.partitionBy(q(roles.id)).orderBy(q(roles.time))
    lookup = {n: p for n, p in parts.items() if p[0].kind == "lookup"}
    rest = {n: p for n, p in parts.items() if n not in lookup}
    if lookup:
        occurrences = Window.partitionBy(q(roles.id), *keys).orderBy(q(roles.time))
        base = base.withColumns({n: F.lag(y, lag).over(occurrences) for n, (_, lag) in lookup.items()})
    if not rest:
        return base.drop(*keys)
    base = base.withColumn(f"{X}ord", F.row_number().over(by_id).cast("long"))
    levels = _levels(rest)
    own = {_column(None, k): c for k, c in {"s": y, "c": y.isNotNull().cast("long"), "q": y * y, "n": y, "x": y, "a": F.array_compact(F.array(y))}.items()}
    own |= {_column(level, "v"): y for level in levels - {None}}
    in_place = {n: p for n, p in rest.items() if p[0].kind in ("rolling", "expanding")}
    bucket = [f"{X}id", *keys]
    base = base.withColumn(f"{X}id", q(roles.id)).withColumns(own)
    if in_place:
        base = _bucket_features(base, bucket, in_place)
    others = {n: p for n, p in rest.items() if n not in in_place}
    if others:
        agg = _expand_levels(base.select(*bucket, f"{X}ord", *own), levels)
        found = _bucket_features(agg, bucket, others).select(F.col(f"{X}id").alias(f"{X}rid"), F.col(f"{X}ord").alias(f"{X}rord"), *others)
        base = base.join(found, (F.col(f"{X}id") == F.col(f"{X}rid")) & (F.col(f"{X}ord") == F.col(f"{X}rord")), "left").drop(f"{X}rid", f"{X}rord")
    return base.drop(*keys, f"{X}ord", f"{X}id", *own)


def _spread_quantiles(values: DataFrame, agg: DataFrame, keys: list[str], parts: Features) -> DataFrame:
    """agg with quantiles over bounded windows of raw values.

    values: keys, time, value and how often it occurs. Each goes to the times whose window holds it, so that a task has the values of one
    bucket and window at most, as counts by value, and partial counts are merged before they are shuffled.
    """
    at = agg.select(*(F.col(k).alias(f"{k}a") for k in keys), F.col(f"{X}t").alias(f"{X}ta"), F.col(f"{X}ord"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}a")) for k in keys] + [F.col(f"{X}tv") == F.col(f"{X}ta")]
    placed = values.join(at, _all(same)).select(*keys, f"{X}ord", f"{X}y", f"{X}times")
    out = agg
    for name, (tfm, lag) in parts.items():
        step = tfm.season_length if tfm.kind == "seasonal" else 1
        first = F.col(f"{X}ord") + lag
        asked = F.sequence(first, first + (tfm.window_size - 1) * step, F.lit(step).cast("long"))
        rows = placed.select(*(F.col(k).alias(f"{k}s") for k in keys), F.explode(asked).alias(f"{X}os"), f"{X}y", f"{X}times")
        stat = F.when(F.sum(f"{X}times") >= max(tfm.least, 1), F.percentile(f"{X}y", F.lit(float(tfm.p)), F.col(f"{X}times")))
        found = rows.groupBy(*(f"{k}s" for k in keys), f"{X}os").agg(stat.alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys] + [F.col(f"{X}ord") == F.col(f"{X}os")]
        out = out.join(found, _all(same), "left").drop(*(f"{k}s" for k in keys), f"{X}os")
    return out


def _pooled(df: DataFrame, roles: Roles, scope: Scope, parts: Features) -> DataFrame:
    """Buckets of many series: aggregate by bucket and time, number the times by the scope's calendar, window, join back."""
    y = value_of(roles.target)
    scope_names = scope.groupby or ()
    base, keys = _with_keys(df, scope_names + (scope.partition_by or ()))
    calendar_keys = keys[: len(scope_names)]
    spread = {n: p for n, p in parts.items() if p[0].stat == "quantile" and p[0].kind in ("rolling", "seasonal") and p[0].time_agg is None}
    windows = {n: p for n, p in parts.items() if n not in spread}
    levels = _levels(windows)
    aggregates = {}
    for level in levels:
        aggregates |= {_column(level, k): c for k, c in _aggregates(y, level, _raw(windows, level)).items()}
    time = q(roles.time)
    by_time = base.groupBy(*keys, time.alias(f"{X}t"))
    agg = by_time.agg(*(c.alias(n) for n, c in aggregates.items())) if aggregates else by_time.agg(F.count(F.lit(1)).alias(_column(None, "rows")))
    order = F.dense_rank().over(Window.partitionBy(*calendar_keys).orderBy(f"{X}t")).cast("long").alias(f"{X}ord")
    if scope.partition_by:
        calendar = base.select(*(F.col(k).alias(f"{k}c") for k in calendar_keys), time.alias(f"{X}tc")).distinct()
        order = F.dense_rank().over(Window.partitionBy(*(f"{k}c" for k in calendar_keys)).orderBy(f"{X}tc")).cast("long").alias(f"{X}ord")
        calendar = calendar.select("*", order)
        same = [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in calendar_keys] + [F.col(f"{X}t") == F.col(f"{X}tc")]
        agg = agg.join(calendar, _all(same)).drop(*(f"{k}c" for k in calendar_keys), f"{X}tc")
    else:
        agg = agg.select("*", order)
    agg = _expand_levels(agg, levels)
    if spread:
        values = base.select(*keys, time.alias(f"{X}tv"), y.alias(f"{X}y")).filter(F.col(f"{X}y").isNotNull())
        values = values.groupBy(*keys, f"{X}tv", f"{X}y").agg(F.count(F.lit(1)).alias(f"{X}times"))
        agg = _spread_quantiles(values, agg, keys, spread)
    found = _bucket_features(agg, keys, windows)
    found = found.select(*(F.col(k).alias(f"{k}r") for k in keys), F.col(f"{X}t").alias(f"{X}tr"), *parts)
    same = [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys] + [time == F.col(f"{X}tr")]
    return base.join(found, _all(same), "left").drop(*keys, *(f"{k}r" for k in keys), f"{X}tr")
