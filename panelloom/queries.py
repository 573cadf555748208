"""Queries of the panel operators over the shared test tables, each beside SQL that gives the same rows."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import intervals as iv
from .operators import lag_transforms as lt
from .operators import targets as tt
from .operators.callbacks import SaveFeatures
from .operators.exog import transform_exog
from .operators.metrics import mape, rmse, smape
from .operators.models import FeatureModel
from .plans.backtest import with_back
from .plans.engine import Panel, Plan
from .plans.features import Roles, add_lag_features, q
from .plans.validate import broken_grids, last_rows
from .sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
R = Roles()

#: The panel of nations by month, as a first common table expression.
P1 = """
WITH o AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
v AS (SELECT c_nationkey AS k, ds, sum(cents) AS v FROM o JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT n_nationkey AS k, n_name AS unique_id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT n.unique_id, d.ds, CAST(coalesce(v.v, 0) AS DOUBLE) / 100003.0::DOUBLE AS y, n.region, CAST(month(d.ds) IN (11, 12) AS INT) AS promo
      FROM n CROSS JOIN (SELECT DISTINCT ds FROM o) d LEFT JOIN v ON v.k = n.k AND v.ds = d.ds)
"""


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def shown(df: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ("unique_id", "ds")) -> DataFrame:
    """keys, and columns under short names, rounded to four digits."""
    return df.select(*(q(k) for k in keys), *(F.round(q(c).cast("double"), 4).alias(n) for c, n in columns.items()))


def features_query(name: str, transforms: list[tuple[int, lt.LagTransform]], short: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {t.name(lag): (t, lag) for lag, t in transforms}
        df = add_lag_features(panels.nation_monthly(spark, sf_dir), R, own)
        return shown(df, dict(zip(own, short, strict=True)))

    query(name, sql)(run)


def rows(lag: int, window: int | None) -> str:
    low = "UNBOUNDED" if window is None else str(lag + window - 1)
    return f"(PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {low} PRECEDING AND {lag} PRECEDING)"


def guarded(agg: str, frame: str, least: int, value: str = "y") -> str:
    return f"round(CASE WHEN count({value}) OVER {frame} >= {least} THEN {agg} OVER {frame} END, 4)"


def local_sql(columns: dict[str, str], extra: str = "", source: str = "p") -> str:
    return P1 + extra + f"SELECT unique_id, ds, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"


features_query("lag_local", [(1, lt.Lag()), (12, lt.Lag())], ["lag1", "lag12"], local_sql({f"lag{n}": f"round(lag(y, {n}) OVER (PARTITION BY unique_id ORDER BY ds), 4)" for n in (1, 12)}))

_STATS = {"mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "q": "quantile_cont(y, 0.25)"}
features_query(
    "rolling_local",
    [(1, lt.RollingMean(3)), (2, lt.RollingStd(4)), (1, lt.RollingMin(6, min_samples=1)), (3, lt.RollingMax(5)), (1, lt.RollingQuantile(0.25, 6, min_samples=2))],
    ["mean", "std", "min", "max", "q"],
    local_sql({n: guarded(_STATS[n], rows(lag, w), least) for n, lag, w, least in (("mean", 1, 3, 3), ("std", 2, 4, 4), ("min", 1, 6, 1), ("max", 3, 5, 5), ("q", 1, 6, 2))}),
)
features_query(
    "expanding_local",
    [(1, lt.ExpandingMean()), (2, lt.ExpandingStd()), (1, lt.ExpandingMin()), (3, lt.ExpandingMax()), (1, lt.ExpandingQuantile(0.25))],
    ["mean", "std", "min", "max", "q"],
    local_sql({n: guarded(_STATS[n], rows(lag, None), 1) for n, lag in (("mean", 1), ("std", 2), ("min", 1), ("max", 3), ("q", 1))}),
)


def seasonal_frame(w: int) -> str:
    return f"(PARTITION BY unique_id, ord % 12 ORDER BY ord ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


_SEASON = ", z AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS ord, lag(y, 1) OVER (PARTITION BY unique_id ORDER BY ds) AS z1 FROM p)\n"
features_query(
    "seasonal_local",
    [(1, lt.SeasonalRollingMean(12, 3)), (1, lt.SeasonalRollingStd(12, 3)), (1, lt.SeasonalRollingMin(12, 3, min_samples=1)), (1, lt.SeasonalRollingMax(12, 2)), (1, lt.SeasonalRollingQuantile(0.25, 12, 4, min_samples=2))],
    ["mean", "std", "min", "max", "q"],
    local_sql({n: guarded(_STATS[n].replace("(y", "(z1"), seasonal_frame(w), least, "z1") for n, w, least in (("mean", 3, 3), ("std", 3, 3), ("min", 3, 1), ("max", 2, 2), ("q", 4, 2))}, _SEASON, "z"),
)
_EWM = "CASE WHEN count(y) OVER {f} > 0 THEN list_reduce(list(y) OVER {f}, lambda p, c: 0.3::DOUBLE * c + 0.7::DOUBLE * p) END"
features_query("ewm_local", [(1, lt.ExponentiallyWeightedMean(0.3)), (3, lt.ExponentiallyWeightedMean(0.3))], ["e1", "e3"], local_sql({f"e{n}": f"round({_EWM.format(f=rows(n, None))}, 4)" for n in (1, 3)}))
features_query(
    "offset_combine",
    [(1, lt.Offset(lt.RollingMean(3), 2)), (1, lt.Combine(lt.RollingMean(3), lt.RollingMean(12), operator.truediv)), (2, lt.Combine(lt.Lag(), lt.Offset(lt.Lag(), 12), operator.sub))],
    ["offset", "ratio", "difference"],
    local_sql({
        "offset": guarded("avg(y)", rows(3, 3), 3),
        "ratio": f"round((CASE WHEN count(y) OVER {rows(1, 12)} >= 12 THEN avg(y) OVER {rows(1, 3)} END) / nullif(avg(y) OVER {rows(1, 12)}, 0), 4)",
        "difference": "round(lag(y, 2) OVER (PARTITION BY unique_id ORDER BY ds) - lag(y, 14) OVER (PARTITION BY unique_id ORDER BY ds), 4)",
    }),
)


def range_of_three(x: np.ndarray, k: int = 3) -> np.ndarray:
    """Largest less smallest of the last k values."""
    out = np.full(len(x), np.nan)
    for i in range(k - 1, len(x)):
        part = x[i - k + 1 : i + 1]
        out[i] = np.nan if np.isnan(part).any() else part.max() - part.min()
    return out


features_query("custom_function", [(1, lt.Custom(range_of_three)), (2, lt.Custom(range_of_three, (4,)))], ["r3", "r4"], local_sql({
    "r3": f"round(CASE WHEN count(y) OVER {rows(1, 3)} >= 3 THEN max(y) OVER {rows(1, 3)} - min(y) OVER {rows(1, 3)} END, 4)",
    "r4": f"round(CASE WHEN count(y) OVER {rows(2, 4)} >= 4 THEN max(y) OVER {rows(2, 4)} - min(y) OVER {rows(2, 4)} END, 4)"}))
features_query("lookup_lag", [(1, lt.LookupLag("promo")), (2, lt.LookupLag(["promo"]))], ["l1", "l2"], local_sql({f"l{n}": f"round(lag(y, {n}) OVER (PARTITION BY unique_id, promo ORDER BY ds), 4)" for n in (1, 2)}))

# Pooled scopes: name, arguments, bucket and calendar of the SQL.
_SCOPES = {
    "global": ({"global_": True}, "", ""),
    "groupby": ({"groupby": "region"}, "region", "region"),
    "partition_local": ({"partition_by": "promo"}, "unique_id, promo", "unique_id"),
    "partition_global": ({"global_": True, "partition_by": "promo"}, "promo", ""),
    "partition_groupby": ({"groupby": ["region"], "partition_by": ["promo"]}, "region, promo", "region"),
}


def _pooled_sql(bucket: str, calendar: str, columns: dict[str, tuple[str, int, int | None, int]], level: str | None = None) -> str:
    """columns: name -> (aggregate, lag, window, least)."""
    by = f"PARTITION BY {bucket} " if bucket else ""
    source, extra = "base", ""
    if level:
        keys = f"{bucket}, " if bucket else ""
        extra = f", one AS (SELECT {keys}ord, {level}(y)::DOUBLE AS y FROM base GROUP BY ALL)"
        source = "one"
    out = []
    for name, (agg, lag, window, least) in columns.items():
        low = "UNBOUNDED PRECEDING" if window is None else f"{lag + window - 1} PRECEDING"
        frame = f"({by}ORDER BY ord RANGE BETWEEN {low} AND {lag} PRECEDING)"
        out.append(f"{guarded(agg, frame, least)} AS {name}")
    cal = f"PARTITION BY {calendar} " if calendar else ""
    head = P1 + f", base AS (SELECT *, dense_rank() OVER ({cal}ORDER BY ds) AS ord FROM p){extra}"
    if not level:
        return head + f" SELECT unique_id, ds, {', '.join(out)} FROM base"
    same = " AND ".join(f"b.{c.strip()} IS NOT DISTINCT FROM a.{c.strip()}" for c in [*(bucket.split(",") if bucket else []), "ord"])
    return head + f", a AS (SELECT *, {', '.join(out)} FROM one) SELECT b.unique_id, b.ds, {', '.join(f'a.{n}' for n in columns)} FROM base b JOIN a ON {same}"


for _name, (_own, _bucket, _calendar) in _SCOPES.items():
    features_query(
        f"pooled_{_name}",
        [(1, lt.RollingMean(3, **_own)), (1, lt.RollingStd(4, min_samples=2, **_own)), (2, lt.RollingMin(3, **_own)), (1, lt.RollingMax(6, min_samples=1, **_own)),
         (1, lt.ExpandingMean(**_own)), (2, lt.ExpandingStd(**_own)), (1, lt.ExpandingMin(**_own)), (1, lt.ExpandingMax(**_own)), (1, lt.RollingQuantile(0.25, 3, **_own))],
        ["mean", "std", "min", "max", "emean", "estd", "emin", "emax", "q"],
        _pooled_sql(_bucket, _calendar, {
            "mean": ("avg(y)", 1, 3, 1 if _name == "partition_local" else 3), "std": ("stddev_samp(y)", 1, 4, 2), "min": ("min(y)", 2, 3, 1 if _name == "partition_local" else 3),
            "max": ("max(y)", 1, 6, 1), "emean": ("avg(y)", 1, None, 1), "estd": ("stddev_samp(y)", 2, None, 1), "emin": ("min(y)", 1, None, 1), "emax": ("max(y)", 1, None, 1),
            "q": ("quantile_cont(y, 0.25)", 1, 3, 1 if _name == "partition_local" else 3)}),
    )
for _level in lt.AGGREGATES:
    features_query(
        f"time_agg_{_level}",
        [(1, lt.RollingMean(3, groupby="region", time_agg=_level)), (2, lt.RollingStd(4, groupby="region", time_agg=_level)), (1, lt.ExpandingMax(groupby="region", time_agg=_level)),
         (1, lt.ExpandingQuantile(0.25, groupby="region", time_agg=_level))],
        ["mean", "std", "emax", "eq"],
        _pooled_sql("region", "region", {"mean": ("avg(y)", 1, 3, 3), "std": ("stddev_samp(y)", 2, 4, 4), "emax": ("max(y)", 1, None, 1), "eq": ("quantile_cont(y, 0.25)", 1, None, 1)}, "avg" if _level == "mean" else _level),
    )
features_query(
    "ewm_global",
    [(1, lt.ExponentiallyWeightedMean(0.3, global_=True)), (2, lt.ExponentiallyWeightedMean(0.3, global_=True, time_agg="sum"))],
    ["e1", "s2"],
    P1 + """, g AS (SELECT ds, avg(y) AS m, sum(y) AS s FROM p GROUP BY ds),
    e AS (SELECT ds, list(m) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, list(s) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS b FROM g)
    SELECT p.unique_id, p.ds, round(CASE WHEN len(a) > 0 THEN list_reduce(a, lambda p, c: 0.3::DOUBLE * c + 0.7::DOUBLE * p) END, 4) AS e1,
           round(CASE WHEN len(b) > 0 THEN list_reduce(b, lambda p, c: 0.3::DOUBLE * c + 0.7::DOUBLE * p) END, 4) AS s2 FROM p JOIN e ON p.ds = e.ds""",
)
features_query(
    "seasonal_partition_global",
    [(1, lt.SeasonalRollingMean(6, 2, min_samples=1, global_=True, partition_by="promo")), (2, lt.SeasonalRollingMax(12, 3, min_samples=1, global_=True, partition_by="promo"))],
    ["mean", "max"],
    P1 + """, base AS (SELECT *, dense_rank() OVER (ORDER BY ds) AS ord FROM p)
    SELECT b.unique_id, b.ds,
      round((SELECT avg(x.y) FROM base x WHERE x.promo = b.promo AND (b.ord - 1 - x.ord) IN (0, 6)), 4) AS mean,
      round((SELECT max(x.y) FROM base x WHERE x.promo = b.promo AND (b.ord - 2 - x.ord) IN (0, 12, 24)), 4) AS max FROM base b""",
)

features_query(
    "seasonal_pooled_quantile",
    [(1, lt.SeasonalRollingQuantile(0.25, 6, 2, min_samples=1, groupby="region")), (2, lt.RollingQuantile(0.75, 4, min_samples=2, groupby="region", partition_by="promo"))],
    ["seasonal", "rolling"],
    P1 + """, base AS (SELECT *, dense_rank() OVER (ORDER BY ds) AS ord FROM p)
    SELECT b.unique_id, b.ds,
      round((SELECT quantile_cont(x.y, 0.25) FROM base x WHERE x.region = b.region AND (b.ord - 1 - x.ord) IN (0, 6)), 4) AS seasonal,
      round((SELECT CASE WHEN count(*) >= 2 THEN quantile_cont(x.y, 0.75) END FROM base x WHERE x.region = b.region AND x.promo = b.promo AND b.ord - x.ord BETWEEN 2 AND 5), 4) AS rolling FROM base b""",
)


@query("date_features", P1 + """SELECT unique_id, ds, CAST(year(ds) AS INT) AS year, CAST(month(ds) AS INT) AS month, CAST(day(ds) AS INT) AS day, CAST(dayofyear(ds) AS INT) AS dayofyear,
    CAST(weekofyear(ds) AS INT) AS week, CAST(quarter(ds) AS INT) AS quarter, CAST(isodow(ds) - 1 AS INT) AS dayofweek, CAST(day(last_day(ds)) AS INT) AS daysinmonth,
    CAST(ds = date_trunc('month', ds) AS INT) AS is_month_start, CAST(ds = last_day(ds) AS INT) AS is_month_end, CAST(ds = date_trunc('quarter', ds) AS INT) AS is_quarter_start,
    CAST(ds + 1 = CAST(date_trunc('quarter', ds + 1) AS DATE) AS INT) AS is_quarter_end, CAST(ds = date_trunc('year', ds) AS INT) AS is_year_start,
    CAST(ds + 1 = CAST(date_trunc('year', ds + 1) AS DATE) AS INT) AS is_year_end FROM p""")
def date_features(spark, sf_dir):
    names = ["year", "month", "day", "dayofyear", "week", "quarter", "dayofweek", "daysinmonth", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end"]
    return Plan("MS", date_features=names).with_dates(panels.nation_monthly(spark, sf_dir)).select("unique_id", "ds", *names)


@query("date_dummies", P1 + "SELECT unique_id, ds, " + ", ".join(f"CAST(month(ds) = {m} AS INT) AS month_{m}" for m in range(1, 13)) + ", " + ", ".join(f"CAST(quarter(ds) = {m} AS INT) AS quarter_{m}" for m in range(1, 5)) + " FROM p")
def dummies(spark, sf_dir):
    plan = Plan("MS", date_dummies=["month", "quarter"])
    return plan.with_dates(panels.nation_monthly(spark, sf_dir)).select("unique_id", "ds", *plan.date_names)


_PREPROCESS = P1 + f""", f AS (SELECT *, lag(y, 1) OVER (PARTITION BY unique_id ORDER BY ds) AS lag1, CASE WHEN count(y) OVER {rows(1, 3)} >= 3 THEN avg(y) OVER {rows(1, 3)} END AS rolling_mean_lag1_window_size3 FROM p)
SELECT unique_id, ds, round(y, 4) AS y, region, promo, round(lag1, 4) AS lag1, round(rolling_mean_lag1_window_size3, 4) AS rolling_mean_lag1_window_size3, CAST(month(ds) AS INT) AS month
FROM f WHERE lag1 IS NOT NULL AND rolling_mean_lag1_window_size3 IS NOT NULL"""


@query("preprocess", _PREPROCESS)
def preprocess(spark, sf_dir):
    panel = Panel([], "MS", lags=[1], lag_transforms={1: [lt.RollingMean(3)]}, date_features=["month"])
    df = panel.preprocess(panels.nation_monthly(spark, sf_dir), static_features=["region"])
    return df.select("unique_id", "ds", F.round("y", 4).alias("y"), "region", "promo", *(F.round(c, 4).alias(c) for c in ("lag1", "rolling_mean_lag1_window_size3")), "month")


@query("preprocess_daily_flags", """WITH r AS (SELECT l_returnflag || l_linestatus AS unique_id, l_linestatus AS status, CAST(l_shipdate AS DATE) AS ds, CAST(sum(l_quantity) AS DOUBLE) AS y FROM lineitem GROUP BY ALL),
    d AS (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM r),
    p AS (SELECT i.unique_id, i.status, d.ds, coalesce(r.y, 0.0) AS y FROM (SELECT DISTINCT unique_id, status FROM r) i CROSS JOIN d LEFT JOIN r ON r.unique_id = i.unique_id AND r.ds = d.ds)
    SELECT unique_id, ds, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS week, round(lag(y, 28) OVER (PARTITION BY unique_id ORDER BY ds), 4) AS lag28,
    CAST(isodow(ds) - 1 AS INT) AS weekday FROM p QUALIFY lag(y, 28) OVER (PARTITION BY unique_id ORDER BY ds) IS NOT NULL""")
def preprocess_daily(spark, sf_dir):
    panel = Panel([], "D", lags=[28], lag_transforms={1: [lt.RollingMean(7)]}, date_features=["weekday"])
    df = panel.preprocess(panels.flag_daily(spark, sf_dir), static_features=["status"])
    return df.select("unique_id", "ds", F.round("rolling_mean_lag1_window_size7", 4).alias("week"), F.round("lag28", 4).alias("lag28"), "weekday")


@query("customer_lags", """WITH p AS (SELECT o_custkey AS unique_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ds, o_totalprice AS y, o_orderpriority AS priority FROM orders)
    SELECT unique_id, ds, round(lag(y) OVER (PARTITION BY unique_id ORDER BY ds), 4) AS last, round(lag(y) OVER (PARTITION BY unique_id, priority ORDER BY ds), 4) AS last_like,
    round(max(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS most FROM p""")
def customer_lags(spark, sf_dir):
    own = {"last": (lt.Lag(), 1), "last_like": (lt.LookupLag("priority"), 1), "most": (lt.ExpandingMax(), 1)}
    return shown(add_lag_features(panels.customer_occurrence(spark, sf_dir), R, own), {n: n for n in own})


@query("expand_target", P1 + "SELECT unique_id, ds, " + ", ".join(f"round(lead(y, {j}) OVER (PARTITION BY unique_id ORDER BY ds), 4) AS y{j}" for j in range(4)) + " FROM p")
def expand_target(spark, sf_dir):
    df = Plan("MS", lags=[1]).prepare(panels.nation_monthly(spark, sf_dir), max_horizon=4, dropna=False, validate=False)
    return shown(df, {f"y{j}": f"y{j}" for j in range(4)})


@query("transform_exog", P1 + f"SELECT unique_id, ds, round(y, 4) AS y, round(lag(y, 2) OVER (PARTITION BY unique_id ORDER BY ds), 4) AS y_lag2, {guarded('avg(y)', rows(1, 3), 3)} AS y_mean FROM p")
def exog(spark, sf_dir):
    df = transform_exog(panels.nation_monthly(spark, sf_dir).select("unique_id", "ds", "y"), lags=[2], lag_transforms={1: [lt.RollingMean(3)]})
    return shown(df, {"y": "y", "y_lag2": "y_lag2", "y_rolling_mean_lag1_window_size3": "y_mean"})


def target_query(name: str, make: Callable[[], tt.TargetTransform], expr: str, extra: str = "", source: str = "p") -> None:
    @query(name, P1 + extra + f"SELECT unique_id, ds, round({expr}, 4) AS y FROM {source}")
    def run(spark, sf_dir):
        return shown(make().fit_transform(panels.nation_monthly(spark, sf_dir), R), {"y": "y"})


_BY = "OVER (PARTITION BY unique_id)"
target_query("target_differences", lambda: tt.Differences([1, 12]), "d - lag(d, 12) OVER (PARTITION BY unique_id ORDER BY ds)", ", d AS (SELECT *, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS d FROM p)\n", "d")
target_query("target_standard", tt.LocalStandardScaler, f"(y - avg(y) {_BY}) / stddev_pop(y) {_BY}")
target_query("target_minmax", tt.LocalMinMaxScaler, f"(y - min(y) {_BY}) / (max(y) {_BY} - min(y) {_BY})")
target_query("target_robust_iqr", tt.LocalRobustScaler, f"(y - quantile_cont(y, 0.5) {_BY}) / (quantile_cont(y, 0.75) {_BY} - quantile_cont(y, 0.25) {_BY})")
target_query("target_robust_mad", lambda: tt.LocalRobustScaler("mad"), "(y - m) / quantile_cont(abs(y - m), 0.5) OVER (PARTITION BY unique_id)", ", m AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY unique_id) AS m FROM p)\n", "m")
target_query("target_global_log1p", lambda: tt.GlobalFunction(F.log1p, F.expm1), "ln(1 + y)")


@query("target_auto")
def target_auto(spark, sf_dir):
    df = panels.nation_monthly(spark, sf_dir)
    parts = [tt.AutoDifferences(2), tt.AutoSeasonalDifferences(12, 1), tt.AutoSeasonalityAndDifferences(13, 1), tt.LocalBoxCox()]
    out = df.select("unique_id", "ds")
    for i, t in enumerate(parts):
        out = out.join(t.fit_transform(df, R).select("unique_id", "ds", F.round("y", 4).alias(f"y{i}")), ["unique_id", "ds"])
    return out


_FUTURE = ", e AS (SELECT unique_id, max(ds) AS e FROM p GROUP BY unique_id), f AS (SELECT unique_id, CAST(e + to_months(CAST(s AS INT)) AS DATE) AS ds, s FROM e CROSS JOIN generate_series(1, {h}) t(s))\n"


def _naive(**options) -> Panel:
    return Panel({"naive": FeatureModel("lag12")}, "MS", lags=[12], **options)


def _monthly(spark, sf_dir) -> DataFrame:
    return panels.nation_monthly(spark, sf_dir).select("unique_id", "ds", "y")


@query("make_future", P1 + _FUTURE.format(h=5) + "SELECT unique_id, ds FROM f")
def make_future(spark, sf_dir):
    return _naive().history_warmup(_monthly(spark, sf_dir)).make_future_dataframe(5)


@query("missing_future", P1 + _FUTURE.format(h=5) + "SELECT unique_id, ds FROM f WHERE s > 3 OR unique_id < 'C'")
def missing_future(spark, sf_dir):
    panel = _naive().history_warmup(_monthly(spark, sf_dir))
    known = panel.make_future_dataframe(3).filter("unique_id >= 'C'")
    return panel.get_missing_future(5, known)


_NAIVE = P1 + _FUTURE.format(h=18) + """, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p)
SELECT f.unique_id, f.ds, round(r.y, 4) AS naive FROM f JOIN r ON r.unique_id = f.unique_id AND r.b = 12 - (f.s - 1) % 12"""


@query("predict_recursive_naive", _NAIVE)
def predict_naive(spark, sf_dir):
    return shown(_naive().fit(_monthly(spark, sf_dir)).predict(18), {"naive": "naive"})


@query("predict_stepwise_naive", _NAIVE.replace("h=18", "").replace("generate_series(1, 18)", "generate_series(1, 3)"))
def predict_stepwise(spark, sf_dir):
    seen = []
    panel = _naive().fit(_monthly(spark, sf_dir))
    return shown(panel.predict(3, before_predict_callback=lambda x: seen.append(1) or x), {"naive": "naive"})


@query("predict_direct_mean", P1 + _FUTURE.format(h=3) + ", r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p), m AS (SELECT unique_id, avg(y) AS m FROM r WHERE b <= 6 GROUP BY unique_id)\nSELECT f.unique_id, f.ds, round(m.m, 4) AS mean FROM f JOIN m ON m.unique_id = f.unique_id")
def predict_direct(spark, sf_dir):
    panel = Panel({"mean": FeatureModel("rolling_mean_lag1_window_size6")}, "MS", lag_transforms={1: [lt.RollingMean(6)]})
    return shown(panel.fit(_monthly(spark, sf_dir), max_horizon=3).predict(3), {"mean": "mean"})


@query("predict_differenced", P1 + _FUTURE.format(h=4) + """, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS d FROM p)
SELECT f.unique_id, f.ds, round(l.y + (SELECT sum(r.d) FROM r WHERE r.unique_id = f.unique_id AND r.b <= 12 AND r.b >= 13 - f.s), 4) AS naive FROM f JOIN r l ON l.unique_id = f.unique_id AND l.b = 1""")
def predict_differenced(spark, sf_dir):
    return shown(_naive(target_transforms=[tt.Differences([1])]).fit(_monthly(spark, sf_dir)).predict(4), {"naive": "naive"})


_LINE = P1 + _FUTURE.format(h=2) + """, t AS (SELECT *, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS x FROM p), b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM t WHERE x IS NOT NULL),
e1 AS (SELECT unique_id, arg_max(y, ds) AS y FROM p GROUP BY unique_id)
SELECT f.unique_id, f.ds, round(CASE WHEN f.s = 1 THEN b.i + b.s * e1.y ELSE b.i + b.s * (b.i + b.s * e1.y) END, 2) AS line FROM f JOIN e1 ON e1.unique_id = f.unique_id CROSS JOIN b"""


@query("predict_linear", _LINE)
def predict_linear(spark, sf_dir):
    panel = Panel({"line": LinearRegression(solver="normal")}, "MS", lags=[1]).fit(_monthly(spark, sf_dir))
    return panel.predict(2).select("unique_id", "ds", F.round("line", 2).alias("line"))


@query("predict_linear_pooled")
def predict_pooled(spark, sf_dir):
    df = panels.nation_monthly(spark, sf_dir)
    own = [lt.RollingMean(3, groupby="region"), lt.ExpandingMean(global_=True)]
    panel = Panel({"line": LinearRegression(solver="normal")}, "MS", lags=[1], lag_transforms={1: own}, date_features=["month"])
    panel.fit(df.drop("promo"), static_features=["region"])
    return shown(panel.predict(2), {"line": "line"})


_CV = P1 + """, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b, lag(y, 12) OVER (PARTITION BY unique_id ORDER BY ds) AS naive FROM p),
w AS (SELECT * FROM (VALUES (12), (6), (0)) t(a)),
c AS (SELECT r.unique_id, r.ds, x.ds AS cutoff, r.y, r.naive, w.a + 7 - r.b AS step FROM w JOIN r ON r.b > w.a AND r.b <= w.a + 6 JOIN r x ON x.unique_id = r.unique_id AND x.b = w.a + 7)
"""


@query("cross_validation", _CV + "SELECT unique_id, ds, cutoff, round(y, 4) AS y, round(naive, 4) AS naive FROM c")
def cross_validation(spark, sf_dir):
    cv = _naive().cross_validation(_monthly(spark, sf_dir), n_windows=3, h=6)
    return shown(cv, {"y": "y", "naive": "naive"}, ("unique_id", "ds", "cutoff"))


@query("cross_validation_frozen", _CV + "SELECT unique_id, ds, cutoff, round(y, 4) AS y, round(naive, 4) AS naive FROM c")
def cross_validation_frozen(spark, sf_dir):
    cv = _naive().cross_validation(_monthly(spark, sf_dir), n_windows=3, h=6, refit=False, input_size=40)
    return shown(cv, {"y": "y", "naive": "naive"}, ("unique_id", "ds", "cutoff"))


@query("fitted_values", P1 + ", r AS (SELECT *, lag(y, 12) OVER (PARTITION BY unique_id ORDER BY ds) AS naive FROM p)\nSELECT unique_id, ds, round(y, 4) AS y, round(naive, 4) AS naive FROM r WHERE naive IS NOT NULL")
def fitted_values(spark, sf_dir):
    return shown(_naive().fit(_monthly(spark, sf_dir), fitted=True).forecast_fitted_values(), {"y": "y", "naive": "naive"})


@query("cv_fitted_values", P1 + """, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b, lag(y, 12) OVER (PARTITION BY unique_id ORDER BY ds) AS naive FROM p)
SELECT unique_id, ds, CAST(f AS INT) AS fold, round(y, 4) AS y, round(naive, 4) AS naive FROM r JOIN (VALUES (0, 12), (1, 6)) t(f, a) ON b > a WHERE naive IS NOT NULL""")
def cv_fitted(spark, sf_dir):
    panel = _naive()
    panel.cross_validation(_monthly(spark, sf_dir), n_windows=2, h=6, fitted=True)
    return shown(panel.cross_validation_fitted_values(), {"y": "y", "naive": "naive"}, ("unique_id", "ds", "fold"))


@query("conformity_scores", _CV + "SELECT unique_id, cutoff, CAST(step AS INT) AS step, round(abs(y - naive), 4) AS naive FROM c")
def scores(spark, sf_dir):
    found = iv.conformity_scores(_naive(), _monthly(spark, sf_dir), iv.PredictionIntervals(3, 6), {})
    return found.select("unique_id", "cutoff", "step", F.round("naive", 4).alias("naive"))


_LAST = ", l AS (SELECT p.*, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p), f AS (SELECT unique_id, CAST(ds + INTERVAL 1 YEAR AS DATE) AS ds, y AS naive, 13 - b AS step FROM l WHERE b BETWEEN 7 AND 12)"


def intervals_query(name: str, method: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        panel = _naive().fit(_monthly(spark, sf_dir), prediction_intervals=iv.PredictionIntervals(3, 6, method))
        out = panel.predict(6, level=[80, 95])
        return shown(out, {"naive": "naive", "naive-lo-95": "lo95", "naive-lo-80": "lo80", "naive-hi-80": "hi80", "naive-hi-95": "hi95"})


_BOUNDS = "SELECT f.unique_id, f.ds, round(naive, 4) AS naive, round(naive - w95, 4) AS lo95, round(naive - w80, 4) AS lo80, round(naive + w80, 4) AS hi80, round(naive + w95, 4) AS hi95 FROM f JOIN s USING (unique_id, step)"
intervals_query("conformal_error", "conformal_error", _CV + ", s AS (SELECT unique_id, step, quantile_cont(abs(y - naive), 0.8) AS w80, quantile_cont(abs(y - naive), 0.95) AS w95 FROM c GROUP BY ALL)" + _LAST + _BOUNDS)
intervals_query("conformal_distribution", "conformal_distribution", _CV + ", x AS (SELECT unique_id, step, abs(y - naive) AS e FROM c UNION ALL SELECT unique_id, step, -abs(y - naive) FROM c), s AS (SELECT unique_id, step, quantile_cont(e, 0.9) AS w80, quantile_cont(e, 0.975) AS w95 FROM x GROUP BY ALL)" + _LAST + _BOUNDS)


@query("weighted_quantile", P1 + """, s AS (SELECT region, y, sum(w) OVER (PARTITION BY region ORDER BY y) / (sum(w) OVER (PARTITION BY region) + 1.0) AS s FROM (SELECT region, y, CAST(month(ds) AS DOUBLE) AS w FROM p))
SELECT region, round(min(y) FILTER (WHERE s >= 0.8 - 1e-12), 4) AS w80, round(min(y) FILTER (WHERE s >= 0.5 - 1e-12), 4) AS w50 FROM s GROUP BY region""")
def weighted_quantile(spark, sf_dir):
    df = panels.nation_monthly(spark, sf_dir).withColumn("w", F.month("ds").cast("double"))
    found = iv.weighted_quantiles(df, ["region"], "y", "w", [0.8, 0.5], 1.0)
    return found.select("region", F.round("w0", 4).alias("w80"), F.round("w1", 4).alias("w50"))


_DELTA = ", d AS (SELECT unique_id, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS d FROM p)"


@query("series_scales_mad", P1 + _DELTA + ", m AS (SELECT *, median(d) OVER (PARTITION BY unique_id) AS m FROM d), s AS (SELECT unique_id, median(abs(d - m)) AS s FROM m GROUP BY unique_id)\nSELECT unique_id AS id, round(greatest(s, (SELECT greatest(median(s) * 0.001, 1e-8) FROM s)), 4) AS scale FROM s")
def scales_mad(spark, sf_dir):
    return iv.series_scales(_monthly(spark, sf_dir), R).select("id", F.round("scale", 4).alias("scale"))


@query("series_scales_std", P1 + _DELTA + ", s AS (SELECT unique_id, stddev_samp(d) AS s FROM d GROUP BY unique_id)\nSELECT unique_id AS id, round(greatest(s, (SELECT greatest(median(s) * 0.001, 1e-8) FROM s)), 4) AS scale FROM s")
def scales_std(spark, sf_dir):
    return iv.series_scales(_monthly(spark, sf_dir), R, "std").select("id", F.round("scale", 4).alias("scale"))


@query("metrics", _CV + """, e AS (SELECT unique_id, avg(CASE WHEN y <> 0 THEN abs((y - naive) / y) END) AS a, avg((y - naive) ** 2) AS b, avg(CASE WHEN abs(y) + abs(naive) = 0 THEN 0.0 ELSE abs(y - naive) / (abs(y) + abs(naive)) END) AS c FROM c GROUP BY unique_id)
SELECT round(avg(a), 4) AS mape, round(sqrt(avg(b)), 4) AS rmse, round(avg(c), 4) AS smape FROM e""")
def metrics(spark, sf_dir):
    cv = _naive().cross_validation(_monthly(spark, sf_dir), n_windows=3, h=6)
    row = (mape(cv, R, "naive"), rmse(cv, R, "naive"), smape(cv, R, "naive"))
    return spark.createDataFrame([tuple(float(x) for x in row)], "mape double, rmse double, smape double").select(*(F.round(c, 4).alias(c) for c in ("mape", "rmse", "smape")))


@query("update", P1 + ", r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p)\nSELECT unique_id, CAST(ds + INTERVAL 1 YEAR AS DATE) AS ds, round(y, 4) AS naive FROM r WHERE b BETWEEN 10 AND 12")
def update(spark, sf_dir):
    numbered = with_back(_monthly(spark, sf_dir), R)
    panel = _naive().fit(numbered.filter("__back > 5").drop("__back"))
    return shown(panel.update(numbered.filter("__back <= 5").drop("__back"), validate=True).predict(3), {"naive": "naive"})


@query("keep_last", P1 + "SELECT unique_id, ds, round(y, 4) AS y FROM p QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 5")
def keep_last(spark, sf_dir):
    return shown(last_rows(_monthly(spark, sf_dir), R, 5), {"y": "y"})


@query("broken_grids", """WITH p AS (SELECT l_returnflag || l_linestatus AS id, CAST(l_shipdate AS DATE) AS ds FROM lineitem), g AS (SELECT id, min(ds) AS first, max(ds) AS last, count(*) AS n, count(DISTINCT ds) AS n_distinct FROM p GROUP BY id)
SELECT * FROM g WHERE n <> n_distinct OR first + CAST(n_distinct - 1 AS INT) <> last""")
def grids(spark, sf_dir):
    from .functions.freq import Freq

    df = panels.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("unique_id"), F.to_date("l_shipdate").alias("ds"), F.lit(1.0).alias("y"))
    return broken_grids(df, R, Freq.of("D"))


@query("events_hourly", """WITH r AS (SELECT event_type AS unique_id, date_trunc('hour', ts) AS ds, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL), d AS (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds FROM r),
p AS (SELECT i.unique_id, d.ds, coalesce(r.y, 0.0) AS y FROM (SELECT DISTINCT unique_id FROM r) i CROSS JOIN d LEFT JOIN r ON r.unique_id = i.unique_id AND r.ds = d.ds)
SELECT unique_id, ds, round(y, 4) AS y, round(lag(y, 24) OVER (PARTITION BY unique_id ORDER BY ds), 4) AS lag24, CAST(hour(ds) AS INT) AS hour FROM p""")
def events(spark, sf_dir):
    df = add_lag_features(panels.events_hourly(spark, sf_dir), R, {"lag24": (lt.Lag(), 24)})
    return df.select("unique_id", "ds", F.round("y", 4).alias("y"), F.round("lag24", 4).alias("lag24"), F.hour("ds").cast("int").alias("hour"))


_SHIFTED = P1 + ", r AS (SELECT unique_id, ds, y * 10 AS y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b, 10 * lag(y, 12) OVER (PARTITION BY unique_id ORDER BY ds) AS naive FROM p)"


def _moved(spark, sf_dir, transfer: iv.TransferConformal):
    """Intervals for new series, ten times the known ones."""
    df = _monthly(spark, sf_dir)
    panel = _naive().fit(df, prediction_intervals=iv.PredictionIntervals(3, 6, "conformal_error"))
    new = df.withColumn("unique_id", F.concat(F.lit("new_"), "unique_id")).withColumn("y", F.col("y") * 10)
    return shown(panel.predict(6, new_df=new, level=[80], transfer=transfer), {"naive": "naive", "naive-lo-80": "lo80", "naive-hi-80": "hi80"})


@query("transfer_recalibrate", _SHIFTED + """, e AS (SELECT CAST(a + 7 - b AS INT) AS step, y - naive AS e FROM r JOIN (VALUES (0), (1)) t(a) ON b > a AND b <= a + 6),
s AS (SELECT step, quantile_cont(e, 0.1) AS lo, quantile_cont(e, 0.9) AS hi FROM e GROUP BY step), f AS (SELECT unique_id, CAST(ds + INTERVAL 1 YEAR AS DATE) AS ds, y AS naive, 13 - b AS step FROM r WHERE b BETWEEN 7 AND 12)
SELECT 'new_' || f.unique_id AS unique_id, f.ds, round(naive, 4) AS naive, round(naive + lo, 4) AS lo80, round(naive + hi, 4) AS hi80 FROM f JOIN s USING (step)""")
def transfer_recalibrate(spark, sf_dir):
    return _moved(spark, sf_dir, iv.TransferConformal("recalibrate", n_windows=2))


@query("transfer_scale_aligned", _CV + _DELTA + """, dm AS (SELECT *, median(d) OVER (PARTITION BY unique_id) AS m FROM d), sc AS (SELECT unique_id, median(abs(d - m)) AS s FROM dm GROUP BY unique_id),
g AS (SELECT unique_id, greatest(s, (SELECT greatest(median(s) * 0.001, 1e-8) FROM sc)) AS scale FROM sc), wd AS (SELECT step, quantile_cont(abs(y - naive) / scale, 0.8) AS w80 FROM c JOIN g USING (unique_id) GROUP BY step)""" + _LAST + """
SELECT 'new_' || f.unique_id AS unique_id, f.ds, round(10 * naive, 4) AS naive, round(10 * naive - w80 * 10 * scale, 4) AS lo80, round(10 * naive + w80 * 10 * scale, 4) AS hi80 FROM f JOIN wd USING (step) JOIN g USING (unique_id)""")
def transfer_scale_aligned(spark, sf_dir):
    return _moved(spark, sf_dir, iv.TransferConformal("scale_aligned"))


@query("fitted_scaled", ORACLES["fitted_values"])
def fitted_scaled(spark, sf_dir):
    panel = _naive(target_transforms=[tt.LocalStandardScaler()])
    return shown(panel.fit(_monthly(spark, sf_dir), fitted=True).forecast_fitted_values(), {"y": "y", "naive": "naive"})


@query("fitted_differences", P1 + ", r AS (SELECT *, lag(y, 1) OVER w + lag(y, 12) OVER w - lag(y, 13) OVER w AS naive FROM p WINDOW w AS (PARTITION BY unique_id ORDER BY ds))\nSELECT unique_id, ds, round(y, 4) AS y, round(naive, 4) AS naive FROM r WHERE naive IS NOT NULL")
def fitted_differences(spark, sf_dir):
    panel = _naive(target_transforms=[tt.Differences([1])])
    return shown(panel.fit(_monthly(spark, sf_dir), fitted=True).forecast_fitted_values(), {"y": "y", "naive": "naive"})


_NEXT = P1 + ", l AS (SELECT p.*, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p)\nSELECT unique_id, CAST(ds + INTERVAL 1 YEAR AS DATE) AS ds, round(y, 4) AS naive FROM l WHERE b BETWEEN 7 AND 12"


@query("predict_ids", _NEXT + " AND unique_id = (SELECT min(unique_id) FROM p)")
def predict_ids(spark, sf_dir):
    df = _monthly(spark, sf_dir)
    return shown(_naive().fit(df).predict(6, ids=[df.agg(F.min("unique_id")).first()[0]]), {"naive": "naive"})


@query("save_load", _NEXT)
def save_load(spark, sf_dir):
    import uuid

    from .plans.engine import Panel
    from .plans.lineage import cut

    panel = _naive().fit(cut(_monthly(spark, sf_dir)))
    path = f"{spark.sparkContext.getCheckpointDir()}/panel-{uuid.uuid4().hex}"
    panel.save(path)
    return shown(Panel.load(spark, path).predict(6), {"naive": "naive"})


@query("predict_new_series", _NEXT.replace("unique_id, CAST", "'new_' || unique_id AS unique_id, CAST"))
def predict_new_series(spark, sf_dir):
    df = _monthly(spark, sf_dir)
    return shown(_naive().fit(df).predict(6, new_df=df.withColumn("unique_id", F.concat(F.lit("new_"), "unique_id"))), {"naive": "naive"})


@query("update_sizes", P1 + "SELECT unique_id, count(*) AS n, max(ds) AS last FROM p GROUP BY unique_id")
def update_sizes(spark, sf_dir):
    ends = _naive().fit(_monthly(spark, sf_dir)).plan.history.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"), F.max("ds").alias("last"))
    return ends


@dataclass(frozen=True)
class Momentum(lt.LagTransform):
    """The value less that of some steps before."""

    over: int = 3
    kind = "column"

    def column(self, y, lag, by_id):
        return F.lag(y, lag).over(by_id) - F.lag(y, lag + self.over).over(by_id)

    def samples(self, lag):
        return lag + self.over


features_query("own_transform", [(1, Momentum()), (2, Momentum(12))], ["m3", "m12"], local_sql({
    f"m{n}": f"round(lag(y, {lag}) OVER (PARTITION BY unique_id ORDER BY ds) - lag(y, {lag + n}) OVER (PARTITION BY unique_id ORDER BY ds), 4)" for lag, n in ((1, 3), (2, 12))}))


@query("predict_own_transform", P1 + """, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p)
SELECT x.unique_id, CAST(x.ds + INTERVAL 1 MONTH AS DATE) AS ds, round(x.y - z.y, 4) AS momentum FROM r x JOIN r z ON z.unique_id = x.unique_id AND x.b = 1 AND z.b = 4""")
def predict_own_transform(spark, sf_dir):
    panel = Panel({"momentum": FeatureModel("momentum_lag1")}, "MS", lag_transforms={1: [Momentum()]})
    return shown(panel.fit(_monthly(spark, sf_dir)).predict(1), {"momentum": "momentum"})


@query("pooled_null_keys", P1 + """, k AS (SELECT unique_id, ds, y, CASE WHEN region <> 'ASIA' THEN region END AS region FROM p), a AS (SELECT region, ds, sum(y) AS s, count(y) AS n FROM k GROUP BY ALL),
w AS (SELECT region, ds, sum(s) OVER x / sum(n) OVER x AS mean, sum(n) OVER x AS n FROM a WINDOW x AS (PARTITION BY region ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT k.unique_id, k.ds, round(CASE WHEN n >= 3 THEN mean END, 4) AS mean FROM k JOIN w ON k.region IS NOT DISTINCT FROM w.region AND k.ds = w.ds""")
def pooled_null_keys(spark, sf_dir):
    df = panels.nation_monthly(spark, sf_dir).withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    return shown(add_lag_features(df, R, {"mean": (lt.RollingMean(3, groupby="region"), 1)}), {"mean": "mean"})


def since_1990(time):
    """Years since 1990."""
    return F.year(time) - F.lit(1990)


@query("names_and_functions", P1 + "SELECT unique_id, ds, round(lag(y) OVER (PARTITION BY unique_id ORDER BY ds), 4) AS lag_of_1, CAST(year(ds) - 1990 AS INT) AS since_1990 FROM p QUALIFY lag_of_1 IS NOT NULL")
def names_and_functions(spark, sf_dir):
    panel = Panel([], "MS", lags=[1], date_features=[since_1990], lag_namer=lambda t, n: f"{type(t).__name__.lower()}_of_{n}")
    return panel.preprocess(_monthly(spark, sf_dir)).select("unique_id", "ds", F.round("lag_of_1", 4).alias("lag_of_1"), "since_1990")


@query("saved_features", P1 + _FUTURE.format(h=3) + """, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM p)
SELECT f.unique_id, f.ds, CAST(f.s AS INT) AS step, round(r.y, 4) AS lag12 FROM f JOIN r ON r.unique_id = f.unique_id AND r.b = 13 - f.s""")
def saved_features(spark, sf_dir):
    seen = SaveFeatures()
    _naive().fit(_monthly(spark, sf_dir)).predict(3, before_predict_callback=seen)
    return seen.get_features(with_step=True).select("unique_id", "ds", "step", F.round("lag12", 4).alias("lag12"))


@query("predict_warmed_up", _NEXT)
def predict_warmed_up(spark, sf_dir):
    """Models of one panel on the state of another that was never fitted."""
    df = _monthly(spark, sf_dir)
    panel = _naive().history_warmup(df)
    panel.fitted = _naive().fit(df).fitted
    return shown(panel.predict(6), {"naive": "naive"})


@query("predict_direct_exog", P1 + _FUTURE.format(h=3) + "SELECT unique_id, ds, CAST(month(ds) IN (11, 12) AS DOUBLE) AS promo FROM f")
def predict_direct_exog(spark, sf_dir):
    panel = Panel({"promo": FeatureModel("promo")}, "MS", lags=[1])
    panel.fit(panels.nation_monthly(spark, sf_dir).drop("region"), static_features=[], max_horizon=3)
    future = panel.make_future_dataframe(3).withColumn("promo", F.month("ds").isin(11, 12).cast("int"))
    return shown(panel.predict(3, X_df=future), {"promo": "promo"})


@query("predict_pooled_mean", P1 + _FUTURE.format(h=2) + """, a AS (SELECT region, ds, avg(y) AS a, row_number() OVER (PARTITION BY region ORDER BY ds DESC) AS b FROM p GROUP BY region, ds),
m AS (SELECT region, avg(a) FILTER (WHERE b <= 3) AS m1, sum(a) FILTER (WHERE b <= 2) AS s FROM a GROUP BY region), i AS (SELECT DISTINCT unique_id, region FROM p)
SELECT f.unique_id, f.ds, round(CASE WHEN f.s = 1 THEN m1 ELSE (m.s + m1) / 3 END, 4) AS mean FROM f JOIN i USING (unique_id) JOIN m USING (region)""")
def predict_pooled_mean(spark, sf_dir):
    panel = Panel({"mean": FeatureModel("groupby_region_rolling_mean_lag1_window_size3")}, "MS", lag_transforms={1: [lt.RollingMean(3, groupby="region")]})
    panel.fit(panels.nation_monthly(spark, sf_dir).drop("promo"), static_features=["region"])
    return shown(panel.predict(2), {"mean": "mean"})


@query("fitted_two_ahead", P1 + ", r AS (SELECT *, lag(y, 2) OVER (PARTITION BY unique_id ORDER BY ds) AS last FROM p)\nSELECT unique_id, ds, round(y, 4) AS y, round(last, 4) AS last FROM r WHERE last IS NOT NULL")
def fitted_two_ahead(spark, sf_dir):
    panel = Panel({"last": FeatureModel("lag1")}, "MS", lags=[1]).fit(_monthly(spark, sf_dir), fitted=True)
    return shown(panel.forecast_fitted_values(h=2), {"y": "y", "last": "last"})


@query("fitted_inverse_auto", P1 + "SELECT unique_id, ds, round(y, 4) AS y0, round(y, 4) AS y1, round(y, 4) AS y2, round(y, 4) AS y3 FROM p QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds) > 26")
def fitted_inverse_auto(spark, sf_dir):
    """Chosen differences and powers map back to the values themselves, but for the rows that differences use up."""
    df = _monthly(spark, sf_dir)
    out = df.select("unique_id", "ds", F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")).alias("n")).filter("n > 26").drop("n")
    for i, t in enumerate((tt.AutoDifferences(2), tt.AutoSeasonalDifferences(12, 1), tt.AutoSeasonalityAndDifferences(13, 1), tt.LocalBoxCox())):
        back = t.inverse_fitted(t.fit_transform(df, R).select("unique_id", "ds", "y"), ["y"])
        out = out.join(back.select("unique_id", "ds", F.round("y", 4).alias(f"y{i}")), ["unique_id", "ds"])
    return out


_SHOWN_80 = "round({k}naive, 4) AS naive, round({k}naive - w80, 4) AS lo80, round({k}naive + w80, 4) AS hi80"


@query("weighted_conformal_error", _CV + """, wt AS (SELECT DISTINCT unique_id, CAST(1 + length(unique_id) % 3 AS DOUBLE) AS w FROM p), x AS (SELECT step, abs(y - naive) AS e, w FROM c JOIN wt USING (unique_id)),
t AS (SELECT step, e, sum(w) OVER (PARTITION BY step ORDER BY e) / (sum(w) OVER (PARTITION BY step) + (SELECT avg(w) FROM x)) AS s FROM x), s AS (SELECT step, min(e) FILTER (WHERE s >= 0.8 - 1e-12) AS w80 FROM t GROUP BY step)""" + _LAST + f"""
SELECT f.unique_id, f.ds, {_SHOWN_80.format(k='')} FROM f JOIN s USING (step)""")
def weighted_conformal_error(spark, sf_dir):
    df = _monthly(spark, sf_dir)
    panel = _naive().fit(df, prediction_intervals=iv.PredictionIntervals(3, 6, "weighted_conformal_error"))
    weights = df.select("unique_id", (1 + F.length("unique_id") % 3).cast("double").alias("weight")).distinct()
    return shown(panel.predict(6, level=[80], weights=weights), {"naive": "naive", "naive-lo-80": "lo80", "naive-hi-80": "hi80"})


@query("transfer_error_scaled", _CV + """, e AS (SELECT 10 * abs(y - naive) AS e FROM r JOIN (VALUES (0), (1)) t(a) ON b > a AND b <= a + 6),
k AS (SELECT (SELECT quantile_cont(e, 0.75) - quantile_cont(e, 0.25) FROM e) / (SELECT quantile_cont(abs(y - naive), 0.75) - quantile_cont(abs(y - naive), 0.25) FROM c) AS k),
s AS (SELECT step, quantile_cont(abs(y - naive), 0.8) * (SELECT k FROM k) AS w80 FROM c GROUP BY step)""" + _LAST + f"""
SELECT 'new_' || f.unique_id AS unique_id, f.ds, {_SHOWN_80.format(k='10 * ')} FROM f JOIN s USING (step)""")
def transfer_error_scaled(spark, sf_dir):
    return _moved(spark, sf_dir, iv.TransferConformal("error_scaled", n_windows=2))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
