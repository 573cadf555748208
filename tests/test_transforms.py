"""Lag transforms: names, literals, and windows against NumPy and SQL."""

import operator

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelloom.operators import lag_transforms as lt
from panelloom.plans.features import Roles, add_lag_features
from panelloom.plans.latest import latest

R = Roles()


def panel(spark, series, **columns):
    rows = [(k, i, float(v), *(columns[c][k] if not isinstance(columns[c][k], list) else columns[c][k][i] for c in columns)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "unique_id string, ds long, y double" + "".join(f", {c} string" for c in columns))


def column(df, name):
    return df.select("unique_id", "ds", f"`{name}`").toPandas().set_index(["unique_id", "ds"])[name].sort_index()


def test_names():
    assert lt.RollingMean(7).name(1) == "rolling_mean_lag1_window_size7"
    assert lt.RollingMean(7, min_samples=1, global_=True).name(2) == "global_rolling_mean_lag2_window_size7_min_samples1"
    assert lt.RollingQuantile(0.5, 3).name(1) == "rolling_quantile_lag1_p0.5_window_size3"
    assert lt.SeasonalRollingStd(7, 4).name(1) == "seasonal_rolling_std_lag1_season_length7_window_size4"
    assert lt.ExpandingMax(groupby=["a", "b"], partition_by="c").name(3) == "groupby_a__b_partby_c_expanding_max_lag3"
    assert lt.ExponentiallyWeightedMean(0.9).name(1) == "exponentially_weighted_mean_lag1_alpha0.9"
    assert lt.Offset(lt.RollingStd(3), 2).name(1) == "rolling_std_lag3_window_size3"
    assert lt.LookupLag("h").name(2) == "partby_h_lookup_lag2"
    assert lt.Combine(lt.Lag(), lt.ExpandingMean(), operator.truediv).name(1) == "lag1_truediv_expanding_mean_lag1"


def test_bad_settings():
    for make in (
        lambda: lt.LookupLag(), lambda: lt.RollingMean(3, global_=True, groupby="a"), lambda: lt.RollingMean(3, time_agg="sum"),
        lambda: lt.RollingMean(3, global_=True, time_agg="median"), lambda: lt.Combine(lt.Lag(), lt.RollingMean(2, global_=True), operator.add),
        lambda: lt.Offset(lt.Lag(), -1).name(1), lambda: lt.ExponentiallyWeightedMean(0.5, global_=True, time_agg=None),
    ):
        with pytest.raises((ValueError, TypeError)):
            make()


def test_keep_last():
    assert lt.keep_last({"a": (lt.Lag(), 5), "b": (lt.RollingMean(7), 2), "c": (lt.SeasonalRollingMean(7, 2), 1)}) == 14
    assert lt.keep_last({"a": (lt.Lag(), 5), "b": (lt.ExpandingMean(), 1)}) is None


TRANSFORMS = [
    lt.Lag(), lt.RollingMean(3), lt.RollingStd(4, min_samples=2), lt.RollingMin(2), lt.RollingMax(5, min_samples=1), lt.RollingQuantile(0.3, 4), lt.SeasonalRollingMean(3, 2),
    lt.SeasonalRollingStd(2, 3, min_samples=2), lt.SeasonalRollingQuantile(0.5, 2, 2), lt.ExpandingMean(), lt.ExpandingStd(), lt.ExpandingMin(), lt.ExpandingMax(),
    lt.ExpandingQuantile(0.7), lt.ExponentiallyWeightedMean(0.4), lt.Offset(lt.RollingMean(2), 1), lt.Combine(lt.RollingMean(2), lt.Lag(), operator.sub),
]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-100, 100), min_size=1, max_size=14), min_size=1, max_size=3), st.integers(1, 3))
def test_windows_match_numpy(spark, series, lag):
    data = {f"s{i}": v for i, v in enumerate(series)}
    features = {f"f{i}": (t, lag) for i, t in enumerate(TRANSFORMS)}
    got = add_lag_features(panel(spark, data), R, features).toPandas().sort_values(["unique_id", "ds"])
    for name, (tfm, n) in features.items():
        want = [latest(np.array(values[:i]), tfm, n) for values in data.values() for i in range(len(values))]
        np.testing.assert_allclose(got[name].to_numpy(float), np.array(want, float), rtol=1e-7, atol=1e-7, err_msg=tfm.name(n))


def test_null_keys_form_one_bucket(spark):
    df = panel(spark, {"a": [1.0, 2, 3, 4], "b": [10.0, 20, 30, 40], "c": [5.0, 5, 5, 5]}, brand={"a": "x", "b": None, "c": None})
    out = column(add_lag_features(df, R, {"m": (lt.RollingMean(1, groupby="brand"), 1)}), "m")
    assert out["a"].tolist()[1:] == [1, 2, 3]
    assert out["b"].tolist()[1:] == out["c"].tolist()[1:] == [7.5, 12.5, 17.5]


def test_staggered_starts_have_no_phantom_zeros(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 2, 20.0), ("b", 3, 30.0)], "unique_id string, ds long, y double")
    out = column(add_lag_features(df, R, {"m": (lt.RollingMean(1, global_=True), 1)}), "m")
    assert out["b"].tolist() == [1.0, 11.0]


def test_partition_windows_count_the_parents_calendar(spark):
    df = panel(spark, {"a": [1.0, 2, 3, 4, 5, 6]}, promo={"a": ["0", "0", "1", "0", "1", "0"]})
    features = {"m": (lt.RollingMean(2, partition_by="promo"), 1), "l": (lt.LookupLag("promo"), 1), "s": (lt.SeasonalRollingMean(2, 2, min_samples=1, partition_by="promo"), 1),
                "e": (lt.ExponentiallyWeightedMean(0.5, partition_by="promo"), 1)}
    out = add_lag_features(df, R, features)
    assert column(out, "m").fillna(-1).tolist() == [-1, 1, -1, 2, 3, 4]
    assert column(out, "l").fillna(-1).tolist() == [-1, 1, -1, 2, 3, 4]
    assert column(out, "s").fillna(-1).tolist() == [-1, 1, -1, 1, -1, -1]
    assert column(out, "e").fillna(-1).tolist() == [-1, 1, -1, 1.5, 3, 2.75]


def test_time_agg_counts_times(spark):
    df = panel(spark, {"a": [1.0, 2, 3], "b": [10.0, 20, 30]})
    features = {"sum": (lt.RollingMean(2, global_=True, time_agg="sum"), 1), "rows": (lt.RollingMean(2, min_samples=2, global_=True), 1)}
    out = add_lag_features(df, R, features)
    assert column(out, "sum")["a"].fillna(-1).tolist() == [-1, -1, 16.5]
    assert column(out, "rows")["a"].fillna(-1).tolist() == [-1, 5.5, 8.25]


def test_existing_columns_win_and_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 7.0), ("a", 1, float("nan"), 7.0), ("a", 2, 3.0, 7.0)], "unique_id string, ds long, y double, lag1 double")
    out = add_lag_features(df, R, {"lag1": (lt.Lag(), 1), "m": (lt.RollingMean(2, min_samples=1), 1)})
    assert column(out, "lag1").tolist() == [7.0, 7.0, 7.0]
    assert column(out, "m").fillna(-1).tolist() == [-1, 1, 1]


def test_custom_function(spark):
    def twice(x, k=2):
        return x * k

    df = panel(spark, {"a": [1.0, 2, 3]})
    out = add_lag_features(df, R, {"t": (lt.as_transform((twice, 3)), 1)})
    assert lt.as_transform((twice, 3)).name(1) == "twice_lag1_k3"
    assert column(out, "t").fillna(-1).tolist() == [-1, 3, 6]


def test_empty_panel(spark):
    df = panel(spark, {"a": [1.0]}).limit(0)
    out = add_lag_features(df, R, {"m": (lt.RollingMean(2), 1), "g": (lt.ExpandingMean(global_=True), 1)})
    assert out.count() == 0 and {"m", "g"} <= set(out.columns)
    assert isinstance(out.toPandas(), pd.DataFrame)
