"""Fitting, prediction, back-tests, intervals, state."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelloom.functions import tests_of_series as ts
from panelloom.functions.freq import Freq
from panelloom.operators import intervals as iv
from panelloom.operators import lag_transforms as lt
from panelloom.operators import targets as tt
from panelloom.operators.exog import transform_exog
from panelloom.operators.models import ArrayModel, FeatureModel, name_models
from panelloom.operators.tuning import AutoPanel, AutoRidge, BoostingCV
from panelloom.plans.engine import Panel
from panelloom.plans.features import Roles
from panelloom.sources.generators import generate_daily_series, generate_prices_for_series
from panelloom.streaming.append import append_stream, history

R = Roles()
# Executors can't import this file: its classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def daily(spark):
    return generate_daily_series(spark, 4, 40, 60, n_static_features=1, equal_ends=True, with_trend=True).cache()


def naive(**options):
    return Panel({"naive": FeatureModel("lag7")}, "D", lags=[7], **options)


def values(df, *columns):
    return df.orderBy("unique_id", "ds").select(*columns).toPandas()


def test_generators(spark, daily):
    again = generate_daily_series(spark, 4, 40, 60, n_static_features=1, equal_ends=True, with_trend=True)
    assert daily.exceptAll(again).isEmpty()
    prices = generate_prices_for_series(daily, horizon=3)
    assert prices.count() == daily.count() + 4 * 3
    with pytest.raises(ValueError):
        generate_prices_for_series(generate_daily_series(spark, 4, 40, 60))


@pytest.mark.parametrize("freq,start,want", [("MS", "2020-01-01", "2020-03-01"), ("ME", "2020-01-31", "2020-03-31"), ("W-THU", "2020-01-02", "2020-01-16"), ("QS", "2020-01-01", "2020-07-01"), ("YS", "2020-01-01", "2022-01-01"), ("2D", "2020-01-01", "2020-01-05")])
def test_freq(spark, freq, start, want):
    df = spark.sql(f"SELECT DATE'{start}' AS d, TIMESTAMP_NTZ'{start} 00:00:00' AS t")
    row = df.select(Freq.of(freq).shift(F.col("d"), 2, "date"), Freq.of(freq).shift(F.col("t"), 2, "timestamp_ntz")).first()
    assert str(row[0]) == want and str(row[1]).startswith(want)


def test_validation(spark):
    for rows in ([("a", 1, 1.0), ("a", 3, 1.0)], [("a", 1, 1.0), ("a", 1, 1.0)], [("a", 1, None), ("a", 2, 1.0)]):
        df = spark.createDataFrame(rows, "unique_id string, ds long, y double")
        with pytest.raises(ValueError):
            Panel([], 1, lags=[1]).preprocess(df)
    with pytest.raises(ValueError):
        Panel([], "D", lags=[1]).preprocess(spark.createDataFrame([("a", 1, 1.0)], "unique_id string, ds long, y double"))


def test_model_names():
    assert list(name_models([LinearRegression(), LinearRegression(), GBTRegressor()])) == ["LinearRegression", "LinearRegression2", "GBTRegressor"]


def test_preprocess_roles(spark, daily):
    out = Panel([], "D", lags=[1], date_features=["dayofweek"]).preprocess(daily)
    assert out.columns == ["unique_id", "ds", "y", "static_0", "lag1", "dayofweek"]
    assert out.count() == daily.count() - 4
    direct = Panel([], "D", lags=[1]).preprocess(daily, max_horizon=3)
    assert {"y0", "y1", "y2"} <= set(direct.columns) and "y" not in direct.columns
    with pytest.raises(ValueError):
        Panel([], "D", lags=[1]).preprocess(daily, max_horizon=2, horizons=[1])


def test_paths_agree(spark, daily):
    """One pass and step by step, with a linear model over several transforms."""
    panel = Panel({"lr": LinearRegression(solver="normal", regParam=0.1)}, "D", lags=[1, 7], lag_transforms={1: [lt.RollingMean(3), lt.ExpandingStd(), lt.ExponentiallyWeightedMean(0.3)]}, date_features=["dayofweek"])
    panel.fit(daily, static_features=["static_0"])
    fast = values(panel.predict(3), "unique_id", "ds", "lr")
    slow = values(panel.predict(3, before_predict_callback=lambda x: x), "unique_id", "ds", "lr")
    np.testing.assert_allclose(fast.lr, slow.lr, rtol=1e-8)
    assert values(panel.predict(2), "lr").lr.tolist() == pytest.approx(fast.groupby("unique_id").head(2).lr.tolist())


def test_direct_equals_recursive_at_one_step(spark, daily):
    make = lambda: Panel({"lr": LinearRegression(solver="normal")}, "D", lags=[1, 2])
    a = values(make().fit(daily.drop("static_0")).predict(1), "lr")
    b = values(make().fit(daily.drop("static_0"), max_horizon=1).predict(1), "lr")
    np.testing.assert_allclose(a, b, rtol=1e-8)
    some = make().fit(daily.drop("static_0"), horizons=[2, 4]).predict(4)
    assert some.count() == 8
    with pytest.raises(ValueError):
        make().fit(daily.drop("static_0"), max_horizon=2).predict(3)


def test_dynamic_columns(spark, daily):
    prices = generate_prices_for_series(daily, horizon=5)
    df = daily.drop("static_0").join(prices, ["unique_id", "ds"])
    panel = Panel({"lr": LinearRegression(solver="normal")}, "D", lags=[1]).fit(df, static_features=[])
    with pytest.raises(ValueError):
        panel.predict(5)
    full = panel.predict(5, X_df=prices)
    assert full.count() == 20 and full.filter("lr is null").isEmpty()
    partial = panel.predict(5, X_df=prices.join(panel.make_future_dataframe(2), ["unique_id", "ds"]))
    assert partial.count() == 20 and partial.filter("lr is null").isEmpty()
    assert panel.get_missing_future(7, prices).count() == 8
    direct = Panel({"lr": LinearRegression(solver="normal")}, "D", lags=[1]).fit(df, static_features=[], max_horizon=2)
    assert direct.predict(2, X_df=prices).filter("lr is null").isEmpty()


def test_ids_and_callbacks(spark, daily):
    panel = naive().fit(daily)
    assert panel.predict(2, ids=["id_1", "id_3"]).select("unique_id").distinct().count() == 2
    with pytest.raises(ValueError):
        panel.predict(2, ids=["nobody"])
    out = panel.predict(2, after_predict_callback=lambda d: d.withColumn("naive", F.lit(1.0)))
    assert out.filter("naive <> 1.0").isEmpty()


@pytest.mark.parametrize("make", [lambda: [tt.Differences([1, 7])], lambda: [tt.LocalStandardScaler()], lambda: [tt.LocalMinMaxScaler()], lambda: [tt.LocalRobustScaler()], lambda: [tt.LocalRobustScaler("mad")],
                                  lambda: [tt.LocalBoxCox()], lambda: [tt.GlobalFunction(F.log1p, F.expm1)], lambda: [tt.AutoDifferences(2)], lambda: [tt.AutoSeasonalDifferences(7, 1)],
                                  lambda: [tt.AutoSeasonalityAndDifferences(10, 1)], lambda: [tt.Differences([1]), tt.LocalStandardScaler()]])
def test_target_transforms_invert(spark, daily, make):
    """In-sample values that are the transformed target itself come back as the target."""
    df = daily.drop("static_0").withColumn("y", F.col("y") + 1)
    transforms = make()
    mapped = tt.apply_all(transforms, df, R)
    back = tt.undo_all(transforms, mapped.withColumn("step", F.lit(1)), ["y"], fitted=True)
    both = back.select("unique_id", "ds", F.col("y").alias("z")).join(df, ["unique_id", "ds"]).filter("z is not null")
    assert both.count() >= df.count() - 4 * 8
    assert both.filter("abs(z - y) > 1e-6").isEmpty()


def test_differences_of_forecasts(spark, daily):
    """A naive forecast of first differences is the last value plus the sum of last week's steps."""
    df = daily.drop("static_0")
    got = naive(target_transforms=[tt.Differences([1])]).fit(df).predict(3).toPandas().set_index(["unique_id", "ds"]).naive
    for uid, own in df.toPandas().sort_values("ds").groupby("unique_id"):
        y = own.y.to_numpy()
        d = np.diff(y)
        np.testing.assert_allclose(got[uid].sort_index(), y[-1] + np.cumsum(d[-7:-4]), rtol=1e-9)


def test_statistics_of_series():
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    season = np.tile([0, 5, 1, 7, 2, 9, 3.0], 40) + rng.normal(size=280) * 0.1
    assert ts.n_differences(noise, 2) == 0 and ts.n_differences(walk, 2) == 1
    assert ts.n_seasonal_differences(season, 7, 1) == 1 and ts.n_seasonal_differences(noise, 7, 1) == 0
    assert ts.find_period(season, 10) == 7
    assert abs(ts.box_cox_lambda(np.exp(rng.normal(size=2000)))) < 0.1


def test_cross_validation_matches_manual_split(spark, daily):
    df = daily.drop("static_0")
    cv = naive().cross_validation(df, n_windows=2, h=7).toPandas()
    assert len(cv) == 4 * 14 and list(cv.columns) == ["unique_id", "ds", "cutoff", "y", "naive"]
    truth = df.toPandas().set_index(["unique_id", "ds"]).y
    week = cv.apply(lambda r: truth[r.unique_id, r.ds - np.timedelta64(7, "D")], axis=1)
    np.testing.assert_allclose(cv.naive, week)
    frozen = naive().cross_validation(df, n_windows=2, h=7, refit=False).toPandas()
    assert sorted(frozen.naive) == pytest.approx(sorted(cv.naive))
    with pytest.raises(ValueError):
        naive().cross_validation(df, n_windows=20, h=7)


def test_intervals(spark, daily):
    df = daily.drop("static_0")
    for method in iv.METHODS:
        panel = naive().fit(df, prediction_intervals=iv.PredictionIntervals(2, 3, method))
        out = panel.predict(3, level=[80, 95]).toPandas()
        assert list(out.columns) == ["unique_id", "ds", "naive", "naive-lo-95", "naive-lo-80", "naive-hi-80", "naive-hi-95"]
        assert (out["naive-lo-95"] <= out["naive-lo-80"]).all() and (out["naive-hi-80"] <= out["naive-hi-95"]).all()
    with pytest.raises(ValueError):
        panel.predict(4, level=[80])
    with pytest.raises(ValueError):
        iv.PredictionIntervals(1)


def test_transfer(spark, daily, tmp_path):
    df = daily.drop("static_0")
    panel = naive().fit(df, prediction_intervals=iv.PredictionIntervals(2, 3))
    new = df.withColumn("unique_id", F.concat(F.lit("new_"), "unique_id")).withColumn("y", F.col("y") * 10)
    before = values(panel.predict(3), "naive")
    for method in iv.TRANSFER_METHODS:
        out = panel.predict(3, new_df=new, level=[80], transfer=iv.TransferConformal(method, cv=2)).toPandas()
        assert len(out) == 12 and out.unique_id.str.startswith("new_").all()
        assert (out["naive-lo-80"].fillna(-1e9) <= out["naive-hi-80"].fillna(1e9)).all(), method
    # Errors are those of the source, ten times as large as the series.
    wide = panel.predict(3, new_df=new, level=[80], transfer=iv.TransferConformal("scale_aligned")).toPandas()
    own = panel.predict(3, level=[80]).toPandas()
    ratio = (wide["naive-hi-80"] - wide["naive"]).mean() / (own["naive-hi-80"] - own["naive"]).mean()
    assert 3 < ratio < 30
    np.testing.assert_allclose(values(panel.predict(3), "naive"), before)
    panel.save(f"file://{tmp_path}/m")
    again = Panel.load(spark, f"file://{tmp_path}/m").predict(3, new_df=new, level=[80], transfer=iv.TransferConformal("scale_aligned")).toPandas()
    columns = ["naive-lo-80", "naive-hi-80"]
    np.testing.assert_allclose(again.sort_values(["unique_id", "ds"])[columns], wide.sort_values(["unique_id", "ds"])[columns])


def test_density_ratio_after_an_observation(spark):
    # From the first observation on, a session can't be serialised, nor a model that holds one.
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    source = spark.range(40).select((F.col("id") / 10).alias("x"))
    out = iv.estimate_density_ratio(source, source.filter("x >= 2"), ["x"], cv=2).orderBy("x").toPandas()
    assert out.x.tolist() == [i / 10 for i in range(40)] and (out.weight > 0).all()
    assert out.weight[:10].mean() < out.weight[30:].mean()


def test_rejected_new_rows_leave_the_panel_usable(spark, daily):
    panel = naive().fit(daily.drop("static_0"))
    before = values(panel.predict(2), "naive")
    with pytest.raises(ValueError):
        panel.predict(2, new_df=daily.drop("static_0", "y"))
    np.testing.assert_allclose(values(panel.predict(2), "naive"), before)


def test_season_candidates():
    from panelloom.operators.tuning import season_candidates, spread_lags

    assert spread_lags(12) == list(range(1, 13)) and spread_lags(24)[-1] == 24 and len(spread_lags(168)) <= 12 and spread_lags(1) == [1]
    found = season_candidates(12, 30, 100, 1.0)
    assert [12, 24, 36] in found["lags"] and found["date_features"] == [None, ["month", "year"]]
    assert {lag for t in found["lag_transforms"] if t for lag in t} == {1, 12, 30}
    assert len(found["target_transforms"]) == 7 and len(season_candidates(12, 3, 20, -1.0)["target_transforms"]) == 3
    assert season_candidates(1, 3, 20, 0.0)["lag_transforms"][2:] == []


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1, float(i), 1.0) for i in range(1, 10)], "k int, v double, w double")
    row = iv.weighted_quantiles(df, ["k"], "v", "w", [0.5, 0.95], 1.0).first()
    assert row["w0"] == 5.0 and row["w1"] is None


def test_series_scales(spark):
    df = spark.createDataFrame([("one", 1, 4.0), ("flat", 1, 2.0), ("flat", 2, 2.0), ("w", 1, 0.0), ("w", 2, 3.0), ("w", 3, 4.0), ("w", 4, 9.0)], "unique_id string, ds long, y double")
    got = {r["id"]: r["scale"] for r in iv.series_scales(df, R).collect()}
    assert got["one"] == 4.0 and got["w"] == 2.0 and got["flat"] == pytest.approx(2e-3)


def test_update_save_load(spark, daily, tmp_path):
    df = daily.drop("static_0")
    numbered = df.withColumn("n", F.datediff(F.max("ds").over(__import__("pyspark").sql.Window.partitionBy("unique_id")), "ds"))
    old, new = numbered.filter("n >= 3").drop("n"), numbered.filter("n < 3").drop("n")
    panel = Panel({"lr": LinearRegression(solver="normal"), "naive": FeatureModel("lag7")}, "D", lags=[1, 7], target_transforms=[tt.LocalStandardScaler()]).fit(old)
    panel.save(f"file://{tmp_path}/m")
    again = Panel.load(spark, f"file://{tmp_path}/m")
    np.testing.assert_allclose(values(again.predict(3), "lr", "naive"), values(panel.predict(3), "lr", "naive"), rtol=1e-9)
    before = values(panel.predict(1), "ds").ds.max()
    assert values(panel.update(new, validate=True).predict(1), "ds").ds.max() > before
    with pytest.raises(ValueError):
        panel.update(new, validate=True)
    with pytest.raises(ValueError):
        panel.update(new.withColumn("unique_id", F.lit("unknown")))


def test_pooled_prediction(spark, daily):
    panel = Panel({"g": FeatureModel("global_rolling_mean_lag1_window_size1_min_samples1")}, "D", lag_transforms={1: [lt.RollingMean(1, min_samples=1, global_=True)]})
    out = panel.fit(daily.drop("static_0")).predict(2).toPandas()
    last = daily.groupBy("unique_id").agg(F.max_by("y", "ds").alias("y")).agg(F.avg("y")).first()[0]
    np.testing.assert_allclose(out.g, last)


def test_tuning(spark, daily):
    df = daily.drop("static_0")
    auto = AutoPanel({"ridge": AutoRidge()}, "D", season_length=7).fit(df, n_windows=1, h=3, num_samples=2, seed=1)
    assert auto.predict(3).count() == 12
    assert len(auto.results["ridge"]) == 2


def test_boosting_stops(spark, daily):
    cv = BoostingCV("D", GBTRegressor(maxDepth=2, seed=1), lags=[7])
    found = cv.fit(daily.drop("static_0"), 1, 2, num_iterations=3, eval_every=1, early_stopping_evals=1, early_stopping_pct=0.99)
    assert len(found) == 2 and cv.best_iteration_ in (1, 2)
    assert cv.predict(2).count() == 8


def test_exog(spark, daily):
    out = transform_exog(daily.drop("static_0"), lags=[1], lag_transforms={1: [lt.RollingMean(2)]})
    assert out.columns == ["unique_id", "ds", "y", "y_lag1", "y_rolling_mean_lag1_window_size2"]
    with pytest.raises(ValueError):
        transform_exog(daily, lag_transforms={1: [lt.RollingMean(2, global_=True)]})


def test_streaming_append(spark, tmp_path):
    schema = "unique_id string, ds long, y double"
    source, table, state = (f"{tmp_path}/{n}" for n in ("in", "table", "state"))
    spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], schema).write.parquet(source)
    append_stream(spark.readStream.schema(schema).parquet(source), table, state).awaitTermination()
    spark.createDataFrame([("a", 2, 9.0), ("a", 3, 3.0), ("b", 1, 5.0)], schema).write.mode("append").parquet(source)
    append_stream(spark.readStream.schema(schema).parquet(source), table, state).awaitTermination()
    got = sorted(tuple(r) for r in history(spark, table).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 5.0)]


def test_save_features(spark, daily):
    from panelloom.operators.callbacks import SaveFeatures

    seen = SaveFeatures()
    naive().fit(daily).predict(2, before_predict_callback=seen)
    assert seen.get_features(with_step=True).select("step").distinct().count() == 2
    assert "lag7" in seen.get_features().columns
    with pytest.raises(ValueError):
        SaveFeatures().get_features()


def test_fitted_values_of_more_steps(spark, daily):
    """Eight steps ahead the naive forecast has to roll over its own first step: the value of two weeks before."""
    df = daily.drop("static_0")
    panel = naive().fit(df, fitted=True)
    got = panel.forecast_fitted_values(h=8).toPandas().set_index(["unique_id", "ds"])
    assert set(got.h) == {8}
    for uid, own in df.toPandas().sort_values("ds").groupby("unique_id"):
        y = own.y.to_numpy()
        np.testing.assert_allclose(got.loc[uid].sort_index().naive, y[: len(y) - 14])
    assert panel.dropped_series(panel.preprocess(df)).count() == 0
    assert set(panel.to_local()) == {"history", "ends"}


def test_weights_of_scores(spark, daily):
    df = daily.drop("static_0")
    panel = naive().fit(df, prediction_intervals=iv.PredictionIntervals(3, 2, "weighted_conformal_error"))
    weights = df.select("unique_id").distinct().withColumn("weight", F.lit(1.0))
    out = panel.predict(2, level=[50], weights=weights).toPandas()
    assert (out["naive-lo-50"] <= out["naive-hi-50"]).all() and out["naive-hi-50"].notna().all()
    with pytest.raises(ValueError):
        panel.predict(2, level=[50], weights=weights, ids=["id_1"])


class Line:
    """Least squares over arrays."""

    def fit(self, X, y, sample_weight=None, shift=0.0):
        w = np.ones(len(y)) if sample_weight is None else np.sqrt(sample_weight)
        self.beta = np.linalg.lstsq(np.column_stack([np.nan_to_num(X), np.ones(len(X))]) * w[:, None], y * w, rcond=None)[0]
        self.beta[-1] += shift
        return self

    def predict(self, X):
        return np.column_stack([np.nan_to_num(X), np.ones(len(X))]) @ self.beta


class Half:
    """A transformer over arrays."""

    def fit(self, x):
        self.mean = x.mean()
        return self

    def transform(self, x):
        return (x - self.mean) / 2

    def inverse_transform(self, x):
        return x * 2 + self.mean


def test_models_over_arrays(spark, daily, tmp_path):
    options = dict(freq="D", lags=[1, 7])
    panel = Panel({"a": Line(), "b": LinearRegression(solver="normal")}, **options).fit(daily, static_features=["static_0"])
    got = values(panel.predict(5), "a", "b")
    assert np.allclose(got["a"], got["b"], rtol=1e-6)
    stepped = values(panel.predict(5, before_predict_callback=lambda x: x), "a")
    assert np.allclose(stepped["a"], got["a"])
    path = f"file://{tmp_path}/arrays"
    panel.save(path)
    assert np.allclose(values(Panel.load(spark, path).predict(5), "a")["a"], got["a"])
    more = Panel({"a": Line(), "b": LinearRegression(solver="normal")}, **options)
    more.fit(daily, static_features=["static_0"], models_fit_kwargs={"a": {"shift": 1.0}, "b": {"regParam": 5.0}})
    ahead = values(more.predict(1), "a", "b")
    first = values(panel.predict(1), "a", "b")
    assert np.allclose(ahead["a"], first["a"] + 1) and not np.allclose(ahead["b"], first["b"])
    with pytest.raises(ValueError):
        more.fit(daily, static_features=["static_0"], models_fit_kwargs={"c": {}})
    with pytest.raises(ValueError):
        Panel({"a": ArrayModel(Line(), most_rows=10)}, **options).fit(daily, static_features=["static_0"])
    assert name_models([ArrayModel(Line())]).keys() == {"Line"}


def test_fitted_transformer(spark, daily):
    plain = values(naive().fit(daily, static_features=["static_0"]).predict(9), "naive")
    mapped = naive(target_transforms=[tt.GlobalFitted(Half())]).fit(daily, static_features=["static_0"])
    assert np.allclose(values(mapped.predict(9), "naive")["naive"], plain["naive"])
    with pytest.raises(ValueError):
        tt.GlobalFitted(Half(), most_rows=3).fit_transform(daily, R)


def test_nulls_and_short_future(spark, daily):
    df = daily.withColumn("price", F.col("y") * 2)
    panel = Panel({"line": Line()}, "D", lags=[1], lag_transforms={1: [lt.RollingMean(100)]}).fit(df.limit(0).union(df), static_features=["static_0"], dropna=False)
    name = "rolling_mean_lag1_window_size100"
    future = panel.make_future_dataframe(2).withColumn("price", F.lit(1.0))
    assert panel.null_inputs(future) == {name: 4}
    with pytest.warns(UserWarning, match=name):
        panel.predict(2, X_df=future, before_predict_callback=lambda x: x).count()
    first = panel.make_future_dataframe(1).withColumn("price", F.lit(1.0))
    with pytest.warns(UserWarning, match="4 of 8"):
        panel.predict(2, X_df=first).count()
    some = first.filter(F.col("unique_id") != first.agg(F.max("unique_id")).first()[0])
    with pytest.raises(ValueError, match="at least one"):
        panel.predict(2, X_df=some)
