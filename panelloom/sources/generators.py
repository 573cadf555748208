"""Random panels for tests and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_daily_series(
    spark: SparkSession, n_series: int, min_length: int = 50, max_length: int = 500, n_static_features: int = 0, equal_ends: bool = False,
    with_trend: bool = False, seed: int = 0,
) -> DataFrame:
    """unique_id, ds, y and static_0...: daily series with a weekly season, the same for the same seed."""
    width = len(str(max(n_series - 1, 1)))
    draw = lambda *salt: F.pmod(F.xxhash64("i", F.lit(seed), *(F.lit(s) for s in salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = spark.range(n_series).select(F.col("id").alias("i"))
    length = (F.lit(min_length) + F.floor(draw("length") * (max_length - min_length + 1))).cast("int")
    ids = ids.select(
        "i", F.concat(F.lit("id_"), F.lpad(F.col("i").cast("string"), width, "0")).alias("unique_id"), length.alias("n"), draw("level").alias("level"),
        *(F.floor(draw("static", k) * 100).cast("int").alias(f"static_{k}") for k in range(n_static_features)),
    )
    start = F.lit("2000-01-01").cast("date")
    rows = ids.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("t"))
    day = F.date_add(start, F.lit(max_length) - F.col("n") + F.col("t")) if equal_ends else F.date_add(start, F.col("t"))
    noise = F.pmod(F.xxhash64("i", "t", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 0.5
    y = F.pmod(F.col("t"), F.lit(7)).cast("double") + noise + F.col("level") + (F.col("t") / 10.0 if with_trend else F.lit(0.0))
    return rows.select("unique_id", day.cast("timestamp_ntz").alias("ds"), y.alias("y"), *(f"static_{k}" for k in range(n_static_features)))


def generate_prices_for_series(series: DataFrame, horizon: int = 7, seed: int = 0) -> DataFrame:
    """unique_id, ds, price: daily from each series' first day to `horizon` days after its last. Ends must be equal."""
    spans = series.groupBy("unique_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    if spans.select("b").distinct().limit(2).count() > 1:
        raise ValueError("series must end at the same time")
    days = F.sequence(F.col("a"), F.timestamp_add("DAY", F.lit(horizon), F.col("b")).cast("timestamp_ntz"), F.expr("INTERVAL 1 DAY"))
    price = F.pmod(F.xxhash64("unique_id", "ds", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return spans.select("unique_id", F.explode(days).alias("ds")).select("unique_id", "ds", price.alias("price"))
