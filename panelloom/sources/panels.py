"""Gap-free panels derived from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """y of each series (id, statics) at each of the periods (ds); 0 where rows have none. Both key sets are small."""
    ids = rows.drop("ds", "y").distinct()
    grid = ids.join(F.broadcast(periods.select("ds").distinct()))
    known = rows.select("unique_id", "ds", F.col("y").alias("known"))
    return grid.join(known, ["unique_id", "ds"], "left").select(*ids.columns, "ds", F.coalesce("known", F.lit(0.0)).alias("y"))


def nation_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id (nation), ds (month), y (order value in about thousands), region (static), promo (November and December)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("ds"), "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # The odd divisor below keeps values and their means off the ties of rounding.
    cents = F.round(F.col("o_totalprice") * 100).cast("long")  # whole numbers add up to the same in any order
    by_customer = orders.groupBy("o_custkey", "ds").agg(F.sum(cents).alias("v"))
    by_nation = by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "ds").agg(F.sum("v").alias("v"))
    names = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("unique_id"), F.col("r_name").alias("region"))
    periods = orders.select("ds").distinct()
    grid = F.broadcast(names).join(periods)
    known = by_nation.select(F.col("c_nationkey").alias("n_nationkey"), "ds", "v")
    out = grid.join(known, ["n_nationkey", "ds"], "left")
    return out.select("unique_id", "ds", (F.coalesce("v", F.lit(0)).cast("double") / 100003.0).alias("y"), "region", F.month("ds").isin(11, 12).cast("int").alias("promo"))


def flag_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id (return flag and line status), ds (day), y (quantity), status (static), dow (day of the week)."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("unique_id"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("ds"), "l_quantity"
    )
    rows = rows.groupBy("unique_id", "status", "ds").agg(F.sum("l_quantity").cast("double").alias("y"))
    days = rows.agg(F.min("ds").alias("a"), F.max("ds").alias("b")).select(F.explode(F.sequence("a", "b")).alias("ds"))
    return filled(rows, days).withColumn("dow", F.weekday("ds").cast("int"))


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id (event type), ds (hour), y (number of events)."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    hours = rows.agg(F.min("ds").alias("a"), F.max("ds").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("ds"))
    return filled(rows, hours)


def customer_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id (customer), ds (number of the order, from 1), y (its price), segment (static), priority (dynamic)."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    rows = orders.select(F.col("o_custkey").alias("unique_id"), nth.alias("ds"), F.col("o_totalprice").alias("y"), F.col("o_orderpriority").alias("priority"))
    return rows.join(customer, rows["unique_id"] == customer["c_custkey"]).select("unique_id", "ds", "y", "segment", "priority")
