"""Appending of streamed observations to a panel's history table.

Each micro-batch keeps rows after their series' last time, and appends them once: a batch that is
replayed after a failure finds its own folder and replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.features import Roles, q


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def append_batch(spark: SparkSession, path: str, roles: Roles):
    """A function for foreachBatch."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            known = spark.read.parquet(path).filter(F.col("batch") != number)
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            fresh = batch
        else:
            ends = known.groupBy(q(roles.id).alias("__id")).agg(F.max(q(roles.time)).alias("__last"))
            joined = batch.join(ends, q(roles.id) == F.col("__id"), "left")
            fresh = joined.filter(F.col("__last").isNull() | (q(roles.time) > F.col("__last"))).select(*batch.columns)
        fresh.dropDuplicates([roles.id, roles.time]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def append_stream(stream: DataFrame, path: str, checkpoint: str, roles: Roles | None = None, **trigger):
    """Starts the query; trigger: availableNow=True or processingTime='...'."""
    run = append_batch(stream.sparkSession, path, roles or Roles())
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
