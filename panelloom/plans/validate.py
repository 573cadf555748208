"""Checks of panels, each one aggregation over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.freq import Freq
from .features import Roles, q


def time_type(df: DataFrame, roles: Roles) -> str:
    return dict(df.dtypes)[roles.time]


def check_columns(df: DataFrame, roles: Roles) -> None:
    missing = [c for c in (roles.id, roles.time, roles.target) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def broken_grids(df: DataFrame, roles: Roles, freq: Freq) -> DataFrame:
    """id, first, last, n, n_distinct of series with repeated times or gaps."""
    kind = time_type(df, roles)
    spans = df.groupBy(q(roles.id).alias("id")).agg(
        F.min(q(roles.time)).alias("first"), F.max(q(roles.time)).alias("last"), F.count(F.lit(1)).alias("n"), F.countDistinct(q(roles.time)).alias("n_distinct")
    )
    ends = freq.shift(F.col("first"), F.col("n_distinct") - 1, kind)
    return spans.filter((F.col("n") != F.col("n_distinct")) | (ends != F.col("last")))


def validate(df: DataFrame, roles: Roles, freq: Freq) -> None:
    """Raises for null targets, repeated times and gaps."""
    check_columns(df, roles)
    freq.check(time_type(df, roles))
    y = q(roles.target).cast("double")
    if not df.filter(y.isNull() | F.isnan(y)).isEmpty():
        raise ValueError(f"{roles.target} has null values")
    bad = broken_grids(df, roles, freq).limit(5).collect()
    if bad:
        names = ", ".join(str(r["id"]) for r in bad)
        what = "repeated times" if any(r["n"] != r["n_distinct"] for r in bad) else "gaps"
        raise ValueError(f"series with {what}: {names}")


def changing_statics(df: DataFrame, roles: Roles, statics: list[str]) -> list[str]:
    """Static columns whose first and last value differ within a series."""
    if not statics:
        return []
    first = [F.min_by(F.struct(q(c)), q(roles.time)).alias(f"a{i}") for i, c in enumerate(statics)]
    last = [F.max_by(F.struct(q(c)), q(roles.time)).alias(f"b{i}") for i, c in enumerate(statics)]
    spans = df.groupBy(q(roles.id)).agg(*first, *last)
    row = spans.agg(*(F.max((~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).cast("int")).alias(f"c{i}") for i in range(len(statics)))).first()
    return [c for i, c in enumerate(statics) if row[i]]


def validate_update(new: DataFrame, last: DataFrame, roles: Roles, freq: Freq) -> None:
    """New rows of known series must go on right after the last known time, without gaps; last: id, last."""
    kind = time_type(new, roles)
    starts = new.groupBy(q(roles.id).alias("id")).agg(F.min(q(roles.time)).alias("start"))
    late = starts.join(last, "id").filter(F.col("start") != freq.shift(F.col("last"), 1, kind)).limit(5).collect()
    if late:
        raise ValueError("new rows do not start right after the last time of: " + ", ".join(str(r["id"]) for r in late))
    bad = broken_grids(new, roles, freq).limit(5).collect()
    if bad:
        raise ValueError("new rows have gaps or repeated times in: " + ", ".join(str(r["id"]) for r in bad))


def equal_ends(df: DataFrame, roles: Roles) -> bool:
    """Pooled features need series that end at the same time."""
    return df.groupBy(q(roles.id)).agg(F.max(q(roles.time)).alias("e")).select("e").distinct().limit(2).count() < 2


def last_rows(df: DataFrame, roles: Roles, n: int) -> DataFrame:
    """The last n rows of each series."""
    back = F.row_number().over(Window.partitionBy(q(roles.id)).orderBy(q(roles.time).desc()))
    return df.withColumn("__back", back).filter(F.col("__back") <= n).drop("__back")
