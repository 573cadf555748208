"""Date features and their one-hot forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _start(unit: str) -> Callable[[Column], Column]:
    return lambda t: F.to_date(t) == F.trunc(F.to_date(t), unit)


def _end(unit: str) -> Callable[[Column], Column]:
    return lambda t: F.trunc(F.date_add(F.to_date(t), 1), unit) == F.date_add(F.to_date(t), 1)


#: By name; days of the week count from Monday as 0, weeks are ISO weeks.
DATE_FEATURES: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": lambda t: F.second(t),
    "dayofyear": F.dayofyear, "day_of_year": F.dayofyear, "week": F.weekofyear, "weekofyear": F.weekofyear, "quarter": F.quarter,
    "dayofweek": F.weekday, "day_of_week": F.weekday, "weekday": F.weekday,
    "daysinmonth": lambda t: F.dayofmonth(F.last_day(t)), "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    "is_month_start": _start("month"), "is_month_end": _end("month"), "is_quarter_start": _start("quarter"), "is_quarter_end": _end("quarter"),
    "is_year_start": _start("year"), "is_year_end": _end("year"),
}
#: First and last value of the features that have one-hot forms.
DUMMY_RANGES = {
    "dayofweek": (0, 6), "day_of_week": (0, 6), "weekday": (0, 6), "month": (1, 12), "quarter": (1, 4), "day": (1, 31), "hour": (0, 23),
    "minute": (0, 59), "second": (0, 59), "dayofyear": (1, 366), "day_of_year": (1, 366), "week": (1, 53), "weekofyear": (1, 53),
}

DateFeature = str | Callable[[Column], Column]


def feature_name(feature: DateFeature) -> str:
    if callable(feature):
        if feature.__name__ == "<lambda>":
            raise ValueError("a date feature needs a name: lambdas have none")
        return feature.__name__
    return feature


def date_feature(feature: DateFeature, time: Column) -> Column:
    if callable(feature):
        return feature(time)
    if feature not in DATE_FEATURES:
        raise ValueError(f"unknown date feature {feature!r}")
    return DATE_FEATURES[feature](time).cast("int")


def date_dummies(feature: str, time: Column) -> dict[str, Column]:
    """A 0/1 column for each value the feature can take."""
    if feature not in DUMMY_RANGES:
        raise ValueError(f"{feature!r} has no fixed set of values")
    low, high = DUMMY_RANGES[feature]
    value = date_feature(feature, time)
    return {f"{feature}_{v}": (value == v).cast("int") for v in range(low, high + 1)}
