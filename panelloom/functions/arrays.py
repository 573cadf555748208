"""Statistics of arrays, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile_of(values: Column, p: float) -> Column:
    """Linear interpolation between the sorted values that are not null; null for an empty array."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = (F.size(v) - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
    return F.when(F.size(v) > 0, a + (b - a) * (at - low))
