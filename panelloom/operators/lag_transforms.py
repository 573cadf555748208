"""Lag transforms: windows over the target that end some steps back.

A transform is a description; plans.features turns all transforms of one scope into one plan. Scopes: a series' own rows (default), all
series (global_), series that share static values (groupby), and rows that share dynamic values (partition_by), alone or
within either.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

AGGREGATES = ("sum", "count", "mean", "min", "max")


def _columns(value) -> tuple[str, ...] | None:
    if value is None:
        return None
    value = (value,) if isinstance(value, str) else tuple(dict.fromkeys(value))
    return value or None


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


@dataclass(frozen=True)
class Scope:
    global_: bool = False
    groupby: tuple[str, ...] | None = None
    partition_by: tuple[str, ...] | None = None

    @property
    def is_local(self) -> bool:
        return not (self.global_ or self.groupby or self.partition_by)

    @property
    def pools_series(self) -> bool:
        return bool(self.global_ or self.groupby)

    def prefix(self) -> str:
        own = "global_" if self.global_ else f"groupby_{'__'.join(self.groupby)}_" if self.groupby else ""
        return own + (f"partby_{'__'.join(self.partition_by)}_" if self.partition_by else "")


@dataclass(frozen=True)
class LagTransform:
    """Base of all. kind: which rows a window takes; stat: what it makes of them.

    A transform of one's own is a frozen dataclass of kind "column" with column(y, lag, by_id): an expression over the window of a
    series, ordered by time; samples tells how many rows it needs.
    """

    kind = ""
    stat = ""
    finite = True  # whether a bounded number of rows is enough

    @property
    def scope(self) -> Scope:
        return Scope(getattr(self, "global_", False), getattr(self, "groupby", None), getattr(self, "partition_by", None))

    def name(self, lag: int) -> str:
        changed = []
        for f in fields(self):
            if f.name in ("global_", "groupby", "partition_by"):
                continue
            value = getattr(self, f.name)
            if value != f.default:
                changed.append(f"{f.name}{value}")
        return f"{self.scope.prefix()}{_snake(type(self).__name__)}_lag{lag}" + "".join(f"_{c}" for c in changed)

    def samples(self, lag: int) -> int:
        """Rows of history that the next step needs; -1 for all."""
        return lag

    def parts(self, lag: int) -> list[tuple[LagTransform, int]]:
        return [(self, lag)]


@dataclass(frozen=True)
class Lag(LagTransform):
    kind = "lag"

    def name(self, lag: int) -> str:
        return f"lag{lag}"


@dataclass(frozen=True)
class LookupLag(LagTransform):
    """The value some occurrences back among the series' rows with the same partition values, whatever lies between."""

    partition_by: tuple[str, ...] | None = None
    kind = "lookup"
    finite = False

    def __post_init__(self):
        object.__setattr__(self, "partition_by", _columns(self.partition_by))
        if self.partition_by is None:
            raise ValueError("LookupLag needs partition_by: the columns that define its buckets")

    def name(self, lag: int) -> str:
        return f"{self.scope.prefix()}lookup_lag{lag}"

    def samples(self, lag: int) -> int:
        return -1


@dataclass(frozen=True)
class _Pooled(LagTransform):
    def _check(self):
        object.__setattr__(self, "groupby", _columns(self.groupby))
        object.__setattr__(self, "partition_by", _columns(self.partition_by))
        if self.global_ and self.groupby:
            raise ValueError("global_ and groupby exclude each other")
        if self.time_agg is not None and self.time_agg not in AGGREGATES:
            raise ValueError(f"time_agg must be one of {', '.join(AGGREGATES)}")
        if self.time_agg is not None and not (self.global_ or self.groupby) and self.time_agg != getattr(type(self), "time_agg", None):
            raise ValueError("time_agg needs global_ or groupby")


@dataclass(frozen=True)
class _Rolling(_Pooled):
    window_size: int
    min_samples: int | None = None
    global_: bool = False
    groupby: tuple[str, ...] | None = None
    partition_by: tuple[str, ...] | None = None
    time_agg: str | None = None
    kind = "rolling"

    def __post_init__(self):
        self._check()
        if self.window_size < 1:
            raise ValueError("window_size must be positive")

    @property
    def least(self) -> int:
        if self.min_samples is None:
            return 1 if self.scope.partition_by and not self.scope.pools_series else self.window_size
        return min(self.min_samples, self.window_size) if self.scope.is_local else self.min_samples

    def samples(self, lag: int) -> int:
        return lag - 1 + self.window_size


class RollingMean(_Rolling):
    stat = "mean"


class RollingStd(_Rolling):
    stat = "std"


class RollingMin(_Rolling):
    stat = "min"


class RollingMax(_Rolling):
    stat = "max"


@dataclass(frozen=True)
class RollingQuantile(_Rolling):
    p: float = field(kw_only=False, default=None)  # type: ignore[assignment]
    stat = "quantile"

    def __init__(self, p: float, window_size: int, min_samples: int | None = None, **pooled: Any):
        _assign(self, p=p, window_size=window_size, min_samples=min_samples, **pooled)

    def name(self, lag: int) -> str:
        return _quantile_name(self, lag)


@dataclass(frozen=True)
class _Seasonal(_Rolling):
    season_length: int = 1
    kind = "seasonal"

    def __init__(self, season_length: int, window_size: int, min_samples: int | None = None, **pooled: Any):
        _assign(self, season_length=season_length, window_size=window_size, min_samples=min_samples, **pooled)

    def name(self, lag: int) -> str:
        return _ordered_name(self, lag, ("season_length", "window_size", "min_samples", "time_agg"))

    def samples(self, lag: int) -> int:
        return lag - 1 + self.season_length * self.window_size


class SeasonalRollingMean(_Seasonal):
    stat = "mean"


class SeasonalRollingStd(_Seasonal):
    stat = "std"


class SeasonalRollingMin(_Seasonal):
    stat = "min"


class SeasonalRollingMax(_Seasonal):
    stat = "max"


@dataclass(frozen=True)
class SeasonalRollingQuantile(_Seasonal):
    p: float = 0.5
    stat = "quantile"

    def __init__(self, p: float, season_length: int, window_size: int, min_samples: int | None = None, **pooled: Any):
        _assign(self, p=p, season_length=season_length, window_size=window_size, min_samples=min_samples, **pooled)

    def name(self, lag: int) -> str:
        return _ordered_name(self, lag, ("p", "season_length", "window_size", "min_samples", "time_agg"))


@dataclass(frozen=True)
class _Expanding(_Pooled):
    global_: bool = False
    groupby: tuple[str, ...] | None = None
    partition_by: tuple[str, ...] | None = None
    time_agg: str | None = None
    kind = "expanding"
    finite = False
    least = 1

    def __post_init__(self):
        self._check()

    def samples(self, lag: int) -> int:
        return -1


class ExpandingMean(_Expanding):
    stat = "mean"


class ExpandingStd(_Expanding):
    stat = "std"


class ExpandingMin(_Expanding):
    stat = "min"


class ExpandingMax(_Expanding):
    stat = "max"


@dataclass(frozen=True)
class ExpandingQuantile(_Expanding):
    p: float = 0.5
    stat = "quantile"

    def __init__(self, p: float, **pooled: Any):
        _assign(self, p=p, **pooled)

    def name(self, lag: int) -> str:
        return _ordered_name(self, lag, ("p", "time_agg"))


@dataclass(frozen=True)
class ExponentiallyWeightedMean(_Pooled):
    """e = alpha * x + (1 - alpha) * e over the observed steps; steps without a value neither count nor decay."""

    alpha: float
    global_: bool = False
    groupby: tuple[str, ...] | None = None
    partition_by: tuple[str, ...] | None = None
    time_agg: str | None = "mean"
    kind = "ewm"
    stat = "ewm"
    finite = False

    def __post_init__(self):
        self._check()
        if self.time_agg is None:
            raise ValueError("an exponentially weighted mean takes one value for each time: time_agg can't be None")

    def samples(self, lag: int) -> int:
        return -1


@dataclass(frozen=True)
class Offset(LagTransform):
    """The transform n steps further back (or nearer, for negative n)."""

    tfm: LagTransform
    n: int

    @property
    def scope(self) -> Scope:
        return self.tfm.scope

    def _lag(self, lag: int) -> int:
        if lag + self.n < 1:
            raise ValueError("an offset can't reach the present")
        return lag + self.n

    def name(self, lag: int) -> str:
        return self.tfm.name(self._lag(lag))

    def samples(self, lag: int) -> int:
        return self.tfm.samples(self._lag(lag))

    def parts(self, lag: int):
        return self.tfm.parts(self._lag(lag))


@dataclass(frozen=True)
class Combine(LagTransform):
    """operator(tfm1, tfm2), of two transforms of one scope. Division by zero gives null."""

    tfm1: LagTransform
    tfm2: LagTransform
    operator: Callable

    def __post_init__(self):
        if self.tfm1.scope != self.tfm2.scope:
            raise ValueError("both transforms must have the same global_, groupby and partition_by")

    @property
    def scope(self) -> Scope:
        return self.tfm1.scope

    def name(self, lag: int) -> str:
        return f"{self.tfm1.name(lag)}_{self.operator.__name__}_{self.tfm2.name(lag)}"

    def samples(self, lag: int) -> int:
        own = (self.tfm1.samples(lag), self.tfm2.samples(lag))
        return -1 if min(own) < 0 else max(own)

    def parts(self, lag: int):
        return self.tfm1.parts(lag) + self.tfm2.parts(lag)


@dataclass(frozen=True)
class Custom(LagTransform):
    """fn(values shifted by lag, *args) over a series' values in order of time, as arrays: one pass of Python per series."""

    fn: Callable
    args: tuple = ()
    kind = "custom"
    finite = False

    def name(self, lag: int) -> str:
        import inspect

        known = list(inspect.signature(self.fn).parameters.values())[1:]
        changed = [f"{p.name}{v}" for p, v in zip(known, self.args, strict=False) if p.default != v]
        return f"{self.fn.__name__}_lag{lag}" + "".join(f"_{c}" for c in changed)

    def samples(self, lag: int) -> int:
        return -1


def _assign(own, **values):
    defaults = {"global_": False, "groupby": None, "partition_by": None, "time_agg": None}
    unknown = set(values) - {f.name for f in fields(own)}
    if unknown:
        raise TypeError(f"unknown arguments: {', '.join(sorted(unknown))}")
    for k, v in (defaults | values).items():
        object.__setattr__(own, k, v)
    own.__post_init__()


def _ordered_name(own, lag: int, order: tuple[str, ...]) -> str:
    changed = [f"{k}{v}" for k in order if (v := getattr(own, k)) is not None]
    return f"{own.scope.prefix()}{_snake(type(own).__name__)}_lag{lag}" + "".join(f"_{c}" for c in changed)


def _quantile_name(own, lag: int) -> str:
    return _ordered_name(own, lag, ("p", "window_size", "min_samples", "time_agg"))


def as_transform(value) -> LagTransform:
    """A transform, a function, or a tuple of a function and its arguments."""
    if isinstance(value, LagTransform):
        return value
    if callable(value):
        return Custom(value)
    return Custom(value[0], tuple(value[1:]))


def keep_last(features: dict[str, tuple[LagTransform, int]]) -> int | None:
    """Rows of history that all features need for the next step; None where one needs all."""
    needs = [t.samples(lag) for t, lag in features.values()]
    return None if not needs or min(needs) < 0 else max(needs)
