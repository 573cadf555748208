"""Frequencies: what one step of a panel's time axis is."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset aliases, as (unit, units in a step, end of its period).
ALIASES = {
    "s": ("SECOND", 1, ""), "S": ("SECOND", 1, ""), "min": ("MINUTE", 1, ""), "T": ("MINUTE", 1, ""), "h": ("HOUR", 1, ""), "H": ("HOUR", 1, ""),
    "D": ("DAY", 1, ""), "W": ("DAY", 7, ""), "MS": ("MONTH", 1, ""), "M": ("MONTH", 1, "month"), "ME": ("MONTH", 1, "month"),
    "QS": ("MONTH", 3, ""), "Q": ("MONTH", 3, "month"), "QE": ("MONTH", 3, "month"), "YS": ("MONTH", 12, ""), "AS": ("MONTH", 12, ""),
    "Y": ("MONTH", 12, "month"), "A": ("MONTH", 12, "month"), "YE": ("MONTH", 12, "month"),
}


@dataclass(frozen=True)
class Freq:
    """An integer step, or a calendar step; period ends stay period ends whatever the months' lengths."""

    unit: str
    step: int
    end_of: str = ""

    @classmethod
    def of(cls, freq: int | str | Freq) -> Freq:
        if isinstance(freq, Freq):
            return freq
        if isinstance(freq, int):
            return cls("", freq)
        found = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-[A-Z]+)?", freq)
        if not found or found[2] not in ALIASES:
            raise ValueError(f"unknown frequency {freq!r}")
        unit, step, end = ALIASES[found[2]]
        return cls(unit, step * int(found[1] or 1), end)

    @property
    def is_integer(self) -> bool:
        return not self.unit

    def check(self, data_type: str) -> None:
        whole = data_type in ("bigint", "int", "smallint", "tinyint")
        if whole != self.is_integer:
            raise ValueError(f"a time column of type {data_type} needs {'an integer' if whole else 'a calendar'} frequency")

    def shift(self, time: Column, steps: Column | int, data_type: str) -> Column:
        """time + steps, reckoned from time itself and not by repeated addition."""
        n = F.lit(steps) if isinstance(steps, int) else steps
        if self.is_integer:
            return (time + n * self.step).cast(data_type)
        moved = F.timestamp_add(self.unit, (n * self.step).cast("int"), time)
        if self.end_of:
            clock = moved.cast("timestamp_ntz") - F.date_trunc("day", moved).cast("timestamp_ntz")
            moved = F.last_day(moved).cast("timestamp_ntz") + clock if data_type != "date" else F.last_day(moved)
        return moved.cast(data_type)
