"""Relative time: one parameter object for units, hours, minutes, periods and ticks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeScale:
    """``hours`` and ``period`` are per time unit; ``tick`` is the clock resolution in units."""

    hours: float
    period: float
    tick: float = 1.0

    @property
    def minutes(self) -> float:
        return self.hours * 60.0

    @property
    def seconds(self) -> float:
        return self.hours * 3600.0

    def to_ticks(self, t: Column) -> Column:
        return F.round(t / F.lit(self.tick)).cast("long")

    def to_hours(self, t: Column) -> Column:
        return t * F.lit(self.hours)

    def to_minutes(self, t: Column) -> Column:
        return t * F.lit(self.minutes)

    def to_seconds(self, t: Column) -> Column:
        return t * F.lit(self.seconds)

    def bucket(self, t: Column) -> Column:
        """Period number of a point in time."""
        return F.floor(t / F.lit(self.period)).cast("int")

    def to_timestamp(self, t: Column, base_micros: int = 0) -> Column:
        """Absolute time of a relative one, counted from ``base_micros`` after the epoch."""
        return F.timestamp_micros((F.lit(base_micros) + F.round(t * F.lit(self.seconds * 1e6))).cast("long"))


# 16.75 units are one week of 168 hours, the clock ticks every 0.01 unit.
LINE_SCALE = TimeScale(hours=168.0 / 16.75, period=16.75, tick=0.01)
# Day-based tables: a unit is a day and a period is a week.
DAY_SCALE = TimeScale(hours=24.0, period=7.0)
# Event tables: a unit is an hour and a period is a day.
HOUR_SCALE = TimeScale(hours=1.0, period=24.0)
