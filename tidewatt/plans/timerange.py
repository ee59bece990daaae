"""Half-open ranges of time and their split at the tier boundary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = timedelta(microseconds=1)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class TimeRange:
    """``[start, end)``; a missing bound is open."""

    start: datetime | None = None
    end: datetime | None = None

    @property
    def empty(self) -> bool:
        return self.start is not None and self.end is not None and self.start >= self.end

    def __and__(self, other: TimeRange) -> TimeRange:
        starts = [x for x in (self.start, other.start) if x is not None]
        ends = [x for x in (self.end, other.end) if x is not None]
        return TimeRange(max(starts, default=None), min(ends, default=None))

    def __or__(self, other: TimeRange) -> TimeRange:
        """The least range that holds both; a gap between them is held too."""
        if self.empty or other.empty:
            return other if self.empty else self
        start = None if None in (self.start, other.start) else min(self.start, other.start)
        end = None if None in (self.end, other.end) else max(self.end, other.end)
        return TimeRange(start, end)

    def __contains__(self, at: datetime) -> bool:
        return (self.start is None or at >= self.start) and (self.end is None or at < self.end)

    def filter(self, column: str = "from") -> Column:
        out = F.lit(True)
        if self.start is not None:
            out = out & (F.col(f"`{column}`") >= F.lit(self.start))
        if self.end is not None:
            out = out & (F.col(f"`{column}`") < F.lit(self.end))
        return out


def after(at: datetime) -> datetime:
    """The next instant that can be stored."""
    return at + TICK


class ReadMode(Enum):
    UNIFIED = "unified"
    HISTORICAL = "historical"
    OPERATIONAL = "operational"


@dataclass(frozen=True)
class TierSplit:
    """What each tier has to read; None where it has nothing to."""

    cold: TimeRange | None
    hot: TimeRange | None

    def narrowed(self, mode: ReadMode) -> TierSplit:
        return TierSplit(None if mode is ReadMode.OPERATIONAL else self.cold, None if mode is ReadMode.HISTORICAL else self.hot)


def split(range_: TimeRange, watermark: datetime) -> TierSplit:
    """Below the watermark is cold, the rest is hot; each instant is in exactly one tier."""
    if range_.empty:
        return TierSplit(None, None)
    cold, hot = range_ & TimeRange(None, watermark), range_ & TimeRange(watermark, None)
    return TierSplit(None if cold.empty or watermark <= EPOCH else cold, None if hot.empty else hot)
