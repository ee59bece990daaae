"""Typed reads: a channel's readings in order, or a refusal where they do not make one series."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import ConfigError, InvariantViolated
from ..plans.timerange import ReadMode, TimeRange
from ..store import Store


@dataclass(frozen=True)
class Reading:
    start: datetime
    end: datetime | None
    value: Decimal
    quality: str


@dataclass(frozen=True)
class Source:
    """Where a delivery came from."""

    kind: str
    detail: str | None
    provenance: str | None
    recorded_at: datetime


@dataclass(frozen=True)
class Series:
    """One channel of one point: intervals, or instants of a register if ``end`` is missing.

    Meter, resolution, source and declared columns are those of the delivery
    that was recorded last; ``sources`` are all, in the order of recording.
    """

    malo_id: str
    melo_id: str | None
    obis_code: str
    sparte: str
    unit: str
    resolution: str | None
    readings: tuple[Reading, ...]
    sources: tuple[Source, ...]
    extras: tuple[tuple[str, str | None], ...]

    @property
    def source(self) -> Source:
        return self.sources[-1]

    @property
    def intervals(self) -> tuple[tuple[datetime, datetime | None], ...]:
        return tuple((r.start, r.end) for r in self.readings)

    @property
    def values(self) -> tuple[tuple[datetime, Decimal], ...]:
        return tuple((r.start, r.value) for r in self.readings)


def channel_order(column: str = "obis_code") -> list:
    """Channels by number, not by text: ``1-0:10.8.0`` comes after ``1-0:2.8.0``."""
    return [F.transform(F.split(column, "[-:.*]"), lambda part: part.cast("int"))]


@dataclass(frozen=True)
class SeriesQuery:
    """A read of one market location, narrowed step by step.

    A typed read ends in the caller's memory, so it fetches its rows once and
    checks them there.
    """

    store: Store
    malo_id: str
    within: TimeRange = TimeRange()
    equal: tuple[tuple[str, str], ...] = ()
    qualities: tuple[str, ...] = ()

    point = False

    def __post_init__(self) -> None:
        if self.store.config.point != self.point:
            raise ConfigError(f"{self.store.config.name} holds {'readings at an instant' if self.store.config.point else 'intervals'}")

    def obis(self, code: str) -> SeriesQuery:
        return replace(self, equal=(*self.equal, ("obis_code", code)))

    def melo(self, code: str) -> SeriesQuery:
        return replace(self, equal=(*self.equal, ("melo_id", code)))

    def column_eq(self, column: str, value: str) -> SeriesQuery:
        return replace(self, equal=(*self.equal, (column, value)))

    def quality_in(self, *flags: str) -> SeriesQuery:
        return replace(self, qualities=flags)

    def range(self, start: datetime | None, end: datetime | None) -> SeriesQuery:
        return replace(self, within=self.within & TimeRange(start, end))

    def since(self, start: datetime) -> SeriesQuery:
        return self.range(start, None)

    def until(self, end: datetime) -> SeriesQuery:
        return self.range(None, end)

    def _selected(self, store: Store) -> DataFrame:
        rows = store.resolved(self.within).filter(F.col("malo_id") == self.malo_id)
        for column, value in self.equal:
            rows = rows.filter(F.col(f"`{column}`") == value)
        return rows.filter(F.col("quality").isin(*self.qualities)) if self.qualities else rows

    def rows(self) -> DataFrame:
        """The readings in force, in key order."""
        return self._selected(self.store).orderBy(*(f"`{k}`" for k in self.store.config.key if k != "from"), "from")

    def channels(self) -> list[str]:
        rows = self._selected(self.store).select("obis_code").distinct()
        return [r.obis_code for r in rows.orderBy(*channel_order()).collect()]

    def _merged(self, rows: list[Row]) -> Series | None:
        """One series of rows in key order; two channels, identities, commodities or values at an instant are none."""
        if not rows:
            return None
        names = [*(k for k in self.store.config.key if k != "from"), "sparte", "unit"]
        if len({tuple(r[n] for n in names) for r in rows}) > 1:
            raise InvariantViolated("readings of several channels are not one series")
        if any(a["from"] == b["from"] for a, b in zip(rows, rows[1:], strict=False)):
            raise InvariantViolated("two values are in force at one instant")
        if any((r.to is None) != self.point for r in rows):
            raise InvariantViolated("intervals and readings at an instant are not one series")
        recorded = sorted(rows, key=lambda r: (r.recorded_at, r["from"]))
        last = recorded[-1]
        sources = dict.fromkeys(Source(r.source_kind, r.source_detail, r.provenance, r.recorded_at) for r in recorded)
        extras = tuple((e.name, last[e.name]) for e in self.store.config.extras)
        return Series(self.malo_id, last.melo_id, last.obis_code, last.sparte, last.unit, last.resolution, tuple(Reading(r["from"], r.to, r.value, r.quality) for r in rows), tuple(sources), extras)

    def collect(self) -> Series | None:
        """The one series that the read selects; None if it selects nothing."""
        return self._merged(self.rows().collect())

    def collect_with_sparte(self) -> tuple[Series, str] | None:
        found = self.collect()
        return (found, found.sparte) if found else None

    def collect_by_channel(self) -> dict[str, Series]:
        """A series for each channel, from one read, in the order of their numbers."""
        rows: dict[str, list[Row]] = {}
        for row in self.rows().collect():
            rows.setdefault(row.obis_code, []).append(row)
        number = lambda code: [int(x) for x in code.replace("*", ".").replace("-", ".").replace(":", ".").split(".")]
        return {code: self._merged(rows[code]) for code in sorted(rows, key=number)}

    def latest(self) -> Reading | None:
        """The newest reading, from the recent tier if that has one."""
        stores = (self.store.in_read_mode(ReadMode.OPERATIONAL), self.store) if self.store.mode is ReadMode.UNIFIED else (self.store,)
        for store in stores:
            rows = self._selected(store).orderBy(F.desc("from")).limit(1).collect()
            if rows:
                return Reading(rows[0]["from"], rows[0].to, rows[0].value, rows[0].quality)
        return None


@dataclass(frozen=True)
class ReadingsQuery(SeriesQuery):
    """The same over a table of register readings."""

    point = True

    def values(self) -> tuple[tuple[datetime, Decimal], ...]:
        found = self.collect()
        return found.values if found else ()

    def deliveries(self) -> dict[Source, tuple[Reading, ...]]:
        """The readings by the delivery that they came with, in the order of recording."""
        out: dict[Source, list[Reading]] = {}
        for r in sorted(self.rows().collect(), key=lambda r: (r.recorded_at, r["from"])):
            out.setdefault(Source(r.source_kind, r.source_detail, r.provenance, r.recorded_at), []).append(Reading(r["from"], r.to, r.value, r.quality))
        return {source: tuple(readings) for source, readings in out.items()}
