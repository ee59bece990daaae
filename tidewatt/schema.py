"""The readings schema, its keys, and validated table configurations."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import types as T

from .errors import ConfigError

VALUE, VERSION = T.DecimalType(18, 6), T.DecimalType(20, 0)
CORE_KEY = ("malo_id", "obis_code", "from")
READINGS = T.StructType(
    [
        T.StructField("malo_id", T.StringType(), False),
        T.StructField("melo_id", T.StringType()),
        T.StructField("obis_code", T.StringType(), False),
        T.StructField("sparte", T.StringType(), False),
        T.StructField("from", T.TimestampType(), False),
        T.StructField("to", T.TimestampType()),
        T.StructField("value", VALUE, False),
        T.StructField("unit", T.StringType(), False),
        T.StructField("quality", T.StringType(), False),
        T.StructField("resolution", T.StringType()),
        T.StructField("source_kind", T.StringType(), False),
        T.StructField("source_detail", T.StringType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("version", VERSION, False),
        T.StructField("version_scope", T.StringType(), False),
        T.StructField("recorded_at", T.TimestampType(), False),
        T.StructField("balancing_day", T.DateType(), False),
    ]
)
#: Units in which a commodity is measured or billed.
UNITS = {"STROM": ("KWH",), "GAS": ("KWH", "M3"), "WAERME": ("KWH",), "WASSER": ("M3",)}
#: Identifiers that a declared column can be checked for.
CHECKED = re.compile(r"(MALO|MELO|BDEW|EIC(:[XYZWTVA])?)\Z")
IDENTIFIER = re.compile(r"[a-z_][a-z0-9_]{0,62}\Z")


@dataclass(frozen=True)
class Extra:
    """A declared text column; an identity column joins the key and is never null.

    ``codes`` lists what it may hold; ``check`` names the identifier that it
    must be: MALO, MELO, BDEW, EIC, or EIC and a type as in ``EIC:X``.
    """

    name: str
    nullable: bool = True
    identity: bool = False
    codes: tuple[str, ...] = ()
    check: str | None = None


@dataclass(frozen=True)
class TableConfig:
    """One table: ``point`` tables hold register readings at an instant, others intervals."""

    name: str = "readings"
    extras: tuple[Extra, ...] = ()
    point: bool = False
    identify_by_melo: bool | None = None
    subject_column: str | None = None
    step: timedelta = timedelta(days=1)
    settlement_lag: timedelta = timedelta(days=7)
    headroom: timedelta = timedelta(days=14)
    reader_grace: timedelta = timedelta(hours=1)
    snapshot_retention: timedelta = timedelta(days=3653)
    keep_snapshots: int = 20

    def __post_init__(self) -> None:
        names = [f.name for f in READINGS]
        problems = []
        if not IDENTIFIER.match(self.name) or len(self.name) > 48:
            problems.append(f"table name {self.name!r} is not a short lower-case identifier")
        for extra in self.extras:
            if not IDENTIFIER.match(extra.name):
                problems.append(f"column name {extra.name!r} is not a lower-case identifier")
            if extra.name in names:
                problems.append(f"column {extra.name} is there already")
            if extra.check is not None and not CHECKED.match(extra.check):
                problems.append(f"column {extra.name} has an unknown check {extra.check!r}")
            if extra.identity and extra.nullable:
                problems.append(f"identity column {extra.name} may not be null")
            names.append(extra.name)
        if self.subject_column and self.subject_column not in [e.name for e in self.extras]:
            problems.append(f"subject column {self.subject_column} is not declared")
        if self.subject_column in [e.name for e in self.extras if e.identity]:
            problems.append("the subject column may not be part of the key")
        if self.step <= timedelta(0) or self.step % timedelta(minutes=1):
            problems.append("the step must be whole minutes")
        if self.settlement_lag < self.step:
            problems.append("the settlement lag may not be less than a step")
        if self.keep_snapshots < 1:
            problems.append("at least one snapshot must be kept")
        if problems:
            raise ConfigError("; ".join(problems))

    @property
    def by_melo(self) -> bool:
        return self.point if self.identify_by_melo is None else self.identify_by_melo

    @property
    def key(self) -> tuple[str, ...]:
        """What names a reading: point, meter where it counts, channel, instant and identity columns."""
        melo = ("melo_id",) if self.by_melo else ()
        return ("malo_id", *melo, "obis_code", "from", *(e.name for e in self.extras if e.identity))

    @property
    def discriminators(self) -> tuple[str, ...]:
        return tuple(k for k in self.key if k not in CORE_KEY)

    @property
    def schema(self) -> T.StructType:
        fields = [T.StructField(f.name, f.dataType, f.nullable and not (f.name == "melo_id" and self.by_melo)) for f in READINGS]
        return T.StructType([*fields, *(T.StructField(e.name, T.StringType(), e.nullable, {"codes": list(e.codes)} if e.codes else {}) for e in self.extras)])

    @property
    def raw(self) -> str:
        """The relation that holds every version."""
        return f"{self.name}_versions"
