"""One table as callers see it: queries over both tiers, derived views, writes and archival."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone
from functools import cached_property
from typing import TYPE_CHECKING, Protocol
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metrics
from .checkpoints import checkpoint, empty
from .errors import AlreadyArchived, BoundaryMoved, ConfigError, InvariantViolated, ScopeError, WriteRefused
from .functions import call, register
from .functions.library import ZONE
from .operators import writes
from .operators.completeness import completeness
from .operators.evolution import Change
from .plans.guard import require_read_only
from .plans.predicate import scanned_range
from .plans.resolve import may_skip_resolution, resolution_sql, resolve
from .plans.timerange import EPOCH, TICK, ReadMode, TimeRange, split
from .schema import TableConfig
from .sources.tiers import Snapshot, Tiers

if TYPE_CHECKING:
    from .operators.erasure import SubjectMap

ROUNDS = 5
REPORT = "meter_completeness"
CALL = re.compile(rf"\b{REPORT}\s*\(([^()]*)\)", re.I)


@dataclass(frozen=True)
class QueryResult:
    """A result with where it came from."""

    df: DataFrame
    watermark: datetime | None
    tiers: tuple[str, ...]
    mode: ReadMode
    resolved: bool

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def batches(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def to_json(self) -> DataFrame:
        """Rows as JSON text; decimals are strings, so that no reader rounds them."""
        text = [F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`") for f in self.df.schema]
        return self.df.select(F.to_json(F.struct(*text)).alias("json"))


@dataclass(frozen=True)
class Description:
    """What a statement would return, and from where; nothing has run."""

    schema: T.StructType
    watermark: datetime | None
    tiers: tuple[str, ...]
    mode: ReadMode


class SqlSurface(Protocol):
    """What answers read-only SQL: a store or a catalog."""

    def sql(self, statement: str, args: dict | list | None = None) -> QueryResult: ...

    def describe(self, statement: str, args: dict | list | None = None) -> Description: ...

    def stream(self, statement: str, args: dict | list | None = None) -> tuple[Description, Iterator[Row]]: ...


class Surface:
    """Describing and streaming, for whatever can run a statement."""

    def describe(self, statement: str, args: dict | list | None = None) -> Description:
        found = self.sql(statement, args)
        return Description(found.schema, found.watermark, found.tiers, found.mode)

    def stream(self, statement: str, args: dict | list | None = None) -> tuple[Description, Iterator[Row]]:
        """What will come, and then the rows, partition by partition."""
        found = self.sql(statement, args)
        return Description(found.schema, found.watermark, found.tiers, found.mode), found.batches()


def query_session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that views of one caller are not those of another."""
    session = spark.newSession()
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.runSQLOnFiles": "false"}.items():
        session.conf.set(key, value)
    register(session)
    return session


def midnight(value: date | datetime) -> datetime:
    """An instant; a bare date is midnight in the market's zone."""
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    return datetime(value.year, value.month, value.day, tzinfo=ZoneInfo(ZONE)).astimezone(timezone.utc)


def expand_reports(session: SparkSession, statement: str, stores: dict[str, Store]) -> tuple[str, set[str]]:
    """Calls of the report's table function, each replaced by a view that holds its rows.

    The arguments are ``(from, to)``, before them the instant since which
    channels are expected, and before that a table's name; they are constants
    that the session evaluates.
    """
    views: set[str] = set()

    def one(found: re.Match) -> str:
        values = list(session.sql(f"SELECT {found[1]}").first()) if found[1].strip() else []
        named = values.pop(0) if values and isinstance(values[0], str) else None
        if named is None and len(stores) > 1:
            raise ConfigError(f"{REPORT} needs a table's name where there are several")
        store = stores.get(named.lower()) if named else next(iter(stores.values()))
        if store is None:
            raise ScopeError(f"no such table here: {named}")
        if len(values) not in (2, 3) or not all(isinstance(v, date) for v in values):
            raise ConfigError(f"{REPORT} takes [table,] [since,] from, to")
        *since, start, end = map(midnight, values)
        view = f"{REPORT}_{len(views) + 1}"
        store.completeness(start, end, *since, session=session).createOrReplaceTempView(view)
        views.add(view)
        return view

    return CALL.sub(one, statement), views


@dataclass(frozen=True)
class Store(Surface):
    """A table, or a narrowed view of it; views only ever narrow."""

    spark: SparkSession
    config: TableConfig
    location: str
    mode: ReadMode = ReadMode.UNIFIED
    snapshot: Snapshot | None = None
    max_version: int | None = None
    known_at: datetime | None = None
    scope: tuple[tuple[str, str], ...] = ()
    subjects: SubjectMap | None = None

    @cached_property
    def tiers(self) -> Tiers:
        return Tiers(self.spark, self.location, self.config)

    @cached_property
    def session(self) -> SparkSession:
        return query_session(self.spark)

    # Views

    def in_read_mode(self, mode: ReadMode) -> Store:
        if self.snapshot:
            raise ConfigError("a pinned snapshot has no read mode")
        return replace(self, mode=mode)

    def as_of(self, snapshot: int | datetime, max_version: int | None = None, now: datetime | None = None) -> Store:
        """Only the cold tier as of a snapshot, which is pinned now; with a ceiling on versions."""
        kept = self.tiers.kept(now or datetime.now(timezone.utc))
        found = next((s for s in kept if s.id == snapshot), None) if isinstance(snapshot, int) else self.tiers.at(snapshot)
        if found is None or found not in kept:
            raise ConfigError(f"no snapshot {snapshot}")
        return replace(self, mode=ReadMode.HISTORICAL, snapshot=found, max_version=max_version)

    def as_known_at(self, at: datetime) -> Store:
        """What was recorded by then, in both tiers and in the raw relation too."""
        return replace(self, known_at=min(at, self.known_at or at))

    def scoped(self, column: str, value: str) -> Store:
        """Only rows with this value; only columns of the key, since others could change which version wins."""
        if column not in self.config.key or column == "from":
            raise ScopeError(f"{column} is not a key column to confine to")
        if any(c == column and v != value for c, v in self.scope):
            raise ScopeError(f"already confined to another {column}")
        return replace(self, scope=tuple(sorted({*self.scope, (column, value)})))

    # Reading

    def frames(self, range_: TimeRange, log: Sequence[Snapshot] | None = None, session: SparkSession | None = None) -> tuple[DataFrame, DataFrame, tuple[str, ...], bool]:
        """Every version and the ones in force, the tiers read, and whether resolution ran.

        ``log`` are the commits that the statement is over; its last one has
        the boundary.
        """
        spark = session or self.spark
        log = list(log or self.log())
        parts = split(range_, log[-1].boundary).narrowed(self.mode)
        found, files = [], []
        if parts.cold:
            files = self.tiers.parts(log, "cold", parts.cold)
            cold = self.tiers.read(spark, files, "cold", parts.cold)
            found.append(("cold", cold if self.max_version is None else cold.filter(F.col("version") <= F.lit(self.max_version).cast("decimal(20,0)"))))
        if parts.hot:
            found.append(("hot", self.tiers.read(spark, self.tiers.parts(log, "hot", parts.hot), "hot", parts.hot)))
        raw = empty(spark, self.config.schema)
        for i, (_, part) in enumerate(found):
            raw = part if i == 0 else raw.unionByName(part)
        for column, value in self.scope:
            raw = raw.filter(F.col(f"`{column}`") == value)
        if self.known_at:
            raw = raw.filter(F.col("recorded_at") <= F.lit(self.known_at))
        skip = not parts.hot and self.known_at is None and self.max_version is None and may_skip_resolution([f.stats for f in files])
        return raw, raw if skip else resolve(raw, self.config.key), tuple(t for t, _ in found), not skip

    def log(self) -> list[Snapshot]:
        return self.tiers.snapshots(self.snapshot)

    def raw(self, range_: TimeRange | None = None) -> DataFrame:
        return self.frames(range_ or TimeRange())[0]

    def resolved(self, range_: TimeRange | None = None) -> DataFrame:
        return self.frames(range_ or TimeRange())[1]

    @property
    def relations(self) -> set[str]:
        return {self.config.name, self.config.raw, "system_tables", "system_config", "system_resolution", "system_snapshots", "system_columns"}

    def show(self, session: SparkSession, range_: TimeRange, log: Sequence[Snapshot]) -> tuple[tuple[str, ...], bool]:
        """Make the relations known to a session; returns the tiers they read, and whether resolution runs."""
        raw, resolved, tiers, ran = self.frames(range_, log, session)
        raw.createOrReplaceTempView(self.config.raw)
        resolved.createOrReplaceTempView(self.config.name)
        return tiers, ran

    def sql(self, statement: str, args: dict | list | None = None) -> QueryResult:
        """Run a query over the table's relations, with one boundary for the whole statement.

        It is planned once over both tiers; the filters that reach the scans
        say which range it needs, and it is planned over that.
        """
        metrics.count("queries", table=self.config.name)
        statement, views = expand_reports(self.session, statement, {self.config.name: self})
        named = require_read_only(self.spark, statement, self.relations | views)
        log = self.log()
        if any(n.startswith("system_") for n in named):
            self.refresh_system_tables()
        tiers, ran = self.show(self.session, TimeRange(), log)
        df = self.session.sql(statement, args=args)
        if named & {self.config.name, self.config.raw}:
            tiers, ran = self.show(self.session, scanned_range(df, self.tiers.files.root), log)
            df = self.session.sql(statement, args=args)
        return QueryResult(df, log[-1].boundary, tiers, self.mode, ran)

    def completeness(self, start: datetime, end: datetime, seen_since: datetime | None = None, *, session: SparkSession | None = None, **equal: str) -> DataFrame:
        """The gap report in a fixed order; with ``seen_since`` also channels that reported before and are silent now.

        ``equal`` narrows it to values of columns: ``malo_id``, ``melo_id``,
        ``obis_code`` or declared ones.
        """
        names = ["malo_id", "obis_code", *self.config.discriminators, "sparte", "resolution"]
        log, slack = self.log(), timedelta(days=1)

        def rows(range_: TimeRange) -> DataFrame:
            found = self.frames(range_, log, session)[1]
            for column, value in equal.items():
                found = found.filter(F.col(f"`{column}`") == value)
            return found

        roster = rows(TimeRange(seen_since, start + slack)).filter(F.col("from") < F.lit(start)).select(*names).distinct() if seen_since else None
        report = completeness(rows(TimeRange(start, end)), start, end, discriminators=self.config.discriminators, roster=roster)
        return report.orderBy(*(f"`{n}`" for n in names if n != "sparte"))

    def latest(self, malo_id: str, obis_code: str) -> Row | None:
        """The newest reading of a channel: the recent tier first, both if it has none."""
        for store in (self.in_read_mode(ReadMode.OPERATIONAL), self) if self.mode is ReadMode.UNIFIED else (self,):
            rows = store.resolved().filter((F.col("malo_id") == malo_id) & (F.col("obis_code") == obis_code)).orderBy(F.desc("from")).limit(1).collect()
            if rows:
                return rows[0]
        return None

    def resolution_sql(self) -> str:
        return resolution_sql(self.config.raw, self.config.key, self.config.schema.names, self.known_at)

    # Writing

    def append(self, df: DataFrame) -> DataFrame:
        """Check, route at the boundary and store; returns what it displaced.

        Rows below the watermark go to the cold tier, the others to the recent
        one, in one commit.  Replays are stored once, in a delivery too; a
        restated or contradictory version, a second operator, an overlap with
        the delivery's or stored intervals, or a subject that nobody is behind
        refuses the whole delivery.  Only windows that it touches are read.
        However few partitions the delivery comes in, its rows are spread by
        reading before they are checked.
        """
        rows = writes.encode(df.repartition(*(f"`{k}`" for k in self.config.key)), self.config)
        for column, value in self.scope:
            if rows.filter(~F.col(f"`{column}`").eqNullSafe(value)).limit(1).count():
                raise ScopeError(f"rows outside {column} = {value}")
        if self.subjects and self.config.subject_column:
            self.subjects.require_resolvable(rows, self.config.subject_column)
        with metrics.timed("append", table=self.config.name):
            rows = checkpoint(rows)
            low, high = rows.agg(F.unix_micros(F.min("from")), F.unix_micros(F.max("from"))).first()
            if low is None:
                return writes.displacements(rows, rows, self.config)
            if writes.contradictory(rows, self.config).limit(1).count():
                raise WriteRefused("the delivery gives one version two values")
            touched = TimeRange(self.tiers.window(EPOCH + timedelta(microseconds=low)), self.tiers.window(EPOCH + timedelta(microseconds=high)) + self.config.step)
            for _ in range(ROUNDS):
                try:
                    return self._append(rows, touched)
                except BoundaryMoved:
                    metrics.count("append_retries", table=self.config.name)
        raise BoundaryMoved(f"other writers were first {ROUNDS} times during an append")

    def _append(self, rows: DataFrame, touched: TimeRange) -> DataFrame:
        log = self.tiers.snapshots()
        base, plain = log[-1], replace(self, mode=ReadMode.UNIFIED, snapshot=None, known_at=None, max_version=None, scope=())
        existing = plain.frames(touched, log)[0]
        new = checkpoint(writes.new_rows(existing, rows, self.config))
        checks = {
            "a stored version would change": lambda: writes.restated(existing, rows, self.config),
            "a second network operator claims a reading": lambda: writes.second_operators(existing, rows, self.config),
            "intervals overlap": lambda: writes.overlaps(new, self.config, existing) if not self.config.point else None,
        }
        for name, check in checks.items():
            if (broken := check()) is not None and broken.limit(1).count():
                raise WriteRefused(name)
        report = checkpoint(writes.displacements(existing, rows, self.config))
        below = F.col("from") < F.lit(base.boundary)
        cold, hot = self.tiers.write(new.filter(below), "cold"), self.tiers.write(new.filter(~below), "hot")
        if cold or hot:
            self.tiers.commit(base, base.boundary, "append", cold, hot)
        for tier, part in (("cold", cold), ("hot", hot)):
            metrics.count("rows_appended", part.rows if part else 0, table=self.config.name, tier=tier)
        return report

    def append_hot(self, df: DataFrame) -> DataFrame:
        """Append to the recent tier only; refuses rows that are archived already."""
        if df.filter(F.col("from") < F.lit(self.tiers.latest().boundary)).limit(1).count():
            raise AlreadyArchived("rows below the watermark belong to the cold tier")
        return self.append(df)

    def append_authoritative(self, df: DataFrame) -> DataFrame:
        """Append with versions above those in force, so that the rows take effect."""
        key = [*self.config.key, "version_scope"]
        low, high = df.agg(F.unix_micros(F.min("from")), F.unix_micros(F.max("from"))).first()
        if low is None:
            return self.append(df)
        stored = self.raw(TimeRange(EPOCH + timedelta(microseconds=low), EPOCH + timedelta(microseconds=high) + TICK))
        top = stored.join(df.select(*(f"`{k}`" for k in key)).distinct(), key, "left_semi").groupBy(*(f"`{k}`" for k in key)).agg(F.max("version").alias("__top"))
        raised = df.join(top, key, "left").withColumn("version", F.greatest(F.col("version"), F.coalesce(F.col("__top") + 1, F.col("version"))).cast("decimal(20,0)")).drop("__top")
        return self.append(raised.select(df.columns))

    # Archival

    def verify_invariant(self) -> None:
        """No recent row was committed below the watermark of its time."""
        found = sum(s.hot.rows for s in self.tiers.snapshots() if s.hot and s.hot.bounds[0] < s.boundary)
        if found:
            raise InvariantViolated(f"rows below the watermark in commits of {found} recent rows")

    def next_window(self, now: datetime, log: Sequence[Snapshot]) -> TimeRange | None:
        """The next window with rows that is closed, or none: windows without rows are passed over."""
        boundary = log[-1].boundary
        low = self.tiers.read(self.spark, self.tiers.parts(list(log), "hot", TimeRange(boundary, None)), "hot", TimeRange(boundary, None)).agg(F.unix_micros(F.min("from"))).first()[0]
        if low is None:
            return None
        start = self.tiers.window(EPOCH + timedelta(microseconds=low))
        return TimeRange(start, start + self.config.step) if start + self.config.step <= now - self.config.settlement_lag else None

    def archive_step(self, now: datetime) -> bool:
        """Move the next closed window to the cold tier and the watermark with it, in one commit.

        An append that comes between fails that commit, and the step is taken anew.
        """
        with metrics.timed("archive", table=self.config.name):
            for _ in range(ROUNDS):
                log = self.tiers.snapshots()
                if (window := self.next_window(now, log)) is None:
                    return False
                part = self.tiers.write(self.tiers.read(self.spark, self.tiers.parts(log, "hot", window), "hot", window), "cold")
                try:
                    self.tiers.commit(log[-1], window.end, "archive", cold=part)
                except BoundaryMoved:
                    continue
                metrics.count("rows_archived", part.rows if part else 0, table=self.config.name)
                return True
        raise BoundaryMoved(f"other writers were first {ROUNDS} times during an archival step")

    def catch_up(self, now: datetime, windows: int = 1000) -> int:
        return next((n for n in range(windows) if not self.archive_step(now)), windows)

    def reclaim(self, now: datetime) -> int:
        """Delete archived windows once readers that began before have had time to end; never one that was not archived."""
        self.verify_invariant()
        log = [s for s in self.tiers.snapshots() if datetime.fromisoformat(s.committed_at) + self.config.reader_grace <= now]
        return self.tiers.drop_windows(log)

    def reassert_watermark(self) -> Snapshot:
        base = self.tiers.latest()
        return self.tiers.commit(base, base.boundary, "reassert")

    def check_schema(self) -> list[Change]:
        """How the configured schema differed from the stored one when this table was opened."""
        return self.tiers.changes

    def refresh_system_tables(self, now: datetime | None = None) -> None:
        """Views on the table's state: tables, configuration, columns, resolution text and snapshots."""
        snapshots = self.tiers.snapshots()
        now = now or datetime.now(timezone.utc)
        mark = snapshots[-1].boundary
        windows = [w for w in self.tiers.windows(snapshots) if w >= mark]
        late = sum(s.hot.rows for s in snapshots if s.hot and s.hot.bounds[0] < s.boundary)
        session, c = self.session, self.config
        lag = (now - mark).total_seconds() if mark > EPOCH else None
        session.createDataFrame([(c.name, mark, lag, len(windows), sum(w >= now for w in windows), late, late == 0)], "table_name string, watermark timestamp, lag_seconds double, partitions int, partitions_ahead int, invariant_violations long, healthy boolean").createOrReplaceTempView("system_tables")
        session.createDataFrame([(c.name, k, str(getattr(c, k))) for k in ("key", "point", "by_melo", "step", "settlement_lag", "snapshot_retention", "keep_snapshots")], "table_name string, setting string, value string").createOrReplaceTempView("system_config")
        session.createDataFrame([(r, f.name, f.dataType.simpleString(), f.nullable) for r in (c.name, c.raw) for f in c.schema], "table_name string, column_name string, data_type string, is_nullable boolean").createOrReplaceTempView("system_columns")
        session.createDataFrame([(c.name, self.resolution_sql())], "table_name string, resolution_sql string").createOrReplaceTempView("system_resolution")
        rows, held = [], 0
        for s in snapshots:
            held += s.cold.rows if s.cold else 0
            rows.append((c.name, s.id, datetime.fromisoformat(s.committed_at), s.boundary, s.operation, held))
        session.createDataFrame(rows, "table_name string, snapshot_id long, committed_at timestamp, watermark timestamp, operation string, cold_rows long").createOrReplaceTempView("system_snapshots")


def billable(df: DataFrame) -> DataFrame:
    return df.filter(call("quality_is_billable", "quality"))
