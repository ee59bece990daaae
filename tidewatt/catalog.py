"""Several tables in one place, queried together with a boundary for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import SparkSession

from .errors import ConfigError, ScopeError, TidewattError
from .plans.guard import require_read_only
from .plans.predicate import scanned_range
from .plans.timerange import ReadMode, TimeRange
from .store import QueryResult, Store, Surface, expand_reports, query_session


@dataclass(frozen=True)
class Catalog(Surface):
    stores: tuple[Store, ...]

    def __post_init__(self) -> None:
        names = [n for s in self.stores for n in (s.config.name, s.config.raw)]
        if not names:
            raise ConfigError("a catalog needs a table")
        if len(set(names)) < len(names):
            raise ConfigError("table names collide")
        if len({s.mode for s in self.stores}) > 1:
            raise ConfigError("tables of one catalog are read in one mode")

    @cached_property
    def session(self) -> SparkSession:
        return query_session(self.stores[0].spark)

    def table(self, name: str) -> Store:
        return next(s for s in self.stores if s.config.name == name)

    def _with(self, stores: Iterable[Store]) -> Catalog:
        return replace(self, stores=tuple(stores))

    def isolated(self, name: str) -> Store:
        """Only this table, in a session that has no other relation."""
        return self.table(name)

    def scoped(self, column: str, value: str) -> Catalog:
        """Every table confined, or none: a table without the column refuses the whole."""
        if missing := [s.config.name for s in self.stores if column not in s.config.key]:
            raise ScopeError(f"{', '.join(missing)} cannot be confined by {column}")
        return self._with(s.scoped(column, value) for s in self.stores)

    def as_known_at(self, at: datetime) -> Catalog:
        return self._with(s.as_known_at(at) for s in self.stores)

    def in_read_mode(self, mode: ReadMode) -> Catalog:
        return self._with(s.in_read_mode(mode) for s in self.stores)

    def sql(self, statement: str, args: dict | list | None = None) -> QueryResult:
        """Run a query over any of the tables; only the boundaries of those it names are read.

        Planned once, the statement says which range of each table it needs;
        each table is then read over its own range.
        """
        statement, views = expand_reports(self.session, statement, {s.config.name: s for s in self.stores})
        stores = {n: s for s in self.stores for n in (s.config.name, s.config.raw)}
        named = require_read_only(self.stores[0].spark, statement, set(stores) | views)
        used = {stores[n].config.name: stores[n] for n in sorted(named - views)}
        logs = {name: store.log() for name, store in used.items()}
        shown = {name: store.show(self.session, TimeRange(), logs[name]) for name, store in used.items()}
        df = self.session.sql(statement, args=args)
        if used:
            needed = {name: scanned_range(df, store.tiers.files.root) for name, store in used.items()}
            shown = {name: store.show(self.session, needed[name], logs[name]) for name, store in used.items()}
            df = self.session.sql(statement, args=args)
        tiers = tuple(dict.fromkeys(t for found, _ in shown.values() for t in found))
        return QueryResult(df, min((log[-1].boundary for log in logs.values()), default=None), tiers, self.stores[0].mode, any(ran for _, ran in shown.values()))

    # Administration: one table's failure does not stop the others

    def _each(self, action: Callable[[Store], str]) -> dict[str, str]:
        out = {}
        for store in self.stores:
            try:
                out[store.config.name] = action(store)
            except TidewattError as error:
                out[store.config.name] = f"failed: {error}"
        return out

    def create(self) -> dict[str, str]:
        return self._each(lambda s: f"watermark {s.tiers.latest().boundary.isoformat()}")

    def verify(self) -> dict[str, str]:
        return self._each(lambda s: s.verify_invariant() or "holds")

    def archive(self, now: datetime) -> dict[str, str]:
        return self._each(lambda s: f"archived {s.catch_up(now)} windows")

    def maintain(self, now: datetime, cutoff: int | None = None) -> dict[str, str]:
        """Verify, archive, reclaim, and forget subjects of epochs before ``cutoff``."""

        def one(store: Store) -> str:
            store.verify_invariant()
            moved, dropped = store.catch_up(now), store.reclaim(now)
            ended = len(store.tiers.snapshots()) - len(store.tiers.kept(now))
            swept = store.subjects.sweep(cutoff, now) if store.subjects and cutoff is not None else 0
            return f"archived {moved} windows, reclaimed {dropped}, {ended} snapshots ended, {swept} subjects forgotten"

        return self._each(one)
