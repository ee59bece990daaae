"""Command line: ``python -m tidewatt.cli --root DIR COMMAND``."""

from __future__ import annotations

import argparse
import tomllib
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from .catalog import Catalog
from .schema import Extra, TableConfig
from .store import Store

DURATIONS = ("step", "settlement_lag", "headroom", "reader_grace", "snapshot_retention")


def load(path: str) -> list[TableConfig]:
    """Tables from a TOML file; durations are seconds."""
    out = []
    for raw in tomllib.loads(Path(path).read_text()).get("table", []):
        values = {k: timedelta(seconds=v) if k in DURATIONS else v for k, v in raw.items() if k != "extras"}
        out.append(TableConfig(extras=tuple(Extra(**e) for e in raw.get("extras", [])), **values))
    return out


def initialise(path: str) -> None:
    """Write a settings file with one table; refuses to overwrite."""
    config = TableConfig()
    lines = ["[[table]]", f'name = "{config.name}"', "point = false", *(f"{k} = {int(getattr(config, k).total_seconds())}" for k in DURATIONS), f"keep_snapshots = {config.keep_snapshots}", ""]
    with open(path, "x") as file:
        file.write("\n".join(lines))


def instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewatt")
    parser.add_argument("--root", required=True)
    parser.add_argument("--config", help="TOML file with [[table]] entries")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("create", "status", "snapshots", "archive", "maintain", "reassert-watermark", "check"):
        commands.add_parser(name)
    commands.add_parser("init").add_argument("file", help="a new TOML file with one table and its defaults")
    trail = commands.add_parser("erasures")
    trail.add_argument("map", help="folder of the subject map")
    trail.add_argument("--since", type=instant)
    trail.add_argument("--until", type=instant)
    trail.add_argument("--trigger")
    trail.add_argument("--limit", type=int, default=100)
    for name in ("query", "explain"):
        commands.add_parser(name).add_argument("sql")
    report = commands.add_parser("completeness")
    report.add_argument("start", type=instant)
    report.add_argument("end", type=instant)
    report.add_argument("--seen-since", type=instant)
    audit = commands.add_parser("audit")
    audit.add_argument("column")
    purge = commands.add_parser("purge")
    purge.add_argument("--confirm", required=True)
    args = parser.parse_args(argv)

    if args.command == "init":
        initialise(args.file)
        return
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "erasures":
        from .operators.erasure import SubjectMap

        SubjectMap(spark, args.map, b"").history(args.since, args.until, args.trigger, args.limit).show(args.limit, truncate=False)
        return
    catalog = Catalog(tuple(Store(spark, c, args.root) for c in (load(args.config) if args.config else [TableConfig()])))
    if args.command == "query":
        catalog.sql(args.sql).df.show(100, truncate=False)
    elif args.command == "explain":
        catalog.sql(args.sql).df.explain("formatted")
    elif args.command in ("maintain", "archive"):
        for name, line in getattr(catalog, args.command)(datetime.now(timezone.utc)).items():
            print(name, line)
    for store in catalog.stores:
        if args.command in ("create", "check"):
            store.verify_invariant()
            print(store.config.name, "watermark", store.tiers.latest().boundary.isoformat())
        elif args.command in ("status", "snapshots"):
            store.refresh_system_tables()
            store.session.table("system_tables" if args.command == "status" else "system_snapshots").show(100, truncate=False)
        elif args.command == "reassert-watermark":
            store.reassert_watermark()
        elif args.command == "completeness":
            store.completeness(args.start, args.end, args.seen_since).show(1000, truncate=False)
        elif args.command == "audit":
            from .operators.writes import attribute_audit

            attribute_audit(store.raw(), args.column, store.config).show()
        elif args.command == "purge" and args.confirm == store.config.name:
            store.tiers.files.delete("")


if __name__ == "__main__":
    main()
