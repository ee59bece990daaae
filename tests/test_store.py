"""A table from first write to archival, as of, scope and confinement."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewatt.catalog import Catalog
from tidewatt.errors import ConfigError, InvariantViolated, Quarantined, ReadOnlyError, ScopeError, WriteRefused
from tidewatt.functions.library import CANONICAL_OBIS, FUNCTIONS
from tidewatt.operators import writes
from tidewatt.operators.evolution import compare
from tidewatt.operators.erasure import SubjectMap
from tidewatt.operators.series import ReadingsQuery, SeriesQuery
from tidewatt.plans.timerange import ReadMode, TimeRange
from tidewatt.schema import Extra, TableConfig
from tidewatt.sources.tiers import Tiers
from tidewatt.store import Store
from tidewatt.streaming.ingest import ingest

MALO, OTHER = "41373559241", "12345678905"
T0 = datetime(2026, 3, 1, 23, tzinfo=timezone.utc)
SCHEMA = "malo_id string, obis_code string, sparte string, `from` timestamp, `to` timestamp, value decimal(18,6), unit string, quality string, resolution string, source_kind string, version decimal(20,0), version_scope string, recorded_at timestamp, tenant string"
CONFIG = TableConfig(extras=(Extra("tenant", nullable=False, identity=True),))
NOW = datetime(2026, 4, 1, tzinfo=timezone.utc)


def reading(hour, value, version=20260301000001, malo=MALO, tenant="a", **other):
    start = T0 + timedelta(hours=hour)
    row = dict(malo_id=malo, obis_code="1-0:1.8.0", sparte="STROM", start=start, end=start + timedelta(hours=1), value=Decimal(value), unit="KWH", quality="MEASURED", resolution="PT1H", source_kind="MSCONS", version=Decimal(version), version_scope="9900000000003:2026-03", recorded_at=NOW + timedelta(days=version % 1000), tenant=tenant)
    return tuple((row | other).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, CONFIG, f"file://{tmp_path}")


def test_life_of_a_table(spark, store):
    report = store.append(frame(spark, *(reading(h, "1.5") for h in range(48)), reading(0, "9", tenant="b")))
    assert {r.effect for r in report.collect()} == {"inserted"}
    again = store.append(frame(spark, reading(0, "1.5"), reading(1, "2.5", 20260301000002), reading(2, "7", 20260101000000)))
    assert sorted(r.effect for r in again.collect()) == ["duplicate", "shadowed", "superseded"]
    query = "SELECT count(*) AS n, sum(value) AS total FROM readings"
    before = store.sql(query)
    first = before.df.first()
    assert first == (49, Decimal("82.000000")) and before.tiers == ("hot",)
    assert store.catch_up(NOW) == 3 and store.tiers.latest().boundary == datetime(2026, 3, 4, tzinfo=timezone.utc)
    store.reclaim(NOW + timedelta(days=400))
    store.verify_invariant()
    after = store.sql(query)
    assert after.df.first() == first and after.watermark == store.tiers.latest().boundary
    late = store.append(frame(spark, reading(3, "11.5", 20260301000003)))
    assert late.first().effect == "superseded" and store.tiers.latest().operation == "append"
    assert store.sql(query).df.first().total == Decimal("92.000000")
    assert store.as_of(store.tiers.latest().id - 1).sql(query).df.first().total == Decimal("82.000000")
    assert store.as_of(store.tiers.latest().id, 20260301000001).sql(query).df.first().total == Decimal("81.000000")
    assert store.as_known_at(NOW + timedelta(days=2)).sql(query).df.first().total == Decimal("82.000000")
    assert store.scoped("tenant", "b").sql(query).df.first() == (1, Decimal("9.000000"))
    assert store.sql("SELECT healthy FROM system_tables").df.first().healthy
    assert "version_rank" in store.sql("SELECT resolution_sql FROM system_resolution").df.first()[0]
    assert store.latest(MALO, "1-0:1.8.0").value == Decimal("1.5")
    assert store.append_authoritative(frame(spark, reading(3, "1", 20260101000000))).first().effect == "superseded"
    assert store.sql("SELECT value FROM readings WHERE tenant = ?", ["b"]).df.first().value == Decimal("9")
    with pytest.raises(WriteRefused):
        store.append(frame(spark, reading(5, "99")))
    with pytest.raises(WriteRefused):
        store.append(frame(spark, reading(5, "99", 20260301000009, version_scope="9900000000029:2026-03")))


def test_ranges_choose_tiers(spark, store):
    store.append(frame(spark, *(reading(h, "1") for h in range(0, 96, 6))))
    store.archive_step(NOW), store.archive_step(NOW)
    mark = store.tiers.latest().boundary
    cold = store.sql(f"SELECT count(*) FROM readings WHERE `from` < TIMESTAMP '{mark:%Y-%m-%d %H:%M:%S}'")
    hot = store.sql(f"SELECT count(*) FROM readings WHERE `from` >= TIMESTAMP '{mark:%Y-%m-%d %H:%M:%S}'")
    assert cold.tiers == ("cold",) and not cold.resolved and hot.tiers == ("hot",) and hot.resolved
    assert cold.df.first()[0] + hot.df.first()[0] == 16
    assert store.in_read_mode(ReadMode.HISTORICAL).sql("SELECT count(*) FROM readings").df.first()[0] == cold.df.first()[0]


def test_guard(spark, store):
    for bad in ("CREATE TABLE x AS SELECT 1", "DROP VIEW readings", "SET a=b", "INSERT INTO readings SELECT * FROM readings", "CACHE TABLE readings"):
        with pytest.raises(ReadOnlyError):
            store.sql(bad)
    for bad in ("SELECT * FROM parquet.`/tmp/x`", "SELECT (SELECT max(a) FROM other) FROM readings", "WITH c AS (SELECT * FROM other) SELECT * FROM c"):
        with pytest.raises(ScopeError):
            store.sql(bad)
    assert store.sql("WITH c AS (SELECT 1 AS a) SELECT a FROM c").df.first().a == 1
    assert "Plan" in store.sql("EXPLAIN SELECT count(*) FROM readings").df.first()[0]
    with pytest.raises(ScopeError):
        store.scoped("quality", "MEASURED")
    with pytest.raises(ScopeError):
        store.scoped("tenant", "a").scoped("tenant", "b")
    with pytest.raises(ScopeError):
        store.scoped("tenant", "a").append(frame(spark, reading(0, "1", tenant="b")))


def test_rules_of_the_encoder(spark, store):
    for broken in (dict(malo_id="41373559240"), dict(obis_code="1-0:01.8.0"), dict(sparte="OEL"), dict(unit="M3"), dict(quality="GOOD"), dict(resolution="PT900S"), dict(end=T0), dict(version_scope="9900000000003:2026-04")):
        with pytest.raises(Exception, match="USER_RAISED|wrong|canonical|unknown|belong|end after|cover|commodity|sparte"):
            store.append(frame(spark, reading(0, "1", **broken)))


def test_series_and_catalog(spark, store, tmp_path):
    store.append(frame(spark, *(reading(h, str(h)) for h in range(5)), reading(9, "5", malo=OTHER)))
    series = SeriesQuery(store, MALO).obis("1-0:1.8.0").since(T0 + timedelta(hours=2)).collect()
    assert [r.value for r in series.readings] == [2, 3, 4] and series.resolution == "PT1H"
    assert SeriesQuery(store, "00000000000").collect() is None and SeriesQuery(store, MALO).channels() == ["1-0:1.8.0"]
    assert SeriesQuery(store, MALO).latest().value == 4
    store.append(frame(spark, reading(1, "8", tenant="b")))
    with pytest.raises(InvariantViolated):
        SeriesQuery(store, MALO).collect()
    other = Store(spark, TableConfig("second"), f"file://{tmp_path}")
    catalog = Catalog((store, other))
    assert catalog.sql("SELECT count(*) FROM readings r LEFT JOIN second s ON r.malo_id = s.malo_id").df.first()[0] == 7
    with pytest.raises(ScopeError):
        catalog.scoped("tenant", "a")
    with pytest.raises(ConfigError):
        Catalog((store, store))
    assert set(catalog.maintain(NOW)) == {"readings", "second"}
    report = store.completeness(T0, T0 + timedelta(hours=10)).filter(f"malo_id = '{MALO}' AND tenant = 'a'").first()
    assert (report.expected, report.actual, report.missing) == (10, 5, 5)


def test_stream(spark, store, tmp_path):
    frame(spark, *(reading(h, "1") for h in range(6))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for name in ("one", "two"):
        ingest(stream, store, f"{tmp_path}/{name}").awaitTermination()
    assert store.raw().count() == 6


def test_erasure(spark, tmp_path):
    people = SubjectMap(spark, f"file://{tmp_path}/people", b"key")
    ref = people.register("Ada", 2024, NOW)
    assert people.register("Ada", 2024, NOW) == ref and people.register("Bob", 2020, NOW) != ref
    assert people.sweep(2022, NOW) == 1 and people.erase("Ada", NOW) == 1 and people.subjects.count() == 0
    assert people.history(trigger="request").first().subject_ref == ref
    with pytest.raises(WriteRefused):
        people.register("Ada", 2025, NOW)
    people.lift("Ada")
    assert people.register("Ada", 2025, NOW)
    with pytest.raises(WriteRefused):
        people.require_resolvable(spark.createDataFrame([(ref,)], "subject string"), "subject")


def test_configuration_and_evolution():
    for bad in (dict(name="Bad Name"), dict(extras=(Extra("value"),)), dict(extras=(Extra("t", identity=True),)), dict(settlement_lag=timedelta(hours=1)), dict(subject_column="who")):
        with pytest.raises(ConfigError):
            TableConfig(**bad)
    assert TableConfig(point=True).key == ("malo_id", "melo_id", "obis_code", "from")
    changes = compare(TableConfig().schema, TableConfig(extras=(Extra("a"), Extra("b", nullable=False))).schema)
    assert [(c.column, c.safe) for c in changes] == [("a", True), ("b", False)]


def test_daily_totals_of_a_stream(spark, store, tmp_path):
    from tidewatt.streaming.ingest import daily_totals

    frame(spark, *(reading(h, "2") for h in range(30))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    daily_totals(stream, store).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT sum(readings), sum(total) FROM totals").first() == (30, Decimal("60.000000"))


def test_command_line(spark, tmp_path, capsys):
    from tidewatt.cli import load, main

    config = tmp_path / "tables.toml"
    config.write_text('[[table]]\nname = "second"\nstep = 86400\n[[table.extras]]\nname = "tenant"\nnullable = false\nidentity = true\n')
    assert load(str(config))[0].key == ("malo_id", "obis_code", "from", "tenant")
    root = f"file://{tmp_path}/root"
    for command in (["create"], ["status"], ["snapshots"], ["query", "SELECT count(*) AS n FROM second"], ["maintain"], ["completeness", "2026-01-01", "2026-01-02"], ["audit", "quality"]):
        main(["--root", root, "--config", str(config), *command])
    out = capsys.readouterr().out
    assert "watermark" in out and "archived 0 windows" in out
    main(["--root", root, "init", str(tmp_path / "new.toml")])
    assert load(str(tmp_path / "new.toml"))[0] == TableConfig()
    main(["--root", root, "erasures", f"file://{tmp_path}/people"])
    assert "subject_ref" in capsys.readouterr().out


def test_replays_and_contradictions_of_one_delivery(spark, store):
    twice = store.append(frame(spark, reading(0, "1"), reading(0, "1"), reading(1, "2")))
    assert sorted(r.effect for r in twice.collect()) == ["duplicate", "inserted", "inserted"] and store.raw().count() == 2
    with pytest.raises(WriteRefused, match="two values"):
        store.append(frame(spark, reading(5, "1"), reading(5, "2")))
    longer = T0 + timedelta(hours=3)
    with pytest.raises(WriteRefused, match="overlap"):
        store.append(frame(spark, reading(1, "1", 20260301000007, end=longer), reading(2, "1", 20260301000007)))
    store.append(frame(spark, reading(1, "1", 20260301000007, end=longer)))
    with pytest.raises(WriteRefused, match="overlap"):  # with a stored interval
        store.append(frame(spark, reading(2, "1", 20260301000007)))
    assert store.raw().count() == 3


def test_an_append_that_meets_an_archival_step_is_routed_anew(spark, store, monkeypatch):
    store.append(frame(spark, *(reading(h, "1") for h in range(0, 96, 6))))
    write, done = store.tiers.write, []

    def between(df, tier):
        if not done and tier == "cold":
            done.append(True)
            assert store.archive_step(NOW)
        return write(df, tier)

    monkeypatch.setattr(store.tiers, "write", between)
    store.append(frame(spark, reading(0, "5", 20260301000002), reading(90, "5", 20260301000002)))
    assert [s.operation for s in store.tiers.snapshots()] == ["create", "append", "archive", "append"]
    last = store.tiers.latest()
    assert last.cold.rows == 1 and last.hot.rows == 1 and store.raw().count() == 18
    store.verify_invariant()
    assert store.reclaim(NOW + timedelta(days=400)) == 1 and store.raw().count() == 18
    assert not [f for f in store.tiers.files.names("cold") if f not in {s.cold.folder.split("/")[1] for s in store.tiers.snapshots() if s.cold}]


def scanned(df):
    """Roots and filters of the files that a plan reads."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_writes_and_reads_touch_only_their_windows(spark, store, monkeypatch):
    store.append(frame(spark, *(reading(h, "1") for h in range(0, 24 * 20, 8))))
    for _ in range(3):
        store.archive_step(NOW)
    asked = []
    read = Tiers.read
    monkeypatch.setattr(Tiers, "read", lambda self, session, parts, tier, range_: asked.append((tier, range_)) or read(self, session, parts, tier, range_))
    store.append(frame(spark, reading(400, "2", 20260301000002)))
    window = store.tiers.window(T0 + timedelta(hours=400))
    assert asked == [("hot", TimeRange(window, window + timedelta(days=1)))]
    at = T0 + timedelta(hours=400)
    plan = scanned(store.sql(f"SELECT sum(value) FROM readings WHERE `from` = TIMESTAMP '{at:%Y-%m-%d %H:%M:%S}'").df)
    assert "PartitionFilters: [isnotnull(window_start" in plan and f"{window:%Y%m%d%H%M}" in plan and "/cold" not in plan
    cold = store.sql(f"SELECT value FROM readings WHERE `from` < TIMESTAMP '{T0 + timedelta(hours=9):%Y-%m-%d %H:%M:%S}'")
    assert cold.tiers == ("cold",) and "ReadSchema: struct<" in scanned(cold.df) and "provenance" not in scanned(cold.df).split("ReadSchema")[1]


def test_catalog_reads_each_table_over_its_own_range(spark, store, tmp_path):
    other = Store(spark, TableConfig("second"), f"file://{tmp_path}")
    rows = frame(spark, *(reading(h, "1") for h in range(0, 96, 6)))
    store.append(rows), other.append(rows.drop("tenant"))
    store.catch_up(NOW), other.catch_up(NOW)
    at = T0 + timedelta(hours=12)
    catalog = Catalog((store, other))
    found = catalog.sql(f"SELECT count(*) AS n FROM readings r JOIN second s ON r.`from` = s.`from` WHERE s.`from` <= TIMESTAMP '{at:%Y-%m-%d %H:%M:%S}'")
    assert found.df.first().n == 3 and found.tiers == ("cold",) and not found.resolved
    assert catalog.describe("SELECT malo_id FROM second").schema.names == ["malo_id"]
    told, rows = catalog.stream("SELECT count(*) AS n FROM second")
    assert told.tiers and next(rows).n == 16
    report = catalog.sql(f"SELECT * FROM meter_completeness('second', TIMESTAMP '{T0:%Y-%m-%d %H:%M:%S}', TIMESTAMP '{T0 + timedelta(hours=24):%Y-%m-%d %H:%M:%S}')").df.first()
    assert (report.expected, report.actual, report.missing) == (24, 4, 20)
    with pytest.raises(ConfigError):
        catalog.sql("SELECT * FROM meter_completeness(DATE '2026-03-02', DATE '2026-03-03')")
    assert catalog.verify() == {"readings": "holds", "second": "holds"} and set(catalog.create()) == {"readings", "second"}


def test_the_report_in_sql(spark, store):
    store.append(frame(spark, *(reading(h, "1") for h in range(30) if h != 4), *(reading(h, "1", malo=OTHER) for h in range(3))))
    both = store.sql("SELECT malo_id, expected, actual, missing FROM meter_completeness(DATE '2026-03-02', DATE '2026-03-03')").df.collect()
    assert [tuple(r) for r in both] == [(OTHER, 24, 3, 21), (MALO, 24, 23, 1)]
    silent = store.sql("SELECT count(*) AS n FROM meter_completeness('readings', DATE '2026-03-02', DATE '2026-03-03', DATE '2026-03-04') WHERE actual = 0").df.first()
    assert silent.n == 1
    assert store.completeness(T0, T0 + timedelta(days=1), malo_id=OTHER).count() == 1
    for bad in ("meter_completeness(DATE '2026-03-02')", "meter_completeness('other', DATE '2026-03-02', DATE '2026-03-03')"):
        with pytest.raises((ConfigError, ScopeError)):
            store.sql(f"SELECT * FROM {bad}")


def test_typed_reads(spark, tmp_path):
    store = Store(spark, TableConfig("meters", point=True), f"file://{tmp_path}")
    at = lambda h, value, day=0, **other: reading(h, value, end=None, recorded_at=NOW + timedelta(days=day), resolution=None, **other)
    rows = frame(spark, at(0, "10"), at(24, "12"), at(48, "15", day=1), at(0, "7", obis_code="1-0:2.8.0"), at(0, "3", obis_code="1-0:10.8.0"))
    store.append(rows.drop("tenant").withColumn("melo_id", F.lit("DE0001234567890123456789012345678")).withColumn("provenance", F.date_format("recorded_at", "dd")))
    query = ReadingsQuery(store, MALO)
    found = query.obis("1-0:1.8.0").collect()
    assert [v for _, v in found.values] == [10, 12, 15] and found.melo_id.startswith("DE") and [s.provenance for s in found.sources] == ["01", "02"]
    assert [len(r) for r in query.obis("1-0:1.8.0").deliveries().values()] == [2, 1] and found.source.provenance == "02"
    assert list(query.collect_by_channel()) == query.channels() == ["1-0:1.8.0", "1-0:2.8.0", "1-0:10.8.0"]
    assert query.obis("1-0:1.8.0").latest().value == 15
    with pytest.raises(InvariantViolated):
        query.collect()
    with pytest.raises(ConfigError):
        SeriesQuery(store, MALO)


def test_checked_columns_and_stored_schema(spark, tmp_path):
    root = f"file://{tmp_path}"
    store = Store(spark, TableConfig("zones", extras=(Extra("zone", check="EIC"), Extra("point", check="MALO"))), root)
    rows = frame(spark, reading(0, "1")).drop("tenant")
    store.append(rows.withColumns({"zone": F.lit("10YDE-EON------1"), "point": F.lit(MALO)}))
    for column, value in (("zone", "10YDE-EON------2"), ("point", "41373559240")):
        with pytest.raises(Exception, match="identifier"):
            store.append(rows.withColumns({"zone": F.lit(None).cast("string"), "point": F.lit(None).cast("string")} | {column: F.lit(value)}))
    wider = Store(spark, TableConfig("zones", extras=(Extra("zone", check="EIC"), Extra("point", check="MALO"), Extra("note"))), root)
    assert [(c.column, c.what) for c in wider.check_schema()] == [("note", "added")] and wider.raw().first().note is None
    assert wider.sql("SELECT count(*) AS n FROM system_columns WHERE column_name = 'note'").df.first().n == 2
    with pytest.raises(Quarantined):
        Store(spark, TableConfig("zones", extras=(Extra("must", nullable=False),)), root).raw()
    with pytest.raises(ConfigError):
        TableConfig(extras=(Extra("x", check="IBAN"),))


def test_references_must_resolve(spark, tmp_path):
    people = SubjectMap(spark, f"file://{tmp_path}/people", b"key")
    ref = people.register("Ada", 2026, NOW)
    store = Store(spark, TableConfig("held", extras=(Extra("who"),), subject_column="who"), f"file://{tmp_path}", subjects=people)
    rows = frame(spark, reading(0, "1")).drop("tenant")
    store.append(rows.withColumn("who", F.lit(ref)))
    with pytest.raises(WriteRefused):
        store.append(rows.withColumns({"who": F.lit("nobody"), "version": F.col("version") + 1}))
    assert people.references("Ada") == [ref] and people.resolve(store.resolved(), "who").first().identity == "Ada"
    people.erase_all(["Ada"], NOW)
    assert people.orphaned(store.resolved(), "who").first().who == ref


def test_bounds_and_retries():
    from datetime import date

    from tidewatt.errors import BoundaryMoved, is_retryable
    from tidewatt.functions.library import day_bounds, month_bounds, retention_cutoff

    hours = lambda bounds: (bounds[1] - bounds[0]).total_seconds() / 3600
    assert [hours(day_bounds(date(2026, m, d))) for m, d in ((3, 29), (7, 1), (10, 25))] == [23, 24, 25]
    assert day_bounds(date(2026, 1, 15), "GAS")[0] == datetime(2026, 1, 15, 5, tzinfo=timezone.utc) and hours(month_bounds(date(2026, 3, 7))) == 31 * 24 - 1
    assert retention_cutoff(datetime(2026, 1, 1, 2, tzinfo=timezone.utc), 3, "GAS") == 2022
    assert is_retryable(BoundaryMoved()) and not is_retryable(ConfigError()) and not is_retryable(ValueError())


def test_expired_snapshots_cannot_be_asked_for(spark, tmp_path):
    store = Store(spark, TableConfig("short", keep_snapshots=2, snapshot_retention=timedelta(days=1)), f"file://{tmp_path}")
    for h in range(4):
        store.append(frame(spark, reading(h, "1")).drop("tenant"))
    late = datetime.now(timezone.utc) + timedelta(days=2)
    assert [s.id for s in store.tiers.kept(late)] == [3, 4] and len(store.tiers.kept(datetime.now(timezone.utc))) == 5
    with pytest.raises(ConfigError):
        store.as_of(1, now=late)
    assert store.as_of(3, now=late).snapshot.id == 3


def test_delivery_in_one_partition_is_spread(spark, store, monkeypatch):
    seen = []
    encode = writes.encode
    monkeypatch.setattr(writes, "encode", lambda df, config: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or encode(df, config))
    store.append(frame(spark, *(reading(h, "1") for h in range(8))).coalesce(1))
    assert seen[0].startswith("RepartitionByExpression") and store.raw().count() == 8


def test_displacements_of_readings_with_many_versions(spark):
    dice = random.Random(7)
    stored = [reading(h, str(v), v, version_scope="s") for h in range(6) for v in dice.sample(range(1, 40), dice.randrange(12))]
    new = [reading(h, str(v), v, version_scope="s") for h in range(6) for v in dice.choices(range(1, 40), k=9)]
    found = writes.displacements(frame(spark, *stored), frame(spark, *new), CONFIG)
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = []
    for hour in range(6):
        mine = lambda rows: sorted(int(r[10]) for r in rows if r[3] == T0 + timedelta(hours=hour))  # noqa: B023, E731
        held = mine(stored)
        for v in mine(new):
            best = max(held, default=None)
            effect = "duplicate" if v in held else "inserted" if best is None else "superseded" if v > best else "shadowed"
            expected.append((hour, v, effect, best if effect == "superseded" else None))
            held.append(v)
    hour = lambda r: int((r["from"].astimezone(timezone.utc) - T0).total_seconds() // 3600)
    got = [(hour(r), int(r.version), r.effect, r.prior_version and int(r.prior_version)) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_canonical_channels_are_those_that_normalising_keeps(spark):
    codes = ["1-0:1.8.0", "1-0:1.8.63", "255-0:1.8.0", "254-0:1.8.0", "1-0:01.8.0", " 1-0:1.8.0", "1-0:1.8.0 ", "1-0:1.8.0\n", "1-0:1.8.0*255", "1-0:1.8.0*254", "1-0:1.8.0*0", "1-0:1.8.0*00", "99-100:199.200.249"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string").select("code", F.expr(f"code RLIKE '{CANONICAL_OBIS}'"), F.expr(FUNCTIONS["obis_normalise"].sql("code")))
    kept = {c: (canonical, normal == c) for c, canonical, normal in rows.collect()}
    assert all(same for canonical, same in kept.values() if canonical)
    assert [c for c, (canonical, same) in kept.items() if same and not canonical] == ["255-0:1.8.0"]
