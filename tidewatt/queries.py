"""One query per operator over the test tables, with the SQL that it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .checkpoints import checkpoint_folder
from .functions import call
from .functions.library import worst_quality
from .operators import writes
from .operators.completeness import completeness, daily, expectations
from .plans.resolve import resolve
from .plans.timerange import ReadMode, TimeRange, split
from .schema import TableConfig
from .sources.adapter import SQL as READINGS_SQL
from .sources.adapter import WATERMARK, readings
from .store import Store

CONFIG = TableConfig()
TOTAL = "CAST(sum(value) AS DECIMAL(28,6)) AS total"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, head: bool = True):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = (READINGS_SQL if head else "") + sql
        return function

    return add


def resolved(spark: SparkSession, folder: str, df: DataFrame | None = None) -> DataFrame:
    return resolve(readings(spark, folder) if df is None else df, CONFIG.key)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,6)").alias("total"))


def within(spark: SparkSession, folder: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """A range, read from the tiers that it touches."""
    parts = split(TimeRange(start, end), WATERMARK)
    rows = readings(spark, folder)
    tiers = [rows.filter(r.filter()).withColumn("tier", F.lit(name)) for name, r in (("cold", parts.cold), ("hot", parts.hot)) if r is not None]
    if not tiers:
        return resolve(rows.limit(0).withColumn("tier", F.lit("none")), CONFIG.key)
    return resolve(tiers[0] if len(tiers) == 1 else tiers[0].unionByName(tiers[1]), CONFIG.key)


def day(n: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, 1, hour, tzinfo=timezone.utc) + timedelta(days=n - 1)


# Scans, resolution and tiers -------------------------------------------------


@query(f"SELECT sparte, count(*) AS n, {TOTAL} FROM versions GROUP BY sparte")
def raw_versions_scan(spark, folder):
    return readings(spark, folder).groupBy("sparte").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,6)").alias("total"))


@query('SELECT malo_id, obis_code, CAST("from" AS DATE) AS day, CAST(version AS BIGINT) AS version, value, quality FROM resolved')
def resolved_scan(spark, folder):
    return resolved(spark, folder).select("malo_id", "obis_code", F.to_date("from").alias("day"), F.col("version").cast("long").alias("version"), "value", "quality")


@query(f"SELECT count(*) AS n, {TOTAL} FROM resolved")
def unified_sum(spark, folder):
    return total(resolved(spark, folder))


@query(f"SELECT count(*) AS n, {TOTAL} FROM resolved WHERE \"from\" < TIMESTAMP '2024-01-20'")
def historical_sum(spark, folder):
    return total(within(spark, folder, None, WATERMARK))


@query(f"SELECT count(*) AS n, {TOTAL} FROM resolved WHERE \"from\" >= TIMESTAMP '2024-01-20'")
def operational_sum(spark, folder):
    return total(within(spark, folder, WATERMARK, None))


def _range(name: str, start: datetime, end: datetime) -> None:
    sql = f"SELECT CASE WHEN \"from\" < TIMESTAMP '2024-01-20' THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n, {TOTAL} FROM resolved WHERE \"from\" >= TIMESTAMP '{start:%Y-%m-%d}' AND \"from\" < TIMESTAMP '{end:%Y-%m-%d}' GROUP BY 1"

    def run(spark, folder):
        return within(spark, folder, start, end).groupBy("tier").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,6)").alias("total"))

    run.__name__ = name
    query(sql)(run)


for _name, _start, _end in (("range_cold_only", 5, 10), ("range_hot_only", 22, 25), ("range_spanning", 18, 23), ("range_empty", 9, 9)):
    _range(_name, day(_start), day(_end))


@query("SELECT CASE WHEN \"from\" < TIMESTAMP '2024-01-20' THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n FROM versions GROUP BY 1")
def tier_routing(spark, folder):
    return readings(spark, folder).groupBy(F.when(F.col("from") < F.lit(WATERMARK), "cold").otherwise("hot").alias("tier")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, {TOTAL} FROM (SELECT * FROM versions WHERE recorded_at <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY malo_id, obis_code, \"from\", version_scope ORDER BY version DESC, recorded_at DESC) = 1)")
def as_known_at_sum(spark, folder):
    return total(resolved(spark, folder, readings(spark, folder).filter(F.col("recorded_at") <= F.lit(day(15)))))


@query(f"SELECT count(*) AS n, {TOTAL} FROM (SELECT * FROM versions WHERE \"from\" < TIMESTAMP '2024-01-20' AND version <= 20240101000500 QUALIFY row_number() OVER (PARTITION BY malo_id, obis_code, \"from\", version_scope ORDER BY version DESC, recorded_at DESC) = 1)")
def as_of_version_ceiling(spark, folder):
    return total(resolved(spark, folder, readings(spark, folder).filter((F.col("from") < F.lit(WATERMARK)) & (F.col("version") <= 20240101000500))))


@query(f"SELECT count(*) AS n, {TOTAL} FROM resolved WHERE obis_code = '1-0:1.8.0'")
def scoped_channel_sum(spark, folder):
    return total(resolved(spark, folder, readings(spark, folder).filter(F.col("obis_code") == "1-0:1.8.0")))


@query('SELECT s.sparte, count(*) AS n FROM resolved s JOIN resolved r ON s.malo_id = r.malo_id AND s."from" = r."from" WHERE s.obis_code = \'1-0:1.8.0\' AND r.obis_code = \'1-0:2.8.0\' GROUP BY s.sparte')
def scoped_join(spark, folder):
    rows = resolved(spark, folder).select("malo_id", "obis_code", "from", "sparte")
    left, right = rows.filter("obis_code = '1-0:1.8.0'"), rows.filter("obis_code = '1-0:2.8.0'").select("malo_id", "from")
    return left.join(right, ["malo_id", "from"]).groupBy("sparte").agg(F.count("*").alias("n"))


# Functions -------------------------------------------------------------------

_AT = "SELECT CAST(ts AS TIMESTAMP) AS ts, event_id, event_type, value, ['STROM', 'GAS', 'WAERME', 'WASSER'][user_id % 4 + 1] AS sparte, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS l FROM events"
_BDAY = "CAST(CASE WHEN sparte = 'GAS' THEN l - INTERVAL 6 HOUR ELSE l END AS DATE)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/events.parquet").withColumns({"at": F.col("ts").cast("timestamp"), "sparte": F.expr("element_at(array('STROM', 'GAS', 'WAERME', 'WASSER'), CAST(user_id % 4 + 1 AS INT))")})


def _bucket(name: str, column, sql: str) -> None:
    def run(spark, folder):
        return _events(spark, folder).groupBy(column().alias("bucket"), "sparte").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(28,6)").alias("total"))

    run.__name__ = name
    query(f"SELECT {sql} AS bucket, sparte, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS total FROM ({_AT}) GROUP BY ALL", head=False)(run)


_bucket("daily_local", lambda: call("meter_local_day", "at"), "CAST(l AS DATE)")
_bucket("daily_gas", lambda: call("meter_gas_day", "at"), "CAST(l - INTERVAL 6 HOUR AS DATE)")
_bucket("daily_balancing", lambda: call("meter_balancing_day", "at", "sparte"), _BDAY)
_bucket("monthly_local", lambda: call("meter_local_month", "at"), "CAST(date_trunc('month', l) AS DATE)")
_bucket("monthly_balancing", lambda: call("meter_balancing_month", "at", "sparte"), f"CAST(date_trunc('month', {_BDAY}) AS DATE)")

_B = "epoch((CAST({d} AS TIMESTAMP) + CASE WHEN sparte = 'GAS' THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END) AT TIME ZONE 'Europe/Berlin')"


@query(
    "SELECT day, sparte, res AS resolution, CAST(CASE res WHEN 'P1D' THEN 1 WHEN 'P1M' THEN NULL ELSE floor((" + _B.format(d="day + INTERVAL 1 DAY") + " - " + _B.format(d="day") + ") / step) END AS INT) AS expected "
    "FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-03-25', TIMESTAMP '2024-04-05', INTERVAL 1 DAY)) AS DATE) AS day UNION ALL SELECT CAST(unnest(generate_series(TIMESTAMP '2024-10-22', TIMESTAMP '2024-10-30', INTERVAL 1 DAY)) AS DATE)), "
    "(VALUES ('STROM'), ('GAS')) s(sparte), (VALUES ('PT15M', 900), ('PT30M', 1800), ('PT1H', 3600), ('P1D', 1), ('P1M', 1)) g(res, step)",
    head=False,
)
def expected_intervals(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    days = spark.sql("SELECT explode(concat(sequence(DATE'2024-03-25', DATE'2024-04-05'), sequence(DATE'2024-10-22', DATE'2024-10-30'))) AS day")
    grid = days.withColumn("sparte", F.explode(F.array(F.lit("STROM"), F.lit("GAS")))).withColumn("resolution", F.explode(F.array(*map(F.lit, ("PT15M", "PT30M", "PT1H", "P1D", "P1M")))))
    return grid.withColumn("expected", call("meter_expected_intervals", "day", "resolution", "sparte"))


_PARTS = "CAST(split_part(code, '-', 1) AS INT) AS a, CAST(split_part(split_part(code, ':', 2), '.', 1) AS INT) AS c, CAST(split_part(code, '.', 2) AS INT) AS d, CAST(split_part(code, '.', 3) AS INT) AS e"
_CODES = f"(SELECT obis_code AS code, value, {_PARTS.replace('code', 'obis_code')} FROM resolved)"


@query(f"SELECT CASE WHEN a = 1 AND c = 1 THEN 'IMPORT' WHEN a = 1 AND c = 2 THEN 'EXPORT' END AS direction, count(*) AS n, {TOTAL} FROM {_CODES} GROUP BY 1")
def obis_direction_sum(spark, folder):
    return resolved(spark, folder).groupBy(call("obis_direction", "obis_code").alias("direction")).agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,6)").alias("total"))


_TESTS = {"obis_is_import": "a = 1 AND c = 1", "obis_is_export": "a = 1 AND c = 2", "obis_is_reactive": "c BETWEEN 3 AND 8", "obis_is_lastgang": "d = 29", "obis_is_zaehlerstand": "d = 8", "obis_is_vorschub": "d = 9", "obis_is_maximum": "d = 6", "obis_is_fehlerregister": "e = 63", "obis_is_total_register": "e = 0"}


@query(f"SELECT DISTINCT code, {', '.join(f'{t} AS {n}' for n, t in _TESTS.items())} FROM {_CODES}")
def obis_predicates(spark, folder):
    return resolved(spark, folder).select(F.col("obis_code").alias("code"), *(call(n, "obis_code") for n in _TESTS)).distinct()


@query(f"SELECT CASE WHEN e NOT IN (0, 63) THEN e END AS tariff, count(*) AS n FROM {_CODES} GROUP BY 1")
def obis_tariff(spark, folder):
    return resolved(spark, folder).groupBy(call("obis_tariff_register", "obis_code").cast("int").alias("tariff")).agg(F.count("*").alias("n"))


_SPELT = "CASE pmod(hour, 4) WHEN 0 THEN concat(code, '*255') WHEN 1 THEN concat('  0', replace(replace(code, ':', ':0'), '.', '.00'), ' ') WHEN 2 THEN concat(code, '*007') ELSE concat(' ', replace(code, '-', '-00'), '*255  ') END"


@query(
    f"SELECT {_SPELT.replace('pmod(hour, 4)', 'hour % 4')} AS code, CASE hour % 4 WHEN 2 THEN code || '*7' ELSE code END AS normal, count(*) AS n FROM (SELECT obis_code AS code, CAST(version % 4 AS INT) AS hour FROM resolved) GROUP BY 1, 2"
)
def obis_normalise(spark, folder):
    """Codes with blanks, leading zeros, and a storage number that is the default or another."""
    codes = resolved(spark, folder).select(F.col("obis_code").alias("code"), (F.col("version") % 4).cast("int").alias("hour")).select(F.expr(_SPELT).alias("code"))
    return codes.groupBy("code", call("obis_normalise", "code").alias("normal")).agg(F.count("*").alias("n"))


@query(f"SELECT quality IN ('MEASURED', 'SUBSTITUTED') AS billable, count(*) AS n, {TOTAL} FROM resolved GROUP BY 1")
def quality_billable_sum(spark, folder):
    return resolved(spark, folder).groupBy(call("quality_is_billable", "quality").alias("billable")).agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,6)").alias("total"))


@query("SELECT quality, CASE quality WHEN 'MEASURED' THEN '220' WHEN 'SUBSTITUTED' THEN '67' WHEN 'ESTIMATED' THEN '187' WHEN 'PRELIMINARY' THEN 'Z18' WHEN 'FAULTY' THEN '20' END AS code, count(*) AS n FROM resolved GROUP BY ALL")
def quality_market_code(spark, folder):
    return resolved(spark, folder).groupBy("quality", call("quality_market_code", "quality").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT quality = 'PRELIMINARY' AS provisional, count(*) AS n FROM resolved GROUP BY 1")
def quality_provisional(spark, folder):
    return resolved(spark, folder).groupBy(call("quality_is_provisional", "quality").alias("provisional")).agg(F.count("*").alias("n"))


@query("SELECT malo_id, obis_code, ['MEASURED', 'SUBSTITUTED', 'CALCULATED', 'CORRECTED', 'ESTIMATED', 'PRELIMINARY', 'UNKNOWN', 'FAULTY'][max(list_position(['MEASURED', 'SUBSTITUTED', 'CALCULATED', 'CORRECTED', 'ESTIMATED', 'PRELIMINARY', 'UNKNOWN', 'FAULTY'], quality))] AS worst FROM resolved GROUP BY 1, 2")
def quality_worst(spark, folder):
    return resolved(spark, folder).groupBy("malo_id", "obis_code").agg(worst_quality().alias("worst"))


_EICS = ["11YN000000000016", "11YV00000000001D", "11XBK0000000001A", "10X168Y4E6H0041Z", " 11xbk0000000001a ", "11YN000000000017", "11QBK0000000001Y", "10YDE-EON------1", "10ydE-VE-------2", "10YFR-RTE------C", "11YR00000000001N", "11YW000000000018", "0011YN0000000000", ""]
_NATION_EIC = f"(SELECT n_nationkey, trim(upper([{', '.join(repr(e) for e in _EICS)}][n_nationkey % {len(_EICS)} + 1])) AS code FROM nation)"
# The check character: weights 16 down to 2, modulo 37.
_SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-"
_GOOD = f"(regexp_full_match(code, '[0-9][0-9][A-Z][0-9A-Z-]{{12}}[0-9A-Z]') AND substr(code, 16, 1) = substr('{_SYMBOLS}', CAST(37 - ((list_sum([(17 - i) * (strpos('{_SYMBOLS}', substr(code, i, 1)) - 1) FOR i IN range(1, 16)]) - 1) % 37 + 37) % 37 AS BIGINT), 1))"


def _eic(spark: SparkSession, folder: str, name: str, alias: str) -> DataFrame:
    code = f"element_at(array({', '.join(repr(e) for e in _EICS)}), CAST(n_nationkey % {len(_EICS)} + 1 AS INT))"
    return spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", F.expr(code).alias("code")).select("n_nationkey", call(name, "code").alias(alias))


@query(f"SELECT n_nationkey, CASE WHEN {_GOOD} THEN code END AS eic FROM {_NATION_EIC}", head=False)
def eic_normalise(spark, folder):
    return _eic(spark, folder, "eic_normalise", "eic")


@query(f"SELECT n_nationkey, CASE WHEN {_GOOD} AND substr(code, 3, 1) IN ('X', 'Y', 'Z', 'W', 'T', 'V', 'A') THEN substr(code, 3, 1) END AS kind FROM {_NATION_EIC}", head=False)
def eic_object_type(spark, folder):
    return _eic(spark, folder, "eic_object_type", "kind")


@query(f"SELECT n_nationkey, CASE WHEN {_GOOD} AND code LIKE '11Y%' THEN CASE substr(code, 4, 1) WHEN 'N' THEN 'TENNET' WHEN 'R' THEN 'AMPRION' WHEN 'V' THEN 'FIFTY_HERTZ' WHEN 'W' THEN 'TRANSNET_BW' END END AS zone FROM {_NATION_EIC}", head=False)
def eic_regelzone(spark, folder):
    return _eic(spark, folder, "eic_regelzone", "zone")


# Reports and writes ----------------------------------------------------------


@query("SELECT malo_id, obis_code, sparte, resolution, balancing_day AS day, quality, count(*) AS actual FROM resolved GROUP BY ALL")
def completeness_daily(spark, folder):
    return daily(resolved(spark, folder))


_LOW, _HIGH = day(3), day(27)
_IN = "\"from\" >= TIMESTAMP '2024-01-03' AND \"from\" < TIMESTAMP '2024-01-27'"
_SPAN = "(SELECT sparte, CAST(unnest(generate_series(CASE WHEN sparte = 'GAS' THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-03' END, CASE WHEN sparte = 'GAS' THEN TIMESTAMP '2024-01-26' ELSE TIMESTAMP '2024-01-27' END, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT sparte FROM resolved))"
# The range starts and ends at 01:00 local time (19:00 of a gas day), so its first
# balancing day lacks its only start and its last one keeps it.
_PLAN = f"(SELECT sparte, day, CASE WHEN day = min(day) OVER (PARTITION BY sparte) THEN 0 ELSE 1 END AS expected FROM {_SPAN})"
_ROLLUP = f"""SELECT t.malo_id, t.obis_code, t.sparte, 'P1D' AS resolution, sum(p.expected) AS expected, any_value(t.actual) AS actual,
  sum(CASE WHEN p.expected > 0 THEN greatest(p.expected - coalesce(c.n, 0), 0) ELSE 0 END) AS missing, sum(CASE WHEN p.expected > 0 THEN greatest(coalesce(c.n, 0) - p.expected, 0) ELSE 0 END) AS surplus,
  min(CASE WHEN p.expected > coalesce(c.n, 0) THEN p.day END) AS first_gap, any_value(t.substituted) AS substituted, any_value(t.not_billable) AS not_billable
FROM (SELECT malo_id, obis_code, sparte, count(*) AS actual, count(*) FILTER (quality = 'SUBSTITUTED') AS substituted, count(*) FILTER (quality NOT IN ('MEASURED', 'SUBSTITUTED')) AS not_billable FROM resolved WHERE {_IN} GROUP BY ALL) t
JOIN {_PLAN} p ON p.sparte = t.sparte
LEFT JOIN (SELECT malo_id, obis_code, balancing_day AS day, count(*) AS n FROM resolved WHERE {_IN} GROUP BY ALL) c ON c.malo_id = t.malo_id AND c.obis_code = t.obis_code AND c.day = p.day
GROUP BY t.malo_id, t.obis_code, t.sparte"""
_FLAGS = "CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, CAST(missing AS BIGINT) AS missing, CAST(surplus AS BIGINT) AS surplus, first_gap, CAST(substituted AS BIGINT) AS substituted, CAST(not_billable AS BIGINT) AS not_billable, missing = 0 AND surplus = 0 AS complete, expected > 0 AS measurable"


@query(f"SELECT malo_id, obis_code, sparte, resolution, {_FLAGS} FROM ({_ROLLUP})")
def completeness_rollup(spark, folder):
    return completeness(resolved(spark, folder), _LOW, _HIGH)


@query(
    f"SELECT DISTINCT r.malo_id, r.obis_code, r.sparte, 'P1D' AS resolution, p.expected, p.first_gap FROM resolved r JOIN (SELECT sparte, CAST(sum(expected) AS BIGINT) AS expected, min(CASE WHEN expected > 0 THEN day END) AS first_gap FROM (SELECT sparte, day, CASE WHEN day = min(day) OVER (PARTITION BY sparte) THEN 0 ELSE 1 END AS expected FROM "
    + _SPAN.replace("2024-01-02", "2024-01-24").replace("2024-01-03", "2024-01-25")
    + ") GROUP BY sparte) p ON p.sparte = r.sparte WHERE NOT EXISTS (SELECT 1 FROM resolved x WHERE x.malo_id = r.malo_id AND x.obis_code = r.obis_code AND x.\"from\" >= TIMESTAMP '2024-01-25' AND x.\"from\" < TIMESTAMP '2024-01-27')"
)
def completeness_silent(spark, folder):
    rows = resolved(spark, folder)
    report = completeness(rows, day(25), day(27), roster=rows.select("malo_id", "obis_code", "sparte", "resolution").distinct())
    return report.filter("actual = 0").select("malo_id", "obis_code", "sparte", "resolution", "expected", "first_gap")


@query(f"SELECT sparte, 'P1D' AS grid, day, CAST(expected AS BIGINT) AS expected FROM {_PLAN}")
def completeness_expectation(spark, folder):
    grids = resolved(spark, folder).select("sparte", F.col("resolution").alias("grid"))
    return expectations(grids, _LOW, _HIGH)


# Quarter-hours that rows cover, counted one by one.
_MIXED = """, h AS (
  SELECT malo_id, obis_code, sparte, quality, "from" + to_hours(k) AS f, 'PT1H' AS grid, 60 AS m FROM resolved, (SELECT unnest(range(24)) AS k)
  WHERE obis_code = '1-0:1.8.0' AND NOT ("from" = TIMESTAMP '2024-01-10' AND CAST(malo_id AS BIGINT) % 2 = 0 AND k > 12)
  UNION ALL
  SELECT malo_id, obis_code, sparte, quality, "from" + to_minutes(15 * k), 'PT15M', 15 FROM resolved, (SELECT unnest(range(50, 90)) AS k)
  WHERE obis_code = '1-0:1.8.0' AND "from" = TIMESTAMP '2024-01-10' AND CAST(malo_id AS BIGINT) % 2 = 0
), r AS (
  SELECT *, CAST(CASE WHEN sparte = 'GAS' THEN f - INTERVAL 5 HOUR ELSE f + INTERVAL 1 HOUR END AS DATE) AS day FROM h WHERE f >= TIMESTAMP '2024-01-09' AND f < TIMESTAMP '2024-01-13'
), p AS (
  SELECT s.sparte, day, greatest(a, TIMESTAMP '2024-01-09') AS lo, least(a + INTERVAL 1 DAY, TIMESTAMP '2024-01-13') AS hi
  FROM (SELECT DISTINCT sparte FROM r) s, (SELECT CAST(unnest(range(DATE '2024-01-08', DATE '2024-01-14', INTERVAL 1 DAY)) AS DATE) AS day), LATERAL (SELECT CAST(day AS TIMESTAMP) + CASE WHEN s.sparte = 'GAS' THEN INTERVAL 5 HOUR ELSE INTERVAL (-1) HOUR END AS a)
  WHERE a < TIMESTAMP '2024-01-13' AND a + INTERVAL 1 DAY > TIMESTAMP '2024-01-09'
), due AS (
  SELECT sparte, day, lo, hi, grid, CAST(date_diff('minute', lo, hi) // m AS BIGINT) AS expected FROM p, (VALUES ('PT1H', 60), ('PT15M', 15)) g(grid, m)
), d AS (
  SELECT malo_id, sparte, day, count(DISTINCT grid) AS grids, min(grid) AS first_grid, first(grid ORDER BY f DESC, grid DESC) AS closing FROM r GROUP BY ALL
), slots AS (
  SELECT malo_id, r.sparte, r.day, unnest(range(greatest(f, lo), least(f + to_minutes(m), hi), INTERVAL 15 MINUTE)) AS slot FROM r JOIN p ON p.sparte = r.sparte AND p.day = r.day
), judged AS (
  SELECT d.malo_id, d.sparte, d.day, closing AS grid, any_value(expected) AS expected, any_value(expected) - count(DISTINCT slot) AS missing, count(slot) - count(DISTINCT slot) AS surplus
  FROM d JOIN due e ON e.sparte = d.sparte AND e.day = d.day AND e.grid = 'PT15M' JOIN slots s ON s.malo_id = d.malo_id AND s.sparte = d.sparte AND s.day = d.day WHERE grids > 1 GROUP BY ALL
  UNION ALL
  SELECT r.malo_id, r.sparte, r.day, r.grid, any_value(expected), greatest(any_value(expected) - count(*), 0), greatest(count(*) - any_value(expected), 0)
  FROM r JOIN d ON d.malo_id = r.malo_id AND d.sparte = r.sparte AND d.day = r.day AND grids = 1 JOIN due e ON e.sparte = r.sparte AND e.day = r.day AND e.grid = r.grid GROUP BY ALL
  UNION ALL
  SELECT c.malo_id, c.sparte, e.day, e.grid, expected, expected, 0
  FROM (SELECT DISTINCT malo_id, sparte FROM d) c JOIN due e ON e.sparte = c.sparte
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.malo_id = c.malo_id AND d.sparte = c.sparte AND d.day = e.day)
    AND e.grid = coalesce((SELECT arg_max(closing, day) FROM d WHERE d.malo_id = c.malo_id AND d.sparte = c.sparte AND d.day < e.day), (SELECT arg_min(first_grid, day) FROM d WHERE d.malo_id = c.malo_id AND d.sparte = c.sparte))
), sums AS (
  SELECT malo_id, sparte, grid, sum(expected) AS expected, sum(missing) AS missing, sum(surplus) AS surplus, min(CASE WHEN missing > 0 THEN day END) AS first_gap FROM judged WHERE expected > 0 GROUP BY ALL
), t AS (
  SELECT malo_id, obis_code, sparte, grid AS resolution, count(*) AS actual, count(*) FILTER (quality = 'SUBSTITUTED') AS substituted, count(*) FILTER (quality NOT IN ('MEASURED', 'SUBSTITUTED')) AS not_billable FROM r GROUP BY ALL
), report AS (
  SELECT t.*, coalesce(expected, 0) AS expected, coalesce(missing, 0) AS missing, coalesce(surplus, 0) AS surplus, first_gap FROM t LEFT JOIN sums s ON s.malo_id = t.malo_id AND s.sparte = t.sparte AND s.grid = t.resolution
)
"""


@query(f"{_MIXED} SELECT malo_id, obis_code, sparte, resolution, {_FLAGS} FROM report")
def completeness_mixed_grid(spark, folder):
    """Hours of one channel; half of the points change to quarter-hours on day 10, with an overlap and gaps."""
    rows = resolved(spark, folder).filter("obis_code = '1-0:1.8.0'")
    changed = (F.col("from") == F.lit(day(10))) & (F.col("malo_id").cast("long") % 2 == 0)
    hours = rows.withColumn("hour", F.explode(F.sequence(F.lit(0), F.when(changed, 12).otherwise(23)))).withColumns({"from": F.expr("`from` + make_dt_interval(0, hour)"), "resolution": F.lit("PT1H")}).drop("hour")
    quarters = rows.filter(changed).withColumn("quarter", F.explode(F.sequence(F.lit(50), F.lit(89)))).withColumns({"from": F.expr("`from` + make_dt_interval(0, 0, 15 * quarter)"), "resolution": F.lit("PT15M")}).drop("quarter")
    return completeness(hours.unionByName(quarters), day(9), day(13))


@query(
    f"""SELECT effect, count(*) AS n, CAST(sum(prior) AS DECIMAL(28,6)) AS prior FROM (
  SELECT CASE WHEN o IS NULL THEN 'inserted' WHEN version > o THEN 'superseded' ELSE 'shadowed' END AS effect, CASE WHEN version > o THEN ov END AS prior FROM (
    SELECT *, max(version) OVER w AS o, arg_max(value, version) OVER w AS ov FROM versions WINDOW w AS (PARTITION BY malo_id, obis_code, "from", version_scope ORDER BY (version % 3 = 0), version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE version % 3 = 0) GROUP BY effect"""
)
def displacement_effects(spark, folder):
    rows = readings(spark, folder)
    arrived = (F.col("version") % 3) == 0
    report = writes.displacements(rows.filter(~arrived), rows.filter(arrived), CONFIG)
    return report.groupBy("effect").agg(F.count("*").alias("n"), F.sum("prior_value").cast("decimal(28,6)").alias("prior"))


@query(f"SELECT count(*) AS n, {TOTAL} FROM versions WHERE version % 5 <> 0")
def cold_reconcile_dedup(spark, folder):
    """A fifth of the versions is stored; all come in, a quarter of them twice."""
    rows = readings(spark, folder)
    return total(writes.new_rows(rows.filter(F.col("version") % 5 == 0), rows.unionByName(rows.filter(F.col("version") % 4 == 0)), CONFIG))


@query("SELECT malo_id, obis_code, CAST(\"from\" AS DATE) AS day, CAST(version AS BIGINT) AS version, value AS one, value + 1 AS other FROM versions WHERE version % 9 = 0")
def contradictory_check(spark, folder):
    """A delivery that gives every ninth version a second value, and repeats every fourth as it is."""
    rows = readings(spark, folder)
    second = rows.filter(F.col("version") % 9 == 0).withColumn("value", (F.col("value") + 1).cast("decimal(18,6)"))
    found = writes.contradictory(rows.unionByName(second).unionByName(rows.filter(F.col("version") % 4 == 0)), CONFIG)
    return found.select("malo_id", "obis_code", F.to_date("from").alias("day"), F.col("version").cast("long").alias("version"), F.col("one.value").alias("one"), F.col("other.value").cast("decimal(19,6)").alias("other"))


@query("SELECT malo_id, obis_code, CAST(\"from\" AS DATE) AS day, value + 1 AS value, value AS stored_value FROM versions WHERE version % 7 = 0")
def restatement_check(spark, folder):
    rows = readings(spark, folder)
    changed = rows.withColumn("value", F.when(F.col("version") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(18,6)"))
    return writes.restated(rows, changed, CONFIG).select("malo_id", "obis_code", F.to_date("from").alias("day"), F.col("value").cast("decimal(19,6)").alias("value"), "stored_value")


@query("SELECT DISTINCT malo_id, obis_code, CAST(\"from\" AS DATE) AS day, '9900000000003' AS one, '9900000000029' AS other FROM versions WHERE sparte = 'WASSER'")
def one_operator_check(spark, folder):
    rows = readings(spark, folder)
    other = rows.filter("sparte = 'WASSER'").withColumn("version_scope", F.regexp_replace("version_scope", "^[0-9]+", "9900000000029"))
    return writes.second_operators(rows, other, CONFIG).select("malo_id", "obis_code", F.to_date("from").alias("day"), "one", "other")


@query("SELECT count(*) AS n FROM (SELECT lead(\"from\") OVER (PARTITION BY malo_id, obis_code, version_scope, 1 ORDER BY \"from\") AS f, \"from\" + INTERVAL 30 HOUR AS t FROM resolved) WHERE f < t")
def overlap_check(spark, folder):
    rows = resolved(spark, folder).withColumns({"to": F.expr("`from` + INTERVAL 30 HOURS"), "version": F.lit(1).cast("decimal(20,0)")})
    return writes.overlaps(rows, CONFIG).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS keys, count(*) FILTER (n > 1) AS several, max(n) AS widest FROM (SELECT count(DISTINCT quality) AS n FROM versions GROUP BY malo_id, obis_code, \"from\")")
def audit_attribute(spark, folder):
    return writes.attribute_audit(readings(spark, folder), "quality", CONFIG)


@query("SELECT DISTINCT malo_id, obis_code FROM resolved")
def channels(spark, folder):
    return resolved(spark, folder).select("malo_id", "obis_code").distinct()


@query("SELECT malo_id, obis_code, CAST(max(\"from\") AS DATE) AS day, arg_max(value, \"from\") AS value FROM resolved GROUP BY 1, 2")
def latest_reading(spark, folder):
    return resolved(spark, folder).groupBy("malo_id", "obis_code").agg(F.to_date(F.max("from")).alias("day"), F.max_by("value", "from").alias("value"))


@query("SELECT malo_id, obis_code, CAST(\"from\" AS DATE) AS day, CAST(row_number() OVER (PARTITION BY malo_id, obis_code ORDER BY \"from\") AS INT) AS place, value FROM resolved")
def series_ordered(spark, folder):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("malo_id", "obis_code").orderBy("from"))
    return resolved(spark, folder).select("malo_id", "obis_code", F.to_date("from").alias("day"), place.alias("place"), "value")


# The same over a stored table: both tiers, archived, with late corrections ----

STORED = TableConfig("stored", step=timedelta(days=7))
#: Windows of seven days that have ended a week before are archived, so the boundary is day 25.
ARCHIVED = day(32)
_built: dict[tuple[str, str], tuple[Store, DataFrame, int]] = {}


def stored(spark: SparkSession, folder: str) -> tuple[Store, DataFrame, int]:
    """A table with half of the versions, archived, and then the other half appended; what that displaced; the snapshot before it.

    It is built once for an application, in the folder that all executors share.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _built:
        rows = readings(spark, folder)
        store = Store(spark, STORED, f"{checkpoint_folder(spark)}/tidewatt-queries-{uuid.uuid4().hex}")
        store.append(rows.filter(F.col("version") % 2 == 0))
        store.catch_up(ARCHIVED)
        before = store.tiers.latest().id
        _built[key] = store, store.append(rows.filter(F.col("version") % 2 == 1)), before
    return _built[key]


def _stored(name: str, statement: str, sql: str, view=lambda store, before: store) -> None:
    def run(spark, folder):
        store, _, before = stored(spark, folder)
        return view(store, before).sql(statement).df

    run.__name__ = name
    query(sql)(run)


_SUM = "SELECT count(*) AS n, CAST(sum(value) AS DECIMAL(28,6)) AS total FROM stored"
_BEST = "QUALIFY row_number() OVER (PARTITION BY malo_id, obis_code, \"from\", version_scope ORDER BY version DESC, recorded_at DESC) = 1"
_bounds = "`from` >= TIMESTAMP '2024-01-{:02}' AND `from` < TIMESTAMP '2024-01-{:02}'"

_stored("stored_sum", _SUM, f"SELECT count(*) AS n, {TOTAL} FROM resolved")
_stored("stored_versions", "SELECT sparte, count(*) AS n FROM stored_versions GROUP BY sparte", "SELECT sparte, count(*) AS n FROM versions GROUP BY sparte")
for _name, _start, _end in (("stored_cold_range", 5, 10), ("stored_hot_range", 26, 29), ("stored_both_tiers", 22, 28)):
    _where = _bounds.format(_start, _end)
    _stored(_name, f"SELECT balancing_day, sparte, count(*) AS n, CAST(sum(value) AS DECIMAL(28,6)) AS total FROM stored WHERE {_where} GROUP BY 1, 2", f"SELECT balancing_day, sparte, count(*) AS n, {TOTAL} FROM resolved WHERE {_where.replace('`', chr(34))} GROUP BY 1, 2")
_stored("stored_as_of", _SUM, f"SELECT count(*) AS n, {TOTAL} FROM (SELECT * FROM versions WHERE version % 2 = 0 AND \"from\" < TIMESTAMP '2024-01-25' {_BEST})", lambda store, before: store.as_of(before))
_stored("stored_as_of_ceiling", _SUM, f"SELECT count(*) AS n, {TOTAL} FROM (SELECT * FROM versions WHERE version <= 20240101000500 AND \"from\" < TIMESTAMP '2024-01-25' {_BEST})", lambda store, _: store.as_of(store.tiers.latest().id, 20240101000500))
_stored("stored_as_known_at", _SUM, f"SELECT count(*) AS n, {TOTAL} FROM (SELECT * FROM versions WHERE recorded_at <= TIMESTAMP '2024-01-15' {_BEST})", lambda store, _: store.as_known_at(day(15)))
_stored("stored_scoped", _SUM, f"SELECT count(*) AS n, {TOTAL} FROM resolved WHERE obis_code = '1-0:2.8.0'", lambda store, _: store.scoped("obis_code", "1-0:2.8.0"))
_stored("stored_historical", _SUM, f"SELECT count(*) AS n, {TOTAL} FROM resolved WHERE \"from\" < TIMESTAMP '2024-01-25'", lambda store, _: store.in_read_mode(ReadMode.HISTORICAL))
_stored("stored_operational", _SUM, f"SELECT count(*) AS n, {TOTAL} FROM resolved WHERE \"from\" >= TIMESTAMP '2024-01-25'", lambda store, _: store.in_read_mode(ReadMode.OPERATIONAL))
_stored("stored_report", "SELECT * FROM meter_completeness(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-27')", f"SELECT malo_id, obis_code, sparte, resolution, {_FLAGS} FROM ({_ROLLUP})")
_stored("stored_healthy", "SELECT watermark = TIMESTAMP '2024-01-25' AS at_day_25, healthy, invariant_violations AS violations FROM system_tables", "SELECT true AS at_day_25, true AS healthy, CAST(0 AS BIGINT) AS violations", lambda store, _: store)


@query(
    f"""SELECT effect, count(*) AS n, CAST(sum(prior) AS DECIMAL(28,6)) AS prior FROM (
  SELECT CASE WHEN o IS NULL THEN 'inserted' WHEN version > o THEN 'superseded' ELSE 'shadowed' END AS effect, CASE WHEN version > o THEN ov END AS prior FROM (
    SELECT *, max(version) OVER w AS o, arg_max(value, version) OVER w AS ov FROM versions WINDOW w AS (PARTITION BY malo_id, obis_code, "from", version_scope ORDER BY (version % 2 = 1), version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE version % 2 = 1) GROUP BY effect"""
)
def stored_late_corrections(spark, folder):
    """What appending the other half of the versions displaced, most of it in the archived tier."""
    report = stored(spark, folder)[1]
    return report.groupBy("effect").agg(F.count("*").alias("n"), F.sum("prior_value").cast("decimal(28,6)").alias("prior"))


@query("SELECT a.sparte, count(*) AS n, CAST(sum(a.value - b.value) AS DECIMAL(28,6)) AS change FROM resolved a JOIN (SELECT * FROM versions WHERE obis_code = '1-0:1.8.0' AND version % 3 = 0 " + _BEST + ") b ON a.malo_id = b.malo_id AND a.obis_code = b.obis_code AND a.\"from\" = b.\"from\" WHERE a.\"from\" >= TIMESTAMP '2024-01-05' AND a.\"from\" < TIMESTAMP '2024-01-12' GROUP BY a.sparte")
def stored_two_tables(spark, folder):
    """Two tables with boundaries of their own in one statement; each is read over the range that it needs."""
    store = stored(spark, folder)[0]
    other = Store(spark, TableConfig("thirds", step=timedelta(days=7)), f"{checkpoint_folder(spark)}/tidewatt-queries-{uuid.uuid4().hex}")
    other.append(readings(spark, folder).filter((F.col("obis_code") == "1-0:1.8.0") & (F.col("version") % 3 == 0)))
    statement = "SELECT a.sparte, count(*) AS n, CAST(sum(a.value - b.value) AS DECIMAL(28,6)) AS change FROM stored a JOIN thirds b ON a.malo_id = b.malo_id AND a.obis_code = b.obis_code AND a.`from` = b.`from` WHERE a.`from` >= TIMESTAMP '2024-01-05' AND a.`from` < TIMESTAMP '2024-01-12' GROUP BY a.sparte"
    return Catalog((store, other)).sql(statement).df


# Generic SQL over several tables ---------------------------------------------


@query("SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", head=False)
def two_table_join(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = lines.join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _plain(name: str, text: str, tables: str) -> None:
    def run(spark, folder):
        views = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables.split()}
        return spark.sql(text.format(**{t: "{" + t + "}" for t in views}), **views)

    run.__name__ = name
    query(text.format(**{t: t for t in tables.split()}), head=False)(run)


_plain("two_table_union_all", "SELECT 'order' AS kind, o_custkey AS party, o_totalprice AS amount FROM {orders} UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM {customer}", "orders customer")
_plain("scalar_subqueries", "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS customers, (SELECT max(o_totalprice) FROM {orders}) AS top FROM {nation}", "nation customer orders")
_plain("cte_count", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 100000), few AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM few GROUP BY n", "orders")
_plain("filtered_aggregates", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS many, count(DISTINCT l_suppkey) AS suppliers, min(l_quantity) AS low, max(l_quantity) AS high FROM {lineitem} GROUP BY l_returnflag", "lineitem")
_plain("predicates", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_size IN (1, 5, 9, 14) AND p_brand IS NOT NULL AND NOT (p_retailprice < 910) AND CAST(p_partkey AS VARCHAR(10)) IS DISTINCT FROM '7'", "part")
_plain("semi_and_anti_joins", "SELECT 'with' AS kind, count(*) AS n FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)", "customer orders")
_plain("set_operations", "(SELECT n_regionkey AS k FROM {nation} INTERSECT SELECT r_regionkey FROM {region}) EXCEPT SELECT c_nationkey FROM {customer} WHERE c_nationkey < 3", "nation region customer")
_plain("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING count(*) > 5", "orders")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Settled quantity by balancing day and commodity over both tiers, with corrections applied."""
    rows = within(spark, folder, None, None)
    return rows.groupBy("balancing_day", "sparte", "unit").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,6)").alias("total"))


query(f"SELECT balancing_day, sparte, unit, count(*) AS n, {TOTAL} FROM resolved GROUP BY ALL")(flagship)
