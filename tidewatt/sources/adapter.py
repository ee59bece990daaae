"""The test table ``events`` as readings, so that every operator has versions to work on."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import call
from ..schema import VALUE, VERSION

WATERMARK = datetime(2024, 1, 20, tzinfo=timezone.utc)
# Channel, commodity and quality codes by event type, user and event.
CHANNELS = {"view": "1-0:1.8.0", "click": "1-0:2.8.0", "purchase": "1-0:1.29.0", "signup": "1-0:3.8.0", "error": "1-0:1.8.63"}
SPARTE = "element_at(array('STROM', 'GAS', 'WAERME', 'WASSER'), CAST(user_id % 4 + 1 AS INT))"
QUALITY = "element_at(array('MEASURED', 'SUBSTITUTED', 'ESTIMATED', 'PRELIMINARY', 'FAULTY', 'CALCULATED', 'CORRECTED', 'UNKNOWN'), CAST(event_id % 8 + 1 AS INT))"
MALO = "concat(p, CAST(pmod(-aggregate(sequence(1, 10), 0, (s, i) -> s + CAST(substr(p, i, 1) AS INT) * (2 - i % 2)), 10) AS STRING))"


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every version, one per event; events of a user, type and day are versions of one reading."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{folder}/events.parquet").withColumns({"at": F.col("ts").cast("timestamp"), "p": F.expr("CAST(1000000000 + user_id AS STRING)")})
    channel = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNELS.items())
    rows = events.select(
        F.expr(MALO).alias("malo_id"),
        F.lit(None).cast("string").alias("melo_id"),
        F.expr(f"CASE event_type {channel} END").alias("obis_code"),
        F.expr(SPARTE).alias("sparte"),
        F.date_trunc("day", "at").alias("from"),
        F.expr("date_trunc('day', at) + INTERVAL 1 DAY").alias("to"),
        F.col("value").cast(VALUE).alias("value"),
        F.expr("CASE WHEN user_id % 4 = 3 THEN 'M3' ELSE 'KWH' END").alias("unit"),
        F.expr(QUALITY).alias("quality"),
        F.lit("P1D").alias("resolution"),
        F.lit("MSCONS").alias("source_kind"),
        F.lit(None).cast("string").alias("source_detail"),
        F.lit(None).cast("string").alias("provenance"),
        F.expr("20240101000000 + event_id").cast(VERSION).alias("version"),
        F.expr("at + make_dt_interval(CAST(event_id % 10 AS INT))").alias("recorded_at"),
    )
    rows = rows.withColumn("balancing_day", call("meter_balancing_day", "`from`", "sparte"))
    return rows.withColumn("version_scope", F.concat(F.lit("9900000000003:"), F.date_format("balancing_day", "yyyy-MM"))).select(
        "malo_id", "melo_id", "obis_code", "sparte", "from", "to", "value", "unit", "quality", "resolution", "source_kind", "source_detail", "provenance", "version", "version_scope", "recorded_at", "balancing_day"
    )


#: The same in DuckDB, as the head of every oracle query.
SQL = f"""
WITH e AS (SELECT *, CAST(1000000000 + user_id AS VARCHAR) AS p FROM events),
v0 AS (
  SELECT p || CAST((10 - list_sum([CAST(substr(p, i, 1) AS INT) * (2 - i % 2) FOR i IN range(1, 11)]) % 10) % 10 AS VARCHAR) AS malo_id,
    CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNELS.items())} END AS obis_code,
    ['STROM', 'GAS', 'WAERME', 'WASSER'][user_id % 4 + 1] AS sparte,
    CAST(date_trunc('day', ts) AS TIMESTAMP) AS "from", CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS "to",
    CAST(value AS DECIMAL(18,6)) AS value, CASE WHEN user_id % 4 = 3 THEN 'M3' ELSE 'KWH' END AS unit,
    ['MEASURED','SUBSTITUTED','ESTIMATED','PRELIMINARY','FAULTY','CALCULATED','CORRECTED','UNKNOWN'][event_id % 8 + 1] AS quality,
    'P1D' AS resolution, 20240101000000 + event_id AS version, CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 10 AS INT)) AS recorded_at
  FROM e
), v1 AS (
  SELECT *, ("from" AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS local_from FROM v0
), v2 AS (
  SELECT *, CAST(CASE WHEN sparte = 'GAS' THEN local_from - INTERVAL 6 HOUR ELSE local_from END AS DATE) AS balancing_day FROM v1
), versions AS (
  SELECT *, '9900000000003:' || strftime(balancing_day, '%Y-%m') AS version_scope FROM v2
), resolved AS (
  SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY malo_id, obis_code, "from", version_scope ORDER BY version DESC, recorded_at DESC) = 1
)
"""
