"""The metering functions on fixed vectors, as SQL functions and as columns."""

import pytest

from tidewatt.functions import FUNCTIONS, call, register
from tidewatt.operators.writes import CHECKS

VECTORS = [
    ("meter_local_day(timestamp'2026-07-20T23:00:00Z')", "2026-07-21"),
    ("meter_local_month(timestamp'2026-07-31T23:00:00Z')", "2026-08-01"),
    ("meter_gas_day(timestamp'2026-07-15T03:00:00Z')", "2026-07-14"),
    ("meter_gas_day(timestamp'2026-07-15T04:00:00Z')", "2026-07-15"),
    ("meter_gas_day(timestamp'2026-01-15T04:59:00Z')", "2026-01-14"),
    ("meter_gas_day(timestamp'2026-01-15T05:00:00Z')", "2026-01-15"),
    ("meter_local_day(timestamp'1850-01-01T00:00:00Z')", None),
    ("meter_balancing_month(timestamp'2026-03-01T01:00:00Z', 'STROM')", "2026-03-01"),
    ("meter_balancing_month(timestamp'2026-03-01T01:00:00Z', 'GAS')", "2026-02-01"),
    ("meter_balancing_day(CAST(NULL AS TIMESTAMP), 'GAS')", None),
    ("meter_expected_intervals(date'2026-07-20', 'PT15M')", "96"),
    ("meter_expected_intervals(date'2026-03-29', 'PT15M')", "92"),
    ("meter_expected_intervals(date'2026-10-25', 'PT15M')", "100"),
    ("meter_expected_intervals(date'2026-10-25', 'PT1H')", "25"),
    ("meter_expected_intervals(date'2026-07-20', 'PT30M')", "48"),
    ("meter_expected_intervals(date'2026-10-25', 'PT1M')", "1500"),
    ("meter_expected_intervals(date'2026-07-20', 'P1M')", None),
    ("meter_expected_intervals(date'2026-10-24', 'PT15M', 'GAS')", "100"),
    ("meter_expected_intervals(date'2026-10-25', 'PT15M', 'GAS')", "96"),
    ("obis_direction('1-0:1.8.0')", "IMPORT"),
    ("obis_direction('1-0:2.29.0')", "EXPORT"),
    ("obis_direction('1-0:3.8.0')", None),
    ("obis_is_import('7-1:99.33.0')", "False"),
    ("obis_is_export('7-1:99.33.0')", "False"),
    ("obis_tariff_register('1-0:1.8.1')", "1"),
    ("obis_tariff_register('1-0:1.8.0')", None),
    ("obis_tariff_register('1-0:1.8.63')", None),
    ("obis_normalise('1-0:1.8.0*255')", "1-0:1.8.0"),
    ("obis_normalise(' 1-00:01.8.0*1 ')", "1-0:1.8.0*1"),
    ("quality_market_code('MEASURED')", "220"),
    ("quality_market_code('ESTIMATED')", "187"),
    ("quality_market_code('UNKNOWN')", None),
    ("quality_is_billable('SUBSTITUTED')", "True"),
    ("quality_is_billable('FAULTY')", "False"),
    ("quality_is_billable(NULL)", None),
    ("eic_regelzone('11YN000000000016')", "TENNET"),
    ("eic_regelzone('11YV00000000001D')", "FIFTY_HERTZ"),
    ("eic_regelzone('11XBK0000000001A')", None),
    ("eic_regelzone('11YN000000000017')", None),
    ("eic_normalise('  11xbk0000000001a  ')", "11XBK0000000001A"),
    ("eic_normalise('10X---ENTSOE---L')", "10X---ENTSOE---L"),
    ("eic_normalise('10X168Y4E6H0041Z')", "10X168Y4E6H0041Z"),
    ("eic_object_type('11QBK0000000001Y')", None),
]


def test_vectors(spark):
    register(spark)
    row = spark.sql("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(VECTORS))).first()
    assert [(e, None if x is None else str(x)) for (e, _), x in zip(VECTORS, row, strict=True)] == VECTORS


def test_columns_and_names(spark):
    assert len(FUNCTIONS) == 24
    assert spark.range(1).select(call("obis_direction", "'1-0:1.8.0'")).first().obis_direction == "IMPORT"


@pytest.mark.parametrize("bad", ["meter_balancing_day(timestamp'2026-01-01', 'OEL')", "meter_expected_intervals(date'2026-01-01', 'PT900S')", "obis_is_import('not-an-obis-code')", "obis_normalise('1-0:256.8.0')", "quality_market_code('GOOD')"])
def test_errors(spark, bad):
    register(spark)
    with pytest.raises(Exception, match="unknown|not an OBIS"):
        spark.sql(f"SELECT {bad}").collect()


def test_identifiers(spark):
    cases = [("MALO", "41373559241", True), ("MALO", "41373559240", False), ("MALO", "56789012345", True), ("BDEW", "9900000000003", True), ("BDEW", "9900000000029", True), ("BDEW", "9900000000004", False), ("EIC:Y", "11YN000000000016", True), ("EIC:X", "11YN000000000016", None)]
    row = spark.sql("SELECT " + ", ".join(f"{CHECKS[k](repr(v))} AS c{i}" for i, (k, v, _) in enumerate(cases))).first()
    assert [bool(x) for x in row] == [bool(w) for _, _, w in cases]
