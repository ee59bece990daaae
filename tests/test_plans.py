"""Properties of ranges, tiers, resolution and extraction."""

from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatt.plans.predicate import scanned_range
from tidewatt.plans.resolve import FileStats, may_skip_resolution, resolve
from tidewatt.plans.timerange import ReadMode, TimeRange, split
from tidewatt.schema import TableConfig
from tidewatt.sources.adapter import readings

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
at = st.integers(0, 40).map(lambda n: DAY + timedelta(days=n))
ranges = st.builds(TimeRange, st.none() | at, st.none() | at)


@given(ranges, at, at)
def test_every_instant_is_in_one_tier(range_, mark, instant):
    parts = split(range_, mark)
    inside = [bool(p and instant in p) for p in (parts.cold, parts.hot)]
    assert sum(inside) == (instant in range_) and (not inside[0] or instant < mark) and (not inside[1] or instant >= mark)
    assert parts.narrowed(ReadMode.HISTORICAL).hot is None and parts.narrowed(ReadMode.OPERATIONAL).cold is None


@given(ranges, ranges, at)
def test_range_algebra(a, b, instant):
    assert (instant in (a & b)) == (instant in a and instant in b)
    assert not (instant in a or instant in b) or instant in (a | b)


files = st.lists(st.tuples(st.none() | st.tuples(st.integers(1, 3), st.integers(0, 1)), st.none() | st.tuples(st.integers(0, 9), st.integers(0, 3))), max_size=6)


def stats(raw):
    return [FileStats(v and (v[0], v[0] + v[1]), s and (DAY + timedelta(s[0]), DAY + timedelta(s[0] + s[1]))) for v, s in raw]


@given(files)
@settings(max_examples=300)
def test_skipping_is_sound(raw):
    found = stats(raw)
    skip = may_skip_resolution(found)
    assert skip == may_skip_resolution(found[::-1])
    meet = lambda a, b: a.starts is None or b.starts is None or (a.starts[0] <= b.starts[1] and b.starts[0] <= a.starts[1])
    if skip:
        assert all(f.versions and f.versions[0] == f.versions[1] for f in found)
        assert all(a.versions == b.versions for a in found for b in found if meet(a, b))
    if found and all(f.versions and f.versions[0] == f.versions[1] and f.starts for f in found) and not any(meet(a, b) for i, a in enumerate(found) for b in found[:i]):
        assert skip


def test_extraction_never_narrows(spark):
    df = spark.range(30).select(F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT))").alias("from"), "id").checkpoint()
    cases = ["`from` < TIMESTAMP'2024-01-05'", "`from` BETWEEN TIMESTAMP'2024-01-03' AND TIMESTAMP'2024-01-09'", "`from` = TIMESTAMP'2024-01-03' OR id = 7", "`from` > TIMESTAMP'2024-01-20' AND id % 2 = 0", "TIMESTAMP'2024-01-05' >= `from` OR `from` >= TIMESTAMP'2024-01-15'", "NOT `from` < TIMESTAMP'2024-01-05'", "date(`from`) = DATE'2024-01-07'"]
    for case in cases:
        found = scanned_range(df.filter(case))
        for row in df.filter(case).collect():
            assert row["from"].replace(tzinfo=timezone.utc) in found, case
    assert scanned_range(df.filter(cases[0])) == TimeRange(None, datetime(2024, 1, 5, tzinfo=timezone.utc))


def test_naive_sum_differs_and_window_is_limited_early(spark):
    rows = readings(spark, "/root/testdata/sf0.001")
    resolved = resolve(rows, TableConfig().key)
    assert 0 < resolved.count() < rows.count()
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    pushed = resolved.filter("malo_id = '1'")._jdf.queryExecution().optimizedPlan().toString()
    assert pushed.rindex("Filter") > pushed.rindex("Window ")
