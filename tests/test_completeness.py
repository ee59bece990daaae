"""Gaps, changes of grid and silent channels on small hand-made tables."""

from datetime import date, datetime, timedelta, timezone

import pytest

from tidewatt.operators.completeness import completeness

START = datetime(2026, 3, 27, 23, tzinfo=timezone.utc)  # midnight in Berlin; the clock changes on the 29th
SCHEMA = "malo_id string, obis_code string, sparte string, resolution string, `from` timestamp, quality string"


def rows(spark, *parts):
    out = []
    for malo, grid, minutes, first, count, *skip in parts:
        out += [(malo, "1-0:1.8.0", "STROM", grid, START + timedelta(minutes=first + minutes * i), "MEASURED") for i in range(count) if i not in skip]
    return spark.createDataFrame(out, SCHEMA)


def report(spark, df, days=3, **kw):
    end = START + timedelta(days=days) - timedelta(hours=1)
    return {(r.malo_id, r.resolution): r for r in completeness(df, START, end, **kw).collect()}


def test_clock_change_and_gap(spark):
    found = report(spark, rows(spark, ("a", "PT15M", 15, 0, 96 + 92 + 96), ("b", "PT15M", 15, 0, 284, 100, 101), ("c", "P1M", 15, 0, 4), ("d", None, 15, 0, 4)))
    a, b, c, d = found["a", "PT15M"], found["b", "PT15M"], found["c", "P1M"], found["d", None]
    assert (a.expected, a.actual, a.missing, a.complete, a.measurable) == (284, 284, 0, True, True)
    assert (b.missing, b.first_gap, b.complete) == (2, date(2026, 3, 29), False)
    assert (c.expected, c.missing, c.measurable) == (0, 0, False) and not d.measurable


def test_absent_days_go_to_the_grid_in_force(spark):
    df = rows(spark, ("a", "PT1H", 60, 0, 24), ("a", "PT30M", 30, 2 * 24 * 60 - 60, 48), ("b", "PT1H", 60, 24 * 60, 23))
    found = report(spark, df)
    assert (found["a", "PT1H"].missing, found["a", "PT1H"].first_gap) == (23, date(2026, 3, 29))
    assert found["a", "PT30M"].missing == 0
    assert (found["b", "PT1H"].missing, found["b", "PT1H"].first_gap) == (48, date(2026, 3, 28))


def test_change_of_grid_inside_a_day(spark):
    clean = report(spark, rows(spark, ("a", "PT1H", 60, 0, 12), ("a", "PT15M", 15, 720, 48)), days=1 + 1 / 24)
    assert (clean["a", "PT15M"].missing, clean["a", "PT15M"].surplus, clean["a", "PT15M"].expected, clean["a", "PT1H"].expected) == (0, 0, 96, 0)
    double = report(spark, rows(spark, ("a", "PT1H", 60, 0, 13), ("a", "PT15M", 15, 720, 40)), days=1 + 1 / 24)
    assert (double["a", "PT15M"].missing, double["a", "PT15M"].surplus) == (8, 4)


def test_silent_channels(spark):
    df = rows(spark, ("a", "PT1H", 60, 0, 24))
    roster = spark.createDataFrame([("a", "1-0:1.8.0", "STROM", "PT15M"), ("z", "1-0:1.8.0", "STROM", "PT1H")], "malo_id string, obis_code string, sparte string, resolution string")
    found = report(spark, df, days=1 + 1 / 24, roster=roster)
    assert set(found) == {("a", "PT1H"), ("z", "PT1H")}
    z = found["z", "PT1H"]
    assert (z.expected, z.actual, z.missing, z.first_gap) == (24, 0, 24, date(2026, 3, 28))


@pytest.mark.parametrize("days", [3])
def test_empty_table(spark, days):
    assert report(spark, rows(spark), days=days) == {}


@pytest.mark.parametrize("grid, minutes", [("PT1M", 1), ("PT15M", 15), ("PT1H", 60), ("P1D", 0)])
@pytest.mark.parametrize("day", [datetime(2026, 3, 28, 23, tzinfo=timezone.utc), datetime(2026, 10, 24, 22, tzinfo=timezone.utc), datetime(2026, 7, 1, 22, tzinfo=timezone.utc)])
def test_a_cut_day_expects_the_starts_that_are_left(spark, grid, minutes, day):
    """A day of 23, 25 or 24 hours, cut at every grid point, and a microsecond beside it."""
    from tidewatt.operators.completeness import expectations

    from functools import reduce

    from pyspark.sql import functions as F

    length = {3: 23, 10: 25}.get(day.month, 24) * 60
    step = minutes or length
    grids = spark.createDataFrame([("STROM", grid)], "sparte string, grid string")
    tick, rest = timedelta(microseconds=1), day + timedelta(minutes=length)
    cuts = [day + timedelta(minutes=m // step * step) + shift for m in (29, 301, length - 1) for shift in (timedelta(), tick)]
    cuts = [c for c in cuts if day < c < rest]
    held = [expectations(grids, day, c).select(F.lit(i).alias("cut"), F.lit(0).alias("side"), "expected") for i, c in enumerate(cuts)]
    held += [expectations(grids, c, rest).select(F.lit(i).alias("cut"), F.lit(1).alias("side"), "expected") for i, c in enumerate(cuts)]
    got = {(r.cut, r.side): r.expected for r in reduce(lambda x, y: x.unionByName(y), held).collect()}
    for i, cut in enumerate(cuts):
        before = sum(day + timedelta(minutes=m) < cut for m in range(0, length, step))
        assert (got[i, 0], got[i, 1]) == (before, length // step - before), (grid, cut)


def plain_force(days):
    """The grid in force after each reported day, one by one."""
    force, out = None, []
    for i, (grids, closing) in enumerate(days):
        force = closing or (force if force in grids else grids[0])
        out.append(force)
    return out


def test_the_grid_in_force_equals_a_plain_fold(spark):
    import random

    from tidewatt.operators.completeness import absent_days, expectations

    rng = random.Random(3)
    zero, last = date(2026, 5, 1), 40
    start, end = datetime(2026, 4, 30, 22, tzinfo=timezone.utc), datetime(2026, 4, 30, 22, tzinfo=timezone.utc) + timedelta(days=last)
    names, rows, want = ["P1D", "P1M", "PT15M", "PT1H"], [], {}
    count = {"P1D": 1, "P1M": 0, "PT15M": 96, "PT1H": 24}
    for channel in range(60):
        reported = sorted(rng.sample(range(last), rng.randint(1, 30)))
        days = []
        for d in reported:
            grids = sorted(rng.sample(names, rng.choice([1, 1, 2, 3])))
            closing = rng.choice([None, rng.choice(grids)]) if len(grids) > 1 else None
            days.append((grids, closing))
            rows.append((f"m{channel}", "1-0:1.8.0", "STROM", zero + timedelta(days=d), grids, closing))
        force = plain_force(days)
        missing = dict.fromkeys(names, 0)
        for d in set(range(last)) - set(reported):
            before = [i for i, r in enumerate(reported) if r < d]
            missing[force[before[-1]] if before else days[0][0][0]] += 1
        want[f"m{channel}"] = {g: n * count[g] for g, n in missing.items() if n * count[g]}
    df = spark.createDataFrame(rows, "malo_id string, obis_code string, sparte string, day date, grids array<string>, closing string")
    plan = expectations(spark.createDataFrame([("STROM", g) for g in names], "sparte string, grid string"), start, end)
    got = {m: {} for m in want}
    for r in absent_days(df, plan, ["malo_id", "obis_code", "sparte"], start, end).collect():
        got[r.malo_id][r.grid] = got[r.malo_id].get(r.grid, 0) + r.missing
    assert got == want
