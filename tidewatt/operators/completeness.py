"""What a range should hold by the calendar, what it holds, and where the first gap is.

Readings are counted by channel, grid and day once, and these counts, which are
small beside the readings, are written to the shared folder; only if a day has
several grids are the readings of such days looked at again.  The rest is one
lazy plan: the grid in force by windows over each channel's reported days, and
expectations from a small table of days and grids that Spark broadcasts when it
is small.  Absent days are judged as runs, from running totals of the
expectation; they are not materialised.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import checkpoint, empty
from ..functions import call
from ..functions.library import GAS_HOUR, RESOLUTIONS, SPARTEN, ZONE

NONE = "-"  # stands for "no grid" in keys; no resolution has this name


def _day_start(day: str) -> Column:
    hour = f"make_dt_interval(0, CASE WHEN sparte = 'GAS' THEN {GAS_HOUR} ELSE 0 END)"
    return F.expr(f"unix_timestamp(to_utc_timestamp(CAST({day} AS TIMESTAMP) + {hour}, '{ZONE}'))")


def expectations(grids: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``sparte, grid, day, expected`` for each balancing day that ``[start, end)`` touches.

    A day inside the range expects its whole count, 92 or 100 quarter-hours on
    the days of a clock change.  A day that the range cuts expects the interval
    starts in the part that is left.  0 means that the day cannot be judged.
    """
    low, high = F.lit(start), F.lit(end)
    rows = grids.select("sparte", "grid").distinct().withColumns({"__from": low, "__to": high - F.expr("INTERVAL 1 MICROSECOND")})
    rows = rows.withColumns({"first": call("meter_balancing_day", "__from", "sparte"), "last": call("meter_balancing_day", "__to", "sparte")}).filter("first <= last")
    rows = rows.select("sparte", "grid", F.explode(F.sequence("first", "last")).alias("day"))
    known = [*RESOLUTIONS, "P1D"]
    rows = rows.withColumn("known", F.when(F.col("grid").isin(known), F.col("grid")))
    rows = rows.withColumn("whole", F.coalesce(call("meter_expected_intervals", "day", "known", "sparte"), F.lit(0)).cast("long"))
    micros = F.lit(1_000_000).cast("long")
    rows = rows.withColumns({"a": _day_start("day") * micros, "b": _day_start("date_add(day, 1)") * micros, "lo": F.unix_micros(low), "hi": F.unix_micros(high)})
    rows = rows.withColumn("step", F.expr("CASE WHEN whole > 0 THEN (b - a) DIV whole END"))
    before = lambda at: f"(({at}) - a + step - 1) DIV step"  # interval starts of the day before an instant
    starts = F.expr(f"CASE WHEN whole = 0 THEN 0L ELSE {before('least(hi, b)')} - {before('greatest(lo, a)')} END")
    inside = (F.col("a") >= F.col("lo")) & (F.col("b") <= F.col("hi"))
    return rows.select("sparte", "grid", "day", F.when(inside, F.col("whole")).otherwise(F.greatest(starts, F.lit(0))).cast("long").alias("expected"))


def absent_days(days: DataFrame, plan: DataFrame, channel: list[str], start: datetime, end: datetime) -> DataFrame:
    """What is missing on days that nobody delivered on, by channel and grid, a row for each run of such days.

    ``days`` are a channel's reported days with their grids, and the closing
    grid of those judged by coverage.  The grid in force on a day is the
    closing one, the only one, or the one before it if it still delivers; a
    run of absent days before the first goes to the first grid of that day.
    Running totals of the plan say what a run should have held.
    """
    along = Window.partitionBy(*channel).orderBy("day")
    sure = F.coalesce("closing", F.when((F.size("grids") == 1) | (F.row_number().over(along) == 1), F.col("grids")[0]))
    days = days.withColumn("sure", sure)
    days = days.withColumn("stretch", F.count("sure").over(along))
    since = Window.partitionBy(*channel, "stretch").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = "aggregate(slice(past, 2, size(past)), first_grid, (grid, grids) -> CASE WHEN array_contains(grids, grid) THEN grid ELSE grids[0] END)"
    days = days.withColumns({"past": F.collect_list(F.when(F.col("sure").isNull(), F.col("grids")).otherwise(F.array(F.lit("-")))).over(since), "first_grid": F.first("sure").over(since)})
    force = F.when(F.col("sure").isNull(), F.expr(kept)).otherwise(F.col("sure"))
    days = days.select(*channel, "day", force.alias("grid"), F.col("grids")[0].alias("opened_on"), F.lag("day").over(along).alias("previous"), F.lead("day").over(along).alias("following"))

    instants = {"__from": F.lit(start), "__to": F.lit(end) - F.expr("INTERVAL 1 MICROSECOND")}
    bounds = {"opening": call("meter_balancing_day", "__from", "sparte"), "last": call("meter_balancing_day", "__to", "sparte")}
    runs = days.select(*channel, "grid", F.date_add("day", 1).alias("low"), F.date_sub("following", 1).alias("high"))
    runs = runs.unionByName(days.filter("previous IS NULL").select(*channel, F.col("opened_on").alias("grid"), F.lit(None).cast("date").alias("low"), F.date_sub("day", 1).alias("high")))
    runs = runs.withColumns(instants).withColumns(bounds).select(*channel, "grid", F.coalesce("low", "opening").alias("low"), F.coalesce("high", "last").alias("high")).filter("low <= high")

    order = Window.partitionBy("sparte", "grid").orderBy("day")
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    totals = plan.withColumns({"upto": F.sum("expected").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "due": F.min(F.when(F.col("expected") > 0, F.col("day"))).over(ahead)})
    first = totals.select("sparte", "grid", F.col("day").alias("low"), (F.col("upto") - F.col("expected")).alias("before"), "due")
    final = totals.select("sparte", "grid", F.col("day").alias("high"), "upto")
    runs = runs.join(first, ["sparte", "grid", "low"]).join(final, ["sparte", "grid", "high"]).withColumn("expected", F.col("upto") - F.col("before")).filter("expected > 0")
    return runs.select(*channel, "grid", "expected", F.col("expected").alias("missing"), F.lit(0).cast("long").alias("surplus"), F.col("due").alias("first_gap"))


def daily(resolved: DataFrame, discriminators: tuple[str, ...] = ()) -> DataFrame:
    """Readings by channel, grid, day and quality."""
    day = call("meter_balancing_day", "`from`", "sparte").alias("day")
    return resolved.groupBy("malo_id", "obis_code", *discriminators, "sparte", "resolution", day, "quality").agg(F.count("*").alias("actual"))


def mixed_coverage(resolved: DataFrame, mixed: DataFrame, plan: DataFrame, start: datetime, end: datetime, channel: list[str]) -> DataFrame:
    """Days on which several grids delivered, judged by the time that their rows cover.

    Uncovered time is missing, time covered twice is surplus, both in intervals
    of the finest grid and rounded up.  The day is charged to the grid whose
    row starts last.  Days with a grid of no fixed length are left out.
    """
    seconds = "CASE grid " + " ".join(f"WHEN '{r}' THEN {s}" for r, s in RESOLUTIONS.items()) + " END"
    rows = resolved.withColumns({"grid": F.coalesce("resolution", F.lit(NONE)), "day": call("meter_balancing_day", "`from`", "sparte")}).join(mixed, [*channel, "day"], "left_semi")
    rows = rows.withColumns({"step": F.expr(seconds), "lo": F.greatest(_day_start("day"), F.lit(start).cast("long")), "hi": F.least(_day_start("date_add(day, 1)"), F.lit(end).cast("long"))})
    rows = rows.withColumns({"a": F.greatest(F.col("from").cast("long"), "lo"), "b": F.least(F.col("from").cast("long") + F.col("step"), "hi")})
    order = Window.partitionBy(*channel, "day").orderBy("a", "b")
    rows = rows.withColumn("reach", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    held = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(0)
    new = F.greatest(F.col("b") - F.greatest("a", F.coalesce("reach", "a")), F.lit(0))
    days = rows.groupBy(*channel, "day").agg(
        F.max_by("grid", F.struct("from", "grid")).alias("closing"), F.min_by("grid", F.struct("step", "grid")).alias("finest"), F.min("step").alias("step"),
        F.count_if(F.col("step").isNull()).alias("open"), F.sum(held).alias("total"), F.sum(new).alias("covered"), F.first(F.col("hi") - F.col("lo")).alias("length"),
    ).filter("open = 0 and length > 0")
    days = days.join(plan.select("sparte", F.col("grid").alias("finest"), "day", "expected"), ["sparte", "finest", "day"])
    units = lambda time: F.expr(f"({time} + step - 1) DIV step")
    return days.select(*channel, "day", "closing", "expected", units("length - covered").alias("missing"), units("total - covered").alias("surplus"))


def completeness(resolved: DataFrame, start: datetime, end: datetime, *, discriminators: tuple[str, ...] = (), roster: DataFrame | None = None) -> DataFrame:
    """The gap report of the resolved readings in ``[start, end)``: a row for each channel and grid.

    A day that a grid delivered on is judged by it.  A day that nobody
    delivered on is judged once, by the grid last in force, or before the first
    delivery by the first.  A grid stays in force while it still delivers.
    Missing and surplus are summed by day and never netted.  Channels of
    ``roster`` without a reading in the range are added as silent.
    """
    channel = ["malo_id", "obis_code", *discriminators, "sparte"]
    resolved = resolved.filter((F.col("from") >= F.lit(start)) & (F.col("from") < F.lit(end)))
    spark, day = resolved.sparkSession, [*channel, "day"]
    grid = F.coalesce("resolution", F.lit(NONE)).alias("grid")
    cells = resolved.groupBy(*channel, grid, call("meter_balancing_day", "`from`", "sparte").alias("day")).agg(
        F.count("*").alias("actual"), F.count_if(F.col("quality") == "SUBSTITUTED").alias("substituted"), F.count_if(~call("quality_is_billable", "quality")).alias("not_billable")
    )
    cells = checkpoint(cells.withColumn("grids", F.array_sort(F.collect_set("grid").over(Window.partitionBy(*(f"`{c}`" for c in day))))))
    every = F.explode(F.array(*(F.struct(F.lit(s).alias("sparte"), F.lit(g).alias("grid")) for s in SPARTEN for g in (*RESOLUTIONS, "P1D")))).alias("x")
    plan = checkpoint(expectations(spark.range(1).select(every).select("x.*"), start, end))

    several = cells.filter(F.size("grids") > 1)
    if several.limit(1).count():
        covered = checkpoint(mixed_coverage(resolved, several.select(*day).distinct(), plan, start, end, channel))
    else:
        covered = empty(spark, T.StructType([*(f for f in cells.schema if f.name in day), T.StructField("closing", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("expected", "missing", "surplus"))]))
    expected = cells.join(plan.filter("expected > 0"), ["sparte", "grid", "day"], "left").join(covered.select(*day, "closing", *(F.col(n).alias(f"covered_{n}") for n in ("expected", "missing", "surplus"))), day, "left")
    judged, charged = F.col("closing").isNull() & F.col("expected").isNotNull(), F.col("closing") == F.col("grid")
    more = lambda x, y: F.greatest(F.col(x) - F.col(y), F.lit(0))
    value = lambda own, name: F.when(judged, own).when(charged, F.col(f"covered_{name}")).otherwise(0)
    rows = expected.select(*channel, "grid", "day", "grids", "closing", "actual", "substituted", "not_billable", value(F.col("expected"), "expected").alias("due"), value(more("expected", "actual"), "missing").alias("missing"), value(more("actual", "expected"), "surplus").alias("surplus"))
    days = rows.filter(F.col("grid") == F.col("grids")[0]).select(*day, "grids", "closing")
    rows = rows.select(*channel, "grid", "actual", "substituted", "not_billable", F.col("due").alias("expected"), "missing", "surplus", F.when(F.col("missing") > 0, F.col("day")).alias("first_gap"))
    sums = rows.unionByName(absent_days(days, plan, channel, start, end), allowMissingColumns=True)
    report = sums.groupBy(*channel, "grid").agg(*(F.sum(n).alias(n) for n in ("actual", "substituted", "not_billable", "expected", "missing", "surplus")), F.min("first_gap").alias("first_gap")).filter("actual IS NOT NULL")
    if roster is not None:
        seen = roster.withColumn("grid", F.coalesce("resolution", F.lit(NONE)))
        silent = seen.join(cells, [c for c in channel if c != "sparte"], "left_anti").groupBy(*[c for c in channel if c != "sparte"]).agg(F.min(F.struct("sparte", "grid")).alias("g"))
        silent = silent.select(*[c for c in channel if c != "sparte"], "g.sparte", "g.grid")
        due = plan.groupBy("sparte", "grid").agg(F.sum("expected").alias("expected"), F.min(F.when(F.col("expected") > 0, F.col("day"))).alias("first_gap"))
        zero = F.lit(0).cast("long")
        silent = silent.join(due, ["sparte", "grid"], "left").select(*channel, "grid", zero.alias("actual"), zero.alias("substituted"), zero.alias("not_billable"), "expected", F.col("expected").alias("missing"), zero.alias("surplus"), "first_gap")
        report = report.unionByName(silent)
    zero_if_null = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expected", "actual", "missing", "surplus")]
    report = report.select("malo_id", "obis_code", *discriminators, "sparte", F.when(F.col("grid") != NONE, F.col("grid")).alias("resolution"), *zero_if_null, "first_gap", F.col("substituted").cast("long").alias("substituted"), F.col("not_billable").cast("long").alias("not_billable"))
    return report.withColumns({"complete": (F.col("missing") == 0) & (F.col("surplus") == 0), "measurable": F.col("resolution").isNotNull() & (F.col("expected") > 0)})
