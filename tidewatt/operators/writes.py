"""Checks before a write, and what a write changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import call
from ..functions.library import CANONICAL_OBIS, EIC_TYPES, FUNCTIONS, QUALITIES, RESOLUTIONS, SPARTEN
from ..schema import UNITS, VALUE, VERSION, TableConfig

#: Instants of a version that states no number: milliseconds, below any stated version.
STATED_DIGITS = 14


def alternating_check(code: str, digits: int) -> str:
    """Whether the last of ``digits`` digits checks the others: weights 1 and 2 in turn, modulo 10."""
    total = f"aggregate(sequence(1, {digits - 1}), 0, (s, i) -> s + CAST(substr({code}, i, 1) AS INT) * (2 - i % 2))"
    return f"({code} RLIKE '^[0-9]{{{digits}}}$' AND pmod(-({total}), 10) = CAST(substr({code}, {digits}, 1) AS INT))"


#: Identifier checks that a column can be declared with.
CHECKS = {
    "MALO": lambda c: alternating_check(c, 11),
    "MELO": lambda c: f"({c} RLIKE '^[A-Z]{{2}}[0-9A-Z]{{31}}$')",
    "BDEW": lambda c: alternating_check(c, 13),
    "EIC": lambda c: f"({FUNCTIONS['eic_normalise'].sql(c)} = {c})",
} | {f"EIC:{t}": lambda c, t=t: f"({FUNCTIONS['eic_normalise'].sql(c)} = {c} AND substr({c}, 3, 1) = '{t}')" for t in EIC_TYPES}


def arrival_version(recorded_at: str = "recorded_at") -> Column:
    """The version of rows that state none: when they were recorded, in milliseconds."""
    return F.unix_millis(recorded_at).cast(VERSION)


def encode(df: DataFrame, config: TableConfig) -> DataFrame:
    """Rows as they are stored: checked, with the balancing day, in the table's columns and order.

    A row that breaks a rule fails the job that reads it, with the rule's name;
    nothing is rounded, filtered or corrected.  Rows without a version column
    have the version of their arrival.
    """
    if "version" not in df.columns:
        df = df.withColumn("version", arrival_version())
    units = " OR ".join(f"(sparte = '{s}' AND unit IN ({', '.join(repr(u) for u in us)}))" for s, us in UNITS.items())
    grids = [*RESOLUTIONS, "P1D", "P1M", "P1Y"]
    day = call("meter_balancing_day", "`from`", "sparte")
    rules = {
        "a required column is null": " OR ".join(f"`{f.name}` IS NULL" for f in config.schema if not f.nullable and f.name != "balancing_day"),
        "the market location has a wrong check digit": f"NOT {alternating_check('malo_id', 11)}",
        "the channel is not in canonical form": f"CASE WHEN obis_code RLIKE '{CANONICAL_OBIS}' THEN false ELSE {FUNCTIONS['obis_normalise'].sql('obis_code')} <> obis_code END",
        "the commodity is unknown": f"sparte NOT IN ({', '.join(repr(s) for s in SPARTEN)})",
        "the unit does not belong to the commodity": f"NOT ({units})",
        "the quality is unknown": f"quality NOT IN ({', '.join(repr(q) for q in QUALITIES)})",
        "the resolution is unknown": f"resolution NOT IN ({', '.join(repr(g) for g in grids)})",
        "the value has more than six decimals or is too large": "try_cast(value AS DECIMAL(18,6)) IS NULL OR try_cast(value AS DECIMAL(18,6)) <> value",
        "an interval must end after it starts": "`to` IS NOT NULL" if config.point else "`to` IS NULL OR `to` <= `from`",
        "the version scope does not cover the balancing month": f"NOT (version_scope RLIKE '^[0-9]{{13}}:[0-9]{{4}}-[0-9]{{2}}$' AND substr(version_scope, 15) = date_format({FUNCTIONS['meter_balancing_day'].sql('`from`', 'sparte')}, 'yyyy-MM'))",
    } | {f"{e.name} is not in its code list": f"`{e.name}` NOT IN ({', '.join(repr(c) for c in e.codes)})" for e in config.extras if e.codes}
    rules |= {f"{e.name} is no {e.check} identifier": f"NOT coalesce({CHECKS[e.check](f'`{e.name}`')}, `{e.name}` IS NULL)" for e in config.extras if e.check}
    broken = "coalesce(" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items()) + ")"
    missing = {f.name: F.lit(None).cast(f.dataType) for f in config.schema if f.nullable and f.name not in df.columns}
    rows = df.withColumns(missing | {"balancing_day": day, "__broken": F.lit(None).cast("string")}).withColumn("__broken", F.expr(broken))
    value = F.when(F.col("__broken").isNull(), F.col("value").cast(VALUE)).otherwise(F.raise_error(F.col("__broken")).cast(VALUE))
    return rows.withColumn("value", value).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in config.schema))


def _identity(config: TableConfig) -> list[str]:
    return [*config.key, "version_scope"]


def displacements(existing: DataFrame, incoming: DataFrame, config: TableConfig) -> DataFrame:
    """What storing ``incoming`` does to the readings in force: an effect for each of its rows.

    ``inserted`` is the first value of a reading, ``superseded`` replaces the
    one in force, ``shadowed`` is stored below a higher version, ``duplicate``
    is there at this version already.  A superseding row names the prior value.
    Only stored versions of incoming readings are read on, one sort serves all
    windows, and none gathers a reading's versions.
    """
    key = _identity(config)
    names = [*key, "version", "value", "quality", "recorded_at"]
    stored = existing.select(*(f"`{c}`" for c in names)).join(incoming.select(*(f"`{c}`" for c in key)).distinct(), key, "left_semi").withColumn("new", F.lit(False))
    both = stored.unionByName(incoming.select(*(f"`{c}`" for c in names)).withColumn("new", F.lit(True)))
    order = Window.partitionBy(*(f"`{k}`" for k in key)).orderBy("version", "new", "recorded_at")
    said, new = F.struct("version", "recorded_at", "value", "quality"), F.col("new")
    stored_best = F.max(F.when(~new, said)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    earlier_best = F.max(F.when(new, said)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = F.lag("version").over(order).eqNullSafe(F.col("version"))
    rows = both.withColumns({"prior": F.greatest(stored_best, earlier_best), "again": again}).filter("new")
    effect = F.when(F.col("again"), "duplicate").when(F.col("prior").isNull(), "inserted").when(F.col("version") > F.col("prior.version"), "superseded").otherwise("shadowed")
    rows = rows.withColumn("effect", effect)
    replaced = F.col("effect") == "superseded"
    before = lambda name: F.when(replaced, F.col(f"prior.{name}")).alias(f"prior_{name}")
    return rows.select(*(f"`{c}`" for c in names), "effect", before("value"), before("quality"), before("version"), F.col("effect").isin("inserted", "superseded").alias("changed_current"), (replaced & (F.col("value") != F.col("prior.value"))).alias("value_changed"), (replaced & (F.col("quality") != F.col("prior.quality"))).alias("quality_changed"))


def new_rows(existing: DataFrame, incoming: DataFrame, config: TableConfig) -> DataFrame:
    """Incoming rows whose reading and version are not stored yet; of several the first recorded."""
    key = [*_identity(config), "version"]
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*(f"`{k}`" for k in key)).orderBy("recorded_at"))).filter("__n = 1").drop("__n")
    return first.join(existing.select(*(f"`{k}`" for k in key)).distinct(), key, "left_anti").select(*(f"`{c}`" for c in incoming.columns))


def restated(existing: DataFrame, incoming: DataFrame, config: TableConfig) -> DataFrame:
    """Incoming rows that give a stored version another value or quality."""
    key = [*_identity(config), "version"]
    stored = existing.select(*(f"`{k}`" for k in key), F.col("value").alias("stored_value"), F.col("quality").alias("stored_quality"))
    return incoming.join(stored, key).filter("NOT (value <=> stored_value AND quality <=> stored_quality)")


def contradictory(incoming: DataFrame, config: TableConfig) -> DataFrame:
    """Readings to which one delivery gives a version twice, with different values or qualities."""
    said = F.struct("value", "quality")
    return incoming.groupBy(*(f"`{k}`" for k in _identity(config)), "version").agg(F.min(said).alias("one"), F.max(said).alias("other")).filter("one <> other")


def second_operators(existing: DataFrame, incoming: DataFrame, config: TableConfig) -> DataFrame:
    """Incoming readings that rows of two network operators would claim."""
    operator = F.split("version_scope", ":")[0].alias("operator")
    key = [F.col(f"`{k}`") for k in config.key]
    stored = existing.select(*key, operator).join(incoming.select(*key).distinct(), list(config.key), "left_semi")
    rows = stored.unionByName(incoming.select(*key, operator))
    return rows.groupBy(*key).agg(F.min("operator").alias("one"), F.max("operator").alias("other")).filter("one <> other")


def overlaps(df: DataFrame, config: TableConfig, stored: DataFrame | None = None) -> DataFrame:
    """Intervals of one channel and version that run into the next, stored ones of the same channels too."""
    key = [k for k in _identity(config) if k != "from"]
    if stored is not None:
        channel = [*key, "version"]
        df = df.unionByName(stored.join(df.select(*(f"`{k}`" for k in channel)).distinct(), channel, "left_semi").select(*(f"`{c}`" for c in df.columns)))
    following = F.lead("from").over(Window.partitionBy(*(f"`{k}`" for k in key), "version").orderBy("from", "to"))
    return df.withColumn("next_from", following).filter(F.col("next_from") < F.col("to"))


def attribute_audit(df: DataFrame, attribute: str, config: TableConfig) -> DataFrame:
    """How often a column outside the key takes several values for one reading: keys, several, widest."""
    per = df.groupBy(*(f"`{k}`" for k in config.key)).agg(F.countDistinct(f"`{attribute}`").alias("n"))
    return per.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("several"), F.max("n").alias("widest"))
