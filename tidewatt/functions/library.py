"""Calendar, OBIS, quality and EIC functions as expressions: no Python runs on rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Code lists and patterns of the German market.
ZONE = "Europe/Berlin"
GAS_HOUR = 6
SPARTEN = ("STROM", "GAS", "WAERME", "WASSER")
QUALITIES = ("MEASURED", "SUBSTITUTED", "ESTIMATED", "PRELIMINARY", "FAULTY", "CALCULATED", "CORRECTED", "UNKNOWN")
BILLABLE = ("MEASURED", "SUBSTITUTED")
PROVISIONAL = ("PRELIMINARY",)
MARKET_CODES = {"MEASURED": "220", "SUBSTITUTED": "67", "ESTIMATED": "187", "PRELIMINARY": "Z18", "FAULTY": "20"}
REGELZONEN = {"N": "TENNET", "R": "AMPRION", "V": "FIFTY_HERTZ", "W": "TRANSNET_BW"}
EIC_TYPES = "XYZWTVA"
EIC_SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-"
RESOLUTIONS = {f"PT{m}M": 60 * m for m in range(1, 60) if 60 % m == 0} | {"PT1H": 3600}
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_PLAIN = "(25[0-4]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Codes that ``obis_normalise`` leaves as they are, of bytes up to 254; 255 is left to the function itself.
CANONICAL_OBIS = rf"^{_PLAIN}-{_PLAIN}:{_PLAIN}[.]{_PLAIN}[.]{_PLAIN}([*]{_PLAIN})?\\z"
OBIS = rf"^\\s*{_BYTE}-{_BYTE}:{_BYTE}[.]{_BYTE}[.]{_BYTE}([*]{_BYTE})?\\s*$"


@dataclass(frozen=True)
class Function:
    """``body`` names its parameters in braces; defaults make trailing ones optional."""

    name: str
    parameters: dict[str, str]
    returns: str
    body: str
    defaults: dict[str, str]

    def sql(self, *arguments: str) -> str:
        """The expression for arguments that are SQL themselves."""
        values = dict(zip(self.parameters, arguments, strict=False))
        values = {p: f"CAST({values.get(p, self.defaults.get(p))} AS {kind})" for p, kind in self.parameters.items()}
        return f"CAST({self.body.format(**values)} AS {self.returns})"

    def register(self, spark: SparkSession) -> None:
        declared = ", ".join(f"{p} {kind}" + (f" DEFAULT {self.defaults[p]}" if p in self.defaults else "") for p, kind in self.parameters.items())
        body = self.body.format(**{p: f"{self.name}.{p}" for p in self.parameters})
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({declared}) RETURNS {self.returns} RETURN CAST({body} AS {self.returns})")


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _known(value: str, allowed, what: str, then: str, kind: str) -> str:
    """``then`` for a known code, null for null, and an error for any other."""
    return f"CASE WHEN {value} IS NULL THEN NULL WHEN {value} IN ({_names(allowed)}) THEN {then} ELSE CAST(raise_error(concat('{what}: ', {value})) AS {kind}) END"


def _in_calendar(then: str) -> str:
    return f"CASE WHEN year({{ts}}) BETWEEN 1900 AND 9998 THEN {then} END"


LOCAL = f"from_utc_timestamp({{ts}}, '{ZONE}')"
LOCAL_DAY = _in_calendar(f"to_date({LOCAL})")
GAS_DAY = _in_calendar(f"to_date({LOCAL} - INTERVAL {GAS_HOUR} HOURS)")
BALANCING_DAY = f"CASE WHEN {{ts}} IS NULL THEN NULL ELSE {_known('{sparte}', SPARTEN, 'unknown sparte', f'''CASE WHEN {{sparte}} = 'GAS' THEN {GAS_DAY} ELSE {LOCAL_DAY} END''', 'DATE')} END"


def _boundary(day: str) -> str:
    hour = f"CASE WHEN {{sparte}} = 'GAS' THEN {GAS_HOUR} ELSE 0 END"
    return f"unix_timestamp(to_utc_timestamp(CAST({day} AS TIMESTAMP) + make_dt_interval(0, {hour}), '{ZONE}'))"


_STEP = "CASE {resolution} " + " ".join(f"WHEN '{r}' THEN {s}" for r, s in RESOLUTIONS.items()) + " END"
EXPECTED = (
    "CASE WHEN {day} IS NULL OR {resolution} IS NULL OR {sparte} IS NULL THEN NULL "
    f"WHEN {{sparte}} NOT IN ({_names(SPARTEN)}) THEN CAST(raise_error(concat('unknown sparte: ', {{sparte}})) AS BIGINT) "
    "WHEN {resolution} IN ('P1M', 'P1Y') THEN NULL WHEN {resolution} = 'P1D' THEN 1 "
    f"WHEN {{resolution}} IN ({_names(RESOLUTIONS)}) THEN ({_boundary('date_add({day}, 1)')} - {_boundary('{day}')}) DIV {_STEP} "
    "ELSE CAST(raise_error(concat('unknown resolution: ', {resolution})) AS BIGINT) END"
)


def _obis(then: str, kind: str) -> str:
    return f"CASE WHEN {{code}} IS NULL THEN NULL WHEN {{code}} RLIKE '{OBIS}' THEN {then} ELSE CAST(raise_error(concat('not an OBIS code: ', {{code}})) AS {kind}) END"


def _group(number: int) -> str:
    return f"CAST(regexp_extract({{code}}, '{OBIS}', {number}) AS INT)"


A, B, C, D, E = (_group(i) for i in range(1, 6))
DIRECTION = f"CASE WHEN {A} = 1 AND {C} = 1 THEN 'IMPORT' WHEN {A} = 1 AND {C} = 2 THEN 'EXPORT' END"
_F = f"regexp_extract({{code}}, '{OBIS}', 7)"
NORMAL = f"concat({A}, '-', {B}, ':', {C}, '.', {D}, '.', {E}, CASE WHEN {_F} IN ('', '255') THEN '' ELSE concat('*', CAST({_F} AS INT)) END)"

_EIC = "upper(trim({code}))"
_SUM = f"aggregate(sequence(1, 15), 0, (s, i) -> s + (17 - i) * (locate(substr({_EIC}, i, 1), '{EIC_SYMBOLS}') - 1))"
EIC = f"CASE WHEN {_EIC} RLIKE '^[0-9][0-9][A-Z][0-9A-Z-]{{{{12}}}}[0-9A-Z]$' AND substr({_EIC}, 16, 1) = substr('{EIC_SYMBOLS}', 37 - pmod({_SUM} - 1, 37), 1) THEN {_EIC} END"


def _function(name: str, parameters: dict[str, str], returns: str, body: str, **defaults: str) -> Function:
    return Function(name, parameters, returns, body, defaults)


_TS, _CODE, _FLAG = {"ts": "TIMESTAMP"}, {"code": "STRING"}, {"flag": "STRING"}
_BOTH = {"ts": "TIMESTAMP", "sparte": "STRING"}
_codes = " ".join(f"WHEN '{q}' THEN '{c}'" for q, c in MARKET_CODES.items())
_zones = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGELZONEN.items())
_OBIS_TESTS = {
    "obis_is_import": f"coalesce({DIRECTION} = 'IMPORT', false)",
    "obis_is_export": f"coalesce({DIRECTION} = 'EXPORT', false)",
    "obis_is_reactive": f"{C} BETWEEN 3 AND 8",
    "obis_is_lastgang": f"{D} = 29",
    "obis_is_zaehlerstand": f"{D} = 8",
    "obis_is_vorschub": f"{D} = 9",
    "obis_is_maximum": f"{D} = 6",
    "obis_is_fehlerregister": f"{E} = 63",
    "obis_is_total_register": f"{E} = 0",
}
FUNCTIONS = {
    f.name: f
    for f in (
        _function("meter_local_day", _TS, "DATE", LOCAL_DAY),
        _function("meter_gas_day", _TS, "DATE", GAS_DAY),
        _function("meter_balancing_day", _BOTH, "DATE", BALANCING_DAY),
        _function("meter_local_month", _TS, "DATE", f"trunc({LOCAL_DAY}, 'MM')"),
        _function("meter_balancing_month", _BOTH, "DATE", f"trunc({BALANCING_DAY}, 'MM')"),
        _function("meter_expected_intervals", {"day": "DATE", "resolution": "STRING", "sparte": "STRING"}, "INT", EXPECTED, sparte="'STROM'"),
        _function("obis_direction", _CODE, "STRING", _obis(DIRECTION, "STRING")),
        *(_function(name, _CODE, "BOOLEAN", _obis(test, "BOOLEAN")) for name, test in _OBIS_TESTS.items()),
        _function("obis_tariff_register", _CODE, "SMALLINT", _obis(f"CASE WHEN {E} NOT IN (0, 63) THEN {E} END", "INT")),
        _function("obis_normalise", _CODE, "STRING", _obis(NORMAL, "STRING")),
        _function("quality_is_billable", _FLAG, "BOOLEAN", _known("{flag}", QUALITIES, "unknown quality", f"{{flag}} IN ({_names(BILLABLE)})", "BOOLEAN")),
        _function("quality_is_provisional", _FLAG, "BOOLEAN", _known("{flag}", QUALITIES, "unknown quality", f"{{flag}} IN ({_names(PROVISIONAL)})", "BOOLEAN")),
        _function("quality_market_code", _FLAG, "STRING", _known("{flag}", QUALITIES, "unknown quality", f"CASE {{flag}} {_codes} END", "STRING")),
        _function("eic_normalise", _CODE, "STRING", EIC),
        _function("eic_object_type", _CODE, "STRING", f"CASE WHEN locate(substr({EIC}, 3, 1), '{EIC_TYPES}') > 0 THEN substr({EIC}, 3, 1) END"),
        _function("eic_regelzone", _CODE, "STRING", f"CASE WHEN substr({EIC}, 1, 3) = '11Y' THEN CASE substr({EIC}, 4, 1) {_zones} END END"),
    )
}


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL in this session."""
    for function in FUNCTIONS.values():
        function.register(spark)


def call(name: str, *arguments: str) -> Column:
    """A function on SQL arguments, as a column."""
    return F.expr(FUNCTIONS[name].sql(*arguments)).alias(name)


#: Flags from best to worst: the source gives no order, so measured values come first and values that cannot be used last.
WORSE = ("MEASURED", "SUBSTITUTED", "CALCULATED", "CORRECTED", "ESTIMATED", "PRELIMINARY", "UNKNOWN", "FAULTY")


def worst_quality(flag: str = "quality") -> Column:
    """An aggregate: the worst flag of a group; null flags do not count."""
    rank = F.array_position(F.array(*map(F.lit, WORSE)), F.col(flag))
    return F.max_by(F.col(flag), F.when(rank > 0, rank))


# Bounds of days and months --------------------------------------------------


def day_bounds(day: date, sparte: str = "STROM") -> tuple[datetime, datetime]:
    """A balancing day as instants, the second not included: 23 to 25 hours."""
    if sparte not in SPARTEN:
        raise ValueError(f"unknown sparte: {sparte}")
    at = lambda d: datetime.combine(d, time(GAS_HOUR if sparte == "GAS" else 0), ZoneInfo(ZONE)).astimezone(timezone.utc)
    return at(day), at(day + timedelta(days=1))


def month_bounds(day: date, sparte: str = "STROM") -> tuple[datetime, datetime]:
    """The balancing month that holds a day."""
    first = day.replace(day=1)
    return day_bounds(first, sparte)[0], day_bounds((first + timedelta(days=32)).replace(day=1), sparte)[0]


def retention_cutoff(now: datetime, years: int, sparte: str = "STROM") -> int:
    """The first epoch, a year of balancing days, that is still kept after ``years`` whole years."""
    local = now.astimezone(ZoneInfo(ZONE)) - timedelta(hours=GAS_HOUR if sparte == "GAS" else 0)
    return local.year - years
