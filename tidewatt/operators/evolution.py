"""Whether a stored schema can be read and written under a changed configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import Quarantined

WIDER = {("int", "bigint"), ("float", "double")}


@dataclass(frozen=True)
class Change:
    column: str
    what: str
    safe: bool


def compare(stored: T.StructType, configured: T.StructType) -> list[Change]:
    """Every difference; only nullable columns may come or go, and types only widen."""
    old, new = {f.name: f for f in stored}, {f.name: f for f in configured}
    changes = [Change(n, "added", new[n].nullable) for n in new if n not in old]
    changes += [Change(n, "dropped", old[n].nullable) for n in old if n not in new]
    for name in old.keys() & new.keys():
        a, b = old[name], new[name]
        if a.nullable != b.nullable:
            changes.append(Change(name, "nullability changed", False))
        if a.dataType != b.dataType:
            decimal = isinstance(a.dataType, T.DecimalType) and isinstance(b.dataType, T.DecimalType) and a.dataType.scale == b.dataType.scale and a.dataType.precision < b.dataType.precision
            changes.append(Change(name, f"{a.dataType.simpleString()} became {b.dataType.simpleString()}", decimal or (a.dataType.simpleString(), b.dataType.simpleString()) in WIDER))
    return sorted(changes, key=lambda c: c.column)


def require_compatible(stored: T.StructType, configured: T.StructType) -> list[Change]:
    changes = compare(stored, configured)
    if unsafe := [f"{c.column}: {c.what}" for c in changes if not c.safe]:
        raise Quarantined("; ".join(unsafe))
    return changes
