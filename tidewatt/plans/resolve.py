"""Which version of a reading is in force."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The highest version of each reading within its version scope, the later recorded of two.

    Spark keeps the first row of a window before the shuffle too, so a task
    sends one version of each reading on.
    """
    order = Window.partitionBy(*(f"`{k}`" for k in key), "version_scope").orderBy(F.desc("version"), F.desc("recorded_at"))
    return df.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def resolution_sql(table: str, key: Sequence[str], columns: Sequence[str], known_at: datetime | None = None) -> str:
    """The same as SQL text, for readers that do not go through this package."""
    names = ", ".join(f"`{c}`" for c in columns)
    keys = ", ".join(f"`{k}`" for k in [*key, "version_scope"])
    ceiling = f" WHERE recorded_at <= TIMESTAMP '{known_at:%Y-%m-%d %H:%M:%S.%f}Z'" if known_at else ""
    return f"SELECT {names} FROM (SELECT {names}, row_number() OVER (PARTITION BY {keys} ORDER BY version DESC, recorded_at DESC) AS version_rank FROM `{table}`{ceiling}) WHERE version_rank = 1"


@dataclass(frozen=True)
class FileStats:
    """The least and greatest version and start in a file; None where it does not say."""

    versions: tuple[int, int] | None
    starts: tuple[datetime, datetime] | None


def may_skip_resolution(files: Sequence[FileStats]) -> bool:
    """Whether no reading can have two versions in these files.

    Every file must hold one version.  Files whose starts overlap, directly or
    through others, must hold the same one; a file without starts overlaps all.
    """
    if any(f.versions is None or f.versions[0] != f.versions[1] for f in files):
        return False
    if any(f.starts is None for f in files):
        return len({f.versions for f in files}) == 1
    reach = version = None
    for file in sorted(files, key=lambda f: f.starts):
        if reach is not None and file.starts[0] <= reach:
            if file.versions[0] != version:
                return False
            reach = max(reach, file.starts[1])
        else:
            reach, version = file.starts[1], file.versions[0]
    return True
