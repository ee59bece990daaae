"""The two tiers: partitioned Parquet written by Spark, and a log of small commits.

Both tiers are folders that Spark partitions: the historical one by identity
columns and month, the recent one by archival window.  A commit names the
folders that one write added, with the counts and bounds that Spark observed
while it wrote, and the watermark; creating the next number is what commits
it, for both tiers at once.  A snapshot is a commit's number: all commits up
to it.  Everything goes through Spark and Hadoop's file system, so a table can
lie on any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import empty
from ..errors import BoundaryMoved, ConfigError
from ..operators.evolution import Change, require_compatible
from ..plans.resolve import FileStats
from ..plans.timerange import EPOCH, TICK, TimeRange
from ..schema import TableConfig

#: Row groups, pages and encodings of the historical tier: bloom filters for identifiers, delta-packed times and numbers.
WRITING = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(128 << 20),
    "parquet.page.row.count.limit": "20000",
    "parquet.bloom.filter.enabled#malo_id": "true",
    "parquet.bloom.filter.enabled#obis_code": "true",
}
WINDOW = "yyyyMMddHHmm"


class Files:
    """Hadoop's file system at one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        try:
            out = self._fs.create(self.path(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Part:
    """A folder that one write added to a tier, with what Spark saw while it wrote."""

    folder: str
    rows: int
    versions: tuple[int, int]
    starts: tuple[str, str]

    @property
    def bounds(self) -> tuple[datetime, datetime]:
        return tuple(datetime.fromisoformat(s) for s in self.starts)

    @property
    def stats(self) -> FileStats:
        return FileStats(tuple(self.versions), self.bounds)

    def meets(self, range_: TimeRange) -> bool:
        low, high = self.bounds
        return (range_.end is None or low < range_.end) and (range_.start is None or high >= range_.start)


@dataclass(frozen=True)
class Snapshot:
    """A commit, and with it the table as of it."""

    id: int
    committed_at: str
    watermark: str
    operation: str
    cold: Part | None = None
    hot: Part | None = None

    @property
    def boundary(self) -> datetime:
        return datetime.fromisoformat(self.watermark)

    @classmethod
    def parse(cls, text: str) -> Snapshot:
        raw = json.loads(text)
        return cls(**raw | {tier: Part(**raw[tier]) if raw[tier] else None for tier in ("cold", "hot")})


class Tiers:
    """The stored data of one table."""

    def __init__(self, spark: SparkSession, root: str, config: TableConfig):
        if (zone := spark.conf.get("spark.sql.session.timeZone")) not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
            raise ConfigError(f"windows and months are cut in UTC, the session is in {zone}")
        self.spark, self.config = spark, config
        self.files = Files(spark, f"{root.rstrip('/')}/{config.name}")
        self.identity = [e.name for e in config.extras if e.identity]
        self.changes = self._evolve()
        if not self.files.exists("commits"):
            self.commit(None, EPOCH, "create")

    def _evolve(self) -> list[Change]:
        """Compare the stored schema with the configured one and store that, unless they cannot be reconciled."""
        names = self.files.names("schema")
        stored = T.StructType.fromJson(json.loads(self.files.read(f"schema/{names[-1]}"))) if names else None
        changes = require_compatible(stored, self.config.schema) if stored else []
        if stored is None or changes:
            self.files.create(f"schema/{len(names):06d}.json", self.config.schema.json())
        return changes

    # Commits

    def snapshots(self, upto: Snapshot | None = None) -> list[Snapshot]:
        """All commits in order, up to one; Spark reads the log as a table of lines."""
        lines = self.spark.read.text(f"{self.files.root}/commits").collect()
        found = sorted((Snapshot.parse(r.value) for r in lines), key=lambda s: s.id)
        return [s for s in found if upto is None or s.id <= upto.id]

    def latest(self) -> Snapshot:
        return Snapshot.parse(self.files.read(f"commits/{self.files.names('commits')[-1]}"))

    def at(self, when: datetime) -> Snapshot | None:
        """The last snapshot committed by then."""
        return next((s for s in reversed(self.snapshots()) if datetime.fromisoformat(s.committed_at) <= when), None)

    def commit(self, base: Snapshot | None, watermark: datetime, operation: str, cold: Part | None = None, hot: Part | None = None) -> Snapshot:
        """Add the next commit; fails if another writer was first, and then takes what it wrote away again."""
        number = base.id + 1 if base else 0
        new = Snapshot(number, datetime.now(timezone.utc).isoformat(), watermark.isoformat(), operation, cold, hot)
        if not self.files.create(f"commits/{number:012d}.json", json.dumps(asdict(new))):
            for part in filter(None, (cold, hot)):
                self.files.delete(part.folder)
            raise BoundaryMoved(f"commit {number} was made by another writer")
        return new

    def kept(self, now: datetime) -> list[Snapshot]:
        """Snapshots that may still be asked for: those of the retention, and the last ones.

        The log itself is never cut, so the chain of watermarks stays whole.
        """
        found = self.snapshots()
        return [s for s in found[: -self.config.keep_snapshots] if datetime.fromisoformat(s.committed_at) >= now - self.config.snapshot_retention] + found[-self.config.keep_snapshots :]

    # Writing

    def write(self, df: DataFrame, tier: str) -> Part | None:
        """Write rows to a new folder of a tier; None, and no folder, if there are none."""
        if not df.limit(1).count():
            return None
        folder, seen, micros = f"{tier}/part={uuid.uuid4().hex}", Observation(), F.unix_micros("from")
        if tier == "cold":
            keys = [*self.identity, "month"]
            rows = df.withColumn("month", F.date_format("from", "yyyy-MM")).repartition(*keys, "malo_id").sortWithinPartitions(*keys, "malo_id", "from")
        else:
            keys, seconds = ["window_start"], int(self.config.step.total_seconds())
            rows = df.withColumn("window_start", F.date_format(F.timestamp_seconds(F.floor(F.col("from").cast("long") / seconds) * seconds), WINDOW))
            rows = rows.sortWithinPartitions("window_start", "malo_id", "from")
        rows = rows.observe(seen, F.count("*").alias("n"), F.min("version").alias("a"), F.max("version").alias("b"), F.min(micros).alias("c"), F.max(micros).alias("d"))
        rows.write.options(**WRITING if tier == "cold" else {"compression": "zstd"}).partitionBy(*keys).parquet(f"{self.files.root}/{folder}")
        got = seen.get
        at = lambda micros: (EPOCH + timedelta(microseconds=micros)).isoformat()
        return Part(folder, got["n"], (int(got["a"]), int(got["b"])), (at(got["c"]), at(got["d"])))

    # Reading

    def parts(self, log: list[Snapshot], tier: str, range_: TimeRange) -> list[Part]:
        """The parts of a tier that can hold a start in the range."""
        return [p for s in log if (p := getattr(s, tier)) and p.meets(range_)]

    def read(self, spark: SparkSession, parts: list[Part], tier: str, range_: TimeRange) -> DataFrame:
        """Rows of the range; Spark prunes months or windows, and older parts lack newer columns."""
        if not parts:
            return empty(spark, self.config.schema)
        column, form = ("month", "%Y-%m") if tier == "cold" else ("window_start", "%Y%m%d%H%M")
        folders = T.StructType([*self.config.schema, T.StructField("part", T.StringType()), T.StructField(column, T.StringType())])
        rows = spark.read.schema(folders).option("basePath", f"{self.files.root}/{tier}").parquet(*(f"{self.files.root}/{p.folder}" for p in parts))
        if range_.start is not None:
            rows = rows.filter(F.col(column) >= (range_.start if tier == "cold" else self.window(range_.start)).astimezone(timezone.utc).strftime(form))
        if range_.end is not None:
            rows = rows.filter(F.col(column) <= (range_.end - TICK).astimezone(timezone.utc).strftime(form))
        return rows.filter(range_.filter()).select(*(f"`{n}`" for n in self.config.schema.names))

    # Windows

    def window(self, at: datetime) -> datetime:
        step = self.config.step
        return EPOCH + (at - EPOCH) // step * step

    def windows(self, log: list[Snapshot]) -> dict[datetime, list[str]]:
        """The windows of the recent tier, and the folders that hold them."""
        out: dict[datetime, list[str]] = {}
        for part in self.parts(log, "hot", TimeRange()):
            for name in self.files.names(part.folder):
                if name.startswith("window_start="):
                    start = datetime.strptime(name.partition("=")[2], "%Y%m%d%H%M").replace(tzinfo=timezone.utc)
                    out.setdefault(start, []).append(f"{part.folder}/{name}")
        return out

    def drop_windows(self, log: list[Snapshot]) -> int:
        """Delete windows that are archived: those below the watermark, in parts committed before it rose above them."""
        dropped = 0
        for number, commit in enumerate(log):
            boundary = max((s.boundary for s in log[number + 1 :]), default=EPOCH)
            for start, folders in self.windows([commit]).items() if commit.hot and commit.hot.bounds[0] < boundary else ():
                if start + self.config.step <= boundary:
                    for folder in folders:
                        self.files.delete(folder)
                        dropped += 1
        return dropped
