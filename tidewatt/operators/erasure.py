"""Pseudonymous subjects: a map from references to people that can forget, and a trail of what it forgot.

Readings hold references only.  Erasing a person removes the map's rows and
leaves an audit row and a keyed digest, by which a later attempt to register
the person again is noticed without storing who it was.
"""

from __future__ import annotations

import hashlib
import hmac
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint, empty
from ..errors import WriteRefused
from ..sources.tiers import Files

TRIGGERS = ("request", "retention")
SUBJECTS = "subject_ref string, identity string, epoch int, registered_at timestamp"
TRAIL = "subject_ref string, epoch int, trigger string, erased_at timestamp, digest string"


@dataclass
class SubjectMap:
    """The map and the trail, each a versioned folder of Parquet that is replaced as a whole."""

    spark: SparkSession
    root: str
    secret: bytes

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.root)

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self.files.names(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{found[-1]}") if found else empty(self.spark, self.spark.createDataFrame([], schema).schema)

    def _replace(self, name: str, df: DataFrame) -> None:
        found = self.files.names(name)
        number = int(found[-1].split("-")[0]) + 1 if found else 0
        df.write.parquet(f"{self.root}/{name}/{number:012d}-{uuid.uuid4().hex[:8]}")
        for old in found:
            self.files.delete(f"{name}/{old}")

    @property
    def subjects(self) -> DataFrame:
        return self._read("subjects", SUBJECTS)

    @property
    def trail(self) -> DataFrame:
        return self._read("trail", TRAIL)

    def digest(self, identity: str) -> str:
        return hmac.new(self.secret, identity.encode(), hashlib.sha256).hexdigest()

    def register(self, identity: str, epoch: int, at: datetime) -> str:
        """A new reference for a person and epoch, or the one that they have."""
        have = self.subjects.filter((F.col("identity") == identity) & (F.col("epoch") == epoch)).select("subject_ref").first()
        if have:
            return have.subject_ref
        if self.suppressed(identity):
            raise WriteRefused("this person was erased; lift the suppression first")
        ref = uuid.uuid4().hex
        self._replace("subjects", checkpoint(self.subjects.unionByName(self.spark.createDataFrame([(ref, identity, epoch, at)], SUBJECTS))))
        return ref

    def lookup(self, identity: str) -> DataFrame:
        return self.subjects.filter(F.col("identity") == identity)

    def references(self, identity: str) -> list[str]:
        """A person's references, oldest epoch first."""
        return [r.subject_ref for r in self.lookup(identity).orderBy("epoch", "subject_ref").select("subject_ref").collect()]

    def epochs(self) -> DataFrame:
        """How many references each epoch holds."""
        return self.subjects.groupBy("epoch").agg(F.count("*").alias("references")).orderBy("epoch")

    def resolve(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the identities behind its references; null where nobody is."""
        return df.join(self.subjects.select(F.col("subject_ref").alias(column), "identity"), column, "left")

    def orphaned(self, df: DataFrame, column: str) -> DataFrame:
        """References in ``df`` that resolve to nobody."""
        return df.filter(F.col(f"`{column}`").isNotNull()).select(f"`{column}`").distinct().join(self.subjects.select(F.col("subject_ref").alias(column)), column, "left_anti")

    def suppressed(self, identity: str) -> bool:
        return self.trail.filter((F.col("digest") == self.digest(identity)) & (F.col("trigger") == "request")).limit(1).count() > 0

    def _forget(self, gone: DataFrame, trigger: str, at: datetime, digest: F.Column) -> int:
        gone = checkpoint(gone)
        count = gone.count()
        if count:
            rows = gone.select("subject_ref", "epoch", F.lit(trigger).alias("trigger"), F.lit(at).alias("erased_at"), digest.alias("digest"))
            self._replace("trail", checkpoint(self.trail.unionByName(rows)))
            self._replace("subjects", checkpoint(self.subjects.join(gone.select("subject_ref"), "subject_ref", "left_anti").select("subject_ref", "identity", "epoch", "registered_at")))
        return count

    def erase(self, identity: str, at: datetime) -> int:
        """Forget a person: their references stay in readings and resolve to nobody."""
        return self._forget(self.lookup(identity), "request", at, F.lit(self.digest(identity)))

    def erase_all(self, identities: list[str], at: datetime) -> int:
        return sum(self.erase(identity, at) for identity in identities)

    def sweep(self, cutoff: int, at: datetime) -> int:
        """Forget all registrations of epochs before the cutoff."""
        return self._forget(self.subjects.filter(F.col("epoch") < cutoff), "retention", at, F.lit(None).cast("string"))

    def lift(self, identity: str) -> None:
        """Allow an erased person to be registered again; the trail keeps the row without its digest."""
        same = F.col("digest") == self.digest(identity)
        self._replace("trail", checkpoint(self.trail.withColumn("digest", F.when(~F.coalesce(same, F.lit(False)), F.col("digest")))))

    def history(self, since: datetime | None = None, until: datetime | None = None, trigger: str | None = None, limit: int = 100) -> DataFrame:
        rows = self.trail
        rows = rows if since is None else rows.filter(F.col("erased_at") >= F.lit(since))
        rows = rows if until is None else rows.filter(F.col("erased_at") < F.lit(until))
        rows = rows if trigger is None else rows.filter(F.col("trigger") == trigger)
        return rows.orderBy(F.desc("erased_at"), "subject_ref").limit(limit)

    def require_resolvable(self, df: DataFrame, column: str) -> None:
        """Refuse rows whose reference names nobody."""
        if self.orphaned(df, column).limit(1).count():
            raise WriteRefused(f"{column} holds references that resolve to nobody")
