"""Line dedup: documents probe sharded arrays behind a minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .perfect_hash import PerfectHash, mix
from .shared import map_arrow, stage

# Fixed value: the white space stripped from a key.
SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: At most so many keys can each hold more than this share of all lines; their shard is small enough to broadcast.
HOT_KEYS = 4096
SHARD_KEYS = 500_000
SHARD_PROBES = 1_000_000
#: Bits of the sieve that spares lines without a repeated key the way to their shard; its size does not grow.
SIEVE = 1 << 26


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Positions and 128-bit hashes of the lines whose key is long enough."""
    places, hashes = [], []
    for i, line in enumerate(text.split("\n")):
        if len(line) >= MIN_CHARS and len(key := line.strip(SPACE)) >= MIN_CHARS:
            places.append(i)
            hashes.append(xxhash.xxh3_128_intdigest(key.encode().lower()))
    return places, hashes


def halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in hashes), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


@dataclass
class Shard:
    """For the repeated keys of a shard: fingerprints, line counts and the documents that keep them."""

    hash: PerfectHash
    seed: int
    prints: np.ndarray
    counts: np.ndarray
    owners: np.ndarray

    @staticmethod
    def joint(low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
        return mix(low.view(np.uint64), seed + 1) ^ high.view(np.uint64)

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Shard:
        seed = 0
        while np.unique(keys := cls.joint(low, high, seed)).size < keys.size:
            seed += 1
        table = PerfectHash.build(keys)
        at = table.numbers(keys)
        out = [np.empty(keys.size, np.int64) for _ in range(3)]
        for column, values in zip(out, (high, counts, owners), strict=True):
            column[at] = values
        return cls(table, seed, *out)

    def owner(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is a repeated one, and the document that keeps it."""
        if not self.prints.size or not low.size:
            return np.zeros(low.size, bool), np.zeros(low.size, np.int64)
        at = self.hash.numbers(self.joint(np.ascontiguousarray(low), np.ascontiguousarray(high), self.seed))
        known = (at >= 0) & (self.prints[at] == high)
        return known, self.owners[at]

    def to_row(self) -> dict[str, list]:
        return {"seed": [self.seed], "sizes": [self.hash.sizes], **{n: [a.tobytes()] for n, a in (("words", self.hash.words), ("ranks", self.hash.ranks), ("prints", self.prints), ("counts", self.counts), ("owners", self.owners))}}

    @classmethod
    def from_row(cls, row: dict) -> Shard:
        get = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(PerfectHash(row["sizes"], get("words", np.uint64), get("ranks", np.int64)), row["seed"], get("prints", np.int64), get("counts", np.int64), get("owners", np.int64))


SHARD_SCHEMA = "shard int, seed int, sizes array<long>, words binary, ranks binary, prints binary, counts binary, owners binary"
SHARD_ARROW = pa.schema([("shard", pa.int32()), ("seed", pa.int32()), ("sizes", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("words", "ranks", "prints", "counts", "owners"))])


def _build(table: pa.Table) -> pa.Table:
    get = lambda name: table.column(name).to_numpy()
    row = Shard.build(get("low"), get("high"), get("lines"), get("owner")).to_row()
    return pa.Table.from_pydict({"shard": [table.column("shard")[0].as_py()], **row}, schema=SHARD_ARROW)


def _probe(lines: pa.Table, shard: pa.Table) -> pa.Table:
    if not shard.num_rows or not lines.num_rows:
        return lines.select(["k1", "k2", "place"]).slice(0, 0)
    get = lambda name: lines.column(name).to_numpy()
    known, owner = Shard.from_row(shard.to_pylist()[0]).owner(get("low"), get("high"))
    return lines.select(["k1", "k2", "place"]).filter(pa.array(known & (owner != get("id"))))


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit for each place that a key falls on."""
    at = F.col("low").bitwiseAND(SIEVE - 1)
    bits = F.expr("shiftleft(1L, CAST(low & 63 AS INT))")
    rows = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bits).alias("bits")).toPandas()
    out = np.zeros(SIEVE >> 6, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that another document of smaller id holds too.

    A line's key is the line without surrounding white space, A to Z lowered.
    Keys of ten code points or more that at least two documents hold lose all
    their lines except in the document of the smallest id; other lines stay.
    Returns the columns of ``df`` with the kept text, and ``n_lines`` and
    ``n_dropped`` (which replace columns of these names).

    Rows that repeat an id are one document and keep the same lines.  Rows
    with a null id are one document that comes after all others.  A null text
    is one empty line.  An empty table gives an empty one.  Ids may be of any
    type that has an order; those that are no whole numbers are known to the
    arrays by a 64-bit hash.

    Keys are 128-bit hashes.  Of the repeated ones, those that hold over
    1/4096 of all lines go to one small array set that every task has; the
    rest lie in shards.  A line goes to its shard only if the sieve, which
    every task has too, does not tell that its key is no repeated one.
    """
    spark = df.sparkSession
    name, whole = F.col(f"`{id_col}`"), isinstance(df.schema[id_col].dataType, T.IntegralType)
    id_ = F.coalesce(name.cast("long"), F.lit(2**63 - 1)) if whole else F.xxhash64(name.isNull(), name)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(id_.alias("id"), text.alias("text"), (F.lit(None).cast("long") if whole else name).alias("name"), F.xxhash64(F.lit(1), id_, text).alias("k1"), F.xxhash64(F.lit(2), id_, text).alias("k2"), F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in (text_col, "n_lines", "n_dropped"))).alias("rest"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = [], []
            for t in batch.column(2).to_pylist():
                found = set(line_hashes(t)[1])
                rows += found
                sizes.append(len(found))
            low, high = halves(rows)
            own = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), batch.column(0).take(own), batch.column(1).take(own)], ["low", "high", "id", "name"])

    kind = "long" if whole else df.schema[id_col].dataType.simpleString()
    held = map_arrow(docs.select("id", "name", "text"), hashed, f"low long, high long, id long, name {kind}").groupBy("low", "high")
    end = lambda pick: pick("id") if whole else pick(F.struct(F.col("name").isNull(), "name", "id")).getField("id")
    every_line = Observation()
    keys = held.agg(end(F.min).alias("owner"), end(F.max).alias("last"), F.count("*").alias("lines")).observe(every_line, F.sum("lines").alias("lines"))
    keys = stage(keys.filter("owner <> last").select("low", "high", "owner", "lines"), "repeated-lines")
    total, count = keys.agg(F.coalesce(F.sum("lines"), F.lit(0)), F.count("*")).first()
    bar = total // HOT_KEYS
    hot = keys.filter(F.col("lines") > bar).toPandas() if total else None
    hottest = Shard.build(*(hot[c].to_numpy(np.int64) for c in ("low", "high", "lines", "owner"))) if total else None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, salts = max(parts, -(-count // SHARD_KEYS), -(-(every_line.get["lines"] or 0) // SHARD_PROBES)), 1 + bar // SHARD_PROBES

    cold = keys.filter(F.col("lines") <= bar).withColumn("shard", F.pmod("low", F.lit(shards)).cast("int"))
    every = spark.sparkContext.broadcast((hottest, _sieve(cold)))
    index = stage(cold.groupBy("shard").applyInArrow(_build, SHARD_SCHEMA), "line-shards")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a document: what the hot shard decides, and the probes for the others."""
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            hashes = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, some = line_hashes(row[3])
                hashes += some
                for column, values in zip(columns, (*([v] * len(some) for v in row[:3]), places), strict=True):
                    column += values
            low, high = halves(hashes)
            ids, k1, k2, place = (np.array(c, np.int64) for c in columns)
            hottest, sieve = every.value
            known, owner = hottest.owner(low, high) if hottest else (np.zeros(low.size, bool), ids)
            at = low.view(np.uint64) & np.uint64(SIEVE - 1)
            keep = np.where(known, owner != ids, (sieve[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1)
            arrays = [a[keep] for a in (k1, k2, place, ids, low, high, known)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["k1", "k2", "place", "id", "low", "high", "known"])

    lines = map_arrow(docs.select("id", "k1", "k2", "text"), look, "k1 long, k2 long, place long, id long, low long, high long, known boolean")
    shard, salt = F.pmod("low", F.lit(shards)).cast("int").alias("shard"), F.pmod("k1", F.lit(salts)).cast("int").alias("salt")
    probes = lines.filter("not known").select("k1", "k2", "place", "id", "low", "high", shard, salt)
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe, "k1 long, k2 long, place long")
    dropped = lines.filter("known").select("k1", "k2", "place").unionByName(found).groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for t, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                split, gone = t.split("\n"), set(places or ())
                kept.append("\n".join(x for i, x in enumerate(split) if i not in gone) if gone else t)
                n_lines.append(len(split))
                n_dropped.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["rest", "kept", "n_lines", "n_dropped"])

    joined = docs.join(dropped, ["k1", "k2"], "left").select("rest", "text", "places")
    rest = next(f.dataType for f in docs.schema if f.name == "rest").simpleString()
    done = map_arrow(joined, keep, f"rest {rest}, kept string, n_lines long, n_dropped long")
    columns = [F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in df.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*columns, "n_lines", "n_dropped")
