"""Removal of long strings that repeat anywhere, by column-wise suffix ordering.

A literal collection-wide construction rewrites its whole external file once
for every column of the longest text.  Here the collection is first cut into
groups that can share a repeat at all, and columns are inserted within groups:

1. In every string of ``LENGTH`` bytes the least of its gram hashes is at the
   same place as in any equal string.  These places are the samples of a text.
2. Samples whose gram occurs once in the corpus cannot lie in a repeat.
3. Samples that agree on all bytes a repeat round them could have are repeats.
4. For the others, each repeat holds one of four cores of 309 bytes, which
   leaves 91 bytes on either side open.  Contexts of equal cores make a group,
   into which one symbol per context is inserted each round, from the right:
   the suffix order is sorted by the new symbol, and common prefixes with the
   neighbour follow from those of the round before.
5. A group too large for a task is split by further columns: half of the open
   bytes on one side join the core, on the left for some repeats and on the
   right for the others, until groups are small or nothing is left open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect_hash import mix
from .shared import map_arrow, stage, texts, whole_groups

LENGTH, GRAM, PARTS = 400, 40, 4
#: Bytes that a core leaves open on a side.
OPEN = -(-(LENGTH - GRAM + 1) // PARTS)
CORE = LENGTH - OPEN
#: Contexts of one core beyond which its group is split by further columns, and contexts that a task orders at once.
#: Rows of any other key that are more than ``GROUP`` do not meet in one task either.
GROUP, AT_ONCE = 2000, 40_000
#: Texts are sampled in pieces of this many bytes, with an overlap.
PIECE = 1 << 22
OUTSIDE = 0xFF  # never occurs in UTF-8

BASE = 0x9E3779B97F4A7C15
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    size = 1 << max(16, count.bit_length())
    if size not in _tables:
        _tables.clear()
        up = np.concatenate([[np.uint64(1)], np.full(size, BASE, np.uint64)])
        down = np.concatenate([[np.uint64(1)], np.full(size, pow(BASE, -1, 1 << 64), np.uint64)])
        _tables[size] = np.cumprod(up), np.cumprod(down)
    return _tables[size]


class Rolling:
    """Hashes of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(data.size + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size])])

    def of(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start], seed)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both ends of blocks."""
    full = np.full(-(-x.size // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: x.size] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: x.size - width + 1], ahead[width - 1 : x.size])


def sample_places(rolling: Rolling, size: int) -> np.ndarray:
    """Where the leftmost least gram of each string of ``LENGTH`` bytes is."""
    found, width = [], LENGTH - GRAM + 1
    for at in range(0, size - LENGTH + 1, PIECE):
        start = np.arange(at, min(size - GRAM, at + PIECE + LENGTH - GRAM - 1) + 1)
        ranked = (rolling.of(start, start + GRAM, 3) >> np.uint64(23) << np.uint64(23)) | (start - at).astype(np.uint64)
        found.append((least(ranked, width) & np.uint64((1 << 23) - 1)).astype(np.int64) + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


# In a group -----------------------------------------------------------------


def range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low..high]``, both included."""
    span = high - low + 1
    levels = np.frexp(span)[1] - 1
    out = np.empty(low.size, values.dtype)
    table = values
    for level in range(int(levels.max(initial=0)) + 1):
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[:-half], table[half:])
        own = levels == level
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << level) + 1])
    return out


def repeated_windows(groups: np.ndarray, contexts: np.ndarray, width: int) -> np.ndarray:
    """For each context and column, whether another context of its group has the same ``width`` symbols there.

    Columns are inserted from the last to the first.  ``order`` lists the
    contexts by group and suffix, ``shared`` the symbols that each has in
    common with the one before it.  Returns a row per context, a column per
    start from 0 to the last that leaves ``width`` symbols.
    """
    count, columns = contexts.shape
    out = np.zeros((count, columns - width + 1), bool)
    order = np.argsort(groups, kind="stable")
    ranks = np.cumsum(np.concatenate([[0], groups[order][1:] != groups[order][:-1]])) if count else np.zeros(0, np.int64)
    rank_of = np.empty(count, np.int64)
    rank_of[order] = ranks
    shared = np.zeros(count, np.int16)
    for column in range(columns - 1, -1, -1):
        keys = (rank_of[order] << 8) | contexts[order, column]
        moved = np.argsort(keys, kind="stable")
        keys = keys[moved]
        same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        now = np.zeros(count, np.int16)
        if same.size:
            now[same] = 1 + range_least(shared, moved[same - 1] + 1, moved[same])
        order, shared = order[moved], now
        if column < out.shape[1]:
            long = np.flatnonzero(shared >= width)
            out[order[long], column] = True
            out[order[long - 1], column] = True
    return out


# Spark ----------------------------------------------------------------------

OCCURRENCE = "struct(t, n, place)"


def _samples(docs: DataFrame, wide: bool) -> DataFrame:
    """Samples of each different text: gram and occurrence, or all that is needed to compare them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                n = data.size
                if n < LENGTH or (t, n) in seen:
                    continue
                seen.add((t, n))
                rolling = Rolling(data)
                p = sample_places(rolling, n)
                gram = rolling.of(p, p + GRAM, 5).view(np.int64)
                if not wide:
                    rows.append([gram, (mix(p.astype(np.uint64), 7) ^ np.array([t], np.int64).view(np.uint64)).view(np.int64)])
                    continue
                low, high = np.maximum(p - (LENGTH - GRAM), 0), np.minimum(p + LENGTH, n)
                around = rolling.of(low, high, 11) ^ mix(((p - low) * 1000 + (high - p)).astype(np.uint64), 13)
                cores = []
                for i in range(PARTS):
                    c = p - OPEN * i
                    inside = (c >= 0) & (c + CORE <= n)
                    c = np.where(inside, c, 0)
                    cores.append(np.where(inside, rolling.of(c, np.minimum(c + CORE, n), 17).view(np.int64), 0))
                rows.append([gram, np.full(p.size, t), np.full(p.size, n), p, around.view(np.int64), *cores])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names)

    names = ["gram", "t", "n", "place", "around", *(f"core{i}" for i in range(PARTS))] if wide else ["gram", "at"]
    return map_arrow(docs.select("t", "text"), task, ", ".join(f"{n} long" for n in names))


def _among(rows: DataFrame, keys: DataFrame, on: list[str], group: int) -> DataFrame:
    """Rows whose ``on`` is among ``keys``, and whether over ``group`` rows are (``large``).

    ``keys`` has each ``on`` once, with the number of its rows as ``many``.
    Large keys, at most a ``group``-th of all rows, are told to every task;
    their rows are dealt to parts by their place, so they meet nowhere.
    """
    parts = F.when(F.col("many") > group, F.ceil(F.col("many") / max(1, group // 8))).otherwise(1).cast("int")
    large = keys.filter(F.col("many") > group).select(*on, parts.alias("parts"))
    dealt = rows.join(F.broadcast(large), on, "left").withColumn("large", F.col("parts").isNotNull())
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("t", "n", "place"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    keys = keys.select(*on, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(keys.hint("merge"), [*on, "part"], "left_semi").drop("part")


def _compare(rows: DataFrame, width: int) -> DataFrame:
    """Repeats among contexts of equal cores that leave ``width`` bytes open: ``t, n, low, high``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["core"], AT_ONCE):
            core, t, n, place = (table.column(c).to_numpy() for c in ("core", "t", "n", "place"))
            contexts = np.frombuffer(b"".join(table.column("context").to_pylist()), np.uint8).reshape(-1, 2 * width)
            hit = repeated_windows(core, contexts, width)
            left, right = np.minimum(place, width), np.minimum(n - place - (LENGTH - width), width)
            column = np.arange(width + 1)
            hit &= (width - column <= left[:, None]) & (column <= right[:, None])
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            low, high = place[row] - width + first, place[row] - width + last + LENGTH
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[row], n[row], low, high)], ["t", "n", "low", "high"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("core", "context", "t", "n", "place").repartition(parts, "core").sortWithinPartitions("core", "t", "n", "place")
    return map_arrow(ordered, task, "t long, n long, low long, high long")


def _split(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Contexts with longer cores, and the bytes that they leave open.

    A repeat takes ``width`` bytes of the left and the right open ones
    together, so half of them on one side at least.  Each context becomes one
    with that half on the right in its core and one with the half on the left.
    """
    half, left = (width + 1) // 2, width // 2
    core = lambda side, start: F.xxhash64(F.lit(side), F.col("core"), F.substring("context", start, half)).alias("core")
    cut = lambda a, b: F.concat(F.substring("context", a + 1, left), F.substring("context", b + 1, left)).alias("context")
    right = rows.filter(F.col("n") - F.col("place") - (LENGTH - width) >= half).select(core("right", width + 1), cut(half, width + half), "t", "n", "place")
    other = rows.filter(F.col("place") >= half).select(core("left", left + 1), cut(0, width), "t", "n", (F.col("place") - half).alias("place"))
    return right.unionByName(other), left


def _large_groups(rows: DataFrame, group: int) -> DataFrame:
    """Repeats among contexts of large groups.

    Contexts of a group that are equal as a whole repeat as a whole, and one
    of them goes on for all.  What is then still large gets longer cores, until
    groups are small or nothing is open, and so all contexts are equal.
    """
    width, found, core = OPEN, [], ["core", "same"]
    while True:
        rows = stage(rows.withColumn("same", F.xxhash64("context")), "open-contexts", compression="zstd")
        classes = rows.groupBy(*core).agg(F.count("*").alias("many"), F.min(F.struct("t", "n", "place", "context")).alias("one"))
        classes = stage(classes, "equal-contexts", compression="zstd")
        equal = _among(rows, classes.filter("many > 1"), core, group)
        low, high = F.greatest(F.col("place") - width, F.lit(0)), F.least(F.col("place") + LENGTH, F.col("n"))
        found.append(equal.select("t", "n", low.alias("low"), high.alias("high")).filter(F.col("high") - F.col("low") >= LENGTH))

        rows = classes.select("core", "one.context", "one.t", "one.n", "one.place")
        held = stage(rows.groupBy("core").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "context-groups", compression="zstd")
        small, large = held.filter(F.col("contexts") <= group).select("core"), F.broadcast(held.filter(F.col("contexts") > group).select("core"))
        found.append(_compare(rows.join(large, "core", "left_anti").join(small.hint("merge"), "core", "left_semi"), width))
        if not large.limit(1).count():
            break
        rows, width = _split(rows.join(large, "core", "left_semi"), width)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _contexts(found: DataFrame) -> DataFrame:
    """The open bytes on both sides of each wanted core."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for t, n, packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack.decompress(packed)
                for w in wanted:
                    c = w["place"]
                    context = data[max(0, c - OPEN) : c].rjust(OPEN, b"\xff") + data[c + CORE : c + LENGTH].ljust(OPEN, b"\xff")
                    for column, value in zip(rows, (w["core"], context, t, n, c), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    names = ["core", "context", "t", "n", "place"]
    return map_arrow(found.select("t", "n", "packed", "wanted"), task, "core long, context binary, t long, n long, place long")


def _packed(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Texts compressed before they are shuffled."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*extra, "t", "n").schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([pack.compress(text.encode()) for text in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*extra, "t", "n")), packed], [*extra, "t", "n", "packed"])

    return map_arrow(docs.select(*extra, "t", "n", "text"), task, f"{kinds}, packed binary")


def repeated_ranges(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Byte ranges to remove of each different text ``t, n``; they may overlap."""
    grams = _samples(docs, wide=False).groupBy("gram").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("many"))
    grams = stage(grams.filter("a <> b").select("gram", "many"), "repeated-grams")
    samples = stage(_among(_samples(docs, wide=True), grams, ["gram"], group).drop("large"), "samples", compression="zstd")
    classes = samples.groupBy("gram", "around").agg(F.min(F.expr(OCCURRENCE)).alias("a"), F.max(F.expr(OCCURRENCE)).alias("b"), F.count("*").alias("many"), *(F.first(f"core{i}").alias(f"core{i}") for i in range(PARTS)))
    classes = stage(classes, "sample-classes", compression="zstd")
    equal = _among(samples, classes.filter("a <> b"), ["gram", "around"], group)
    ranges = equal.select("t", "n", F.greatest(F.col("place") - (LENGTH - GRAM), F.lit(0)).alias("low"), F.least(F.col("place") + LENGTH, "n").alias("high")).filter(F.col("high") - F.col("low") >= LENGTH)

    cores = F.explode(F.array(*(F.struct(F.col(f"core{i}").alias("core"), (F.col("a.place") - OPEN * i).alias("place")) for i in range(PARTS)))).alias("c")
    cores = classes.select("a.t", "a.n", cores).select("t", "n", "c.core", "c.place").filter("core <> 0").distinct()
    cores = stage(cores, "cores", compression="zstd")
    shared = stage(cores.groupBy("core").agg(F.count("*").alias("many")).filter("many > 1"), "shared-cores")
    wanted = _among(cores, shared, ["core"], group)
    wanted = stage(wanted.groupBy("t", "n", "large").agg(F.collect_list(F.struct("core", "place")).alias("wanted")), "wanted-cores", compression="zstd")
    distinct = _packed(docs, []).groupBy("t", "n").agg(F.first("packed").alias("packed"))
    found = distinct.join(wanted.hint("merge"), ["t", "n"])
    ranges = ranges.unionByName(_compare(_contexts(found.filter("not large")), OPEN))
    if wanted.filter("large").limit(1).count():
        ranges = ranges.unionByName(_large_groups(_contexts(found.filter("large")), group))
    return ranges


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Remove each byte covered by a string of 400 bytes that starts anywhere else too.

    One row per document: ``doc_id, n_bytes, n_removed, n_spans`` (maximal
    removed runs), ``kept`` and ``kept_sha256``; ``kept`` are bytes, since a
    cut may fall inside a character.  Strings are judged on the input: of two
    equal texts of 400 bytes or more neither keeps a byte.  A null text is
    empty.  Null ids and rows that repeat an id are documents like others; an
    empty table gives an empty one; other columns are left out.
    """
    docs = texts(df, id_col, text_col).withColumns({"t": F.xxhash64("text"), "n": F.octet_length("text").cast("long")})
    copies = docs.groupBy("t", "n").count().filter(f"count > 1 and n >= {LENGTH}").select("t", "n", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
    ranges = repeated_ranges(docs, group).unionByName(copies).groupBy("t", "n").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    joined = _packed(docs, ["doc_id"]).join(ranges.hint("merge"), ["t", "n"], "left").select("doc_id", "packed", "ranges")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = unpack.decompress(packed)
                kept, at, spans, reach = [], 0, 0, -1
                for low, high in sorted((r["low"], r["high"]) for r in found or ()):
                    if low > reach:
                        spans += 1
                        kept.append(data[at:low])
                    at = reach = max(reach, high)
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(joined, task, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
