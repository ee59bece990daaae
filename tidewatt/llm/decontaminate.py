"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .perfect_hash import mix
from .shared import Known, add_columns, unused

WORDS, SIMILARITY = 5, 0.8
#: Differing bits at which a window still is a candidate.  At a similarity of
#: 0.8 fingerprints differ in 9.7 bits on average, 2.9 the standard deviation.
RADIUS = 24
#: Characters of items that one pass over the documents takes with it.
BLOCK_CHARS = 1 << 24

WORD = re.compile(r"\w+")
ODD = 0x9E3779B97F4A7C15


_hashes = Known(xxhash.xxh3_64_intdigest)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    count = max(0, hashes.size - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * np.uint64(ODD) + hashes[k : k + count]
    return mix(out, 5)


def similarity(a: list[str], b: list[str], size: int) -> float:
    """Weighted Jaccard similarity: shingles weigh as often as they occur."""
    grams = lambda w: Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    x, y = grams(a), grams(b)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def prefix_bits(hashes: np.ndarray) -> np.ndarray:
    """Row i holds how often each bit is set in the first i hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def simhashes(prefix: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    sums = prefix[starts + count] - prefix[starts]
    return np.packbits(2 * sums > count, axis=1, bitorder="little").view(np.uint64).ravel()


class HammingBlocks:
    """Fingerprints found by blocks: of ``radius + 1`` blocks one is equal for any pair within the radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        ends = [64 * (i + 1) // (radius + 1) for i in range(radius + 1)]
        self.prints, self.radius = prints, radius
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.orders = [np.argsort((prints >> s) & m, kind="stable") for s, m in self.blocks]
        self.values = [((prints >> s) & m)[o] for (s, m), o in zip(self.blocks, self.orders, strict=True)]

    def near(self, print_: np.uint64) -> np.ndarray:
        """Every fingerprint within the radius, and no other."""
        found = []
        for (shift, mask), order, values in zip(self.blocks, self.orders, self.values, strict=True):
            value = (print_ >> shift) & mask
            found.append(order[np.searchsorted(values, value) : np.searchsorted(values, value, side="right")])
        some = np.unique(np.concatenate(found))
        return some[np.bitwise_count(self.prints[some] ^ print_) <= self.radius]


@dataclass
class Length:
    """The items of one length in words."""

    words: int
    size: int
    items: list[tuple[int, list[str]]]
    known: np.ndarray
    index: HammingBlocks


class Benchmark:
    """Items by length, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int, str]]):
        by: dict[int, list] = {}
        for item, text in items:
            if found := words_of(text or ""):
                by.setdefault(len(found), []).append((item, found))
        self.lengths = []
        for n, some in sorted(by.items()):
            size = min(WORDS, n)
            hashed = [shingles(np.array([_hashes[w] for w in found], np.uint64), size) for _, found in some]
            prints = np.array([simhashes(prefix_bits(h), np.zeros(1, np.int64), h.size)[0] for h in hashed], np.uint64)
            self.lengths.append(Length(n, size, some, np.unique(np.concatenate(hashed)), HammingBlocks(prints, RADIUS)))
        self.known = {size: np.unique(np.concatenate([x.known for x in self.lengths if x.size == size])) for size in {x.size for x in self.lengths}}
        self.sieve = {}
        for size, known in self.known.items():
            self.sieve[size] = np.zeros(1 << 22, bool)
            self.sieve[size][known & np.uint64((1 << 22) - 1)] = True

    def leaks(self, text: str) -> list[tuple[int, float, int]]:
        """Items whose best window is similar enough: item, similarity, first word of the window.

        A window takes part only if enough of its shingles occur in items of
        its length, without which it cannot reach the similarity.
        """
        words = words_of(text)
        if not words:
            return []
        hashes = np.array([_hashes[w] for w in words], np.uint64)
        best: dict[int, tuple[float, int]] = {}
        runs: dict[int, np.ndarray] = {}
        prefix: dict[int, np.ndarray] = {}
        hit: dict[int, np.ndarray] = {}
        for size, known in self.known.items():
            runs[size] = shingles(hashes, size)
            some = np.flatnonzero(self.sieve[size][runs[size] & np.uint64((1 << 22) - 1)])
            hit[size] = some[known[np.minimum(np.searchsorted(known, runs[size][some]), known.size - 1)] == runs[size][some]]
        for length in self.lengths:
            size, count = length.size, length.words - length.size + 1
            found = hit[size]
            if not found.size or len(words) < length.words:
                continue
            own = found[np.isin(runs[size][found], length.known)]
            need = int(np.ceil(count * 2 * SIMILARITY / (1 + SIMILARITY) - 1e-9))
            if own.size < need:
                continue
            marks = np.zeros(runs[size].size + 1, np.int64)
            marks[own + 1] = 1
            sums = np.cumsum(marks)
            starts = np.flatnonzero(sums[count:] - sums[:-count] >= need)
            if not starts.size:
                continue
            if size not in prefix:
                prefix[size] = prefix_bits(runs[size])
            for start, print_ in zip(starts.tolist(), simhashes(prefix[size], starts, count), strict=True):
                for i in length.index.near(print_):
                    item, gold = length.items[i]
                    if best.get(item, (0, 0))[0] < 1 and (s := similarity(words[start : start + length.words], gold, size)) >= SIMILARITY and s > best.get(item, (0, 0))[0]:
                        best[item] = (s, start)
        return [(item, s, start) for item, (s, start) in sorted(best.items())]


LEAK = "array<struct<item_id:bigint,similarity:double,start_word:bigint>>"
_LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64())]))


def mark_leaks(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", leaks_col: str = "leaks") -> DataFrame:
    """``df`` with the items that each whole text leaks: item, similarity and first word.

    Words are lower-cased runs of letters and digits; a shingle has five, or
    as many as a shorter item.  The benchmark is a stated query set: it is
    taken in blocks of bounded size, each of which passes over all documents.
    Null texts and null or wordless items leak nothing; a null item id is left
    out.  Rows that repeat an item are one item if their texts are equal.
    Documents keep their rows and columns, but for one that has the name of
    the new one.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").alias("text")).filter("item is not null and text is not null").distinct()
    size, count = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-(size + 100 * count) // BLOCK_CHARS))
    out = df
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        shared = df.sparkSession.sparkContext.broadcast(Benchmark([(r.item, r.text) for r in some]))
        name = leaks_col if block == 0 else unused(out, "more_leaks")

        def find(found: list[str], shared=shared) -> list[pa.Array]:
            return [pa.array([[{"item_id": i, "similarity": s, "start_word": w} for i, s, w in shared.value.leaks(t)] for t in found], _LEAK_ARROW)]

        out = add_columns(out, text_col, find, {name: LEAK})
        if block:
            out = out.withColumn(leaks_col, F.concat(f"`{leaks_col}`", f"`{name}`")).drop(name)
    return out


def leaked_items(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it leaks: ``doc_id, item_id, similarity, start_word``."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return mark_leaks(rows, benchmark).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
