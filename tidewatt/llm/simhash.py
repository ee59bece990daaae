"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints at ``radius`` differing bits or fewer agree well on some
rotation: cut into ``radius + 1`` blocks round a ring, there is a block from
which the differences in the first l blocks never exceed l - 1.  So each
rotation of the fingerprints is a trie in which pairs of nodes are traversed
with an error budget that starts at 0 and grows by one a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .components import connected_components
from .perfect_hash import mix
from .shared import map_arrow, stage, texts, whole_groups

#: Fingerprints of a group, about; groups of over ``SPLIT`` descend by ``STEP`` bits.
GROUP, SPLIT, STEP = 2000, 8192, 4
#: Node pairs of this many leaf pairs or fewer are compared outright.
LEAVES = 64
PIECE = 100_000
#: Bins of a sketch: the seven high bits of a hash choose one.
SKETCH = 128
#: Shingles of a chunk of a group whose sets are compared, and pairs that are compared before components are looked at again.
HELD, AT_ONCE = 4_000_000, 256
#: Up to so many shingles a set's keys find every similar set.
SHORT = 39


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of all words if they are fewer; of none for no words."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view(np.uint64)[0])


def sketch(hashes: np.ndarray) -> bytes:
    """The smallest hash of each of ``SKETCH`` bins, as one byte; 0 for an empty bin."""
    out = np.zeros(SKETCH, np.uint8)
    if hashes.size:
        mixed = np.sort(mix(hashes, 11))
        bins = (mixed >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out[bins[first]] = 1 + mixed[first] % np.uint64(255)
    return out.tobytes()


def least_shingles(hashes: np.ndarray, similarity: float) -> list[int]:
    """Keys of a set of distinct hashes, of which similar sets share one; one fixed key for no shingles.

    A set that can be similar to one of ``SHORT`` hashes or fewer has its least
    ones, of which two similar sets always share one: as many as may be left
    out, and one more.  Larger sets have the least hash in each eighth of the
    hash space.
    """
    if not hashes.size:
        return [0]
    mixed = np.sort(mix(hashes, 13))
    first = np.zeros(mixed.size, bool)
    if hashes.size * similarity <= SHORT + 1e-6:
        first[: hashes.size - math.ceil(hashes.size * similarity - 1e-6) + 1] = True
    if hashes.size > SHORT:
        part = mixed >> np.uint64(61)
        first |= np.concatenate([[True], part[1:] != part[:-1]])
    return mixed[first].view(np.int64).tolist()


def alike_radius(similarity: float) -> int:
    """Bits in which fingerprints of similar sets of distinct hashes may differ: eight standard deviations over their mean."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(64, math.ceil(64 * share + 8 * (64 * share * (1 - share)) ** 0.5))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of rows of sketches."""
    both, either = ((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


class Sets:
    """Shingle sets of rows: candidates by their sketches, decided on the sets themselves.

    The sketch only spares comparisons: it lets a pair pass down to seven
    standard errors below the similarity.
    """

    def __init__(self, sketches: np.ndarray, shingles: pa.Array, similarity: float):
        self.sketches, self.similarity = sketches, similarity
        self.least = similarity - 7 * (similarity * (1 - similarity) / SKETCH) ** 0.5
        self.hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles]
        self.size = np.fromiter(map(len, self.hashes), np.int64, len(self.hashes))

    def candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.size[a], self.size[b]
        sizes = np.minimum(x, y) >= self.similarity * np.maximum(x, y) - 1e-6
        sizes[sizes] = alike(self.sketches[a[sizes]], self.sketches[b[sizes]]) >= self.least
        return sizes

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fromiter((jaccard(self.hashes[x], self.hashes[y]) >= self.similarity for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, a.size)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of hashes, each in order; two empty ones are alike."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (both.size - common) if both.size else 1.0


# Trie join ------------------------------------------------------------------


def block_ends(radius: int) -> list[int]:
    return [64 * (i + 1) // (radius + 1) for i in range(radius + 1)]


def depth_budgets(radius: int) -> np.ndarray:
    """The most differing bits in the first d bits, for d from 0 to 64."""
    return np.searchsorted(block_ends(radius), np.arange(65))


class Labels:
    """Disjoint sets over 0 to n - 1; a set's label is its smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def trie_links(values: np.ndarray, pairs: np.ndarray, radius: int, budgets: np.ndarray | None = None, sets: Sets | None = None) -> np.ndarray:
    """The label of each value: values linked by the traversal share one.

    ``values`` are fingerprints, in order within each trie.  A row of
    ``pairs`` is a pair of root nodes: the ranges of two tries, or twice the
    range of one, and 0 for the bits that differ so far.  A pair of nodes that
    already hold one component is passed over.  ``budgets`` are the most
    differing bits for each depth, ``radius`` if there are none.  With
    ``sets`` a link needs their similarity, too.
    """
    labels = Labels(values.size)
    budgets = np.full(65, radius) if budgets is None else budgets
    link = lambda a, b: _link(values, labels, a, b, radius, sets)
    own = pairs[(pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] > 1)]
    if own.size:
        sizes = own[:, 1] - own[:, 0] - 1
        first = np.repeat(own[:, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        link(first, first + 1)
    ones: dict[int, np.ndarray] = {}
    stack = [(0, pairs)]
    while stack:
        depth, pairs = stack.pop()
        changes = np.concatenate([[0], np.cumsum(labels.of[1:] != labels.of[:-1])])
        al, ah, bl, bh, errors = pairs.T
        same = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (labels.of[al] == labels.of[bl])
        pairs = pairs[~same]
        al, ah, bl, bh, errors = pairs.T
        few = (ah - al) * (bh - bl) <= (LEAVES if depth < 64 else np.inf)
        if few.any():
            _leaves(pairs[few], link)
            pairs = pairs[~few]
            al, ah, bl, bh, errors = pairs.T
        if not pairs.size:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        count = ones[depth]
        am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
        twin = (al == bl) & (ah == bh)
        make = lambda a, b, c, d, e: np.stack([a, b, c, d, e], axis=1)
        new = np.concatenate([make(al, am, bl, bm, errors), make(am, ah, bm, bh, errors), make(al, am, bm, bh, errors + 1), make(am, ah, bl, bm, errors + 1)[~twin]])
        new = new[(new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3]) & (new[:, 4] <= budgets[depth + 1])]
        stack += [(depth + 1, new[at : at + PIECE]) for at in range(0, len(new), PIECE)]
    return labels.of


def _leaves(pairs: np.ndarray, link: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Compare all leaves of node pairs, some at a time."""
    al, ah, bl, bh, _ = pairs.T
    width = bh - bl
    sizes = (ah - al) * width
    ends = np.cumsum(sizes)
    for at in range(0, int(ends[-1]) if ends.size else 0, 10 * PIECE):
        place = np.arange(at, min(at + 10 * PIECE, int(ends[-1])))
        which = np.searchsorted(ends, place, side="right")
        place = place - (ends - sizes)[which]
        link(al[which] + place // width[which], bl[which] + place % width[which])


def _link(values: np.ndarray, labels: Labels, a: np.ndarray, b: np.ndarray, radius: int, sets: Sets | None) -> None:
    near = np.bitwise_count(values[a] ^ values[b]) <= radius
    a, b = a[near], b[near]
    if sets is None:
        labels.join(a, b)
        return
    for at in range(0, a.size, PIECE):
        x, y = _apart(labels, a[at : at + PIECE], b[at : at + PIECE])
        found = sets.candidates(x, y)
        x, y = x[found], y[found]
        while x.size:
            some, other = x[:AT_ONCE], y[:AT_ONCE]
            good = sets.alike(some, other)
            labels.join(some[good], other[good])
            x, y = _apart(labels, x[AT_ONCE:], y[AT_ONCE:])


def _apart(labels: Labels, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = labels.of[a] != labels.of[b]
    return a[apart], b[apart]


def _rotate(values: np.ndarray, left: int) -> np.ndarray:
    left %= 64
    return values if not left else (values << np.uint64(left)) | (values >> np.uint64(64 - left))


def _chunked(rows: DataFrame, keys: list[str], cap: int, weight: Column | None = None) -> DataFrame:
    """Split groups of over ``cap`` rows into chunks and give each pair of chunks the rows of both.

    A row counts as ``weight`` rows if that is given.  Adds the chunks ``i <= j`` of the pair, and ``side``, 1 for the rows of
    chunk ``j`` of two.
    """
    large = stage(rows.groupBy(*keys).agg(F.sum(F.lit(1) if weight is None else weight).alias("count")).filter(F.col("count") > cap).select(*keys, F.ceil(F.col("count") / cap).cast("int").alias("chunks")), "large-groups")
    rows = rows.join(large, keys, "left").withColumn("chunk", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    return rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other"), "side": (F.col("chunk") > F.col("other")).cast("int")}).drop("chunks", "chunk", "other")


def _deeper(rows: DataFrame, depth: int, step: int, budgets: np.ndarray) -> DataFrame:
    """Each row in the node pairs below its own, ``step`` bits on: those whose differing bits the budget still allows."""
    masks = F.explode(F.array(*(F.lit(m).cast("long") for m in range(1 << step)))).alias("mask")
    rows = rows.select("node", "turn", "value", "a", "b", "side", masks).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) + F.bit_count("mask") <= int(budgets[depth + step]))
    own = F.shiftrightunsigned("value", 64 - depth - step)
    across = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    other = F.shiftleft(across, step).bitwiseOR(own.bitwiseAND((1 << step) - 1).bitwiseXOR(F.col("mask")))
    one = F.col("a") == F.col("b")
    rows = rows.select("node", "turn", "value", own.alias("own"), other.alias("other"), F.when(one, (own > other).cast("int")).otherwise(F.col("side")).alias("side"))
    return rows.select("node", "turn", "value", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("a"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("b"), "side")


def fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges ``u, v`` that connect the ``node`` of ``nodes`` as all pairs of ``fp`` within the radius would.

    A group is a pair of nodes ``a, b`` of the trie of one rotation, at one
    depth: the fingerprints below them, or below one node if they are equal.
    Groups of over ``SPLIT`` fingerprints descend; a fingerprint is copied only
    to the node pairs that the budget of the depth allows it.
    """
    starts, budgets = [0, *block_ends(radius)[:-1]], depth_budgets(radius)
    depth = min(block_ends(radius)[0], max(0, (nodes.count() // GROUP).bit_length()))
    turned = F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")).alias("value")) for i, s in enumerate(starts)))).alias("r")
    root = F.shiftrightunsigned("r.value", 64 - depth) if depth else F.lit(0).cast("long")
    rows = nodes.select("node", turned).select("node", "r.turn", "r.value", root.alias("a"), root.alias("b"), F.lit(0).alias("side"))

    def links(table: pa.Table) -> pa.Table:
        values, nodes, side = (table.column(c).to_numpy() for c in ("value", "node", "side"))
        values = values.view(np.uint64)
        order = np.lexsort((values, side))
        values, nodes, middle, n = values[order], nodes[order], int((side == 0).sum()), len(side)
        pair = [0, n, 0, n, 0] if table.column("a")[0] == table.column("b")[0] else [0, middle, middle, n, 0]
        labels = trie_links(values, np.array([pair]), radius, budgets)
        moved = labels != np.arange(n)
        return pa.table({"u": nodes[moved], "v": nodes[labels[moved]]})

    group, edges = ["turn", "a", "b"], None
    while True:
        sizes = rows.groupBy(*group).agg(F.count("*").alias("count"), F.min("side").alias("low"), F.max("side").alias("high"))
        if edges is not None:  # node pairs with nothing below one of them
            sizes = stage(sizes.filter("a = b OR low < high"), "node-pairs")
            rows = rows.join(sizes.select(*group), group, "left_semi")
        large = stage(sizes.filter(F.col("count") > SPLIT).select(*group), "large-node-pairs")
        new = rows.join(large, group, "left_anti").groupBy(*group).applyInArrow(links, "u long, v long")
        edges = new if edges is None else edges.unionByName(new)
        if not large.limit(1).count():
            return edges.distinct()
        rows, depth = _deeper(rows.join(large, group, "left_semi"), depth, step := min(STEP, 64 - depth), budgets), depth + step
        rows = stage(rows, "deeper-node-pairs")


def alike_links(nodes: DataFrame, rows: DataFrame, words: int, radius: int, similarity: float, count: int) -> DataFrame:
    """Edges ``u, v`` between nodes of similar shingle sets, found by tries of those that share a least shingle.

    The keys of a node are its ``least_shingles``.  Two large sets of similarity
    s share none of them with a chance of (1 - s)^8, 2.6 in a million at 0.8;
    short ones always share one.  The nodes of a key make one trie, and a link
    needs the exact similarity of the sets.  ``rows`` are the texts; their sets
    go only to the keys that nodes share.  ``count`` is about how many nodes there are.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = stage(keyed.join(keyed.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi"), "shared-keys", rows=count)
    needed = rows.select("node", "text").join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(text, words)).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    sets = stage(map_arrow(needed, shingles, "node long, shingles binary"), "shingle-sets", rows=4 * count)
    full = F.greatest(F.lit(1.0), F.col("size") * (SPLIT / HELD))
    sizes = sets.select("node", (F.octet_length("shingles") / 8).alias("size"))
    keys = _chunked(shared.join(sizes, "node"), ["key"], SPLIT, full).select("node", "key", "i", "j", "side")
    rows = keys.join(nodes.select("node", "fp", "sketch"), "node").join(sets, "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "i", "j"], SPLIT):
            nodes, values, key, i, j, side = (table.column(c).to_numpy() for c in ("node", "fp", "key", "i", "j", "side"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]])
            low, high = np.flatnonzero(new)[:-1], np.flatnonzero(new)[1:]
            left = np.concatenate([[0], np.cumsum(side == 0)])
            middle = low + left[high] - left[low]
            two = i[low] != j[low]
            pairs = np.stack([low, np.where(two, middle, high), np.where(two, middle, low), high, np.zeros_like(low)], axis=1)
            pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (high - low > 1)]
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            found = Sets(sketches, table.column("shingles"), similarity)
            labels = trie_links(values.view(np.uint64), pairs, radius, None, found)
            moved = labels != np.arange(labels.size)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[labels[moved]])], ["u", "v"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("key", "i", "j", "side", "fp", "node", "sketch", "shingles").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", F.shiftrightunsigned("fp", 1), "fp")
    return map_arrow(ordered, links, "u long, v long").distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Documents whose fingerprints differ in ``radius`` bits or fewer link, and
    ``component_id`` is the smallest id reachable.  With ``similarity`` a link
    needs sets of distinct shingles that are so alike, by their exact Jaccard
    similarity; fingerprints are over distinct shingles then, and the radius is
    that of ``alike_radius`` at least.

    A null or empty text has the fingerprint zero, linked like any other.
    Rows that repeat an id each keep a row; a null id never is a component's
    smallest while another id is there.  An empty table gives an empty one;
    other columns are left out.
    """
    prints, named = _grouped(df, id_col, text_col, words, radius, similarity)
    lowest = named.groupBy("part").agg(F.min("low").alias("component_id"))
    known = named.join(lowest, "part").select("node", "component_id")
    return prints.select("doc_id", "fp", "node").join(known, "node").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, similarity: float) -> DataFrame:
    """The rows of ``df`` without near-duplicates: one row of each component of similar texts.

    It is the row of smallest id, a null id after all others; of several texts
    under that id the one of smallest hash, and of rows equal in both the
    smallest by all columns.  So ids need not be unique, and runs agree.
    """
    _, named = _grouped(df, id_col, text_col, words, radius, similarity)
    first = named.groupBy("part").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("first")).select(F.col("first.low").alias("__low"), F.col("first.node").alias("__node"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("node"))
    kept = rows.join(first, (F.col("node") == F.col("__node")) & F.col("id").eqNullSafe(F.col("__low")), "left_semi")
    return kept.groupBy("node").agg(F.min("row").alias("row")).select("row.*")


def _grouped(df: DataFrame, id_col: str, text_col: str, words: int, radius: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp, node`` of each row, and ``node, low, part``: the smallest id of each node, and its component."""
    exact = similarity is None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sketches, keys = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, words)
                hashes = hashes if exact else np.unique(hashes)
                found.append(fingerprint(hashes))
                sketches.append(None if exact else sketch(hashes))
                keys.append(None if exact else least_shingles(hashes, similarity))
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, prints if exact else batch.column(2), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "node", "sketch", "keys"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = texts(df, id_col, text_col)
    rows = rows if exact else rows.withColumn("node", F.xxhash64("text"))
    seen = Observation()
    prints = stage(map_arrow(rows, task, f"doc_id {kind}, fp long, node long, sketch binary, keys array<long>").observe(seen, F.count("*").alias("n")), "fingerprints")
    count = seen.get["n"]
    nodes = stage(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), *([] if exact else [F.first("sketch").alias("sketch"), F.first("keys").alias("keys")])), "fingerprint-nodes", rows=count)
    parts = connected_components(fingerprint_links(nodes, radius) if exact else alike_links(nodes, rows, words, max(radius, alike_radius(similarity)), similarity, count))
    named = nodes.select("node", "low").join(parts, "node", "left").select("node", "low", F.coalesce("component", "node").alias("part"))
    return prints, named
