"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Known, add_columns, map_arrow, texts

#: Words share this many vectors by their hash, so that the table has a fixed size.
BUCKETS, WIDTH, NONZERO, REACH = 1 << 14, 64, 8, 2
#: At most so many labelled documents train the network: those with the smallest hash of their id.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 20, 256, 0.01, 1e-4
#: Words whose contexts are summed at once.
AT_ONCE = 200_000

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
#: Markers that stand in the stream of words: upper case, a repeated word, and the gap between documents.
CAPS, AGAIN, GAP = 0, 1, BUCKETS


def _numbers(word: str) -> bytes:
    """Numbers of a word, two bytes each: its bucket, after a marker if it is in upper case."""
    found = (2 + xxhash.xxh32_intdigest(word.lower()) % (BUCKETS - 2)).to_bytes(2, sys.byteorder)
    return CAPS.to_bytes(2, sys.byteorder) + found if len(word) > 1 and word.isupper() else found


_words = Known(_numbers)


def word_numbers(text: str) -> np.ndarray:
    out = np.frombuffer(bytearray().join(map(_words.__getitem__, TOKEN.findall(text))), np.uint16)
    if out.size > 1:
        again = out[1:] == out[:-1]
        out[1:][again] = AGAIN
    return out


def index_vectors() -> np.ndarray:
    """A sparse random vector of 1, -1 and 0 for each bucket, and zero for the gap."""
    rng = np.random.default_rng(17)
    out = np.zeros((BUCKETS + 1, WIDTH), np.int8)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:BUCKETS], places, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return out


def context_sums(df: DataFrame, text_col: str) -> np.ndarray:
    """For each bucket the sum of the index vectors around its occurrences, over all documents.

    The sums are whole numbers, so they do not depend on the order of tasks.
    Each task sends a row for each bucket that it met, at most; the result has
    ``BUCKETS`` rows whatever the input.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, total = index_vectors(), np.zeros((BUCKETS + 1, WIDTH), np.int64)
        gap = np.full(REACH, GAP, np.uint16)

        def add(parts: list[np.ndarray]) -> None:
            ids = np.concatenate(parts)
            own = vectors[ids]
            near = np.zeros_like(own)
            for k in range(1, REACH + 1):
                near[k:] += own[:-k]
                near[:-k] += own[k:]
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            total[ids[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int32)

        for batch in batches:
            parts, size = [], 0
            for text in batch.column(0).to_pylist():
                parts += [word_numbers(text), gap]
                size += parts[-2].size
                if size > AT_ONCE:
                    add(parts)
                    parts, size = [], 0
            if parts:
                add(parts)
        met = np.flatnonzero(total[:BUCKETS].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(total[met, i]) for i in range(WIDTH))], ["bucket", *(f"s{i}" for i in range(WIDTH))])

    names = [f"s{i}" for i in range(WIDTH)]
    rows = map_arrow(texts(df, df.columns[0], text_col).select("text"), task, ", ".join(["bucket int", *(f"{n} long" for n in names)]))
    found = rows.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((BUCKETS + 1, WIDTH), np.float64)
    out[found["bucket"].to_numpy(np.int64)] = found[names].to_numpy(np.float64)
    return out


def word_vectors(df: DataFrame, text_col: str) -> np.ndarray:
    """A word's own index vector plus the direction of the contexts that it stands in."""
    context = context_sums(df, text_col)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return (index_vectors() / np.sqrt(NONZERO) + context / np.maximum(length, 1)).astype(np.float32)


def pooled(found: list[str], vectors: np.ndarray) -> np.ndarray:
    """The mean of the word vectors of each text; zero for a text without words."""
    out = np.zeros((len(found), WIDTH))
    for i, text in enumerate(found):
        ids = word_numbers(text)
        for at in range(0, ids.size, 20_000):
            out[i] += np.add.reduce(vectors.take(ids[at : at + 20_000], axis=0))
        out[i] /= max(1, ids.size)
    return out


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
        """Adam in small batches; every fifth row is kept for the temperature."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        kept, used = order[::5], np.setdiff1d(order, order[::5])
        net = cls(x.mean(axis=0) if len(y) else np.zeros(x.shape[1]), x.std(axis=0) + 1e-6 if len(y) else np.ones(x.shape[1]), [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])
        if not used.size or len(np.unique(y)) < 2:
            net.layers[2][:] = 0
            net.layers[3][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
            return net
        z, first, second, t = (x - net.mean) / net.spread, [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
        for _ in range(max(EPOCHS, 1500 * BATCH // used.size)):
            used = rng.permutation(used)
            for at in range(0, used.size, BATCH):
                rows, t = used[at : at + BATCH], t + 1
                a, b, c, _ = net.layers
                hidden = np.tanh(z[rows] @ a + b)
                wrong = (1 / (1 + np.exp(-np.clip(hidden @ c + net.layers[3], -50, 50))) - y[rows]) / rows.size
                back = np.outer(wrong, c) * (1 - hidden**2)
                slopes = [z[rows].T @ back + DECAY * a, back.sum(axis=0), hidden.T @ wrong + DECAY * c, np.array([wrong.sum()])]
                for k, slope in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    net.layers[k] = net.layers[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        if len(np.unique(y[kept])) == 2:
            logits = net.logits(x[kept])
            loss = lambda t: np.logaddexp(0, np.where(y[kept] == 1, -1, 1) * logits / t).mean()
            net.temperature = float(min(np.geomspace(0.25, 16, 97), key=loss))
        return net

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.spread @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def scores(self, found: list[str]) -> np.ndarray:
        return self.network.scores(pooled(found, self.vectors))


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are never learned from: the CRC-32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Word vectors from all documents; the network from at most ``sample`` labelled ones.

    Labels of held-out ids do not count, nor do null ones.  Of several labels
    for an id the mean decides.  Without two kinds of labels every text gets
    the same score.
    """
    vectors = word_vectors(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(vectors)
    chosen = labels.filter(~held_out(id_col)).groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.avg(f"`{label_col}`") >= 0.5).cast("int").alias("label"))
    chosen = chosen.filter("id is not null and label is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = texts(df, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "label", F.xxhash64("id", "text").alias("rank"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pooled(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([v.tobytes() for v in found], pa.binary())], ["label", "rank", "vector"])

    learned = map_arrow(rows, task, "label int, rank long, vector binary").orderBy("rank").limit(sample).toPandas()
    x = np.array([np.frombuffer(v) for v in learned["vector"]]).reshape(-1, WIDTH)
    return Classifier(vectors, Network.train(x, learned["label"].to_numpy(np.int64)))


def score(df: DataFrame, model: Classifier, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 of each whole text; a null text counts as empty.

    Every row gets a score, repeated rows the same one.  A column that has the
    name of the score already is replaced; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return add_columns(df, text_col, lambda found: [pa.array(shared.value.scores(found))], {score_col: "double"})
