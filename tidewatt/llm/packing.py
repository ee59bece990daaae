"""Mixture-controlled packing by deficit round-robin over source queues.

Every window is filled to the target token proportions.  What rounding leaves
to a queue is carried to later windows; as the carried amount follows from the
number of windows alone, any task can tell where a queue stands at any window,
and so the deficits cross partitions without passing rows through one place.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, stage

WINDOW = 2048
END_ID = 1
#: Bytes of words and ids from which on a Python worker starts a new generation of them; it keeps two while a task runs.
CACHED_BYTES = 3 << 24
#: A source with less than this share of all characters has no queue of its own: such sources share one.
QUEUES = 128
#: Whole numbers that a task keeps of windows that it has looked at.
KEPT_NUMBERS = 250_000


# Tokens ---------------------------------------------------------------------


def _class(wanted: Callable[[str], bool]) -> str:
    return "".join(rf"\x{{{ord(c):x}}}" for c in map(chr, range(0x250)) if wanted(c))


_LETTERS, _DIGITS = (_class(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
#: The tokenizer's own split of a lower-cased text into words, for characters up to U+024F.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\t\n\x0b\x0c\r {_LETTERS}{_DIGITS}]+"
#: Texts with other characters, with ones that lower-casing takes beyond these, or with other white space than ASCII's go to the tokenizer whole.
ODD = "[^" + _class(lambda c: len(c.lower()) == 1 and c.lower() < "ɐ" and (c in " \t\n\v\f\r" or not c.isspace()) and not "\x80" <= c <= "\x9f") + "]"
#: Bytes of texts that are encoded at once.
SLICE_BYTES = 1 << 22


class Encoder:
    """Ids of whole texts as unsigned 16-bit integers, word by word.

    The tokenizer's words do not influence each other, so each word is
    encoded once for a task and looked up after that, as long as the words of
    two generations hold it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit in 16 bits")
        # Texts that hold an added token, in any case, go to the tokenizer whole too.
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *(f"(?i:{token})" for token in sorted(added))])
        self.last = np.zeros(1 << 16, bool)  # ids that end a word
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Give back what the words take; the tokenizer itself stays."""
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0
        pa.default_memory_pool().release_unused()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _learn(self, words: list[str]) -> None:
        """Encode words, many in one text; the ids that end a word part them again."""
        if self.held > CACHED_BYTES:
            self.young, self.old, self.held = {"": b""}, self.young, 0
        fresh = []
        for word in words:
            if word in self.young:
                continue
            self.held += 200 + 2 * len(word)
            if (found := self.old.get(word)) is not None:
                self.young[word] = found
            else:
                fresh.append(word)
        for at in range(0, len(fresh), 2000):
            some = fresh[at : at + 2000]
            ids = self._ids(" ".join(some))
            ends = (2 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(some):
                raise ValueError("this tokenizer does not mark the ends of words")
            data = ids.tobytes()
            self.young.update(zip(some, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _encode_plain(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), WORDS, r"\0 "))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        known = [self.young[w] for w in words]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        table, first = np.frombuffer(b"".join(known), "<u2"), np.cumsum(size) - size
        index = coded.indices.to_numpy()
        counts = size[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        data = table[np.repeat(first[index] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        bounds = (2 * ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            some = texts.slice(at, end - at)
            odd = pc.match_substring_regex(some, self.odd)
            plain = iter(self._encode_plain(some.filter(pc.invert(odd))))
            whole = iter(some.filter(odd).to_pylist())
            out += [self._ids(next(whole)).tobytes() if is_odd else next(plain) for is_odd in odd.to_pylist()]
            at = end
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# Schedule -------------------------------------------------------------------


def _shares(tokens: int, weights: list[int]) -> list[int]:
    """Divide ``tokens`` by ``weights`` in whole numbers that never fall as ``tokens`` grows."""
    out, left, total = [0] * len(weights), tokens, sum(weights)
    for i in range(len(weights) - 1, 0, -1):
        rest = left * (total - weights[i]) // total if total else 0
        out[i], left, total = left - rest, rest, total - weights[i]
    out[0] = left
    return out


@dataclass
class Phase:
    """Windows over which the same queues are served at the same rates."""

    first: int
    served: list[int]
    active: list[int] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)


class Schedule:
    """Tokens of each queue served before a window, for any window.

    ``weights`` are the target proportions.  When a queue runs dry the others
    share its part in proportion; queues of weight 0 come after all others.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int = WINDOW):
        self.totals, self.window, self.phases = totals, window, []
        served, at = [0] * len(totals), 0
        while any(s < t for s, t in zip(served, totals, strict=True)):
            left = [t - s for s, t in zip(served, totals, strict=True)]
            active = [i for i, x in enumerate(left) if x and weights[i]] or [i for i, x in enumerate(left) if x]
            rates = [weights[i] or left[i] for i in active]
            fits = lambda n: all(x <= left[i] for i, x in zip(active, _shares(n * window, rates), strict=True))  # noqa: B023, E731
            low, high = 0, sum(left[i] for i in active) // window + 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if fits(middle) else (low, middle)
            if low:
                self.phases.append(Phase(at, served, active, rates))
                served = list(served)
                for i, x in zip(active, _shares(low * window, rates), strict=True):
                    served[i] += x
                at += low
                continue
            # A queue ends inside this window: the rest of its part goes to the others.
            self.phases.append(Phase(at, served))
            served, room = list(served), window
            for i, x in zip(active, _shares(window, rates), strict=True):
                take = min(x, left[i])
                served[i] += take
                room -= take
            for i in sorted(range(len(totals)), key=lambda i: (i not in active, served[i] - totals[i])):
                take = min(room, totals[i] - served[i])
                served[i] += take
                room -= take
            at += 1
        self.phases.append(Phase(at, served))
        self.windows = at
        self.starts = [p.first for p in self.phases]

    def before(self, window: int) -> list[int]:
        at = int(np.searchsorted(self.starts, window, side="right")) - 1
        phase = self.phases[at]
        out = list(phase.served)
        if phase.active and window > phase.first:
            for i, x in zip(phase.active, _shares((window - phase.first) * self.window, phase.weights), strict=True):
                out[i] += x
        return out

    def window_of(self, queue: int, token: int) -> int:
        """The window that holds this token of the queue."""
        low, high = 0, self.windows
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.before(middle)[queue] <= token else (low, middle)
        return low


# Spark ----------------------------------------------------------------------


def tokenize(df: DataFrame, tokenizer: str, queues: list[str], *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Ids of each document, and where it stands in its part of its queue."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reached, end = encoder(tokenizer), {}, np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            ids = [x + end for x in coder.encode(batch.column("text"))]
            starts = []
            for queue, x in zip(batch.column("queue").to_pylist(), ids, strict=True):
                starts.append(reached.get(queue, 0))
                reached[queue] = starts[-1] + len(x) // 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("queue"), batch.column("part"), pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()), batch.column("source")],
                ["doc_id", "queue", "part", "start_in_part", "doc_tokens", "ids", "source"],
            )
        coder.forget()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.when(queue_of(source_col).isin(queues), queue_of(source_col)).otherwise(REST).alias("queue"),
        F.spark_partition_id().alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    return map_arrow(rows, task, f"doc_id {kind}, queue string, part int, start_in_part long, doc_tokens long, ids binary, source string")


#: The queue of the sources that have none of their own.
REST = "*"


def queue_of(source_col: str) -> Column:
    """A source's name after a mark; a null source is a source too."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-"))


def own_queues(df: DataFrame, text_col: str, source_col: str) -> list[str]:
    """Sources with at least one ``QUEUES``-th of all characters, so ``QUEUES`` at most."""
    held = df.groupBy(queue_of(source_col).alias("queue")).agg(F.sum(F.coalesce(F.length(f"`{text_col}`"), F.lit(0)) + 1).alias("size"))
    total = held.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    return sorted(r.queue for r in held.join(F.broadcast(total), F.col("size") * QUEUES >= F.col("total")).select("queue").collect())


def pack(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str | None, int] | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all documents into windows: one row for each piece of a document.

    ``targets`` maps sources to whole-number weights; sources that it leaves
    out come last, from one queue.  Without it each source has its share of
    the corpus in every window; sources with less than one ``QUEUES``-th of
    all characters share a queue, so the driver holds at most that many
    totals.  A window's state is kept for ``KEPT_NUMBERS`` numbers at most.

    A null text is empty and a null source is a source of its own.  Documents
    with a repeated id are packed each for itself.  An empty table gives an
    empty one.  Columns that are not named stay out.
    """
    spark = df.sparkSession
    queues = own_queues(df, text_col, source_col) if targets is None else sorted("-" if name is None else f"={name}" for name in targets)
    tokens = stage(tokenize(df, tokenizer, queues, id_col=id_col, text_col=text_col, source_col=source_col), "tokens", compression="zstd")
    parts = tokens.groupBy("queue", "part").agg(F.max(F.col("start_in_part") + F.col("doc_tokens")).alias("held"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(parts.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))), "queue-parts")
    totals = {r.queue: r.total for r in base.groupBy("queue").agg(F.sum("held").alias("total")).collect()}
    names = sorted(totals)
    weights = [totals[q] if targets is None else 0 if q == REST else int(targets[q[1:] if q[0] == "=" else None]) for q in names]
    plan, numbers = spark.sparkContext.broadcast(Schedule([totals[q] for q in names], weights, window)), {q: i for i, q in enumerate(names)}
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, at = plan.value, {}
        states: dict[int, tuple[list[int], list[int], list[int]]] = {}
        most = max(2, KEPT_NUMBERS // (3 * max(1, len(numbers))))

        def state(k: int) -> tuple[list[int], list[int], list[int]]:
            """Served before this window, where each queue's run starts in it, and served after it."""
            if k not in states:
                if len(states) >= most:
                    del states[next(iter(states))]
                served, then = schedule.before(k), schedule.before(k + 1)
                runs, room = [], 0
                for a, b in zip(served, then, strict=True):
                    runs.append(room)
                    room += b - a
                states[k] = served, runs, then
            return states[k]

        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            rows = []
            for i, (queue, first, count, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("queue", "first", "doc_tokens")), batch.column("ids"), strict=True)):
                number = numbers[queue]
                wide = memoryview(np.frombuffer(ids.as_buffer(), "<u2").astype("<u4").tobytes())
                k, token, last = at.get(number, 0), first, first + count
                while token < last:
                    served, runs, then = state(k)
                    if not served[number] <= token < then[number]:
                        k = schedule.window_of(number, token)
                        served, runs, then = state(k)
                    stop = min(last, then[number])
                    rows.append(i)
                    for column, value in zip(out, (token - first, stop - token, zlib.crc32(wide[4 * (token - first) : 4 * (stop - first)]), count, k, runs[number] + token - served[number]), strict=True):
                        column.append(value)
                    token = stop
                    if token < last:
                        k += 1
                at[number] = k
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), *(pa.array(c, pa.int64()) for c in out), batch.column("source").take(take)], columns)

    placed = tokens.join(base.select("queue", "part", "base"), ["queue", "part"]).select("doc_id", (F.col("base") + F.col("start_in_part")).alias("first"), "queue", "doc_tokens", "ids", "source")
    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(placed, task, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
