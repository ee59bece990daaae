"""What the corpus operators share: the staging folder and Arrow batches."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Spark hands to Python; long texts make a row large.
BATCH_ROWS = 1000


def staging_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``.  Only
    where that is unset and all tasks run on this machine, as in tests, a
    folder of this machine is made once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the application ends."""
    path = f"{staging_root(spark)}/tidewatt-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str, *, rows: int | None = None, rows_per_file: int = 20_000, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    With ``rows``, about as many as there will be, files and the tasks that
    write them are no more than these rows need, whatever the shuffles use.

    The table cuts the lineage: whatever reads it survives the loss of
    executors, and ids or orders that the first run gave stay as they are.
    Nulls, repeated rows and empty tables come back as they are; columns need
    names that differ.
    """
    spark = df.sparkSession
    path = staging_folder(spark, name)
    files = df if rows is None else df.coalesce(max(1, -(-rows // rows_per_file)))
    files.write.mode("append").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for tasks that write or seek in files themselves."""
    where = re.sub("^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(where if "://" in where else re.sub("^file:/*", "/", where))


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch and send this package to the executors, once an application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if (app := spark.sparkContext.applicationId) not in _shipped:
        home = Path(__file__).parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", home.parent, home.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


class Known(dict):
    """What ``compute`` says of a word, kept for a task: at most ``most`` words at a time."""

    def __init__(self, compute: Callable[[str], object], most: int = 100_000):
        super().__init__()
        self.compute, self.most = compute, most
        _known.append(self)

    def __missing__(self, word: str) -> object:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.compute(word)
        return found


_known: list[Known] = []


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df`` through a task on Arrow batches; a Python worker, which serves many tasks, gives its memory back after each."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        for known in _known:
            known.clear()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, a null text as the empty one."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, whole: its nulls, repeated rows and columns as they are; an empty one is empty."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever case its names are in."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def add_columns(df: DataFrame, text_col: str, compute: Callable[[list[str]], list[pa.Array]], added: dict[str, str]) -> DataFrame:
    """``df`` with columns computed from whole texts, batch by batch; a null text counts as empty.

    ``added`` maps the new names to Spark types; they replace columns of the
    same name.  All other columns stay as they are, the text too.
    """
    others = [c for c in df.columns if c != text_col and c not in added]
    packed = df.select(F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("rest"), F.col(f"`{text_col}`").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["rest", "text", *(f"n{i}" for i in range(len(new)))])

    rest = packed.schema["rest"].dataType.simpleString()
    done = map_arrow(packed, task, ", ".join([f"rest {rest}", "text string", *(f"n{i} {kind}" for i, kind in enumerate(added.values()))]))
    kept = [F.col("text").alias(c) if c == text_col else F.col(f"rest.c{others.index(c)}").alias(c) for c in df.columns if c not in added]
    return done.select(*kept, *(F.col(f"n{i}").alias(c) for i, c in enumerate(added)))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``rows`` rows or one group, from batches in order of their integer keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy() for k in keys]
        other = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
        end = int(other[-1]) + 1 if other.size else 0
        held = table.slice(end).combine_chunks().to_batches()
        if end:
            yield table.slice(0, end).combine_chunks()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table.combine_chunks()
