"""From raw documents to packed training windows: five stages, each a corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.decontaminate import mark_leaks
from tidewatt.llm.lines import dedup_lines
from tidewatt.llm.packing import pack
from tidewatt.llm.quality import fit, score
from tidewatt.llm.queries import GOOD, tokenizer_path
from tidewatt.llm.shared import stage, table, unused
from tidewatt.llm.simhash import first_of_groups

#: Near-duplicates: distinct shingles of five words, alike at 0.8.  The similarity sets the radius of their fingerprints.
WORDS, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null or empty text is scored like any other; rows that repeat an id or a
    text have the same score for the same text; an empty table stays empty.
    """
    name = unused(docs, "score")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), score_col=name)
    return scored.filter(F.col(name) >= GOOD).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; their length is counted anew.

    Rows without an id are one document after all others; rows that repeat an
    id are one document; a null text becomes the empty one, which has one
    empty line; an empty table stays empty.
    """
    own = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    kept = dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped").withColumnsRenamed({new: c for c, new in own.items()})
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: the one of smallest id, null ids after all others.

    Ties go to the smallest hash of the text, then to the smallest row, so
    repeated rows leave one; texts without words are alike; an empty table
    stays empty.
    """
    return first_of_groups(docs, words=WORDS, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none; repeated rows stay or go together; an
    empty table, of documents or items, changes nothing.
    """
    name = unused(docs, "leaks")
    return mark_leaks(docs, table(spark, sf_dir, "benchmark"), leaks_col=name).filter(F.size(name) == 0).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, each with its mixture of sources.

    A null text is an empty one, of one token; rows that repeat an id are
    packed each for itself; a null source is a source; no rows give none.
    """
    return pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicate), ("benchmark decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
