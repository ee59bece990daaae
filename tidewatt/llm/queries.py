"""The queries of the corpus operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import leaked_items
from .html import extract_main_text
from .lines import dedup_lines
from .media import media_columns
from .packing import pack
from .quality import fit, held_out, score
from .repeats import remove_repeats
from .secrets import scan_secrets
from .shared import table
from .simhash import near_duplicates
from .sql import SQL
from .warc import archive_and_read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path())


#: A document is predicted good from this score on.
GOOD = 0.3


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    scored = score(documents, fit(documents, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_and_read(table(spark, folder, "pages"))


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept")


def op7_media(spark: SparkSession, folder: str) -> DataFrame:
    return media_columns(table(spark, folder, "documents"), tile_side=16)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_lines, op4_secrets, op5_warc, op6_repeats, op7_media, op8_simhash, op9_html, op10_decontamination)}

__all__ = ["QUERIES", "SQL", "tokenizer_path"]
