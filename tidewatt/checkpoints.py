"""Cut a plan where its result must not be computed twice, in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConfigError


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's own, but for one of this machine where all tasks run on it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatt-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form that the optimizer drops from unions."""
    return spark.range(0).filter("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
