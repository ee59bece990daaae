"""Ingest from a stream, and running totals by balancing day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import call
from ..store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch; a batch that comes again is stored once, by its readings' versions."""
    return stream.writeStream.foreachBatch(lambda batch, _: store.append(batch) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_totals(stream: DataFrame, store: Store) -> DataFrame:
    """Quantity and readings by balancing day; what comes after the settlement lag no longer counts."""
    late = f"{int(store.config.settlement_lag.total_seconds())} seconds"
    rows = stream.withWatermark("from", late).withColumn("balancing_day", call("meter_balancing_day", "`from`", "sparte"))
    day = F.window("from", f"{int(store.config.step.total_seconds())} seconds")
    return rows.groupBy(day, "balancing_day", "sparte", "unit").agg(F.count("*").alias("readings"), F.sum("value").alias("total"))
