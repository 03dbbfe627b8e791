"""Streaming counterparts: windowed counts with late data, and supersession by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import temporal


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; works on a stream or a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def superseding(read_state, write_state, at: str):
    """A foreachBatch function: each batch of asserted edges moves the stored state on."""

    def run(batch: DataFrame, _: int) -> None:
        write_state(temporal.supersede(read_state(batch.sparkSession), batch, at))

    return run
