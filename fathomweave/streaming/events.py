"""Structured streaming over message and packet events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.operators import store


def counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Events without repeats (event_id) counted in tumbling windows by type; works on a stream and on a table alike."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    unique = events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return unique.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the table that :func:`upsert` keeps at ``path``; None if there is none."""
    return store.read(spark, path)


def upsert(path: str, keys: list[str], seq: str, buckets: int = store.BUCKETS):
    """A foreachBatch function: the table at ``path`` keeps the row with the largest ``seq`` of each key.

    Each batch rewrites only the buckets that it touches; a crash at any point leaves the last whole version, and a
    repeated batch changes nothing. The version before the newest is kept for those who still read it, older ones go.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        store.merge(batch, path, keys, seq, "last", buckets)
        store.vacuum(batch.sparkSession, path, keep=2)

    return run
