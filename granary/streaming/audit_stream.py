"""Audit events as a stream: duplicates within a watermark are dropped, each batch is appended.  An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour"):
    """Starts a query that appends each audit_id once to a Parquet table; stops when the input is read."""
    fresh = events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["audit_id"])
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
