"""The same expressions over streams: document intake, audit, activity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import document_entities


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of JSON-lines files as they arrive in a folder."""
    return spark.readStream.schema("doc_id string, text string").json(path)


def mentions(docs: DataFrame) -> DataFrame:
    """Mentions of a stream (or a batch) of documents; append mode, no state."""
    return document_entities(docs)


def activity(events: DataFrame, lateness: str = "1 hour", gap: str = "15 hours", least: int = 3) -> DataFrame:
    """events(entity_id, ts) -> sessions of at least so many events with gaps
    shorter than `gap`; state of a session goes once the watermark passes it."""
    w = events.withWatermark("ts", lateness).groupBy("entity_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_events"))
    return w.where(F.col("n_events") >= least).select("entity_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def write(stream: DataFrame, path: str, checkpoint: str):
    """Appends to parquet and stops when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
