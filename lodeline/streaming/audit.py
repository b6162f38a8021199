"""The audit trail as an append-only stream sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.access import audit_id, audit_key

#: How long an event may be repeated, or come late, and still be told for a repeat.
LATENESS = "1 day"


def keyed(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """A stream of audit events (as audit_append takes them, timestamps as written) with
    id, key and time, each event once: its key is state until the watermark passes it."""
    dated = events.withColumn("id", audit_id()).withColumn("key", audit_key()).withColumn("at", F.try_to_timestamp("timestamp"))
    return dated.where("at is not null").withWatermark("at", lateness).dropDuplicatesWithinWatermark(["key"])


def sink(events: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS):
    """Appends a stream of audit events to a parquet table and stops when what is there
    has been read.  A batch is written as the partition of its number, over what an
    attempt of it has left, so one that runs again after a failure adds nothing.  Events
    without a time that can be read are left to undated()."""

    def write(batch: DataFrame, number: int) -> None:
        batch.drop("at").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keyed(events, lateness).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def undated(events: DataFrame, path: str, checkpoint: str):
    """Appends the events that sink() cannot place in time."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rest = events.withColumn("id", audit_id()).withColumn("key", audit_key()).where(F.try_to_timestamp("timestamp").isNull())
    return rest.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
