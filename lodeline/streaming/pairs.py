"""Events of one entity close in time, over streams: an interval join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def close_events(first: DataFrame, second: DataFrame, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """first, second(event_id, event_type, entity_id, ts), the same events read twice ->
    entity_id, first_event, second_event, first_type, second_type, seconds_apart: the
    pairs at most so many seconds apart, the earlier event (of equal times the lesser
    id) first.

    Both sides have a watermark and the join a bound on their difference, so an event is
    state only until no partner can come any more.
    """
    a = first.where("ts is not null").select(F.col("event_id").alias("first_event"), F.col("event_type").alias("first_type"), "entity_id", F.col("ts").alias("t")).withWatermark("t", lateness)
    b = second.where("ts is not null").select(F.col("event_id").alias("second_event"), F.col("event_type").alias("second_type"), F.col("entity_id").alias("of"), F.col("ts").alias("u")).withWatermark("u", lateness)
    # Times are compared by the second, so partners are less than a second further off as written.
    near = (F.col("u") >= F.col("t") - F.expr("interval 1 second")) & (F.col("u") <= F.col("t") + F.expr(f"interval {int(seconds) + 1} seconds"))
    apart = F.unix_timestamp("u") - F.unix_timestamp("t")
    later = (apart > 0) | ((apart == 0) & (F.col("first_event") < F.col("second_event")))
    met = a.join(b, (F.col("entity_id") == F.col("of")) & near & later & (apart <= seconds))
    return met.select("entity_id", "first_event", "second_event", "first_type", "second_type", apart.alias("seconds_apart"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """One kind of event at clashing times, as timeline.conflicts gives them."""
    return pairs.where("first_type = second_type and seconds_apart > 0").select("entity_id", F.col("first_type").alias("event_type"), "first_event", "second_event", "seconds_apart")


def correlations(pairs: DataFrame) -> DataFrame:
    """Different kinds of event of one entity, as timeline.correlations gives them."""
    kind = F.when(F.col("entity_id").startswith("PHONE_"), "SHARED_PHONE").when(F.col("entity_id").startswith("LOC_"), "SHARED_LOCATION").otherwise("SHARED_ENTITY")
    status = F.when(F.col("seconds_apart") == 0, "DIRECTLY_SUPPORTED").otherwise("POTENTIAL_CORRELATION")
    return pairs.where("first_type <> second_type").select("first_event", "second_event", "entity_id", kind.alias("kind"), status.alias("status"))


def late_rows(query: StreamingQuery) -> int:
    """Rows of a query that came after the watermark had passed them."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
