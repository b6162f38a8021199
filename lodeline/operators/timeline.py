"""Events in time: case timelines, conflicts and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EvidenceGraph, checkpointed
from .neighbours import case_nodes

_SHOWN = ["id", "event_type", "timestamp", "location_id", "description"]


def case_timeline(graph: EvidenceGraph, case_id: str) -> DataFrame:
    """Events in the case's subgraph, at its location, or next to a node of the
    subgraph; undated first, then by time as written, then id."""
    events = graph.entities.where("entity_type = 'EVENT'")
    nodes = checkpointed(case_nodes(graph, case_id).select("id"))
    place = graph.entities.where((F.col("id") == case_id) & F.col("location_id").isNotNull()).select("location_id")
    near = graph.edges().join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    near = checkpointed(near.distinct())
    found = events.join(nodes, "id", "left_semi").select(_SHOWN).union(events.join(place, "location_id", "left_semi").select(_SHOWN)).union(events.join(near, "id", "left_semi").select(_SHOWN))
    return found.dropDuplicates(["id"]).orderBy(F.col("timestamp").asc_nulls_first(), "id")


def all_events(graph: EvidenceGraph, event_type: str | None = None, keyword: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """All events under some filters; dated ones first."""
    e = graph.entities.where("entity_type = 'EVENT'").select(_SHOWN)
    if event_type:
        e = e.where(F.lower("event_type") == event_type.lower())
    if keyword:
        e = e.where(F.lower(F.concat_ws(" ", "id", "event_type", "description", "location_id")).contains(keyword.lower()))
    if since:
        e = e.where(F.col("timestamp") >= since)
    if until:
        e = e.where(F.col("timestamp") < until)
    return e.orderBy(F.col("timestamp").asc_nulls_last(), "id")


def narrowed(graph: EvidenceGraph, events: DataFrame, case_id: str | None = None, method: str | None = None, correlated: DataFrame | None = None, status: str | None = None) -> DataFrame:
    """Events (as all_events gives them) of a case's timeline, with evidence by a method,
    and with a status among correlations(first_event, second_event, status); ALL or None
    stands for any.  Dated ones first."""
    any_ = lambda v: v is None or v.upper() == "ALL"
    if not any_(case_id):
        events = events.join(case_timeline(graph, case_id).select("id"), "id", "left_semi").select(_SHOWN)
    if not any_(method):
        by = graph.evidence.where(F.upper("extraction_method") == method.upper()).select("evidence_id")
        own = graph.edges(known=False).select(F.col("src").alias("id"), F.explode("evidence_ids").alias("evidence_id")).join(by, "evidence_id", "left_semi").select("id")
        events = events.join(own, "id", "left_semi").select(_SHOWN)
    if not any_(status) and correlated is not None:
        held = correlated.where(F.col("status") == status.upper()).select(F.explode(F.array("first_event", "second_event")).alias("id"))
        events = events.join(held, "id", "left_semi").select(_SHOWN)
    return events.orderBy(F.col("timestamp").asc_nulls_last(), "id")


def normalized(events: DataFrame) -> DataFrame:
    """Events of client feeds: type or event_type, a title and a place for those without."""
    have = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    kind = F.coalesce(have("event_type"), have("type"), F.lit("EVENT"))
    title = F.coalesce(have("title"), have("description"), kind)
    return events.select("id", kind.alias("event_type"), title.alias("title"), have("timestamp").alias("timestamp"), F.coalesce(have("location_id"), have("location"), F.lit("Unknown location")).alias("location"))


def involved(graph: EvidenceGraph) -> DataFrame:
    """event_id, ts, event_type, entity_id: who an event involves."""
    e = graph.entities.where("entity_type = 'EVENT'").select("id", "event_type", F.try_to_timestamp("timestamp").alias("ts"))
    r = graph.relationships.where("relationship = 'INVOLVES'").select(F.col("source_id").alias("id"), F.col("target_id").alias("entity_id"))
    return e.join(r, "id").select(F.col("id").alias("event_id"), "ts", "event_type", "entity_id")


def _close(events: DataFrame, seconds: int):
    """Pairs of events of one entity at most so many seconds apart.  Time is cut
    in cells of that length; a partner is in the same cell or the next one."""
    t = events.withColumn("s", F.unix_timestamp("ts")).where("s is not null")
    cell = F.floor(F.col("s") / seconds)
    a = t.withColumn("cell", cell).alias("a")
    b = t.withColumn("cell", F.explode(F.array(cell, cell - 1))).alias("b")
    near = (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.cell") == F.col("b.cell"))
    apart = F.col("b.s") - F.col("a.s")
    later = (apart > 0) | ((apart == 0) & (F.col("a.event_id") < F.col("b.event_id")))
    return a.join(b, near & later & (apart <= seconds))


def conflicts(graph: EvidenceGraph, seconds: int) -> DataFrame:
    """One kind of event of one entity at clashing times, closer than the tolerance."""
    m = _close(involved(graph), seconds).where("a.event_type = b.event_type and a.s <> b.s")
    return m.select(F.col("a.entity_id").alias("entity_id"), F.col("a.event_type").alias("event_type"), F.col("a.event_id").alias("first_event"), F.col("b.event_id").alias("second_event"), (F.col("b.s") - F.col("a.s")).alias("seconds_apart"))


def correlations(graph: EvidenceGraph, seconds: int) -> DataFrame:
    """Different events that share an entity; equal times support each other directly."""
    m = _close(involved(graph), seconds).where("a.event_type <> b.event_type")
    kind = F.when(F.col("a.entity_id").startswith("PHONE_"), "SHARED_PHONE").when(F.col("a.entity_id").startswith("LOC_"), "SHARED_LOCATION").otherwise("SHARED_ENTITY")
    status = F.when(F.col("a.s") == F.col("b.s"), "DIRECTLY_SUPPORTED").otherwise("POTENTIAL_CORRELATION")
    return m.select(F.col("a.event_id").alias("first_event"), F.col("b.event_id").alias("second_event"), F.col("a.entity_id").alias("entity_id"), kind.alias("kind"), status.alias("status"))
