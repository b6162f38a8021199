"""Case access and the audit trail.  Access is denied unless granted, and rows
are taken out before any traversal, so no path runs through hidden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import EvidenceGraph, checkpointed


def visible(graph: EvidenceGraph, policy: DataFrame, user: str) -> EvidenceGraph:
    """policy(username, case_id): cases a user may see; ALL stands for every one.  Of the
    evidence the user sees what a visible entity or relationship rests on."""
    own = policy.where(F.col("username") == user).select("case_id").distinct()
    if not own.where("case_id = 'ALL'").isEmpty():
        return graph
    is_case = F.col("entity_type") == "CASE"
    allowed = graph.entities.where(is_case).join(own.withColumnRenamed("case_id", "id"), "id", "left_semi").select(graph.entities.columns)
    entities = graph.entities.where(~is_case).unionByName(allowed)
    edges = _between(graph, entities, allowed).select(graph.relationships.columns)
    rests_on = edges.select(F.explode("evidence_ids").alias("evidence_id")).union(entities.select(F.explode("source_ids")))
    return EvidenceGraph(entities, edges, graph.evidence.join(rests_on, "evidence_id", "left_semi").select(graph.evidence.columns))


def _between(graph: EvidenceGraph, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Relationships with both ends visible.  Those of types whose ends' types are told are
    joined with the allowed cases, and only if an end is one; others with all entities."""
    kinds = graph.kinds if graph.missing is not None and graph.kinds else {}
    told = F.coalesce(F.col("relationship").isin(*kinds), F.lit(False)) if kinds else F.lit(False)
    edges = graph.relationships.where(~told)
    for end in ("source_id", "target_id"):
        edges = edges.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    if not kinds:
        return edges
    short = graph.known(graph.relationships.where(told)).select(graph.relationships.columns)
    cases = checkpointed(allowed.select("id"))
    for i, end in enumerate(("source_id", "target_id")):
        touch = F.col("relationship").isin([k for k, ends in kinds.items() if ends[i] == "CASE"])
        short = short.where(~touch).unionByName(short.where(touch).join(cases.withColumnRenamed("id", end), end, "left_semi").select(short.columns))
    return edges.select(short.columns).unionByName(short)


class WriteDenied(PermissionError):
    """A change by someone who may only read."""


def may_write(role: str) -> None:
    """Raises for roles that only read; every change of a graph asks it first."""
    if role.upper() in ("READ_ONLY", "READONLY", "ANALYST"):
        raise WriteDenied(role)


AUDIT = "id string, timestamp string, actor string, action string, resource_type string, resource_id string, case_id string, status string, details map<string,string>"


SAID = ("timestamp", "actor", "action", "resource_type", "resource_id", "case_id", "status")


def _said() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SAID]


def audit_id() -> Column:
    """The id that is shown: short, so not one of its own among many events."""
    return F.concat(F.lit("AUDIT_"), F.upper(F.substring(F.sha2(F.concat_ws("|", *_said()), 256), 1, 8)))


def audit_key() -> Column:
    """What tells one event from all others: a hash of its fields, each with its length."""
    return F.sha2(F.concat_ws("|", *[x for c in _said() for x in (F.length(c).cast("string"), c)]), 256)


def audit_append(audit: DataFrame, events: DataFrame) -> DataFrame:
    """audit with events(timestamp, actor, action, resource_type, resource_id, case_id,
    status, details) added.  Events that say the same are one, so a second append of
    one adds nothing; events of equal ids that say something else are all kept."""
    new = events.withColumn("id", audit_id()).withColumn("key", audit_key()).dropDuplicates(["key"])
    have = audit.select(audit_key().alias("key"))
    return audit.unionByName(new.join(have, "key", "left_anti").select(audit.columns))


def audit_filter(audit: DataFrame, status: str) -> DataFrame:
    """One row: how many rows have the status, and of how many."""
    return audit.agg(F.count_if(F.col("status") == status).alias("shown"), F.count(F.lit(1)).alias("total"))


def audit_list(audit: DataFrame, case_id: str | None = None, action: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first; a case's list also has what concerns ALL; 1 to 200 rows."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    for c, v in (("action", action), ("status", status)):
        if v:
            audit = audit.where(F.col(c) == v)
    if case_id:
        audit = audit.where(F.col("case_id").isin(case_id, "ALL"))
    return audit.orderBy(F.desc("timestamp"), "id").limit(limit)
