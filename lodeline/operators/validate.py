"""Integrity of a graph, and checks before and after retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EvidenceGraph

_OUT = ["severity", "kind", "id", "detail"]


def _row(df: DataFrame, severity: str, kind: str, id_: str, detail) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col(id_).alias("id"), detail.alias("detail"))


def integrity(graph: EvidenceGraph) -> DataFrame:
    """severity, kind, id, detail: ranges and references that don't hold."""
    e, r, v = graph.entities, graph.relationships, graph.evidence
    ids, evid = e.select(F.col("id").alias("ref")).distinct(), v.select(F.col("evidence_id").alias("ref")).distinct()
    out = []
    for df, key, kind in ((e, "id", "ENTITY_CONFIDENCE"), (r, "id", "RELATIONSHIP_CONFIDENCE"), (v, "evidence_id", "EVIDENCE_CONFIDENCE")):
        out.append(_row(df.where(~F.col("confidence").between(0, 1)), "ERROR", kind, key, F.col("confidence").cast("string")))
    lists = [(F.explode(c).alias("ref"), c) for c in ("phone_ids", "vehicle_ids", "address_ids", "owner_ids")] + [(F.col(c).alias("ref"), c) for c in ("owner_id", "location_id")]
    for ref, name in lists:
        out.append(_row(e.select("id", ref).where("ref is not null").join(ids, "ref", "left_anti"), "ERROR", f"DANGLING_{name.upper()}", "id", F.col("ref")))
    for end in ("source_id", "target_id"):
        out.append(_row(r.select("id", F.col(end).alias("ref")).join(ids, "ref", "left_anti"), "ERROR", f"DANGLING_{end.upper()}", "id", F.col("ref")))
    out.append(_row(r.select("id", F.explode("evidence_ids").alias("ref")).join(evid, "ref", "left_anti"), "ERROR", "DANGLING_EVIDENCE", "id", F.col("ref")))
    given = e.select("id", F.explode("source_ids").alias("ref")).where(F.col("ref").startswith("EVID_"))
    out.append(_row(given.join(evid, "ref", "left_anti"), "WARNING", "MISSING_SOURCE", "id", F.col("ref")))
    out.append(_row(v.where(F.trim(F.coalesce("source_text", F.lit(""))) == ""), "WARNING", "BLANK_TEXT", "evidence_id", F.lit("")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole.select(_OUT)


def unknown(ids: DataFrame, graph: EvidenceGraph) -> DataFrame:
    """Ids of a plan that the graph doesn't have."""
    return ids.select("id").join(graph.entities.select("id"), "id", "left_anti").select("id", F.lit("ENTITY_NOT_FOUND").alias("problem"))


def bad_confidence(df: DataFrame, key: str = "id") -> DataFrame:
    return df.where(~F.col("confidence").between(0, 1)).select(F.col(key).alias("id"), F.lit("INVALID_CONFIDENCE").alias("problem"))
