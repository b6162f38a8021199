"""Changes to a graph: each returns a new graph and leaves the old one as it is.

Each is made in a role; roles that only read are refused before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EvidenceGraph
from ..schema import ENTITY, ENTITY_TYPES, EVIDENCE, RELATIONSHIP, RELATIONSHIP_TYPES, conform
from .access import may_write

#: The role of changes that name none.
ROLE = "INVESTIGATOR"
PREFIX = {"LOCATION": "LOC", "ORGANIZATION": "ORG", "ACCOUNT": "ACC"}


class Refused(ValueError):
    """A change that the graph doesn't allow."""


def _upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(graph: EvidenceGraph, entities: DataFrame | None = None, relationships: DataFrame | None = None, evidence: DataFrame | None = None, role: str = ROLE) -> EvidenceGraph:
    """Rows of equal id are replaced; entity types must be known."""
    may_write(role)
    e, r, v = graph.entities, graph.relationships, graph.evidence
    if entities is not None:
        new = conform(entities, ENTITY)
        if not new.where(~F.col("entity_type").isin(*ENTITY_TYPES)).isEmpty():
            raise Refused("unknown entity type")
        e = _upsert(e, new, "id")
    if relationships is not None:
        r = _upsert(r, conform(relationships, RELATIONSHIP), "id")
    if evidence is not None:
        v = _upsert(v, conform(evidence, EVIDENCE), "evidence_id")
    return EvidenceGraph(e, r, v)


def create_entity(graph: EvidenceGraph, entity_type: str, name: str, role: str = ROLE, **fields) -> tuple[EvidenceGraph, str]:
    """The id is a hash of type and name, so a repeated call changes nothing."""
    import hashlib

    may_write(role)
    kind = {"SUSPECT": "PERSON"}.get(entity_type.upper(), entity_type.upper())
    if kind not in ENTITY_TYPES:
        raise Refused(f"unknown entity type {entity_type}")
    made = fields.pop("id", None) or f"{PREFIX.get(kind, kind)}_{hashlib.sha256(f'{kind}|{name}'.encode()).hexdigest()[:12]}"
    shown = {"PHONE": "phone_number", "VEHICLE": "registration_number", "CASE": "title", "ACCOUNT": "identifier"}.get(kind, "name")
    row = {"id": made, "entity_type": kind, shown: name, "source": "Manual", "is_manual": True, "confidence": 1.0} | fields
    df = graph.entities.sparkSession.createDataFrame([row], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items()))
    return upsert(graph, entities=df, role=role), made


def create_case(graph: EvidenceGraph, title: str, case_id: str, status: str = "ACTIVE", priority: str = "MEDIUM", role: str = ROLE, **fields) -> EvidenceGraph:
    may_write(role)
    if not title:
        raise Refused("a case needs a title")
    if not graph.entities.where(F.col("id") == case_id).isEmpty():
        raise Refused(f"{case_id} exists")
    return create_entity(graph, "CASE", title, role=role, id=case_id, status=status, priority=priority, **fields)[0]


def update_entity(graph: EvidenceGraph, patch: DataFrame, role: str = ROLE) -> EvidenceGraph:
    """patch(id, ...): its non-null values replace; what it touches becomes manual."""
    may_write(role)
    columns = [c for c in patch.columns if c != "id"]
    p = patch.select("id", F.lit(True).alias("_touched"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    e = graph.entities.join(p, "id", "left")
    for c in columns:
        e = e.withColumn(c, F.coalesce(f"_new_{c}", c))
    e = e.withColumn("is_manual", F.coalesce("_touched", "is_manual"))
    return EvidenceGraph(e.select(graph.entities.columns), graph.relationships, graph.evidence)


def delete_entity(graph: EvidenceGraph, ids: DataFrame, role: str = ROLE) -> EvidenceGraph:
    """Takes entities out with every relationship that touches them."""
    may_write(role)
    r = graph.relationships
    for end in ("source_id", "target_id"):
        r = r.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return EvidenceGraph(graph.entities.join(ids.select("id"), "id", "left_anti"), r.select(graph.relationships.columns), graph.evidence)


def create_relationship(graph: EvidenceGraph, source_id: str, target_id: str, relationship: str = "ASSOCIATED_WITH", confidence: float = 0.95, role: str = ROLE) -> EvidenceGraph:
    may_write(role)
    if relationship not in RELATIONSHIP_TYPES:
        raise Refused(f"unknown relationship {relationship}")
    have = {r["id"] for r in graph.entities.where(F.col("id").isin(source_id, target_id)).select("id").collect()}
    if have != {source_id, target_id}:
        raise Refused("both ends of a relationship must exist")
    row = [(f"REL_MANUAL_{source_id}_{relationship}_{target_id}", source_id, relationship, target_id, confidence)]
    return upsert(graph, relationships=graph.entities.sparkSession.createDataFrame(row, "id string, source_id string, relationship string, target_id string, confidence double"), role=role)


def create_and_link(graph: EvidenceGraph, entity_type: str, name: str, case_id: str, role: str = ROLE) -> EvidenceGraph:
    """A new entity and its involvement in a case, as one change."""
    grown, made = create_entity(graph, entity_type, name, role)
    return create_relationship(grown, made, case_id, "INVOLVED_IN", 0.95, role)
