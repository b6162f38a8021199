"""Lookup, filter and search over a graph's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import confidence, label, tier
from ..graph import EvidenceGraph

SEARCHED = ("id", "name", "title", "phone_number", "registration_number", "identifier")


def by_id(df: DataFrame, value: str, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def by_type(graph: EvidenceGraph, entity_type: str) -> DataFrame:
    return graph.entities.where(F.col("entity_type") == entity_type.upper())


def matches(term: str, columns=SEARCHED) -> Column:
    """Whether a column or an alias contains the term, literally, in any case."""
    low = F.lit(term.lower())
    out = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(low))
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return out


def list_entities(graph: EvidenceGraph, entity_type: str | None = None, search: str | None = None, min_confidence: float | None = None, members: DataFrame | None = None) -> DataFrame:
    """All conditions hold; members(id) restricts to a case's subgraph."""
    e = graph.entities if entity_type is None else by_type(graph, entity_type)
    if search:
        e = e.where(matches(search))
    if min_confidence is not None:
        e = e.where(confidence() >= min_confidence)
    return e if members is None else e.join(members.select("id"), "id", "left_semi")


def cases(graph: EvidenceGraph, status: str | None = None, search: str | None = None) -> DataFrame:
    c = by_type(graph, "CASE")
    if status:
        c = c.where(F.lower("status") == status.lower())
    return c.where(matches(search, ("id", "title", "location_id"))) if search else c


def view(graph: EvidenceGraph, entity_types=None, relationships=None, min_confidence: float | None = None) -> EvidenceGraph:
    """Nodes of some types; edges with both ends among them, of some kinds and
    confidence.  Nodes are not pruned by what edges remain."""
    nodes = graph.entities.where(F.col("entity_type").isin(*entity_types)) if entity_types else graph.entities
    ids = nodes.select("id")
    edges = graph.relationships
    if relationships:
        edges = edges.where(F.col("relationship").isin(*relationships))
    if min_confidence is not None:
        edges = edges.where(confidence() >= min_confidence)
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return EvidenceGraph(nodes, edges, graph.evidence)


def supported(graph: EvidenceGraph) -> DataFrame:
    return graph.relationships.where(F.size("evidence_ids") > 0)


def list_evidence(graph: EvidenceGraph, document: str | None = None, min_confidence: float | None = None, method: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    e = graph.evidence
    if document:
        e = e.where(F.lower("source_document_id").contains(document.lower()))
    if min_confidence is not None:
        e = e.where(F.col("confidence") >= min_confidence)
    if method:
        e = e.where(F.col("extraction_method") == method)
    if ids is not None:
        e = e.join(ids.select("evidence_id"), "evidence_id", "left_semi")
    return e.withColumn("confidence_tier", tier())


def counts(graph: EvidenceGraph) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one(graph.entities, "entities").union(one(graph.relationships, "relationships")).union(one(graph.evidence, "evidence"))


def labels(graph: EvidenceGraph) -> DataFrame:
    return graph.entities.select("id", label().alias("label"), F.col("entity_type").alias("type"), confidence().alias("confidence"))


def client_search(graph: EvidenceGraph, term: str, entity_type: str | None = None) -> DataFrame:
    """Entities that have the term in a searched field, the description, or a field that
    the schema doesn't know (its name left out), in any case; of one type, if given."""
    low = F.lit(term.lower())
    more = F.coalesce(F.exists(F.map_values("extras"), lambda v: F.lower(v).contains(low)), F.lit(False))
    e = graph.entities if entity_type is None or entity_type.upper() == "ALL" else by_type(graph, entity_type)
    return e.where(matches(term, (*SEARCHED, "description")) | more)


def case_detail(graph: EvidenceGraph, case_id: str) -> DataFrame:
    """The case's row; KeyError where there is none, or the id is not of a case."""
    found = by_id(by_type(graph, "CASE"), case_id)
    if found.isEmpty():
        raise KeyError(case_id)
    return found


def shown_edges(graph: EvidenceGraph, supported_only: bool = False, source_types=None, cross_case: bool | None = None) -> DataFrame:
    """Relationships with cross_case (whether an end is next to two cases and more), under
    the filters of a graph view: with evidence only, from some kinds of source, crossing
    cases or not.  A relationship that names no source is of none."""
    case = graph.entities.where("entity_type = 'CASE'").select(F.col("id").alias("dst"))
    near = graph.edges().join(case, "dst").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n")).where("n >= 2").select("id")
    r = graph.relationships if not supported_only else supported(graph)
    if source_types:
        r = r.where(F.col("source_type").isin(*source_types))
    for end in ("source_id", "target_id"):
        r = r.join(near.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    r = r.withColumn("cross_case", F.coalesce("_source_id", "_target_id", F.lit(False)))
    r = r.select(*graph.relationships.columns, "cross_case")
    return r if cross_case is None else r.where(F.col("cross_case") == F.lit(cross_case))


def evidence_shown(graph: EvidenceGraph) -> DataFrame:
    """Evidence as client views show it: page 1, method AI_NER and confidence 0.95 where
    none is given.  For display; what is stored stays as it is."""
    return graph.evidence.withColumn("page_number", F.coalesce("page_number", F.lit(1))).withColumn("extraction_method", F.coalesce("extraction_method", F.lit("AI_NER"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.95)))
