"""Case reports, assembled from other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import label, tier
from ..graph import EvidenceGraph, checkpointed
from . import routes
from .neighbours import case_edges, case_nodes
from .timeline import case_timeline

DISCLAIMER = "Findings are leads for human review and do not determine guilt."


def sections(graph: EvidenceGraph, case_id: str) -> DataFrame:
    """section, n, items (sorted, comma-joined labels) for the kinds of node in a case."""
    n = case_nodes(graph, case_id).select("entity_type", label().alias("label"))
    return n.groupBy(F.col("entity_type").alias("section")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("items"))


def links(graph: EvidenceGraph, case_id: str) -> DataFrame:
    """The case's edges with the tier of their confidence."""
    return case_edges(graph, case_id).select("rel_id", "relationship", "confidence", tier().alias("tier"))


def structured(graph: EvidenceGraph, case_id: str) -> DataFrame:
    """One row: node, edge and evidence counts and density of a case's subgraph."""
    k = lambda df: df.withColumn("k", F.lit(1))
    edges = case_edges(graph, case_id)
    nodes = case_nodes(graph, case_id, edges).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"), F.round(F.min("confidence"), 2).alias("least_confidence"))
    d = F.when(F.col("node_count") < 2, 0.0).otherwise(2.0 * F.col("edge_count") / (F.col("node_count") * (F.col("node_count") - 1)))
    return k(nodes).join(k(e), "k").select(F.lit(case_id).alias("case_id"), "node_count", "edge_count", "least_confidence", F.round(d, 8).alias("density"), F.lit(DISCLAIMER).alias("limitations"))


def markdown(graph: EvidenceGraph, case_id: str) -> DataFrame:
    """One row with the report as text."""
    parts = sections(graph, case_id).select(F.concat(F.lit("## "), "section", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "items").alias("text"), "section")
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return body.select(F.concat(F.lit(f"# Case report {case_id}\n"), "body", F.lit(f"\n{DISCLAIMER}\n")).alias("report"))


def _lines(df: DataFrame, section: str, key: str, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(key).alias("key"), line.alias("line"))


def _two(c: str) -> Column:
    return F.format_string("%.2f", F.round(F.coalesce(F.col(c), F.lit(1.0)), 2))


def detailed(graph: EvidenceGraph, case_id: str, linked: EvidenceGraph | None = None, max_depth: int = 4) -> DataFrame:
    """section, key, line: direct links with their confidence (1_LINKS), the best route to
    every other case (2_CROSS_CASE; over the relationships of linked, else all), the
    evidence of the direct links with page, method and tier (3_EVIDENCE), the case's
    events in order (4_TIMELINE), and what the report doesn't say (5_LIMITS).  Rows, not
    one text, so a case of any size is written by many tasks."""
    near = checkpointed(graph.edges(known=False).where(F.col("src") == case_id))
    others = graph.entities.select(F.col("id").alias("dst"), F.col("entity_type").alias("kind"), label().alias("shown"))
    links_ = near.join(others, "dst").withColumn("key", F.col("rel_id"))
    out = _lines(links_, "1_LINKS", "key", F.concat("shown", F.lit(" ("), "dst", F.lit(", "), "kind", F.lit(") by "), "relationship", F.lit(", confidence "), _two("confidence")))
    cases = graph.entities.where("entity_type = 'CASE'").select("id")
    found = routes.search(routes.written(linked or graph), cases.where(F.col("id") == case_id), cases.where(F.col("id") != case_id), max_depth)
    out = out.union(_lines(found, "2_CROSS_CASE", "target_id", F.concat("path", F.lit(", confidence "), _two("confidence"))))
    said = graph.evidence.join(checkpointed(near.select(F.explode("evidence_ids").alias("evidence_id")).distinct()), "evidence_id", "left_semi")
    place = F.concat(F.coalesce("source_document_id", F.lit("?")), F.lit(" p. "), F.coalesce("page_number", F.lit(1)).cast("string"), F.lit(", "), F.coalesce("extraction_method", F.lit("?")))
    out = out.union(_lines(said, "3_EVIDENCE", "evidence_id", F.concat(place, F.lit(", "), _two("confidence"), F.lit(" "), tier(F.coalesce("confidence", F.lit(1.0))), F.lit(": "), F.coalesce("source_text", F.lit("")))))
    events = case_timeline(graph, case_id)
    out = out.union(_lines(events, "4_TIMELINE", "id", F.concat(F.coalesce("timestamp", F.lit("undated")), F.lit(" "), F.coalesce("event_type", F.lit("EVENT")))))
    return out.union(graph.entities.sparkSession.createDataFrame([("5_LIMITS", case_id, DISCLAIMER)], "section string, key string, line string"))


def write(rows: DataFrame, path: str, kind: str) -> None:
    """A report's rows as json (a record a line) or md (a list item a line, headed by its
    section), in order over the files."""
    lined = rows.repartitionByRange("section", "key").sortWithinPartitions("section", "key")
    if kind == "json":
        lined.write.json(path)
    elif kind == "md":
        lined.select(F.concat(F.lit("- **"), "section", F.lit("** `"), "key", F.lit("` "), "line").alias("value")).write.text(path)
    else:
        raise ValueError("kind must be json or md")
