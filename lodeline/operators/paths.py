"""Simple paths between entities, and what is read off them.

A path has distinct nodes and one edge per step; parallel edges give paths of
their own.  If both ends are few, paths of length L meet in the middle: half is
grown from the source, half from the target, and the halves are joined on the node
where they meet.  If one end is many, all of a path is grown from the other one.
So each frontier is anchored.  The edge view and each step's walks are worked out once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EvidenceGraph, checkpointed

MAX_DEPTH = 10
#: Ends that both are grown from if they are no more.
FEW = 100


class UnknownEntity(KeyError):
    """An end of a path that the graph doesn't have."""


def _grow(start: DataFrame, edges: DataFrame, steps: int, ends: DataFrame | None = None) -> list[DataFrame]:
    """Partial paths of 0..steps edges from start(id); with ends(id), the last step leads
    only there.  What is joined with all ends are the walks, not the edges."""
    none = F.array().cast("array<string>")
    walks = [checkpointed(start.distinct()).select(F.col("id").alias("cur"), F.array("id").alias("nodes"), none.alias("rels"), F.lit(1.0).alias("conf"))]
    for k in range(steps):
        w = walks[-1].join(edges.select("src", "dst", "rel_id", "confidence"), F.col("cur") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        if ends is not None and k + 1 == steps:
            w = w.join(ends.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
        walks.append(checkpointed(w.select(F.col("dst").alias("cur"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel_id")).alias("rels"), F.least("conf", F.coalesce("confidence", F.lit(1.0))).alias("conf"))))
    return walks


def _with_evidence(found: DataFrame, graph: EvidenceGraph) -> DataFrame:
    """Paths(nodes, rels, hop_count, confidence) with their evidence_ids, sorted, and ends."""
    found = checkpointed(found)
    step = found.select(F.explode(F.array_distinct("rels")).alias("rel_id")).distinct()
    rests = graph.relationships.select(F.col("id").alias("rel_id"), F.explode("evidence_ids").alias("e"))
    held = checkpointed(rests.join(checkpointed(step), "rel_id").distinct())
    own = found.select("rels", F.explode(F.array_distinct("rels")).alias("rel_id")).join(held, "rel_id").groupBy("rels").agg(F.array_sort(F.collect_set("e")).alias("evidence_ids"))
    none = F.array().cast("array<string>")
    out = found.join(own, "rels", "left").select(F.element_at("nodes", 1).alias("source_id"), F.element_at("nodes", -1).alias("target_id"), "nodes", "rels", "hop_count", "confidence", F.coalesce("evidence_ids", none).alias("evidence_ids"))
    return checkpointed(out)


def simple_paths(graph: EvidenceGraph, sources: DataFrame, targets: DataFrame, max_depth: int = 6, directed: bool = False) -> DataFrame:
    """sources(id), targets(id) -> source_id, target_id, nodes, rels, hop_count,
    confidence (the least of the edges, to two digits), evidence_ids (sorted).

    Paths end at the first target they reach that is theirs; equal ends give none.
    """
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be 1 to {MAX_DEPTH}")
    many = [ends.select("id").limit(FEW + 1).count() > FEW for ends in (sources, targets)]
    if many[0] != many[1]:
        return _from_few(graph, sources, targets, max_depth, directed, many[0])
    stored = graph.linked("id")
    ahead = stored.edges("outgoing" if directed else "undirected", known=False)
    behind = stored.edges("incoming", known=False) if directed else ahead
    fore = _grow(sources.select("id"), ahead, (max_depth + 1) // 2)
    back = _grow(targets.select("id"), behind, max_depth // 2)
    out = None
    for length in range(1, max_depth + 1):
        f = fore[(length + 1) // 2].alias("f")
        b = back[length // 2].select("cur", F.reverse("nodes").alias("nodes"), F.reverse("rels").alias("rels"), "conf").alias("b")
        rest = F.slice("b.nodes", F.lit(2), F.greatest(F.size("b.nodes") - 1, F.lit(0)))
        met = f.join(b, F.col("f.cur") == F.col("b.cur")).where(~F.arrays_overlap("f.nodes", rest) | (F.size(rest) == 0))
        one = met.select(
            F.concat("f.nodes", rest).alias("nodes"), F.concat("f.rels", "b.rels").alias("rels"), F.lit(length).alias("hop_count"),
            F.round(F.least("f.conf", "b.conf"), 2).alias("confidence"),
        )
        out = one if out is None else out.union(one)
    return _with_evidence(out.where(F.element_at("nodes", 1) != F.element_at("nodes", -1)), graph)


def _from_few(graph: EvidenceGraph, sources: DataFrame, targets: DataFrame, max_depth: int, directed: bool, back: bool) -> DataFrame:
    """Whole paths grown from the sources, with back from the targets."""
    few, others = (targets, sources) if back else (sources, targets)
    edges = graph.linked("id").edges(("incoming" if back else "outgoing") if directed else "undirected", known=False)
    walks = _grow(few.select("id"), edges, max_depth, others)
    whole = walks[1]
    for w in walks[2:]:
        whole = whole.union(w)
    whole = whole.join(others.select(F.col("id").alias("cur")).distinct(), "cur", "left_semi")
    turned = lambda c: F.reverse(c) if back else F.col(c)
    return _with_evidence(whole.select(turned("nodes").alias("nodes"), turned("rels").alias("rels"), F.size("rels").alias("hop_count"), F.round("conf", 2).alias("confidence")), graph)


def between(graph: EvidenceGraph, source: str, target: str, max_depth: int = 6, directed: bool = False) -> DataFrame:
    ends = graph.entities.where(F.col("id").isin(source, target)).select("id")
    known = {r["id"] for r in ends.limit(3).collect()}
    for wanted in (source, target):
        if wanted not in known:
            raise UnknownEntity(wanted)
    return simple_paths(graph, ends.where(F.col("id") == source), ends.where(F.col("id") == target), max_depth, directed)


def ranked(paths: DataFrame) -> DataFrame:
    """Fewest hops first, then confidence, then the path itself."""
    return paths.withColumn("path", F.array_join("nodes", "->")).orderBy("hop_count", F.desc("confidence"), "path", F.array_join("rels", "->"))


def steps(paths: DataFrame, graph: EvidenceGraph) -> DataFrame:
    """One row per step: from, to, relationship, confidence, evidence_ids."""
    s = paths.select(F.array_join("nodes", "->").alias("path"), "nodes", F.posexplode("rels").alias("step", "rel_id"))
    r = graph.relationships.select(F.col("id").alias("rel_id"), "relationship", "confidence", "evidence_ids")
    return s.join(r, "rel_id").select("path", "step", "rel_id", F.element_at("nodes", F.col("step") + 1).alias("from_id"), F.element_at("nodes", F.col("step") + 2).alias("to_id"), "relationship", "confidence", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))


def interior(paths: DataFrame, graph: EvidenceGraph) -> DataFrame:
    """Adds intermediate (inner nodes but cases and events) and shared_entities
    (the resources among them, else all of them)."""
    keyed = checkpointed(paths).withColumn("path_key", F.array_join("rels", "->"))
    inner = F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 2, F.lit(0)))
    kinds = graph.entities.select("id", "entity_type")
    found = keyed.select("path_key", F.posexplode(inner).alias("place", "id")).join(kinds, "id").where("entity_type not in ('CASE', 'EVENT')")
    row = F.struct("place", "id", "entity_type")
    grouped = found.groupBy("path_key").agg(F.array_sort(F.collect_list(row)).alias("x"))
    names = lambda xs: F.transform(xs, lambda r: r["id"])
    resources = F.filter("x", lambda r: r["entity_type"].isin("PHONE", "VEHICLE", "ACCOUNT", "LOCATION"))
    parts = grouped.select("path_key", names(F.col("x")).alias("intermediate"), names(F.when(F.size(resources) > 0, resources).otherwise(F.col("x"))).alias("shared_entities"))
    none = F.array().cast("array<string>")
    joined = keyed.join(parts, "path_key", "left")
    return joined.select(*paths.columns, F.coalesce("intermediate", none).alias("intermediate"), F.coalesce("shared_entities", none).alias("shared_entities"))


def summary(paths: DataFrame) -> DataFrame:
    inner = F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 2, F.lit(0)))
    conduits = paths.select("source_id", "target_id", F.explode(inner).alias("c")).groupBy("source_id", "target_id").agg(F.countDistinct("c").alias("conduits"))
    base = paths.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("paths"), F.min("hop_count").alias("min_hops"), F.max("confidence").alias("max_confidence"))
    return base.join(conduits, ["source_id", "target_id"], "left").select("source_id", "target_id", "paths", "min_hops", "max_confidence", F.coalesce("conduits", F.lit(0)).alias("conduits"))


def best(paths: DataFrame, by: str = "hops") -> DataFrame:
    """One path for each pair of ends: the shortest, or the one of highest confidence."""
    path = F.array_join("nodes", "->")
    key = F.struct("hop_count", (-F.col("confidence")).alias("c"), path.alias("path")) if by == "hops" else F.struct((-F.col("confidence")).alias("c"), "hop_count", path.alias("path"))
    b = paths.groupBy("source_id", "target_id").agg(F.min(key).alias("b"))
    return b.select("source_id", "target_id", F.col("b.hop_count").alias("hop_count"), (-F.col("b.c")).alias("confidence"), F.col("b.path").alias("path"))


def compared(routes: DataFrame) -> DataFrame:
    """Routes, one for each pair of ends (as best() or routes.search() give them), with the
    rank among those of the source, whether it is direct, and the entities in between."""
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("hop_count", F.desc("confidence"), "path")
    return routes.withColumn("rank", F.row_number().over(order)).withColumn("is_direct", F.col("hop_count") == 1).withColumn("between", F.array_join(F.slice(F.split("path", "->"), F.lit(2), F.col("hop_count").cast("int") - 1), "->"))
