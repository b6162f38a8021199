"""Network measures.  Formulas of influence, priority and community role are
this engine's own; priority ranks entities for review and says nothing of guilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import label, score_tier
from ..graph import EvidenceGraph, checkpointed
from .neighbours import adjacent_cases, degree


def density(nodes: int, edges: int) -> float:
    return 0.0 if nodes < 2 else 2.0 * edges / (nodes * (nodes - 1))


def graph_density(graph: EvidenceGraph) -> DataFrame:
    n = graph.entities.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("k"), "n")
    m = graph.relationships.agg(F.count(F.lit(1)).alias("m")).select(F.lit(1).alias("k"), "m")
    d = F.when(F.col("n") < 2, 0.0).otherwise(2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1)))
    return n.join(m, "k").select("n", "m", F.round(d, 8).alias("density"))


def components(graph: EvidenceGraph) -> DataFrame:
    """id, component: the least id that an entity is connected to.  Labels move to
    the least neighbour's and then to that label's own, until none changes."""
    und = checkpointed(graph.edges().select("src", "dst").distinct())
    now = checkpointed(graph.entities.select("id", F.col("id").alias("component")))
    while True:
        near = und.join(now, und["dst"] == now["id"]).groupBy("src").agg(F.min("component").alias("m"))
        step = now.join(near, now["id"] == near["src"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        own = step.select(F.col("id").alias("label"), F.col("component").alias("up"))
        jump = step.join(own, step["component"] == own["label"], "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"))
        new = checkpointed(jump)
        if new.join(now, ["id", "component"], "left_anti").isEmpty():
            return new
        now = new


def communities(graph: EvidenceGraph) -> DataFrame:
    """community_id (C-001 is the largest), members, internal edges, density and
    cases of every component of two and more."""
    c = components(graph)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    edges = graph.relationships.join(c, graph.relationships["source_id"] == c["id"]).groupBy("component").agg(F.count(F.lit(1)).alias("internal_edges"))
    cases = graph.entities.where("entity_type = 'CASE'").select("id").join(c, "id").groupBy("component").agg(F.count(F.lit(1)).alias("cases"))
    number = F.row_number().over(Window.orderBy(F.desc("members"), "component"))
    out = size.join(edges, "component", "left").join(cases, "component", "left").withColumn("number", number)
    m, n = F.coalesce("internal_edges", F.lit(0)), F.col("members")
    return out.select(F.concat(F.lit("C-"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("community_id"), "component", "members", m.alias("internal_edges"), F.coalesce("cases", F.lit(0)).alias("cases"), F.round(F.least(F.lit(1.0), 2.0 * m / (n * (n - 1))), 8).alias("density"))


def community_members(graph: EvidenceGraph, component: str) -> DataFrame:
    """id, degree, role: BRIDGE next to two cases, CORE from degree 3, else PERIPHERAL."""
    m = components(graph).where(F.col("component") == component).select("id")
    near = adjacent_cases(graph).groupBy("id").agg(F.count(F.lit(1)).alias("n_cases"))
    d = m.join(degree(graph), "id", "left").join(near, "id", "left")
    role = F.when(F.col("n_cases") >= 2, "BRIDGE").when(F.col("degree") >= 3, "CORE").otherwise("PERIPHERAL")
    return d.select("id", F.coalesce("degree", F.lit(0)).alias("degree"), role.alias("role"))


def badges(graph: EvidenceGraph) -> DataFrame:
    """Entities next to more than one case, or of degree 3 and up."""
    near = adjacent_cases(graph).groupBy("id").agg(F.count(F.lit(1)).alias("n_cases"))
    d = degree(graph).join(near, "id", "left").select("id", "degree", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))
    return d.select("id", "degree", "n_cases", (F.col("n_cases") > 1).alias("is_bridge"), (F.col("degree") >= 3).alias("is_central")).where("is_bridge or is_central")


def key_players(graph: EvidenceGraph, entity_type: str = "PERSON", top: int = 20) -> DataFrame:
    """Influence: 0.6 degree and 0.4 adjacent cases, each over the greatest; the first `top`."""
    e = graph.entities.where(F.col("entity_type") == entity_type).select("id", label().alias("label"))
    near = adjacent_cases(graph).groupBy("id").agg(F.count(F.lit(1)).alias("n_cases"))
    d = e.join(degree(graph), "id").join(near, "id", "left").select("id", "label", "degree", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))
    most = d.agg(F.max("degree").alias("md"), F.greatest(F.max("n_cases"), F.lit(1)).alias("mc"))
    scored = d.withColumn("k", F.lit(1)).join(F.broadcast(most.withColumn("k", F.lit(1))), "k")
    influence = F.round(0.6 * F.col("degree") / F.col("md") + 0.4 * F.col("n_cases") / F.col("mc"), 4)
    ranked = scored.select("id", "label", "degree", "n_cases", influence.alias("influence")).orderBy(F.desc("influence"), "id").limit(top)
    role = F.when(F.col("n_cases") >= 2, "CROSS_CASE_INFLUENCER").when(F.col("degree") >= 3, "CORE_HUB").otherwise("BRIDGE_ENTITY")
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("influence"), "id"))).withColumn("role", role)


def review_priority(graph: EvidenceGraph) -> DataFrame:
    """id, priority 0 to 100, level: persons by named signals, for human review only."""
    e = graph.entities.where("entity_type = 'PERSON'").select("id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    near = adjacent_cases(graph).groupBy("id").agg(F.count(F.lit(1)).alias("n_cases"))
    d = e.join(degree(graph), "id", "left").join(near, "id", "left")
    degree_part = F.least(F.coalesce("degree", F.lit(0)) / 50.0, F.lit(1.0)) * 40
    cases_part = F.least(F.coalesce("n_cases", F.lit(0)) / 10.0, F.lit(1.0)) * 40
    score = F.round(degree_part + cases_part + F.col("confidence") * 20, 2)
    return d.select("id", score.alias("priority"), F.when(score >= 75, "HIGH").when(score >= 50, "MODERATE").otherwise("LOW").alias("level"))


#: What influence is made of, and the part of each.
INFLUENCE = {"degree": 0.5, "n_cases": 0.3, "n_evidence": 0.2}


def evidence_counts(graph: EvidenceGraph) -> DataFrame:
    """id, n_evidence: records of evidence of an entity's relationships, each once.  What
    one relationship only has is counted where it is; of evidence that is in several, told
    by hashes, the different ids of an entity are dealt out."""
    own = F.array_distinct("evidence_ids")
    used = graph.known(graph.relationships.select("source_id", "target_id", "evidence_ids")).select(F.explode(own).alias("v"))
    twice = checkpointed(used.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    edges = graph.edges()
    if twice.isEmpty():
        return edges.groupBy(F.col("src").alias("id")).agg(F.sum(F.coalesce(F.size(own), F.lit(0))).alias("n_evidence"))
    rests = edges.select(F.col("src").alias("id"), F.explode(own).alias("v")).withColumn("h", F.xxhash64("v"))
    single = rests.join(twice, "h", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    several = rests.join(twice, "h", "left_semi").select("id", "v").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return single.union(several).groupBy("id").agg(F.sum("n").alias("n_evidence"))


def influence(graph: EvidenceGraph, entity_type: str | None = None, case_id: str | None = None, role: str | None = None, cross_case: bool | None = None, top: int = 50) -> DataFrame:
    """rank, id, entity_type, label, degree, n_cases, n_evidence, influence, role of the
    first `top` entities under the filters, cases and events left out.  Influence is
    0.5 degree, 0.3 adjacent cases and 0.2 records of evidence, each over the greatest
    of all entities, so a filter doesn't change an entity's influence."""
    e = graph.entities.where("entity_type not in ('CASE', 'EVENT')").select("id", "entity_type", label().alias("label"))
    near = checkpointed(adjacent_cases(graph))
    cases = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_cases"))
    rests = evidence_counts(graph)
    d = e.join(degree(graph), "id").join(cases, "id", "left").join(rests, "id", "left").fillna(0, ["n_cases", "n_evidence"])
    d = checkpointed(d)
    most = d.agg(*[F.max(c).alias(c) for c in INFLUENCE]).first()
    score = sum((part * F.coalesce(F.try_divide(F.col(c), F.lit(most[c])), F.lit(0.0)) for c, part in INFLUENCE.items()), F.lit(0.0))
    named = F.when(F.col("n_cases") >= 2, "CROSS_CASE_INFLUENCER").when(F.col("degree") >= 3, "CORE_HUB").otherwise("BRIDGE_ENTITY")
    d = d.withColumn("influence", F.round(score, 4)).withColumn("role", named)
    if entity_type:
        d = d.where(F.col("entity_type") == entity_type.upper())
    if case_id:
        d = d.join(near.where(F.col("case_id") == case_id).select("id"), "id", "left_semi")
    if role:
        d = d.where(F.col("role") == role.upper())
    if cross_case is not None:
        d = d.where((F.col("n_cases") >= 2) == F.lit(cross_case))
    first = d.orderBy(F.desc("influence"), "id").limit(top)  # a list of that length, numbered in one task
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("influence"), "id"))).select("rank", "id", "entity_type", "label", "degree", "n_cases", "n_evidence", "influence", "role")


#: Signals of review priority: the value from which one counts in full, and its points.
SIGNALS = {"degree": (50.0, 40.0), "cross_case_links": (10.0, 40.0), "confidence": (1.0, 20.0)}


def priority_signals(graph: EvidenceGraph) -> DataFrame:
    """id, signal, value, weight, points: what review_priority adds up, one row for each
    person and signal; its features are the values."""
    e = graph.entities.where("entity_type = 'PERSON'").select("id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    near = adjacent_cases(graph).groupBy("id").agg(F.count(F.lit(1)).alias("cross_case_links"))
    d = e.join(degree(graph), "id", "left").join(near, "id", "left").fillna(0, ["degree", "cross_case_links"])
    row = lambda s: F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"), F.lit(SIGNALS[s][1]).alias("weight"), F.round(F.least(F.col(s) / SIGNALS[s][0], F.lit(1.0)) * SIGNALS[s][1], 2).alias("points"))
    return d.select("id", F.explode(F.array(*[row(s) for s in SIGNALS])).alias("s")).select("id", "s.*")


def shared_members(graph: EvidenceGraph) -> DataFrame:
    """id, n_cases: entities in the subgraphs of two cases and more, next to one or not."""
    from .neighbours import class_membership

    members, nodes = class_membership(graph)
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    cases = graph.entities.where("entity_type = 'CASE'").select("id")
    found = nodes.join(sizes, "class_id").groupBy("id").agg(F.sum("n").alias("n_cases")).where("n_cases >= 2")
    return found.join(cases, "id", "left_anti").select("id", "n_cases")


def overview(graph: EvidenceGraph, findings: DataFrame) -> DataFrame:
    """The dashboard's row with, from findings (as envelope.all_patterns gives them), how
    many patterns and anomalies there are, and key entities and cross-case links."""
    k = lambda df: df.withColumn("k", F.lit(1))
    seen = findings.agg(F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("pattern_type") == "ENTITY_ACTIVITY_ANOMALY").alias("anomalies"))
    marked = badges(graph).agg(F.count(F.lit(1)).alias("key_entities"), F.count_if("is_bridge").alias("cross_case_links"))
    return k(dashboard(graph)).join(k(seen), "k").join(k(marked), "k").drop("k")


def shared_entities(graph: EvidenceGraph) -> DataFrame:
    """id, n_cases: entities next to two cases and more."""
    return adjacent_cases(graph).groupBy("id").agg(F.count(F.lit(1)).alias("n_cases")).where("n_cases >= 2")


def dashboard(graph: EvidenceGraph) -> DataFrame:
    """One row of counts."""
    e = graph.entities.agg(F.count_if(F.col("entity_type") == "CASE").alias("cases"), F.count_if((F.col("entity_type") == "CASE") & (F.col("status") == "ACTIVE")).alias("active_cases"), F.count_if((F.col("entity_type") == "CASE") & F.col("priority").isin("1-URGENT", "2-HIGH", "HIGH")).alias("high_priority"), F.count_if(F.col("entity_type") == "PERSON").alias("persons"))
    r = graph.relationships.agg(F.count(F.lit(1)).alias("links"))
    v = graph.evidence.agg(F.count(F.lit(1)).alias("evidence"))
    k = lambda df: df.withColumn("k", F.lit(1))
    return k(e).join(k(r), "k").join(k(v), "k").drop("k")


__all__ = ["badges", "communities", "community_members", "components", "dashboard", "density", "graph_density", "influence", "key_players", "overview", "priority_signals", "review_priority", "score_tier", "shared_entities", "shared_members"]
