"""The query catalogue: every operator over whole tables, and the equal SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import scalar as S
from ..graph import EvidenceGraph, delete_at_exit, shared_folder
from ..operators import access, clusters, envelope, findings, ingest, lookup, mutate, names, neighbours, network, paths, patterns, postings, report, resolve, routes, stats, text, timeline, validate
from ..sources import files, records, testdata, versions
from . import planner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PERSON = "PERSON_5"
#: A case of that person: the first by number.
CASE_SQL = "(SELECT 'CASE_' || min(o_orderkey) FROM orders WHERE o_custkey = 5)"
ROUTES = ("INVOLVED_IN", "USES")


def _case(spark: SparkSession, sf: str) -> str:
    r = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey = 5").agg(F.min("o_orderkey").alias("k")).first()
    return f"CASE_{r['k']}"


def _add(name: str, sql: str | None = None, graph: bool = True):
    """Registers f(graph, spark, sf), or f(spark, sf) without graph.  SQL that
    begins with a comma or SELECT follows the graph's table expressions."""

    def keep(f):
        QUERIES[name] = (lambda spark, sf: f(testdata.load(spark, sf), spark, sf)) if graph else f
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {testdata.SQL} {sql}" if graph else sql
        return f

    return keep


LABEL = "coalesce(name, title, phone_number, id)"

# ---- lookup, filter, search


@_add("graph_counts", "SELECT 'entities' AS what, count(*) AS n FROM ent UNION ALL SELECT 'relationships', count(*) FROM rel UNION ALL SELECT 'evidence', count(*) FROM rel")
def _(g, spark, sf):
    return lookup.counts(g)


@_add("entities_by_type", "SELECT entity_type, count(*) AS n FROM ent GROUP BY entity_type")
def _(g, spark, sf):
    return g.entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@_add("point_lookup", "SELECT id, title, status, priority, incident_date FROM ent WHERE id = 'CASE_1'")
def _(g, spark, sf):
    return lookup.by_id(g.entities, "CASE_1").select("id", "title", "status", "priority", "incident_date")


@_add("entity_scan_locations", "SELECT id, name FROM ent WHERE entity_type = 'LOCATION'")
def _(g, spark, sf):
    return lookup.by_type(g, "location").select("id", "name")


@_add("entity_search", "SELECT id, name FROM ent WHERE entity_type = 'PERSON' AND (contains(lower(name), '#00000001') OR contains(lower(id), '#00000001'))")
def _(g, spark, sf):
    return lookup.list_entities(g, "person", "#00000001", 0.5).select("id", "name")


@_add("entity_search_any", f"SELECT id, {LABEL} AS label, entity_type AS type FROM ent WHERE contains(lower(concat_ws('|', id, name, title, phone_number)), 'widget')")
def _(g, spark, sf):
    return lookup.list_entities(g, search="WIDGET").select("id", S.label().alias("label"), F.col("entity_type").alias("type"))


@_add("entity_list_in_case", f", c AS (SELECT {CASE_SQL} AS c), n1 AS (SELECT DISTINCT dst AS id FROM und, c WHERE src = c.c), n2 AS (SELECT u.dst AS id FROM n1 JOIN und u ON u.src = n1.id JOIN ent e ON e.id = u.dst WHERE e.entity_type <> 'CASE') SELECT id FROM ent WHERE entity_type = 'PHONE' AND id IN (SELECT id FROM n1 UNION SELECT id FROM n2)")
def _(g, spark, sf):
    return lookup.list_entities(g, "PHONE", members=neighbours.case_nodes(g, _case(spark, sf))).select("id")


@_add("case_list", "SELECT id, title, status, priority FROM ent WHERE entity_type = 'CASE' AND status = 'ACTIVE'")
def _(g, spark, sf):
    return lookup.cases(g, "active").select("id", "title", "status", "priority")


@_add("case_search", "SELECT id, title FROM ent WHERE entity_type = 'CASE' AND status = 'CLOSED' AND contains(lower(title), 'order 12')")
def _(g, spark, sf):
    return lookup.cases(g, "Closed", "Order 12").select("id", "title")


@_add("graph_view_edges", "SELECT id, confidence FROM rel WHERE relationship = 'USES' AND confidence >= 0.9 AND source_id IN (SELECT id FROM ent WHERE entity_type = 'PERSON') AND target_id IN (SELECT id FROM ent WHERE entity_type = 'PHONE')")
def _(g, spark, sf):
    return lookup.view(g, ["PERSON", "PHONE"], ["USES"], 0.9).relationships.select("id", "confidence")


@_add("graph_view_nodes", "SELECT entity_type, count(*) AS n FROM ent WHERE entity_type IN ('PERSON', 'PHONE') GROUP BY 1")
def _(g, spark, sf):
    return lookup.view(g, ["PERSON", "PHONE"]).entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@_add("supported_edges", "SELECT relationship, count(*) AS n FROM rel GROUP BY 1")
def _(g, spark, sf):
    return lookup.supported(g).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


@_add("evidence_list", "SELECT evid AS evidence_id, CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' ELSE 'Low' END AS confidence_tier FROM rel WHERE contains(lower(doc), 'doc_12') AND confidence >= 0.8")
def _(g, spark, sf):
    return lookup.list_evidence(g, "DOC_12", 0.8, "RECORD_LINK").select("evidence_id", "confidence_tier")


@_add("evidence_tier_counts", "SELECT CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' ELSE 'Low' END AS confidence_tier, count(*) AS n FROM rel GROUP BY 1")
def _(g, spark, sf):
    return lookup.list_evidence(g).groupBy("confidence_tier").agg(F.count(F.lit(1)).alias("n"))


@_add("web_labels", f"SELECT id, {LABEL} AS label, entity_type AS type, CAST(1.0 AS DOUBLE) AS confidence FROM ent")
def _(g, spark, sf):
    return lookup.labels(g)


@_add("adapter_labels", "SELECT entity_type, count(*) AS n, min(coalesce(phone_number, name, title, id)) AS first_label FROM ent GROUP BY 1")
def _(g, spark, sf):
    return g.entities.select("entity_type", S.adapter_label().alias("l")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("first_label"))


# ---- neighbourhoods

for _name, _sql in (
    ("undirected", f"SELECT u.rel_id, u.relationship, u.confidence, u.dst AS neighbor_id, e.entity_type AS neighbor_type, {LABEL} AS neighbor_label FROM und u JOIN ent e ON e.id = u.dst WHERE u.src = 'PERSON_5'"),
    ("outgoing", f"SELECT r.id AS rel_id, r.relationship, r.confidence, r.target_id AS neighbor_id, e.entity_type AS neighbor_type, coalesce(e.name, e.title, e.phone_number, e.id) AS neighbor_label FROM rel r JOIN ent e ON e.id = r.target_id WHERE r.source_id = 'PERSON_5'"),
    ("incoming", f"SELECT r.id AS rel_id, r.relationship, r.confidence, r.source_id AS neighbor_id, e.entity_type AS neighbor_type, coalesce(e.name, e.title, e.phone_number, e.id) AS neighbor_label FROM rel r JOIN ent e ON e.id = r.source_id WHERE r.target_id = 'PERSON_5'"),
):
    _add(f"neighbors_{_name}", _sql)(lambda g, spark, sf, d=_name: neighbours.neighbors(g, PERSON, d))

_SUB = f""", c AS MATERIALIZED (SELECT {CASE_SQL} AS c), n1 AS MATERIALIZED (SELECT DISTINCT dst AS id FROM und JOIN c ON src = c.c WHERE dst <> c.c),
ce AS MATERIALIZED (SELECT rel_id FROM und JOIN c ON src = c.c UNION SELECT u.rel_id FROM n1 JOIN und u ON u.src = n1.id JOIN ent e ON e.id = u.dst WHERE e.entity_type <> 'CASE'
  UNION SELECT u.rel_id FROM n1 JOIN und u ON u.src = n1.id JOIN c ON u.dst = c.c),
cr AS MATERIALIZED (SELECT r.id AS rel_id, r.source_id, r.target_id, r.relationship, r.confidence FROM rel r JOIN ce ON ce.rel_id = r.id),
cn AS MATERIALIZED (SELECT source_id AS id FROM cr UNION SELECT target_id FROM cr UNION SELECT c FROM c)
"""


@_add("case_subgraph_edges", _SUB + "SELECT rel_id, relationship, confidence FROM cr")
def _(g, spark, sf):
    return neighbours.case_edges(g, _case(spark, sf)).select("rel_id", "relationship", "confidence")


@_add("case_subgraph_nodes", _SUB + "SELECT id, entity_type FROM ent WHERE id IN (SELECT id FROM cn)")
def _(g, spark, sf):
    return neighbours.case_nodes(g, _case(spark, sf)).select("id", "entity_type")


@_add("case_evidence", _SUB + "SELECT 'EVID_' || rel_id AS evidence_id FROM ce")
def _(g, spark, sf):
    return lookup.list_evidence(g, ids=neighbours.case_evidence_ids(g, _case(spark, sf))).select("evidence_id")


@_add("case_sizes", ", n1 AS (SELECT DISTINCT e.id AS case_id, u.dst AS id FROM ent e JOIN und u ON u.src = e.id WHERE e.entity_type = 'CASE'), n2 AS (SELECT n1.case_id, u.dst AS id FROM n1 JOIN und u ON u.src = n1.id JOIN ent e ON e.id = u.dst WHERE e.entity_type <> 'CASE') SELECT case_id, count(*) AS n_nodes FROM (SELECT * FROM n1 UNION SELECT * FROM n2 UNION SELECT id, id FROM ent WHERE entity_type = 'CASE') GROUP BY 1")
def _(g, spark, sf):
    return neighbours.case_sizes(g)


@_add("entity_details", f", x AS (SELECT count(*) AS n, string_agg(DISTINCT CASE WHEN e.entity_type = 'CASE' THEN u.dst END, ',' ORDER BY CASE WHEN e.entity_type = 'CASE' THEN u.dst END) AS c, string_agg(DISTINCT u.evid, ',' ORDER BY u.evid) AS v FROM und u JOIN ent e ON e.id = u.dst WHERE u.src = 'PERSON_5') SELECT id, entity_type, {LABEL} AS label, x.n AS n_relationships, x.c AS case_ids, x.v AS evidence_ids FROM ent, x WHERE id = 'PERSON_5'")
def _(g, spark, sf):
    return neighbours.details(g, PERSON).withColumns({"case_ids": F.array_join("case_ids", ","), "evidence_ids": F.array_join("evidence_ids", ",")})


@_add("entity_evidence", "SELECT DISTINCT evid AS evidence_id FROM und WHERE src = 'PERSON_5'")
def _(g, spark, sf):
    return neighbours.entity_evidence(g, PERSON).select("evidence_id")


@_add("entity_cases", "SELECT DISTINCT u.dst AS case_id FROM und u JOIN ent e ON e.id = u.dst WHERE u.src = 'PERSON_5' AND e.entity_type = 'CASE'")
def _(g, spark, sf):
    return neighbours.adjacent_cases(g).where(F.col("id") == PERSON).select("case_id")


@_add("ego_network", ", e2 AS MATERIALIZED (SELECT DISTINCT src, dst FROM und WHERE relationship IN ('INVOLVED_IN', 'USES')), h1 AS (SELECT DISTINCT dst AS id FROM e2 WHERE src = 'CASE_1'), h2 AS (SELECT DISTINCT dst AS id FROM h1 JOIN e2 ON src = id), h3 AS (SELECT DISTINCT dst AS id FROM h2 JOIN e2 ON src = id) SELECT id, min(hop) AS hop FROM (SELECT 'CASE_1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id")
def _(g, spark, sf):
    return neighbours.ego(g.only(*ROUTES), "CASE_1", 3)


@_add("degree_topk", "SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def _(g, spark, sf):
    return neighbours.degree(g).orderBy(F.desc("degree"), "id").limit(20)


# ---- paths

_PATHS = """, e2 AS MATERIALIZED (SELECT * FROM und WHERE relationship IN ('INVOLVED_IN', 'USES')),
walk(cur, nodes, rels, conf, evid) AS (SELECT 'CASE_1', ['CASE_1'], CAST([] AS VARCHAR[]), CAST(1.0 AS DOUBLE), CAST([] AS VARCHAR[])
  UNION ALL SELECT e.dst, list_append(w.nodes, e.dst), list_append(w.rels, e.rel_id), least(w.conf, e.confidence), list_append(w.evid, e.evid) FROM walk w JOIN e2 e ON e.src = w.cur WHERE len(w.rels) < 4 AND NOT list_contains(w.nodes, e.dst)),
p AS MATERIALIZED (SELECT 'CASE_1' AS source_id, cur AS target_id, nodes, rels, array_to_string(nodes, '->') AS path, CAST(len(rels) AS BIGINT) AS hop_count, round(conf, 2) AS confidence, array_to_string(list_sort(list_distinct(evid)), ',') AS evidence FROM walk WHERE starts_with(cur, 'CASE_') AND len(rels) > 0)
"""
_INNER = "unnest(nodes[2:len(nodes) - 1])"


def _routes(g: EvidenceGraph) -> DataFrame:
    """From one case to all others."""
    ids = g.entities.where("entity_type = 'CASE'").select("id")
    return paths.simple_paths(g.only(*ROUTES), ids.where("id = 'CASE_1'"), ids.where("id <> 'CASE_1'"), 4).withColumn("hop_count", F.col("hop_count").cast("long"))


def _best_routes(g: EvidenceGraph, by: str = "hops") -> DataFrame:
    """The best from one case to each other, by a search that lists no others."""
    ids = g.entities.where("entity_type = 'CASE'").select("id")
    found = routes.search(routes.written(g.only(*ROUTES)), ids.where("id = 'CASE_1'"), ids.where("id <> 'CASE_1'"), 4, by)
    return found.withColumn("hop_count", F.col("hop_count").cast("long"))


def _shown(p: DataFrame) -> DataFrame:
    return p.withColumn("path", F.array_join("nodes", "->")).withColumn("evidence", F.array_join("evidence_ids", ","))


@_add("simple_paths", _PATHS + "SELECT source_id, target_id, path, array_to_string(rels, '->') AS rels, hop_count, confidence, evidence FROM p")
def _(g, spark, sf):
    return _shown(_routes(g)).select("source_id", "target_id", "path", F.array_join("rels", "->").alias("rels"), "hop_count", "confidence", "evidence")


@_add("simple_paths_directed", "SELECT r.source_id, r.target_id, r.id AS rels, CAST(1 AS BIGINT) AS hop_count, r.confidence FROM rel r WHERE r.source_id = 'PERSON_5' AND r.relationship = 'USES'")
def _(g, spark, sf):
    ids = g.entities.select("id", "entity_type")
    p = paths.simple_paths(g.only(*ROUTES), ids.where("id = 'PERSON_5'"), ids.where("entity_type = 'PHONE'"), 2, directed=True)
    return p.select("source_id", "target_id", F.array_join("rels", "->").alias("rels"), F.col("hop_count").cast("long").alias("hop_count"), "confidence")


@_add("cross_case_connections", _PATHS + f", inn AS (SELECT DISTINCT path, rels, id, entity_type FROM (SELECT path, rels, {_INNER} AS n FROM p) JOIN ent ON id = n WHERE entity_type NOT IN ('CASE', 'EVENT')), sh AS (SELECT path, rels, string_agg(id, ',' ORDER BY id) AS shared FROM inn WHERE entity_type IN ('PHONE', 'LOCATION') OR (path, rels) NOT IN (SELECT (path, rels) FROM inn WHERE entity_type IN ('PHONE', 'LOCATION')) GROUP BY 1, 2) SELECT p.path, p.hop_count, p.confidence, coalesce(sh.shared, '') AS shared_entities FROM p LEFT JOIN sh ON sh.path = p.path AND sh.rels = p.rels")
def _(g, spark, sf):
    p = paths.interior(_routes(g), g)
    return p.select(F.array_join("nodes", "->").alias("path"), "hop_count", "confidence", F.array_join(F.array_sort("shared_entities"), ",").alias("shared_entities"))


@_add("path_steps", _PATHS + ", s AS (SELECT path, rels, nodes, unnest(range(0, len(rels))) AS step FROM p) SELECT path, CAST(step AS BIGINT) AS step, rels[step + 1] AS rel_id, nodes[step + 1] AS from_id, nodes[step + 2] AS to_id, relationship, confidence, evid AS evidence FROM s JOIN rel ON rel.id = rels[step + 1]")
def _(g, spark, sf):
    return paths.steps(_routes(g), g).withColumn("step", F.col("step").cast("long")).withColumn("evidence", F.array_join("evidence_ids", ",")).drop("evidence_ids")


@_add("path_summary", _PATHS + f", c AS (SELECT target_id, count(DISTINCT n) AS k FROM (SELECT target_id, {_INNER} AS n FROM p) GROUP BY 1) SELECT p.source_id, p.target_id, count(*) AS paths, min(hop_count) AS min_hops, max(confidence) AS max_confidence, coalesce(any_value(k), 0) AS conduits FROM p LEFT JOIN c ON c.target_id = p.target_id GROUP BY 1, 2")
def _(g, spark, sf):
    return paths.summary(_routes(g))


_BEST = _PATHS + ", b AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY {order}) AS k FROM p) SELECT {cols} FROM b WHERE k = 1"


@_add("shortest_path", _BEST.format(order="hop_count, confidence DESC, path", cols="source_id, target_id, hop_count, confidence, path"))
def _(g, spark, sf):
    return _best_routes(g)


@_add("strongest_path", _BEST.format(order="confidence DESC, hop_count, path", cols="source_id, target_id, hop_count, confidence, path"))
def _(g, spark, sf):
    return _best_routes(g, "confidence")


@_add("path_comparison", _BEST.format(order="hop_count, confidence DESC, path", cols="source_id, target_id, hop_count, confidence, path, row_number() OVER (ORDER BY hop_count, confidence DESC, path) AS rank, hop_count = 1 AS is_direct, array_to_string(nodes[2:len(nodes) - 1], '->') AS between"))
def _(g, spark, sf):
    return paths.compared(_best_routes(g)).withColumn("rank", F.col("rank").cast("long"))


@_add("unusual_paths", _BEST.format(order="hop_count, confidence DESC, path", cols="source_id, target_id, hop_count, confidence, path") + " AND hop_count >= 4 AND source_id < target_id")
def _(g, spark, sf):
    return _best_routes(g).where("hop_count >= 4 and source_id < target_id")


_PERSONS_CASES = ", k AS (SELECT DISTINCT dst AS id FROM und WHERE src = 'PERSON_5' AND relationship = 'INVOLVED_IN')"


@_add("cross_case_bridges", _PERSONS_CASES + """, p AS (SELECT a.src AS source_id, b.dst AS target_id, CAST(2 AS BIGINT) AS hop_count, round(least(a.confidence, b.confidence), 2) AS confidence, a.src || '->PERSON_5->' || b.dst AS path
  FROM und a JOIN und b ON a.dst = 'PERSON_5' AND b.src = 'PERSON_5' AND a.src < b.dst WHERE a.src IN (SELECT id FROM k) AND b.dst IN (SELECT id FROM k) AND a.relationship = 'INVOLVED_IN' AND b.relationship = 'INVOLVED_IN') SELECT * FROM p""")
def _(g, spark, sf):
    """The best route between every two cases of a person: cases have one person each, so it runs through that one."""
    ids = neighbours.adjacent_cases(g).where(F.col("id") == PERSON).select(F.col("case_id").alias("id"))
    return patterns.bridges(g.only(*ROUTES), ids).withColumn("hop_count", F.col("hop_count").cast("long"))


@_add("strongest_routes", """, b AS MATERIALIZED (SELECT src, dst, max(confidence) AS c FROM und WHERE src <> dst GROUP BY 1, 2),
reach(node, c) AS (SELECT 'CASE_1', CAST(1.0 AS DOUBLE) UNION SELECT b.dst, least(r.c, b.c) FROM reach r JOIN b ON b.src = r.node)
SELECT 'CASE_1' AS source_id, node AS target_id, max(c) AS confidence FROM reach WHERE starts_with(node, 'CASE_') AND node <> 'CASE_1' GROUP BY node""")
def _(g, spark, sf):
    """Over all relationships and routes of any length."""
    ids = g.entities.where("entity_type = 'CASE'").select("id")
    pairs = ids.where("id <> 'CASE_1'").select(F.lit("CASE_1").alias("source_id"), F.col("id").alias("target_id"))
    return routes.bottlenecks(routes.forest(routes.links(g, directed=True)), pairs)


_CLASSES = """, k AS MATERIALIZED (SELECT src AS p, min(dst) AS class_id, count(*) AS n FROM und WHERE relationship = 'INVOLVED_IN' AND starts_with(dst, 'CASE_') GROUP BY src),
u AS MATERIALIZED (SELECT k.class_id, k.n, dst AS via, max(confidence) AS c FROM und JOIN k ON k.p = src WHERE relationship = 'USES' GROUP BY ALL),
w AS (SELECT a.class_id AS x, b.class_id AS y, a.n * b.n AS pairs, a.via, least(a.c, b.c) AS c FROM u a JOIN u b ON a.via = b.via AND a.class_id < b.class_id),
bridge AS (SELECT 'CLASSES' AS kind, class_id AS first_class, class_id AS second_class, p AS via, CAST(2 AS BIGINT) AS hop_count, CAST(1.0 AS DOUBLE) AS confidence, CAST(n * (n - 1) // 2 AS BIGINT) AS case_pairs FROM k WHERE n > 1
  UNION ALL SELECT 'CLASSES', x, y, arg_min(via, (-c, via)), 4, max(c), CAST(any_value(pairs) AS BIGINT) FROM w GROUP BY x, y)
""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3")


@_add("case_bridges", _CLASSES + "SELECT * FROM bridge")
def _(g, spark, sf):
    """Of all cases: in this graph those of one person are a class, as a case has one person."""
    return patterns.case_bridges(g.only(*ROUTES)).withColumn("hop_count", F.col("hop_count").cast("long"))


@_add("unusual_bridges", _CLASSES + "SELECT first_class, second_class, via, hop_count, confidence, case_pairs FROM bridge WHERE hop_count >= 4")
def _(g, spark, sf):
    return patterns.unusual_paths(g.only(*ROUTES)).select("first_class", "second_class", "via", F.col("hop_count").cast("long").alias("hop_count"), "confidence", "case_pairs")


# ---- text

_SAMPLES = [
    (-1, "Suspect Rahul Kumar uses 9876543210\nand was seen with MH 12 AB 1234 near Crime Branch."),
    (-2, "CASE-101: Priya Sharma operated +91-9123456780\nVikram Singh Rathore drove KA-01-M-4321 (FIR 204)"),
    (-3, ""),
    (-4, "Aarav Verma (PERSON_017) and Aarav Verma drove MH-01-AB-1234, not XMH-02-AB-1234 or MH-03-AB-12345; Neha Rao (PERSON_x) called 9123456780."),
]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(_SAMPLES, "doc_id long, text string"))


_DOCS = "WITH docs AS (SELECT doc_id, text FROM documents UNION ALL " + " UNION ALL ".join("SELECT {}, '{}'".format(i, t.replace("\n", "' || chr(10) || '")) for i, t in _SAMPLES) + ")"
_STOP = ", ".join(f"'{s}'" for s in X.STOP)
_LINES = _DOCS + f""", lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM docs),
m AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT doc_id, line, t, 'PHONE' AS kind, unnest(regexp_extract_all(t, '{X.PHONE}')) AS value, CAST(0.95 AS DOUBLE) AS confidence FROM lines WHERE trim(t) <> ''
  UNION ALL SELECT doc_id, line, t, 'VEHICLE', unnest(regexp_extract_all(t, '{X.PLATE}')), 0.94 FROM lines WHERE trim(t) <> ''
  UNION ALL SELECT doc_id, line, t, 'PERSON', unnest(regexp_extract_all(t, '{X.PERSON_LINE}', 1)), 0.92 FROM lines WHERE trim(t) <> '') WHERE value NOT IN ({_STOP}))
"""


@_add("extract_line_mentions", _LINES + "SELECT doc_id, line, kind, value, confidence, row_number() OVER (PARTITION BY doc_id, kind, value ORDER BY line) = 1 AS first FROM m", graph=False)
def _(spark, sf):
    return text.line_mentions(_docs(spark, sf)).select("doc_id", F.col("line").cast("long").alias("line"), "kind", "value", "confidence", "first")


@_add("extract_uses_relations", _LINES + f"SELECT DISTINCT p.doc_id, p.value AS person, r.value AS resource, 'USES' AS relationship, CAST(0.91 AS DOUBLE) AS confidence, p.line FROM m p JOIN m r ON r.doc_id = p.doc_id AND r.line = p.line WHERE p.kind = 'PERSON' AND r.kind <> 'PERSON' AND regexp_matches(p.t, '{X.USES}')", graph=False)
def _(spark, sf):
    return text.uses_relations(_docs(spark, sf)).withColumn("line", F.col("line").cast("long"))


_MENTIONS = _DOCS + f""", m AS MATERIALIZED (SELECT DISTINCT doc_id, 'PHONE' AS kind, unnest(regexp_extract_all(text, '{X.PHONE_BOUND}')) AS value, CAST(0.96 AS DOUBLE) AS confidence FROM docs
  UNION ALL SELECT DISTINCT doc_id, 'VEHICLE', unnest(regexp_extract_all(text, '{X.PLATE_BOUND}')), 0.94 FROM docs
  UNION ALL SELECT {{d}} doc_id, 'PERSON', unnest(regexp_extract_all(text, '{X.PERSON_GIVEN}')), 0.95 FROM docs)
"""


@_add("extract_document_entities", _MENTIONS.replace("{d}", "") + f"""SELECT doc_id, coalesce(nullif(regexp_extract(raw, '\\((PERSON_[0-9]+)\\)$', 1), ''), kind || '_' || substr(sha256(value), 1, 12)) AS entity_id, kind, value, confidence
FROM (SELECT doc_id, kind, value AS raw, CASE WHEN kind = 'PERSON' THEN regexp_extract(value, '{X.PERSON}') ELSE value END AS value, confidence FROM m)""", graph=False)
def _(spark, sf):
    return text.document_entities(_docs(spark, sf))


@_add("extract_document_relations", _MENTIONS.replace("{d}", "DISTINCT") + f"""SELECT p.doc_id, p.person, r.value AS resource, CASE r.kind WHEN 'VEHICLE' THEN 'USED' ELSE 'USES' END AS relationship, CAST(CASE r.kind WHEN 'VEHICLE' THEN 0.92 ELSE 0.93 END AS DOUBLE) AS confidence
FROM (SELECT DISTINCT doc_id, regexp_extract(value, '{X.PERSON}') AS person FROM m WHERE kind = 'PERSON') p JOIN m r ON r.doc_id = p.doc_id WHERE r.kind <> 'PERSON'""", graph=False)
def _(spark, sf):
    return text.document_relations(_docs(spark, sf))


@_add("extract_document_evidence", "SELECT doc_id, 'EVID_' || doc_id AS evidence_id, substr(coalesce(text, ''), 1, 300) AS source_text, CAST(0.95 AS DOUBLE) AS confidence FROM documents", graph=False)
def _(spark, sf):
    return text.document_evidence(spark.read.parquet(f"{sf}/documents.parquet"))


@_add("extract_case_refs", _DOCS + f"SELECT DISTINCT doc_id, 'CASE_' || unnest(regexp_extract_all(text, '{X.CASE_REF}', 1)) AS case_id FROM docs", graph=False)
def _(spark, sf):
    return text.case_mentions(_docs(spark, sf))


# ---- resolution


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Persons with signals by a rule of their key."""
    k = F.col("c_custkey")
    tag = lambda t, n: F.concat(F.lit(t), (n).cast("string"))
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        tag("PERSON_", k).alias("id"), F.concat(F.col("c_name"), F.lit(" G"), (k % 500).cast("string")).alias("name"), F.array(tag("g", (k + 1) % 500)).alias("aliases"),
        F.array(tag("PHONE_", k % 701)).alias("phone_ids"), F.array(tag("VEH_", k % 337)).alias("vehicle_ids"), F.lit(None).cast("int").alias("age"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("address"), tag("LOC_", F.col("c_nationkey")).alias("location_id"),
    )


_PEOPLE = """WITH p AS (SELECT c_custkey AS k, 'PERSON_' || c_custkey AS id, c_name || ' G' || (c_custkey % 500) AS name, 'g' || ((c_custkey + 1) % 500) AS alias, c_nationkey FROM customer),
j AS (SELECT a.id AS a, b.id AS b, a.name AS name_a, b.name AS name_b, CAST(a.k % 500 = b.k % 500 AS INT) AS token, CAST(contains(lower(b.name), a.alias) OR contains(a.alias, lower(b.name)) AS INT) AS alias, CAST(a.k % 701 = b.k % 701 AS INT) AS phone, CAST(a.k % 337 = b.k % 337 AS INT) AS vehicle FROM p a JOIN p b ON a.id < b.id
  WHERE a.k % 500 = b.k % 500 OR a.k % 701 = b.k % 701 OR a.k % 337 = b.k % 337)
"""


@_add("resolution_additive", _PEOPLE + "SELECT * FROM (SELECT a, b, name_a, name_b, token, alias, phone, vehicle, least(CAST(0.98 AS DOUBLE), round(CAST(0.4 AS DOUBLE) * token + CAST(0.4 AS DOUBLE) * alias + CAST(0.35 AS DOUBLE) * phone + CAST(0.35 AS DOUBLE) * vehicle, 2)) AS score, 'PENDING_REVIEW' AS status FROM j) WHERE score >= 0.7", graph=False)
def _(spark, sf):
    return resolve.candidates_additive(_people(spark, sf))


def _spelled(spark: SparkSession, sf: str) -> DataFrame:
    """Persons whose names a rule spells: of each three keys one name, one without its
    fourth letter, and one with two other letters."""
    k = F.col("c_custkey")
    letters = F.translate(F.md5(F.concat(F.lit("n"), (k - k % 3).cast("string"))), "0123456789abcdef", "aeioubdgklmnrstv")
    base = F.concat(F.substring(letters, 1, 6), F.lit(" "), F.substring(letters, 7, 8))
    name = F.when(k % 3 == 0, base).when(k % 3 == 1, F.concat(F.substring(base, 1, 3), F.substring(base, 5, 30))).otherwise(F.concat(F.substring(base, 1, 8), F.lit("xy"), F.substring(base, 11, 30)))
    tag = lambda t, n: F.array(F.concat(F.lit(t), n.cast("string")))
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("PERSON_"), k.cast("string")).alias("id"), name.alias("name"), tag("PHONE_", k % 701).alias("phone_ids"), tag("VEH_", k % 337).alias("vehicle_ids"))


#: The matched share by recursion: of each pair of pieces the longest common substring, then what is left and right of it.
_SPELLED = """WITH RECURSIVE b AS (SELECT c_custkey AS k, translate(md5('n' || (c_custkey - c_custkey % 3)), '0123456789abcdef', 'aeioubdgklmnrstv') AS h FROM customer),
c AS (SELECT k, substr(h, 1, 6) || ' ' || substr(h, 7, 8) AS n FROM b),
p AS MATERIALIZED (SELECT k, 'PERSON_' || k AS id, CASE k % 3 WHEN 0 THEN n WHEN 1 THEN substr(n, 1, 3) || substr(n, 5) ELSE substr(n, 1, 8) || 'xy' || substr(n, 11) END AS name FROM c),
m AS MATERIALIZED (SELECT x.id AS a, y.id AS b, x.name AS name_a, y.name AS name_b, CAST(x.k % 701 = y.k % 701 AS INT) AS phone, CAST(x.k % 337 = y.k % 337 AS INT) AS vehicle FROM p x JOIN p y ON x.id < y.id
  WHERE x.k % 701 = y.k % 701 OR x.k % 337 = y.k % 337 OR 5 * levenshtein(x.name, y.name) <= length(x.name) + length(y.name)
  OR (string_split(x.name, ' ')[2] = string_split(y.name, ' ')[2] AND x.name[1] = y.name[1])),
parts(x, y, u, v, n) AS (SELECT x, y, x, y, CAST(0 AS BIGINT) FROM (SELECT name_a AS x, name_b AS y FROM m UNION SELECT name_b, name_a FROM m)
  UNION ALL SELECT x, y, side[1], side[2], CASE WHEN place = 1 THEN length(u) * 0 + b.n ELSE 0 END FROM (
    SELECT x, y, u, v, b, unnest([[substr(u, 1, b.i - 1), substr(v, 1, b.j - 1)], [substr(u, b.i + b.n), substr(v, b.j + b.n)]]) AS side, unnest([1, 2]) AS place FROM (
      SELECT x, y, u, v, list_sort(flatten([[{'o': -k, 'i': i, 'j': instr(v, substr(u, i, k)), 'n': k} FOR k IN range(1, length(u) - i + 2) IF instr(v, substr(u, i, k)) > 0] FOR i IN range(1, length(u) + 1)]))[1] AS b FROM parts WHERE u <> '' AND v <> '') WHERE b IS NOT NULL)),
r AS (SELECT x, y, 2.0::DOUBLE * sum(n) / (length(x) + length(y)) AS share FROM parts GROUP BY x, y),
s AS (SELECT a, b, name_a, name_b, phone, vehicle, CASE WHEN name_a = name_b THEN 1.0::DOUBLE WHEN string_split(name_a, ' ')[2] = string_split(name_b, ' ')[2] AND name_a[1] = name_b[1] THEN 0.88::DOUBLE ELSE share END AS name_score
  FROM m JOIN r ON x = name_a AND y = name_b),
t AS (SELECT *, greatest(name_score, CASE WHEN phone = 1 THEN 0.92::DOUBLE ELSE 0 END, CASE WHEN vehicle = 1 THEN 0.94::DOUBLE ELSE 0 END) AS best FROM s WHERE name_score >= 0.8 OR phone = 1 OR vehicle = 1)
"""


@_add("resolution_similar", _SPELLED + "SELECT a, b, name_a, name_b, round(name_score, 4) AS name_score, phone, vehicle, round(best, 4) AS score, 'PENDING_REVIEW' AS status FROM t WHERE round(best, 4) >= 0.75", graph=False)
def _(spark, sf):
    return resolve.candidates_similar(_spelled(spark, sf))


@_add("names_alike", _SPELLED + "SELECT least(x, y) AS name_a, greatest(x, y) AS name_b, round(max(share), 4) AS share FROM r WHERE share >= 0.8 AND x <> y GROUP BY 1, 2", graph=False)
def _(spark, sf):
    return names.alike(_spelled(spark, sf)).withColumn("share", F.round("share", 4))


@_add("resolution_compare", _PEOPLE + "SELECT a.id AS a, b.id AS b, array_to_string(list_filter([CASE WHEN a.name = b.name THEN 'name' END, CASE WHEN a.c_nationkey = b.c_nationkey THEN 'location_id' END], lambda x: x IS NOT NULL), ',') AS matching_fields, array_to_string(list_filter([CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.c_nationkey <> b.c_nationkey THEN 'location_id' END], lambda x: x IS NOT NULL), ',') AS conflicting_fields, CASE WHEN a.name <> b.name AND a.c_nationkey <> b.c_nationkey THEN 'DISTINCT' ELSE 'CONFLICT' END AS match_status, 'PENDING_REVIEW' AS status FROM p a, p b WHERE a.id = 'PERSON_5' AND b.id = 'PERSON_7'", graph=False)
def _(spark, sf):
    return resolve.compare(_people(spark, sf), "PERSON_5", "PERSON_7")


@_add("candidate_filters", _PEOPLE + "SELECT a, b, score FROM (SELECT a, b, least(CAST(0.98 AS DOUBLE), round(CAST(0.4 AS DOUBLE) * token + CAST(0.4 AS DOUBLE) * alias + CAST(0.35 AS DOUBLE) * phone + CAST(0.35 AS DOUBLE) * vehicle, 2)) AS score FROM j) WHERE score >= 0.7 AND score < 0.9", graph=False)
def _(spark, sf):
    return findings.candidate_filter(resolve.candidates_additive(_people(spark, sf)), tier="medium", status="PENDING_REVIEW").select("a", "b", "score")


_RELATED = _PEOPLE + """, found AS (SELECT 'CONTRADICTION' AS kind, 'PERSON_' || c_custkey AS first_id, 'PERSON_' || c_custkey AS second_id, CAST(1.0 AS DOUBLE) AS confidence, c_name || ' / ' || c_name || ' Jr' AS detail FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT 'SAME_RESOLVED_ENTITY', a, b, score, 'PENDING_REVIEW' FROM (SELECT a, b, least(CAST(0.98 AS DOUBLE), round(CAST(0.4 AS DOUBLE) * token + CAST(0.4 AS DOUBLE) * alias + CAST(0.35 AS DOUBLE) * phone + CAST(0.35 AS DOUBLE) * vehicle, 2)) AS score FROM j) WHERE score >= 0.7
  UNION ALL SELECT 'CROSS_CASE_CORRELATION', 'CASE_' || a.o_orderkey, 'CASE_' || b.o_orderkey, CAST(0.5 AS DOUBLE), 'PERSON_' || a.o_custkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
"""


def _related(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey")
    case = lambda c: F.concat(F.lit("CASE_"), F.col(c).cast("string"))
    other = o.withColumnRenamed("o_orderkey", "other")
    met = o.join(other, "o_custkey").where("o_orderkey < other").select(case("o_orderkey").alias("source_id"), case("other").alias("target_id"), F.lit(0.5).alias("confidence"), F.concat(F.lit("PERSON_"), F.col("o_custkey").cast("string")).alias("path"))
    return findings.correlations(ingest.ingest(spark, _sources(spark, sf)).conflicts, resolve.candidates_additive(_people(spark, sf)), met)


@_add("correlations", _RELATED + "SELECT * FROM found", graph=False)
def _(spark, sf):
    return _related(spark, sf)


@_add("correlation_filters", _RELATED + "SELECT kind, count(*) AS n, max(confidence) AS max_confidence FROM found WHERE confidence >= 0.6 GROUP BY 1", graph=False)
def _(spark, sf):
    return findings.correlation_summary(findings.correlation_filter(_related(spark, sf), "all", 0.6))


# ---- timelines


@_add("case_timeline", _SUB + "SELECT DISTINCT e.id, e.event_type, e.ts AS timestamp FROM ent e WHERE e.entity_type = 'EVENT' AND (e.id IN (SELECT id FROM cn) OR e.id IN (SELECT src FROM und WHERE dst IN (SELECT id FROM cn)))")
def _(g, spark, sf):
    return timeline.case_timeline(g, _case(spark, sf)).select("id", "event_type", "timestamp")


@_add("event_list", "SELECT id, event_type, ts AS timestamp FROM ent WHERE entity_type = 'EVENT' AND event_type = 'error' AND contains(lower(id), '_1') AND ts >= '2024-01-05'")
def _(g, spark, sf):
    return timeline.all_events(g, "ERROR", "_1", "2024-01-05").select("id", "event_type", "timestamp")


_INV = ", i AS MATERIALIZED (SELECT e.id AS event_id, e.event_type, epoch(strptime(e.ts, '%Y-%m-%d %H:%M:%S')) AS s, r.target_id AS entity_id FROM ent e JOIN rel r ON r.source_id = e.id AND r.relationship = 'INVOLVES')"


@_add("temporal_conflicts", _INV + " SELECT a.entity_id, a.event_type, a.event_id AS first_event, b.event_id AS second_event, CAST(b.s - a.s AS BIGINT) AS seconds_apart FROM i a JOIN i b ON a.entity_id = b.entity_id AND a.event_type = b.event_type AND b.s > a.s AND b.s - a.s <= 1800")
def _(g, spark, sf):
    return timeline.conflicts(g, 1800)


@_add("event_correlations", _INV + " SELECT a.event_id AS first_event, b.event_id AS second_event, a.entity_id, 'SHARED_ENTITY' AS kind, CASE WHEN a.s = b.s THEN 'DIRECTLY_SUPPORTED' ELSE 'POTENTIAL_CORRELATION' END AS status FROM i a JOIN i b ON a.entity_id = b.entity_id AND a.event_type <> b.event_type AND (b.s > a.s OR b.s = a.s AND a.event_id < b.event_id) AND b.s - a.s <= 900")
def _(g, spark, sf):
    return timeline.correlations(g, 900)


# ---- patterns

_DEG = ", deg AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY id), nc AS (SELECT u.src AS id, count(DISTINCT u.dst) AS n_cases FROM und u JOIN ent e ON e.id = u.dst WHERE e.entity_type = 'CASE' GROUP BY 1)"


@_add("connectivity_hubs", _DEG + " SELECT e.id, e.entity_type, deg.degree, coalesce(n_cases, 0) AS n_cases, CAST(1.0 AS DOUBLE) AS confidence FROM ent e JOIN deg ON deg.id = e.id LEFT JOIN nc ON nc.id = e.id WHERE e.entity_type <> 'CASE' AND deg.degree >= 60")
def _(g, spark, sf):
    return patterns.hubs(g, 60)


@_add("temporal_clusters", _INV + " SELECT entity_id, event_id, n_events FROM (SELECT entity_id, event_id, count(*) OVER (PARTITION BY entity_id ORDER BY s RANGE BETWEEN 54000 PRECEDING AND CURRENT ROW) AS n_events FROM i) WHERE n_events >= 3")
def _(g, spark, sf):
    return patterns.temporal_clusters(g)


@_add("repeated_contacts", _INV + " SELECT entity_id, event_type, max(n) AS most FROM (SELECT entity_id, event_type, count(*) OVER (PARTITION BY entity_id, event_type ORDER BY s RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS n FROM i) GROUP BY 1, 2 HAVING max(n) >= 2")
def _(g, spark, sf):
    return patterns.repeated_contacts(g)


@_add("activity_anomalies", _INV + ", d AS (SELECT entity_id, strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM i GROUP BY 1, 2), w AS (SELECT *, avg(n) OVER x AS mean, stddev_pop(n) OVER x AS sd FROM d WINDOW x AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, round((n - mean) / sd, 4) AS z FROM w WHERE sd > 0) SELECT entity_id, day, n, z, round(least(1.0, z / 10), 3) AS anomaly_score FROM z WHERE z >= 2")
def _(g, spark, sf):
    return patterns.activity_anomalies(g)


@_add("corroboration", " SELECT entity_id, count(DISTINCT doc) AS n_documents, CAST(1 AS BIGINT) AS n_methods FROM (SELECT source_id AS entity_id, doc FROM rel UNION ALL SELECT target_id, doc FROM rel) GROUP BY 1 HAVING count(DISTINCT doc) >= 2")
def _(g, spark, sf):
    return patterns.corroborated(g)


@_add("pattern_filters", _DEG + " SELECT id, severity FROM (SELECT e.id, CASE WHEN degree >= 100 THEN 'HIGH' WHEN degree >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ent e JOIN deg ON deg.id = e.id WHERE e.entity_type = 'PERSON') WHERE severity IN ('HIGH', 'MEDIUM') AND contains(id, '_1')")
def _(g, spark, sf):
    d = neighbours.degree(g).join(lookup.by_type(g, "PERSON").select("id"), "id")
    found = d.select("id", F.when(F.col("degree") >= 100, "HIGH").when(F.col("degree") >= 60, "MEDIUM").otherwise("LOW").alias("severity"), F.lit(1.0).alias("confidence"))
    return patterns.filtered(found, "MEDIUM", "_1", 0.5, ("id",)).select("id", "severity")


@_add("client_search", " SELECT id FROM ent WHERE entity_type = 'PERSON' AND (contains(lower(concat_ws('|', id, name)), 'machinery') OR contains(lower(description), 'machinery'))")
def _(g, spark, sf):
    return lookup.client_search(g, "Machinery", "person").select("id")


@_add("case_detail", f" SELECT id, title, status, priority, incident_date FROM ent WHERE id = {CASE_SQL}")
def _(g, spark, sf):
    return lookup.case_detail(g, _case(spark, sf)).select("id", "title", "status", "priority", "incident_date")


@_add("edges_shown", _DEG + " SELECT id, relationship, source_id IN (SELECT id FROM nc WHERE n_cases >= 2) OR target_id IN (SELECT id FROM nc WHERE n_cases >= 2) AS cross_case FROM rel")
def _(g, spark, sf):
    return lookup.shown_edges(g, supported_only=True).select("id", "relationship", "cross_case")


@_add("relationship_list", f" SELECT rel.id AS rel_id, relationship, CASE WHEN source_id = 'PERSON_5' THEN 'OUT' ELSE 'IN' END AS direction, x.id AS neighbor_id, x.entity_type AS neighbor_type, coalesce(x.name, x.title, x.phone_number, x.id) AS neighbor_label, confidence FROM rel JOIN ent x ON x.id = CASE WHEN source_id = 'PERSON_5' THEN target_id ELSE source_id END WHERE source_id = 'PERSON_5' OR target_id = 'PERSON_5'")
def _(g, spark, sf):
    return neighbours.relationship_list(g, PERSON).drop("evidence_ids")


@_add("timeline_narrowed", _INV + " SELECT DISTINCT e.id, e.event_type, e.ts AS timestamp FROM ent e JOIN (SELECT a.event_id AS x, b.event_id AS y FROM i a JOIN i b ON a.entity_id = b.entity_id AND a.event_type <> b.event_type AND (b.s > a.s OR b.s = a.s AND a.event_id < b.event_id) AND b.s - a.s <= 900 AND a.s <> b.s) k ON e.id IN (k.x, k.y) WHERE e.entity_type = 'EVENT'")
def _(g, spark, sf):
    """Events with a potential correlation, by records of links."""
    found = timeline.narrowed(g, timeline.all_events(g), "ALL", "record_link", timeline.correlations(g, 900), "potential_correlation")
    return found.select("id", "event_type", "timestamp")


# ---- network


@_add("badges", _DEG + " SELECT deg.id, degree, coalesce(n_cases, 0) AS n_cases, coalesce(n_cases, 0) > 1 AS is_bridge, degree >= 3 AS is_central FROM deg LEFT JOIN nc ON nc.id = deg.id WHERE coalesce(n_cases, 0) > 1 OR degree >= 3")
def _(g, spark, sf):
    return network.badges(g)


@_add("key_players", _DEG + f", d AS (SELECT e.id, {LABEL} AS label, degree, coalesce(n_cases, 0) AS n_cases FROM ent e JOIN deg ON deg.id = e.id LEFT JOIN nc ON nc.id = e.id WHERE entity_type = 'PERSON'), s AS (SELECT *, round(CAST(0.6 AS DOUBLE) * degree / (SELECT max(degree) FROM d) + CAST(0.4 AS DOUBLE) * n_cases / (SELECT greatest(max(n_cases), 1) FROM d), 4) AS influence FROM d) SELECT id, label, degree, n_cases, influence, row_number() OVER (ORDER BY influence DESC, id) AS rank, CASE WHEN n_cases >= 2 THEN 'CROSS_CASE_INFLUENCER' WHEN degree >= 3 THEN 'CORE_HUB' ELSE 'BRIDGE_ENTITY' END AS role FROM s ORDER BY influence DESC, id LIMIT 20".replace("coalesce(name, title, phone_number, id)", "coalesce(e.name, e.title, e.phone_number, e.id)"))
def _(g, spark, sf):
    return network.key_players(g).withColumn("rank", F.col("rank").cast("long"))


_STAR = ", s AS (SELECT location_id AS l, id FROM ent WHERE entity_type IN ('PERSON', 'ORGANIZATION') UNION ALL SELECT id, id FROM ent WHERE entity_type = 'LOCATION'), k AS (SELECT l, min(id) AS component, count(*) AS members FROM s GROUP BY l)"


@_add("communities", _STAR + " SELECT 'C-' || lpad(CAST(row_number() OVER (ORDER BY members DESC, component) AS VARCHAR), 3, '0') AS community_id, component, members, members - 1 AS internal_edges, CAST(0 AS BIGINT) AS cases, round(CAST(2.0 AS DOUBLE) * (members - 1) / (members * (members - 1)), 8) AS density FROM k WHERE members >= 2")
def _(g, spark, sf):
    return network.communities(g.only("LOCATED_AT"))


@_add("connected_components", _STAR + " SELECT e.id, coalesce(k.component, e.id) AS component FROM ent e LEFT JOIN s ON s.id = e.id LEFT JOIN k ON k.l = s.l")
def _(g, spark, sf):
    return network.components(g.only("LOCATED_AT"))


@_add("community_members", _STAR + _DEG + " SELECT s.id, coalesce(CASE WHEN s.id LIKE 'LOC_%' THEN k.members - 1 ELSE 1 END, 0) AS degree, CASE WHEN s.id LIKE 'LOC_%' AND k.members > 3 THEN 'CORE' ELSE 'PERIPHERAL' END AS role FROM s JOIN k ON k.l = s.l WHERE k.component = (SELECT min(component) FROM k)")
def _(g, spark, sf):
    star = g.only("LOCATED_AT")
    first = network.communities(star).agg(F.min("component").alias("c")).first()["c"]
    return network.community_members(star, first)


@_add("community_filters", _STAR + " SELECT component, members, CASE WHEN members >= 10 THEN 'UNLINKED_CLUSTER' ELSE 'UNLINKED_GROUP' END AS classification FROM k WHERE members >= 2 AND CAST(2.0 AS DOUBLE) * (members - 1) / (members * (members - 1)) >= 0.02")
def _(g, spark, sf):
    return findings.community_filter(network.communities(g.only("LOCATED_AT")), min_density=0.02, cross_case=False).select("component", "members", "classification")


_HOP = """, e2 AS MATERIALIZED (SELECT src, dst FROM und WHERE relationship IN ('INVOLVED_IN', 'INVOLVES')),
p AS (SELECT id AS person, id FROM ent WHERE entity_type = 'PERSON' UNION ALL SELECT dst, src FROM e2 WHERE dst LIKE 'PERSON_%'), k AS (SELECT person, min(id) AS component FROM p GROUP BY 1)
"""


@_add("connected_components_multi_hop", _HOP + " SELECT e.id, coalesce(k.component, e.id) AS component FROM ent e LEFT JOIN p ON p.id = e.id LEFT JOIN k ON k.person = p.person")
def _(g, spark, sf):
    """Cases and events of a person are two hops apart, and linked to no one else's."""
    return network.components(g.only("INVOLVED_IN", "INVOLVES"))


_VOTES = """, w AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM und WHERE src <> dst GROUP BY 1, 2),
l0 AS (SELECT id, id AS label FROM ent),
""" + ",\n".join(
    f"""v{k} AS (SELECT src, arg_min(label, (-n, label)) AS label FROM (SELECT src, label, CAST(sum(n) AS BIGINT) AS n FROM w JOIN l{k} ON dst = id WHERE (md5(src) >= '8') = {bool(k % 2)} GROUP BY 1, 2) GROUP BY 1),
l{k + 1} AS MATERIALIZED (SELECT id, coalesce(v{k}.label, l{k}.label) AS label FROM l{k} LEFT JOIN v{k} ON src = id)"""
    for k in range(clusters.ROUNDS)
) + f""",
l AS (SELECT * FROM l{clusters.ROUNDS}), size AS (SELECT label, count(*) AS members FROM l GROUP BY 1 HAVING count(*) >= 2),
placed AS MATERIALIZED (SELECT r.*, a.label AS a, b.label AS b, CASE relationship WHEN 'ASSOCIATED_WITH' THEN 'ORGANIZED_CELL' WHEN 'USES' THEN 'COMMUNICATION_RING' WHEN 'LOCATED_AT' THEN 'CO_LOCATION_CLUSTER' ELSE 'ASSOCIATED_GROUP' END AS kind
  FROM rel r JOIN l a ON a.id = source_id JOIN l b ON b.id = target_id)
"""
_COMMUNITIES = _VOTES + """, inn AS (SELECT a AS label, count(*) AS m, round(CAST(sum(CAST(confidence AS DECIMAL(18, 4))) AS DOUBLE) / count(*), 4) AS confidence, count(DISTINCT evid) AS evidence FROM placed WHERE a = b GROUP BY 1),
kinds AS (SELECT label, arg_min(kind, (-n, kind)) AS kind FROM (SELECT a AS label, kind, count(*) AS n FROM placed WHERE a = b GROUP BY 1, 2) GROUP BY 1),
outs AS (SELECT label, count(*) AS x FROM (SELECT a AS label FROM placed WHERE a <> b UNION ALL SELECT b FROM placed WHERE a <> b) GROUP BY 1),
cs AS (SELECT label, count(*) AS cases FROM ent JOIN l ON l.id = ent.id WHERE entity_type = 'CASE' GROUP BY 1),
t AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM placed),
f AS (SELECT label, members, coalesce(m, 0) AS m, coalesce(x, 0) AS x, coalesce(cases, 0) AS cases, coalesce(confidence, 0) AS confidence, coalesce(evidence, 0) AS evidence, coalesce(kind, 'POTENTIAL_GROUP') AS kind, total
  FROM size LEFT JOIN inn USING (label) LEFT JOIN outs USING (label) LEFT JOIN cs USING (label) LEFT JOIN kinds USING (label) CROSS JOIN t)
SELECT label AS community, members, m AS internal_edges, x AS external_edges, round(least(1.0, CAST(2.0 AS DOUBLE) * m / (members * (members - 1))), 8) AS density, round(m / total - ((2 * m + x) / (2 * total)) * ((2 * m + x) / (2 * total)), 8) + 0.0 AS modularity,
  cases AS linked_cases, cases >= 2 AS cross_case, confidence, CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS tier, evidence, kind AS classification FROM f"""


@_add("label_communities", _COMMUNITIES)
def _(g, spark, sf):
    """Over all relationships."""
    return clusters.communities(g)


@_add("label_community_members", _VOTES + """, e AS (SELECT source_id AS id, b AS other FROM placed UNION ALL SELECT target_id, a FROM placed),
c AS (SELECT l.label AS community, l.id, count(*) FILTER (other = l.label) AS inside, count(*) FILTER (other <> l.label) AS outside, count(DISTINCT other) FILTER (other <> l.label) AS others FROM l JOIN size USING (label) LEFT JOIN e ON e.id = l.id GROUP BY 1, 2),
z AS (SELECT c.*, round(coalesce(inside / nullif(max(inside) OVER (PARTITION BY community), 0), 0), 4) AS centrality FROM c)
SELECT community, z.id, entity_type, inside, outside, centrality, CASE WHEN others >= 2 THEN 'BRIDGE' WHEN centrality >= 0.5 THEN 'CORE' ELSE 'PERIPHERAL' END AS role FROM z JOIN ent ON ent.id = z.id""")
def _(g, spark, sf):
    return clusters.members(g)


@_add("label_community_assets", _VOTES + """, near AS (SELECT DISTINCT a.label, dst, p.entity_type, src FROM und JOIN l a ON a.id = src JOIN l b ON b.id = dst AND a.label = b.label JOIN ent s ON s.id = src AND s.entity_type = 'PERSON' JOIN ent p ON p.id = dst AND p.entity_type IN ('PHONE', 'LOCATION'))
SELECT label AS community, entity_type, count(*) AS assets FROM (SELECT label, entity_type, dst FROM near GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2""")
def _(g, spark, sf):
    return clusters.shared_assets(g)


@_add("graph_density", " SELECT (SELECT count(*) FROM ent) AS n, (SELECT count(*) FROM rel) AS m, round(CAST(2.0 AS DOUBLE) * (SELECT count(*) FROM rel) / ((SELECT count(*) FROM ent) * ((SELECT count(*) FROM ent) - 1)), 8) AS density")
def _(g, spark, sf):
    return network.graph_density(g)


@_add("review_priority", _DEG + " SELECT id, priority, CASE WHEN priority >= 75 THEN 'HIGH' WHEN priority >= 50 THEN 'MODERATE' ELSE 'LOW' END AS level FROM (SELECT e.id, round(least(coalesce(degree, 0) / CAST(50.0 AS DOUBLE), 1.0) * 40 + least(coalesce(n_cases, 0) / CAST(10.0 AS DOUBLE), 1.0) * 40 + 20, 2) AS priority FROM ent e LEFT JOIN deg ON deg.id = e.id LEFT JOIN nc ON nc.id = e.id WHERE entity_type = 'PERSON')")
def _(g, spark, sf):
    return network.review_priority(g)


@_add("priority_filter", _DEG + " SELECT id FROM (SELECT e.id, round(least(coalesce(degree, 0) / CAST(50.0 AS DOUBLE), 1.0) * 40 + least(coalesce(n_cases, 0) / CAST(10.0 AS DOUBLE), 1.0) * 40 + 20, 2) AS priority FROM ent e LEFT JOIN deg ON deg.id = e.id LEFT JOIN nc ON nc.id = e.id WHERE entity_type = 'PERSON') WHERE priority >= 75")
def _(g, spark, sf):
    return findings.priority_filter(network.review_priority(g), "high").select("id")


@_add("top_findings", _DEG + " SELECT part, title FROM (SELECT 0 AS part, id AS title, 0 AS rank FROM ent WHERE entity_type = 'CASE' AND status = 'ACTIVE' AND priority = '1-URGENT' AND id LIKE 'CASE_1_' UNION ALL SELECT 1, e.id, -degree FROM ent e JOIN deg ON deg.id = e.id WHERE entity_type = 'PERSON') ORDER BY part, rank, title LIMIT 10")
def _(g, spark, sf):
    urgent = lookup.cases(g, "active").where("priority = '1-URGENT' and id like 'CASE_1_'").select(F.col("id").alias("title"), F.lit(0).cast("long").alias("rank"))
    linked = neighbours.degree(g).join(lookup.by_type(g, "PERSON").select("id"), "id").select(F.col("id").alias("title"), (-F.col("degree")).alias("rank"))
    return findings.first_of(10, urgent, linked).select("part", "title")


@_add("shared_entities", _DEG + " SELECT id, n_cases FROM nc WHERE n_cases >= 2")
def _(g, spark, sf):
    return network.shared_entities(g)


@_add("dashboard", " SELECT count(*) FILTER (entity_type = 'CASE') AS cases, count(*) FILTER (entity_type = 'CASE' AND status = 'ACTIVE') AS active_cases, count(*) FILTER (priority IN ('1-URGENT', '2-HIGH')) AS high_priority, count(*) FILTER (entity_type = 'PERSON') AS persons, (SELECT count(*) FROM rel) AS links, (SELECT count(*) FROM rel) AS evidence FROM ent")
def _(g, spark, sf):
    return network.dashboard(g)


@_add("yearly_trends", "WITH c AS (SELECT n_name AS area, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT area, year, n, round((n - lag(n) OVER w) * CAST(100.0 AS DOUBLE) / lag(n) OVER w, 4) AS change_percent, rank() OVER (PARTITION BY year ORDER BY n DESC, area) AS rank FROM c WINDOW w AS (PARTITION BY area ORDER BY year)", graph=False)
def _(spark, sf):
    o, c, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return stats.trends(joined.groupBy(F.col("n_name").alias("area"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))).withColumn("rank", F.col("rank").cast("long")).withColumn("year", F.col("year").cast("long"))


_FINDINGS = _DEG + _INV + _CLASSES.rstrip() + """,
x1 AS (SELECT u.src AS id, count(DISTINCT u.dst) AS n, min(confidence) AS c FROM und u JOIN ent e ON e.id = u.dst AND e.entity_type = 'CASE' GROUP BY 1 HAVING count(DISTINCT u.dst) >= 2),
x3 AS (SELECT entity_id, max(n) AS n FROM (SELECT entity_id, count(*) OVER (PARTITION BY entity_id ORDER BY s RANGE BETWEEN 54000 PRECEDING AND CURRENT ROW) AS n FROM i) WHERE n >= 3 GROUP BY 1),
x4 AS (SELECT entity_id, event_type, max(n) AS n FROM (SELECT entity_id, event_type, count(*) OVER (PARTITION BY entity_id, event_type ORDER BY s RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS n FROM i) GROUP BY 1, 2 HAVING max(n) >= 2),
ad AS (SELECT entity_id, strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM i GROUP BY 1, 2),
aw AS (SELECT *, avg(n) OVER x AS mean, stddev_pop(n) OVER x AS sd FROM ad WINDOW x AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
x5 AS (SELECT entity_id, day, n, round(least(1.0, z / 10), 3) AS score FROM (SELECT *, round((n - mean) / sd, 4) AS z FROM aw WHERE sd > 0) WHERE z >= 2),
x6 AS (SELECT entity_id, count(DISTINCT doc) AS n FROM (SELECT source_id AS entity_id, doc FROM rel UNION ALL SELECT target_id, doc FROM rel) GROUP BY 1 HAVING count(DISTINCT doc) >= 2),
f AS (SELECT 'CROSS_CASE_BRIDGE' AS t, id AS key, id AS e, n || ' cases' AS o, 'next to ' || n || ' cases' AS p, n / CAST(10 AS DOUBLE) AS s, c AS confidence FROM x1
  UNION ALL SELECT 'HIGH_CONNECTIVITY_HUB', e.id, e.id, degree || ' links', 'degree of at least 60', degree / CAST(100 AS DOUBLE), 1.0 FROM deg JOIN ent e ON e.id = deg.id WHERE entity_type <> 'CASE' AND degree >= 60
  UNION ALL SELECT 'TEMPORAL_CLUSTER', entity_id, entity_id, n || ' events', 'up to ' || n || ' events within 15 hours', n / CAST(10 AS DOUBLE), 1.0 FROM x3
  UNION ALL SELECT 'REPEATED_CONTACT_PATTERN', entity_id || ':' || event_type, entity_id, n || ' events of kind ' || event_type, 'up to ' || n || ' within 48 hours', n / CAST(10 AS DOUBLE), 1.0 FROM x4
  UNION ALL SELECT 'ENTITY_ACTIVITY_ANOMALY', entity_id || ':' || day, entity_id, n || ' events on ' || day, 'more than on the 7 days with events before', score, 1.0 FROM x5
  UNION ALL SELECT 'MULTI_SOURCE_CORROBORATION', entity_id, entity_id, n || ' documents', 'in ' || n || ' documents by 1 methods', n / CAST(100 AS DOUBLE), 1.0 FROM x6
  UNION ALL SELECT 'UNUSUAL_PATH_PATTERN', first_class || '~' || second_class || '~' || via, via, case_pairs || ' pairs of cases', 'linked over ' || hop_count || ' steps', hop_count / CAST(10 AS DOUBLE), confidence FROM bridge WHERE hop_count >= 4),
findings AS (SELECT t || ':' || key AS pattern_id, t AS pattern_type, e AS entity_id, o AS observed_data, p AS computed_pattern, round(least(CAST(1.0 AS DOUBLE), s), 4) AS anomaly_score,
  CASE WHEN round(least(CAST(1.0 AS DOUBLE), s), 4) >= 0.8 THEN 'HIGH' WHEN round(least(CAST(1.0 AS DOUBLE), s), 4) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(confidence AS DOUBLE) AS confidence FROM f)
"""


@_add("pattern_findings", _FINDINGS + "SELECT * FROM findings")
def _(g, spark, sf):
    return envelope.all_patterns(g, g.only(*ROUTES)).drop("investigative_lead", "disclaimer")


@_add("pattern_findings_of_case", _FINDINGS + f"""SELECT pattern_id, severity FROM findings WHERE severity <> 'LOW' AND confidence >= 0.65 AND entity_id IN (SELECT {CASE_SQL} UNION ALL SELECT dst FROM und WHERE src = {CASE_SQL}
  UNION ALL SELECT u.dst FROM und u JOIN ent e ON e.id = u.dst AND e.entity_type <> 'CASE' WHERE u.src IN (SELECT dst FROM und WHERE src = {CASE_SQL}))""")
def _(g, spark, sf):
    found = envelope.all_patterns(g, g.only(*ROUTES))
    return envelope.narrowed(found, g, _case(spark, sf), min_confidence=0.65, least="medium").select("pattern_id", "severity")


@_add("overview", _FINDINGS + """SELECT (SELECT count(*) FROM ent WHERE entity_type = 'CASE') AS cases, (SELECT count(*) FROM ent WHERE entity_type = 'CASE' AND status = 'ACTIVE') AS active_cases, (SELECT count(*) FROM ent WHERE priority IN ('1-URGENT', '2-HIGH')) AS high_priority,
  (SELECT count(*) FROM ent WHERE entity_type = 'PERSON') AS persons, (SELECT count(*) FROM rel) AS links, (SELECT count(*) FROM rel) AS evidence, (SELECT count(*) FROM findings) AS patterns, (SELECT count(*) FROM findings WHERE pattern_type = 'ENTITY_ACTIVITY_ANOMALY') AS anomalies,
  (SELECT count(*) FROM deg LEFT JOIN nc ON nc.id = deg.id WHERE coalesce(n_cases, 0) > 1 OR degree >= 3) AS key_entities, (SELECT count(*) FROM nc WHERE n_cases > 1) AS cross_case_links""")
def _(g, spark, sf):
    return network.overview(g, envelope.all_patterns(g, g.only(*ROUTES)))


_INFLUENCE = _DEG + f""", ne AS (SELECT src AS id, count(DISTINCT evid) AS n_evidence FROM und GROUP BY 1),
d AS (SELECT e.id, entity_type, {LABEL.replace("id)", "e.id)")} AS label, degree, coalesce(n_cases, 0) AS n_cases, coalesce(n_evidence, 0) AS n_evidence FROM ent e JOIN deg ON deg.id = e.id LEFT JOIN nc ON nc.id = e.id LEFT JOIN ne ON ne.id = e.id WHERE entity_type NOT IN ('CASE', 'EVENT')),
s AS (SELECT *, round(CAST(0.5 AS DOUBLE) * degree / max(degree) OVER () + CAST(0.3 AS DOUBLE) * coalesce(n_cases / nullif(max(n_cases) OVER (), 0), 0) + CAST(0.2 AS DOUBLE) * coalesce(n_evidence / nullif(max(n_evidence) OVER (), 0), 0), 4) AS influence,
  CASE WHEN n_cases >= 2 THEN 'CROSS_CASE_INFLUENCER' WHEN degree >= 3 THEN 'CORE_HUB' ELSE 'BRIDGE_ENTITY' END AS role FROM d)
"""


@_add("influence", _INFLUENCE + "SELECT row_number() OVER (ORDER BY influence DESC, id) AS rank, * FROM s ORDER BY influence DESC, id LIMIT 50")
def _(g, spark, sf):
    return network.influence(g).withColumn("rank", F.col("rank").cast("long"))


@_add("influence_filtered", _INFLUENCE + "SELECT row_number() OVER (ORDER BY influence DESC, id) AS rank, id, influence FROM s WHERE role = 'CORE_HUB' AND entity_type = 'PHONE' AND n_cases < 2 ORDER BY influence DESC, id LIMIT 20")
def _(g, spark, sf):
    return network.influence(g, "phone", role="core_hub", cross_case=False, top=20).select(F.col("rank").cast("long").alias("rank"), "id", "influence")


@_add("priority_signals", _DEG + """, p AS (SELECT e.id, CAST(coalesce(degree, 0) AS DOUBLE) AS degree, CAST(coalesce(n_cases, 0) AS DOUBLE) AS n FROM ent e LEFT JOIN deg ON deg.id = e.id LEFT JOIN nc ON nc.id = e.id WHERE entity_type = 'PERSON')
SELECT id, 'degree' AS signal, degree AS value, CAST(40.0 AS DOUBLE) AS weight, round(least(degree / 50, 1.0) * 40, 2) AS points FROM p UNION ALL SELECT id, 'cross_case_links', n, 40.0, round(least(n / 10, 1.0) * 40, 2) FROM p UNION ALL SELECT id, 'confidence', 1.0, 20.0, 20.0 FROM p""")
def _(g, spark, sf):
    return network.priority_signals(g)


@_add("shared_by_membership", """, n1 AS (SELECT DISTINCT src AS case_id, dst AS id FROM und WHERE starts_with(src, 'CASE_')),
m AS (SELECT case_id, id FROM n1 UNION SELECT n1.case_id, u.dst FROM n1 JOIN und u ON u.src = n1.id) SELECT id, count(*) AS n_cases FROM m WHERE NOT starts_with(id, 'CASE_') GROUP BY 1 HAVING count(*) >= 2""")
def _(g, spark, sf):
    return network.shared_members(g)


# ---- reports and exports


@_add("report_detailed", _PATHS + f""", near AS (SELECT * FROM und WHERE src = 'CASE_1'), b AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY hop_count, confidence DESC, path) AS k FROM p)
SELECT '1_LINKS' AS section, rel_id AS key, coalesce(name, title, phone_number, ent.id) || ' (' || dst || ', ' || entity_type || ') by ' || relationship || ', confidence ' || printf('%.2f', confidence) AS line FROM near JOIN ent ON ent.id = dst
UNION ALL SELECT '2_CROSS_CASE', target_id, path || ', confidence ' || printf('%.2f', confidence) FROM b WHERE k = 1
UNION ALL SELECT '3_EVIDENCE', r.evid, r.doc || ' p. ' || r.n || ', RECORD_LINK, ' || printf('%.2f', r.confidence) || ' ' || CASE WHEN r.confidence >= 0.9 THEN 'High' WHEN r.confidence >= 0.7 THEN 'Medium' ELSE 'Low' END || ': Record of ' || r.id FROM rel r JOIN near ON near.rel_id = r.id
UNION ALL SELECT DISTINCT '4_TIMELINE', e.id, coalesce(e.ts, 'undated') || ' ' || e.event_type FROM und u JOIN ent e ON e.id = u.dst AND e.entity_type = 'EVENT' WHERE u.src IN (SELECT dst FROM near)
UNION ALL SELECT '5_LIMITS', 'CASE_1', '{report.DISCLAIMER}'""")
def _(g, spark, sf):
    return report.detailed(g, "CASE_1", g.only(*ROUTES))


@_add("question_answers", """ SELECT 'SUSPECT_DISCOVERY' AS intent, src AS id FROM und WHERE dst = 'CASE_1' AND starts_with(src, 'PERSON_') UNION ALL SELECT DISTINCT 'COMMUNICATIONS_INTELLIGENCE', dst FROM und WHERE src = 'PERSON_5' AND starts_with(dst, 'PHONE_')
UNION ALL SELECT 'ENTITY_CONNECTIONS', dst FROM und WHERE src = 'PERSON_5' UNION ALL SELECT DISTINCT 'ENTITY_CASES', dst FROM und WHERE src = 'PERSON_5' AND starts_with(dst, 'CASE_') UNION ALL SELECT DISTINCT 'CASE_SUMMARY', entity_type FROM ent WHERE id IN (SELECT 'CASE_1' UNION ALL SELECT dst FROM und WHERE src = 'CASE_1' UNION ALL SELECT u.dst FROM und u WHERE u.src IN (SELECT dst FROM und WHERE src = 'CASE_1') AND NOT starts_with(u.dst, 'CASE_'))""")
def _(g, spark, sf):
    """The rows of answers, over the whole graph: no vehicles or accounts are in it, so those answers are empty."""
    policy = spark.createDataFrame([("bob", "ALL")], "username string, case_id string")
    asked = [("Who are the suspects in case 1?", None, "id"), ("Which phones does this person use?", "PERSON_5", "id"), ("What is linked to this person?", "PERSON_5", "neighbor_id"), ("Which cases is this person in?", "PERSON_5", "case_id"), ("Summarize case 1", None, "entity_type"), ("Which vehicles are in case 1?", None, "id"), ("Which bank accounts are in case 1?", None, "id")]
    out = None
    for question, entity, column in asked:
        p, rows = planner.answer(g, question, policy, "bob", entity_id=entity)
        one = rows.select(F.lit(p.intent).alias("intent"), F.col(column).alias("id"))
        out = one if out is None else out.union(one)
    return out


@_add("report_sections", _SUB + f" SELECT entity_type AS section, count(*) AS n, string_agg({LABEL}, ', ' ORDER BY {LABEL}) AS items FROM ent WHERE id IN (SELECT id FROM cn) GROUP BY 1")
def _(g, spark, sf):
    return report.sections(g, _case(spark, sf))


@_add("report_links", _SUB + " SELECT rel_id, relationship, confidence, CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' ELSE 'Low' END AS tier FROM cr")
def _(g, spark, sf):
    return report.links(g, _case(spark, sf))


@_add("report_structured", _SUB + f" SELECT {CASE_SQL} AS case_id, (SELECT count(*) FROM cn) AS node_count, count(*) AS edge_count, round(min(r.confidence), 2) AS least_confidence, round(CAST(2.0 AS DOUBLE) * count(*) / ((SELECT count(*) FROM cn) * ((SELECT count(*) FROM cn) - 1)), 8) AS density, '{report.DISCLAIMER}' AS limitations FROM rel r JOIN ce ON ce.rel_id = r.id")
def _(g, spark, sf):
    return report.structured(g, _case(spark, sf))


@_add("report_markdown", _SUB + f", s AS (SELECT entity_type AS section, '## ' || entity_type || ' (' || count(*) || ')' || chr(10) || string_agg({LABEL}, ', ' ORDER BY {LABEL}) AS t FROM ent WHERE id IN (SELECT id FROM cn) GROUP BY 1) SELECT '# Case report ' || {CASE_SQL} || chr(10) || string_agg(t, chr(10) ORDER BY section) || chr(10) || '{report.DISCLAIMER}' || chr(10) AS report FROM s")
def _(g, spark, sf):
    return report.markdown(g, _case(spark, sf))


@_add("cypher_export", " SELECT part, count(*) AS n, min(statement) AS first_statement FROM (SELECT 0 AS part, 'MERGE (n:' || entity_type || ' {id: \"' || id || '\"}) SET n.label = \"' || coalesce(name, title, phone_number, id) || '\";' AS statement FROM ent UNION ALL SELECT 1, 'MATCH (a {id: \"' || source_id || '\"}), (b {id: \"' || target_id || '\"}) MERGE (a)-[r:' || relationship || ' {id: \"' || id || '\"}]->(b);' FROM rel) GROUP BY part")
def _(g, spark, sf):
    return records.cypher(g).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("statement").alias("first_statement"))


# ---- validation, access, audit


@_add("integrity_errors", ", v AS (SELECT evid FROM rel WHERE evid NOT LIKE '%\\_77' ESCAPE '\\'), e AS (SELECT * FROM ent WHERE id NOT IN ('PERSON_5', 'LOC_3')) SELECT 'ERROR' AS severity, 'DANGLING_LOCATION_ID' AS kind, id, location_id AS detail FROM e WHERE location_id IS NOT NULL AND location_id NOT IN (SELECT id FROM e) UNION ALL SELECT 'ERROR', 'DANGLING_SOURCE_ID', id, source_id FROM rel WHERE source_id NOT IN (SELECT id FROM e) UNION ALL SELECT 'ERROR', 'DANGLING_TARGET_ID', id, target_id FROM rel WHERE target_id NOT IN (SELECT id FROM e) UNION ALL SELECT 'ERROR', 'DANGLING_EVIDENCE', id, evid FROM rel WHERE evid NOT IN (SELECT evid FROM v)")
def _(g, spark, sf):
    broken = EvidenceGraph(g.entities.where("id not in ('PERSON_5', 'LOC_3')"), g.relationships, g.evidence.where(~F.col("evidence_id").endswith("_77")))
    return validate.integrity(broken)


@_add("plan_validation", " SELECT 'NOBODY_1' AS id, 'ENTITY_NOT_FOUND' AS problem")
def _(g, spark, sf):
    return validate.unknown(spark.createDataFrame([("NOBODY_1",), ("PERSON_5",)], "id string"), g)


@_add("confidence_validation", " SELECT id, 'INVALID_CONFIDENCE' AS problem FROM rel WHERE confidence + 0.02 > 1.0")
def _(g, spark, sf):
    return validate.bad_confidence(g.relationships.withColumn("confidence", F.col("confidence") + 0.02))


@_add("visible_graph", ", e AS (SELECT * FROM ent WHERE entity_type <> 'CASE' OR id IN ('CASE_1', 'CASE_2')) SELECT relationship, count(*) AS n FROM rel WHERE source_id IN (SELECT id FROM e) AND target_id IN (SELECT id FROM e) GROUP BY 1")
def _(g, spark, sf):
    policy = spark.createDataFrame([("ann", "CASE_1"), ("ann", "CASE_2"), ("bob", "ALL")], "username string, case_id string")
    return access.visible(g, policy, "ann").relationships.groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


@_add("audit_list", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS action, CASE WHEN event_id % 7 = 0 THEN 'ALL' ELSE 'CASE_' || user_id END AS case_id FROM events WHERE event_id % 7 = 0 OR user_id = 5 ORDER BY 2 DESC, 1 LIMIT 200", graph=False)
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    audit = e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("action"), F.when(F.col("event_id") % 7 == 0, "ALL").otherwise(F.concat(F.lit("CASE_"), F.col("user_id").cast("string"))).alias("case_id"))
    return access.audit_list(audit, "CASE_5", limit=200)


_AUDIT_SQL = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'user' || user_id AS actor, event_type AS action, CASE WHEN event_id % 5 = 0 THEN 'DENIED' ELSE 'SUCCESS' END AS status FROM events"


def _events_said(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.lit("EVENT").alias("resource_type"), F.col("event_id").cast("string").alias("resource_id"), F.lit("ALL").alias("case_id"), F.when(F.col("event_id") % 5 == 0, "DENIED").otherwise("SUCCESS").alias("status"), F.lit(None).cast("map<string,string>").alias("details"))


@_add("audit_append", f"SELECT timestamp, actor, action, status, 'AUDIT_' || upper(substr(sha256(timestamp || '|' || actor || '|' || action || '|EVENT|' || event_id || '|ALL|' || status), 1, 8)) AS id FROM ({_AUDIT_SQL})", graph=False)
def _(spark, sf):
    """Events are appended twice; the second time adds nothing."""
    audit, events = spark.createDataFrame([], access.AUDIT), _events_said(spark, sf)
    return access.audit_append(access.audit_append(audit, events), events).select("id", "timestamp", "actor", "action", "status")


@_add("audit_status_filter", f"SELECT count(*) FILTER (status = 'DENIED') AS shown, count(*) AS total FROM ({_AUDIT_SQL})", graph=False)
def _(spark, sf):
    return access.audit_filter(_events_said(spark, sf), "DENIED")


@_add("normalized_events", "SELECT CAST(event_id AS VARCHAR) AS id, event_type, event_type AS title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'Unknown location' AS location FROM events", graph=False)
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return timeline.normalized(e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")))


# ---- questions

_ASKED = [("ann", "Who is guilty in case 1?"), ("ann", "Summarize case 1"), ("ann", "Summarize case 3"), ("ann", "What is near person 999999999?"), ("bob", "How are case 1 and case 2 connected?"), ("bob", "Which entities are shared?"), ("bob", "Tell me a joke")]


@_add("question_intents", "SELECT * FROM (VALUES ('ann', 'SAFETY_REFUSAL'), ('ann', 'CASE_SUMMARY'), ('ann', 'AUTHORIZATION_DENIAL'), ('ann', 'NOT_FOUND'), ('bob', 'CROSS_CASE_CONNECTION'), ('bob', 'SHARED_ENTITIES'), ('bob', 'UNSUPPORTED')) t(username, intent)", graph=False)
def _(spark, sf):
    g = testdata.load(spark, sf)
    policy = spark.createDataFrame([("ann", "CASE_1"), ("ann", "CASE_2"), ("bob", "ALL")], "username string, case_id string")
    cases = {"ann": ("CASE_1", "CASE_2"), "bob": ("ALL",)}
    seen = {u: access.visible(g, policy, u) for u in cases}
    said = [(u, planner.checked(seen[u], planner.plan(q, allowed=cases[u])).intent) for u, q in _ASKED]
    return spark.createDataFrame(said, "username string, intent string")


@_add("question_shared_entities", """, n1 AS (SELECT DISTINCT src AS case_id, dst AS id FROM und WHERE src IN ('CASE_1', 'CASE_2', 'CASE_3')), m AS (SELECT case_id, id FROM n1 UNION SELECT n1.case_id, u.dst FROM n1 JOIN und u ON u.src = n1.id)
SELECT id, count(*) AS n_cases FROM m WHERE NOT starts_with(id, 'CASE_') GROUP BY 1 HAVING count(*) >= 2""")
def _(g, spark, sf):
    """Over what the asker may see alone."""
    policy = spark.createDataFrame([("ann", c) for c in ("CASE_1", "CASE_2", "CASE_3")], "username string, case_id string")
    return planner.answer(g, "Which entities are shared?", policy, "ann")[1]


# ---- ingest and changes


def _sources(spark: SparkSession, sf: str) -> list:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    one = c.select(F.concat(F.lit("PERSON_"), k.cast("string")).alias("id"), F.lit("suspect").alias("type"), F.col("c_name").alias("name"))
    two = c.where(k % 3 == 0).select(F.concat(F.lit("PERSON_"), k.cast("string")).alias("id"), F.lit("person").alias("type"), F.concat(F.col("c_name"), F.when(k % 2 == 0, " Jr").otherwise("")).alias("name"))
    three = c.where(k % 5 == 0).select(F.concat(F.lit("CARGO_"), k.cast("string")).alias("id"), F.lit("cargo").alias("type"), F.lit(None).cast("string").alias("name"))
    edges = c.where(k % 5 == 0).select(F.concat(F.lit("PERSON_"), k.cast("string")).alias("source"), F.concat(F.lit("CARGO_"), k.cast("string")).alias("target"), F.when(k % 10 == 0, "OWNS").otherwise("BORROWED").alias("relationship"))

    class Broken(records.DataSource):
        source_type = "EXTERNAL_CONNECTOR"

        def fetch_records(self):
            raise ConnectionError("feed is down")

    return [records.ManualSource("register", {"entities": one}), Broken("feed"), records.ManualSource("tips", {"entities": two}), records.ExternalSource("port", {"entities": three, "relationships": edges})]


@_add("ingest_dedup", "SELECT 'PERSON_' || c_custkey AS id, 'PERSON' AS entity_type, c_name AS label, 'MANUAL_INVESTIGATION' AS source FROM customer UNION ALL SELECT 'CARGO_' || c_custkey, 'VEHICLE', 'CARGO_' || c_custkey, 'EXTERNAL_CONNECTOR' FROM customer WHERE c_custkey % 5 = 0", graph=False)
def _(spark, sf):
    return ingest.ingest(spark, _sources(spark, sf)).graph.entities.select("id", "entity_type", S.label().alias("label"), "source")


@_add("ingest_conflicts", "SELECT 'NAME_CONFLICT' AS kind, 'PERSON_' || c_custkey AS id, c_name AS existing, c_name || ' Jr' AS conflicting, 'MANUAL_INVESTIGATION' AS source FROM customer WHERE c_custkey % 6 = 0", graph=False)
def _(spark, sf):
    return ingest.ingest(spark, _sources(spark, sf)).conflicts


@_add("ingest_provenance", "SELECT 'register' AS source, 'OK' AS status, 'entities' AS detail, count(*) AS offered FROM customer UNION ALL SELECT 'feed', 'FAILED', 'feed is down', 0 UNION ALL SELECT 'tips', 'OK', 'entities', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'port', 'OK', 'entities', count(*) FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'port', 'OK', 'relationships', count(*) FROM customer WHERE c_custkey % 5 = 0", graph=False)
def _(spark, sf):
    return ingest.ingest(spark, _sources(spark, sf)).provenance.select("source", "status", "detail", "offered")


@_add("ingest_rejects", "SELECT 'relationship' AS kind, 'PERSON_' || c_custkey || '_BORROWED_CARGO_' || c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 0", graph=False)
def _(spark, sf):
    return ingest.ingest(spark, _sources(spark, sf)).rejects.select("kind", "id")


@_add("delete_cascade", " SELECT relationship, count(*) AS n FROM rel WHERE source_id <> 'PERSON_5' AND target_id <> 'PERSON_5' GROUP BY 1")
def _(g, spark, sf):
    return mutate.delete_entity(g, spark.createDataFrame([(PERSON,)], "id string")).relationships.groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


@_add("update_entities", " SELECT id, CASE WHEN id = 'CASE_1' THEN 'REOPENED' ELSE status END AS status, id = 'CASE_1' AS manual FROM ent WHERE entity_type = 'CASE'")
def _(g, spark, sf):
    new = mutate.update_entity(g, spark.createDataFrame([("CASE_1", "REOPENED")], "id string, status string"))
    return lookup.by_type(new, "CASE").select("id", "status", F.coalesce("is_manual", F.lit(False)).alias("manual"))


@_add("create_and_link", " SELECT entity_type, count(*) + CAST(entity_type = 'PERSON' AS INT) AS n FROM ent GROUP BY 1")
def _(g, spark, sf):
    return mutate.create_and_link(g, "suspect", "New Person", "CASE_1").entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@_add("create_case", " SELECT status, count(*) + CAST(status = 'ACTIVE' AS INT) AS n FROM ent WHERE entity_type = 'CASE' GROUP BY 1")
def _(g, spark, sf):
    return lookup.by_type(mutate.create_case(g, "New case", "CASE_NEW"), "CASE").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_add("delete_cascade_rows", " SELECT id, source_id, target_id FROM rel WHERE source_id <> 'PERSON_5' AND target_id <> 'PERSON_5'")
def _(g, spark, sf):
    return mutate.delete_entity(g, spark.createDataFrame([(PERSON,)], "id string")).relationships.select("id", "source_id", "target_id")


@_add("create_and_link_edge", """, n AS (SELECT 'PERSON_' || substr(sha256('PERSON|New Person'), 1, 12) AS p)
SELECT id, source_id, relationship, target_id, confidence FROM rel WHERE target_id = 'CASE_1' UNION ALL SELECT 'REL_MANUAL_' || p || '_INVOLVED_IN_CASE_1', p, 'INVOLVED_IN', 'CASE_1', CAST(0.95 AS DOUBLE) FROM n""")
def _(g, spark, sf):
    new = mutate.create_and_link(g, "suspect", "New Person", "CASE_1")
    return new.relationships.where("target_id = 'CASE_1'").select("id", "source_id", "relationship", "target_id", "confidence")


@_add("create_case_row", " SELECT id, title, status, priority FROM ent WHERE entity_type = 'CASE' UNION ALL SELECT 'CASE_NEW', 'New case', 'ACTIVE', 'MEDIUM'")
def _(g, spark, sf):
    return lookup.by_type(mutate.create_case(g, "New case", "CASE_NEW"), "CASE").select("id", "title", "status", "priority")


@_add("cypher_statements", " SELECT 0 AS part, 'MERGE (n:' || entity_type || ' {id: \"' || id || '\"}) SET n.label = \"' || coalesce(name, title, phone_number, id) || '\";' AS statement FROM ent UNION ALL SELECT 1, 'MATCH (a {id: \"' || source_id || '\"}), (b {id: \"' || target_id || '\"}) MERGE (a)-[r:' || relationship || ' {id: \"' || id || '\"}]->(b);' FROM rel")
def _(g, spark, sf):
    return records.cypher(g).select("part", "statement")


@_add("visible_rows", ", e AS (SELECT * FROM ent WHERE entity_type <> 'CASE' OR id IN ('CASE_1', 'CASE_2')), v AS (SELECT * FROM rel WHERE source_id IN (SELECT id FROM e) AND target_id IN (SELECT id FROM e)) SELECT 'relationship' AS part, id FROM v UNION ALL SELECT 'evidence', evid FROM v UNION ALL SELECT 'entity', id FROM e")
def _(g, spark, sf):
    """All that a user of two cases sees, evidence too."""
    policy = spark.createDataFrame([("ann", "CASE_1"), ("ann", "CASE_2"), ("bob", "ALL")], "username string, case_id string")
    seen = access.visible(g, policy, "ann")
    part = lambda name, df, c: df.select(F.lit(name).alias("part"), F.col(c).alias("id"))
    return part("relationship", seen.relationships, "id").union(part("evidence", seen.evidence, "evidence_id")).union(part("entity", seen.entities, "id"))


@_add("entity_search_indexed", " SELECT id FROM ent WHERE contains(lower(concat_ws('|', id, name, title, phone_number)), 'customer#00000001')")
def _(g, spark, sf):
    """By trigram postings of all searched texts."""
    return postings.search(postings.index(postings.texts_of(g.entities)), "Customer#00000001")


@_add("evidence_search_indexed", " SELECT evid AS id FROM rel WHERE contains(lower('Record of ' || id), 'rel_use_12')")
def _(g, spark, sf):
    texts = postings.texts_of(g.evidence, "evidence_id", ("source_text",), None)
    return postings.search(postings.index(texts), "REL_USE_12")


@_add("graph_json_scan", " SELECT id, entity_type, coalesce(name, title, phone_number, id) AS label, status, location_id FROM ent")
def _(g, spark, sf):
    """Written as graph files of some thousand records each, and read by the source for them."""
    count = g.entities.count()
    cell = F.pmod(F.xxhash64("id"), F.lit(max(1, count // 2_000)))
    packed = g.entities.groupBy(cell.alias("cell")).agg(F.to_json(F.struct(F.collect_list(F.struct(*[c for c in g.entities.columns if c != "extras"])).alias("entities"))).alias("value"))
    path = f"{shared_folder(spark)}/graph-json-{uuid.uuid4().hex}"
    packed.select("value", "cell").write.partitionBy("cell").text(path)
    delete_at_exit(spark, path)
    files.register(spark)
    found = spark.read.format("evidence_graph").option("part", "entities").load(path)
    return found.select("id", "entity_type", S.label().alias("label"), "status", "location_id")


@_add("graph_versions", """ SELECT id, entity_type, CASE WHEN id = 'LOC_3' THEN 'RENAMED' ELSE coalesce(name, title, phone_number, id) END AS label, 0 AS edges FROM ent WHERE id <> 'PERSON_5' UNION ALL SELECT 'PERSON_NEW', 'PERSON', 'Someone', 0
UNION ALL SELECT id, relationship, source_id || '->' || target_id, 1 FROM rel WHERE source_id <> 'PERSON_5' AND target_id <> 'PERSON_5'""")
def _(g, spark, sf):
    """A graph on disk, changed in place."""
    path = f"{shared_folder(spark)}/graph-versions-{uuid.uuid4().hex}"
    versions.create(g, path)
    delete_at_exit(spark, path)
    versions.upsert(spark, path, entities=spark.createDataFrame([("LOC_3", "LOCATION", "RENAMED"), ("PERSON_NEW", "PERSON", "Someone")], "id string, entity_type string, name string"))
    versions.delete(spark, path, spark.createDataFrame([(PERSON,)], "id string"))
    now = versions.read(spark, path)
    return now.entities.select("id", "entity_type", S.label().alias("label"), F.lit(0).alias("edges")).union(now.relationships.select("id", "relationship", F.concat_ws("->", "source_id", "target_id"), F.lit(1)))


# ---- scalar functions


@_add("scalar_functions", """WITH p AS (SELECT p_partkey AS k, (p_partkey % 101) / CAST(100 AS DOUBLE) AS c, p_type AS t, 'Bearer abc.def at /var/log/app' || p_partkey AS e FROM part)
SELECT k, CASE WHEN c >= 0.9 THEN 'High' WHEN c >= 0.7 THEN 'Medium' ELSE 'Low' END AS tier, CASE WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS score_tier,
 'Bearer [redacted] at [path]' AS redacted, 'the person of interest of case ' || k AS sanitized,
 CASE WHEN k % 7 = 0 THEN 'CONFLICT DETECTED' WHEN k % 3 >= 2 THEN 'CORROBORATED' ELSE 'SINGLE SOURCE' END AS corroboration,
 CASE k % 4 WHEN 0 THEN 'DENIED' WHEN 1 THEN 'FAILURE' ELSE 'SUCCESS' END AS audit, CASE WHEN k % 2 = 0 THEN 'No supporting evidence is available for this relationship.' ELSE 'Supported by E' || k END AS evidence,
 CASE k % 5 WHEN 0 THEN 'VEHICLE' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'CASE' ELSE 'PERSON' END AS kind FROM p""", graph=False)
def _(spark, sf):
    k = F.col("k")
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") % 101) / 100.0).alias("c"))
    said = lambda options, n: F.element_at(F.array(*[F.lit(o) for o in options]), (k % n + 1).cast("int"))
    return p.select(
        "k", S.tier("c").alias("tier"), S.score_tier("c").alias("score_tier"), S.redact(F.concat(F.lit("Bearer abc.def at /var/log/app"), k.cast("string"))).alias("redacted"),
        S.sanitize(F.concat(F.lit("the culprit of case "), k.cast("string"))).alias("sanitized"), S.corroboration(k % 3, k % 7 == 0).alias("corroboration"),
        S.audit_status(said(["AUTHORIZATION_DENIAL", "SAFETY_REFUSAL", "CASE_SUMMARY", "TIMELINE"], 4)).alias("audit"),
        S.evidence_text(F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), k.cast("string"))))).alias("evidence"),
        S.normal_type(said(["cargo van", "Loc", "smartphone", "old case", "suspect"], 5)).alias("kind"),
    )


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
