"""An evidence graph over relational tables.

Orders are cases, customers persons, parts the shared resources (phones),
suppliers organizations, nations locations.  The confidence of an edge is a rule
of its keys, so any engine gets the same graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EvidenceGraph
from ..schema import ENTITY, EVIDENCE, RELATIONSHIP, conform


#: Entity types of the ends of relationships; LOCATED_AT has sources of two types.
KINDS = {"INVOLVED_IN": ("PERSON", "CASE"), "USES": ("PERSON", "PHONE"), "ASSOCIATED_WITH": ("ORGANIZATION", "PHONE"), "INVOLVES": ("EVENT", "PERSON")}


def _key(kind: str, c: str) -> Column:
    return F.concat(F.lit(kind + "_"), F.col(c).cast("string"))


def edge_confidence(k1: str, k2: str) -> Column:
    return F.round(F.lit(0.60) + ((F.col(k1) * 31 + F.col(k2) * 17) % 40).cast("double") / 100, 2)


def _edges(df: DataFrame, rel: str, tag: str, source: tuple, target: tuple, n: Column | None = None) -> DataFrame:
    (s_kind, s), (t_kind, t) = source, target
    id_ = F.concat(F.lit(f"REL_{tag}_"), F.col(s).cast("string"), F.lit("_"), F.col(t).cast("string"))
    return df.select(id_.alias("id"), _key(s_kind, s).alias("source_id"), F.lit(rel).alias("relationship"), _key(t_kind, t).alias("target_id"), edge_confidence(s, t).alias("confidence"), F.array(F.concat(F.lit("EVID_"), id_)).alias("evidence_ids"), (n if n is not None else F.lit(1)).cast("int").alias("page_number"))


def load(spark: SparkSession, sf_dir: str) -> EvidenceGraph:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    orders, customer, part, supplier, nation, events, lines = (read(n) for n in ("orders", "customer", "part", "supplier", "nation", "events", "lineitem"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    status = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("UNDER_INVESTIGATION")
    kinds = [
        orders.select(_key("CASE", "o_orderkey").alias("id"), F.lit("CASE").alias("entity_type"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), status.alias("status"), F.col("o_orderpriority").alias("priority"), at("o_orderdate").alias("incident_date")),
        customer.select(_key("PERSON", "c_custkey").alias("id"), F.lit("PERSON").alias("entity_type"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), _key("LOC", "c_nationkey").alias("location_id")),
        part.select(_key("PHONE", "p_partkey").alias("id"), F.lit("PHONE").alias("entity_type"), F.col("p_name").alias("phone_number"), F.col("p_brand").alias("description")),
        supplier.select(_key("ORG", "s_suppkey").alias("id"), F.lit("ORGANIZATION").alias("entity_type"), F.col("s_name").alias("name"), _key("LOC", "s_nationkey").alias("location_id")),
        nation.select(_key("LOC", "n_nationkey").alias("id"), F.lit("LOCATION").alias("entity_type"), F.col("n_name").alias("name")),
        events.select(_key("EVENT", "event_id").alias("id"), F.lit("EVENT").alias("entity_type"), F.col("event_type"), at("ts").alias("timestamp"), F.col("event_type").alias("description")),
    ]
    entities = kinds[0]
    for k in kinds[1:]:
        entities = entities.unionByName(k, allowMissingColumns=True)
    sold = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    uses = sold.groupBy("o_custkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    supplies = lines.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    edges = [
        _edges(orders, "INVOLVED_IN", "INV", ("PERSON", "o_custkey"), ("CASE", "o_orderkey")),
        _edges(uses, "USES", "USE", ("PERSON", "o_custkey"), ("PHONE", "l_partkey"), F.col("n")),
        _edges(supplies, "ASSOCIATED_WITH", "ASC", ("ORG", "l_suppkey"), ("PHONE", "l_partkey"), F.col("n")),
        _edges(customer, "LOCATED_AT", "LOCP", ("PERSON", "c_custkey"), ("LOC", "c_nationkey")),
        _edges(supplier, "LOCATED_AT", "LOCO", ("ORG", "s_suppkey"), ("LOC", "s_nationkey")),
        _edges(events, "INVOLVES", "EVT", ("EVENT", "event_id"), ("PERSON", "user_id")),
    ]
    rel = edges[0]
    for e in edges[1:]:
        rel = rel.union(e)
    evidence = rel.select(
        F.element_at("evidence_ids", 1).alias("evidence_id"), F.concat(F.lit("DOC_"), F.regexp_extract("id", r"([0-9]+)$", 1)).alias("source_document_id"),
        F.concat(F.lit("Record of "), F.col("id")).alias("source_text"), F.col("page_number"), F.lit("RECORD_LINK").alias("extraction_method"), F.col("confidence"),
    )

    def missing() -> DataFrame:
        """Keys that the tables have as ends of relationships but not as rows; cases and
        events are ends only by their own rows."""
        ends = [
            ("PERSON", orders.select("o_custkey").union(events.select("user_id")), customer.select("c_custkey")),
            ("PHONE", lines.select("l_partkey"), part.select("p_partkey")), ("ORG", lines.select("l_suppkey"), supplier.select("s_suppkey")),
            ("LOC", customer.select("c_nationkey").union(supplier.select("s_nationkey")), nation.select("n_nationkey")),
        ]
        gone = [own.toDF("k").distinct().join(rows.toDF("k"), "k", "left_anti").select(_key(kind, "k").alias("id")) for kind, own, rows in ends]
        out = gone[0]
        for g in gone[1:]:
            out = out.union(g)
        return out.where("id is not null")

    return EvidenceGraph(conform(entities, ENTITY), conform(rel.drop("page_number"), RELATIONSHIP), conform(evidence, EVIDENCE), missing, KINDS)


#: The same graph as DuckDB common table expressions.
SQL = """
_use AS (SELECT o_custkey AS a, l_partkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
_asc AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
_pairs AS (
  SELECT 'INVOLVED_IN' AS r, 'INV' AS tag, 'PERSON' AS sk, 'CASE' AS tk, o_custkey AS a, o_orderkey AS b, 1 AS n FROM orders
  UNION ALL SELECT 'USES', 'USE', 'PERSON', 'PHONE', a, b, n FROM _use
  UNION ALL SELECT 'ASSOCIATED_WITH', 'ASC', 'ORG', 'PHONE', a, b, n FROM _asc
  UNION ALL SELECT 'LOCATED_AT', 'LOCP', 'PERSON', 'LOC', c_custkey, c_nationkey, 1 FROM customer
  UNION ALL SELECT 'LOCATED_AT', 'LOCO', 'ORG', 'LOC', s_suppkey, s_nationkey, 1 FROM supplier
  UNION ALL SELECT 'INVOLVES', 'EVT', 'EVENT', 'PERSON', event_id, user_id, 1 FROM events),
rel AS MATERIALIZED (SELECT 'REL_' || tag || '_' || a || '_' || b AS id, sk || '_' || a AS source_id, r AS relationship, tk || '_' || b AS target_id,
  round(CAST(0.60 AS DOUBLE) + CAST((a * 31 + b * 17) % 40 AS DOUBLE) / 100, 2) AS confidence, 'EVID_REL_' || tag || '_' || a || '_' || b AS evid, n, 'DOC_' || b AS doc FROM _pairs),
ent AS MATERIALIZED (
  SELECT 'CASE_' || o_orderkey AS id, 'CASE' AS entity_type, CAST(NULL AS VARCHAR) AS name, 'Order ' || o_orderkey AS title, CAST(NULL AS VARCHAR) AS phone_number,
    CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'ACTIVE' ELSE 'UNDER_INVESTIGATION' END AS status, o_orderpriority AS priority,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS incident_date, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS ts, CAST(NULL AS VARCHAR) AS location_id, CAST(NULL AS VARCHAR) AS description FROM orders
  UNION ALL SELECT 'PERSON_' || c_custkey, 'PERSON', c_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'LOC_' || c_nationkey, c_mktsegment FROM customer
  UNION ALL SELECT 'PHONE_' || p_partkey, 'PHONE', NULL, NULL, p_name, NULL, NULL, NULL, NULL, NULL, NULL, p_brand FROM part
  UNION ALL SELECT 'ORG_' || s_suppkey, 'ORGANIZATION', s_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'LOC_' || s_nationkey, NULL FROM supplier
  UNION ALL SELECT 'LOC_' || n_nationkey, 'LOCATION', n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'EVENT_' || event_id, 'EVENT', NULL, NULL, NULL, NULL, NULL, NULL, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S'), NULL, event_type FROM events),
_known AS (SELECT r.* FROM rel r WHERE source_id IN (SELECT id FROM ent) AND target_id IN (SELECT id FROM ent)),
und AS MATERIALIZED (SELECT source_id AS src, target_id AS dst, id AS rel_id, relationship, confidence, evid FROM _known
  UNION ALL SELECT target_id, source_id, id, relationship, confidence, evid FROM _known WHERE source_id <> target_id)
"""
