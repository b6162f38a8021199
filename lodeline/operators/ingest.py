"""Multi-source ingest: normalization, deduplication, conflicts, provenance, rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import label, normal_type
from ..graph import EvidenceGraph
from ..schema import ENTITY, EVIDENCE, RELATIONSHIP, RELATIONSHIP_TYPES, conform


def normalize_entities(raw: DataFrame, source: str, rank: int) -> DataFrame:
    """Types put right and display fields filled from name or id."""
    kind = normal_type("entity_type" if "entity_type" in raw.columns else F.col("type"))
    e = conform(raw.withColumn("entity_type", kind), ENTITY)
    shown = F.coalesce("name", "id")
    fill = lambda c, t: F.when(F.col("entity_type") == t, F.coalesce(c, shown)).otherwise(F.col(c))
    return (
        e.withColumn("name", F.when(F.col("entity_type").isin("PERSON", "LOCATION", "ORGANIZATION"), shown).otherwise(F.col("name")))
        .withColumn("title", fill("title", "CASE")).withColumn("case_number", F.when(F.col("entity_type") == "CASE", F.coalesce("case_number", "id")).otherwise(F.col("case_number")))
        .withColumn("phone_number", fill("phone_number", "PHONE")).withColumn("registration_number", fill("registration_number", "VEHICLE"))
        .withColumn("identifier", fill("identifier", "ACCOUNT")).withColumn("event_type", F.when(F.col("entity_type") == "EVENT", F.coalesce("event_type", F.lit("UNKNOWN"))).otherwise(F.col("event_type")))
        .withColumn("description", F.when(F.col("entity_type") == "EVENT", F.coalesce("description", shown)).otherwise(F.col("description")))
        .withColumn("source", F.coalesce("source", F.lit(source))).withColumn("source_rank", F.lit(rank))
    )


def normalize_edges(raw: DataFrame, source: str, rank: int) -> DataFrame:
    """Accepts source/target for the ends; an edge without id is named by its ends and kind."""
    named = raw
    for long, short in (("source_id", "source"), ("target_id", "target")):
        if long not in raw.columns:
            named = named.withColumn(long, F.col(short) if short in raw.columns else F.lit(None).cast("string"))
    r = conform(named.drop("source", "target"), RELATIONSHIP).withColumn("relationship", F.coalesce("relationship", F.lit("LINKED_TO")))
    made = F.concat_ws("_", "source_id", "relationship", "target_id")
    return r.withColumn("id", F.coalesce("id", made)).withColumn("source_type", F.coalesce("source_type", F.lit(source))).withColumn("source_rank", F.lit(rank))


def normalize_evidence(raw: DataFrame, source: str, rank: int) -> DataFrame:
    e = conform(raw, EVIDENCE)
    return (
        e.withColumn("source_document_id", F.coalesce("source_document_id", F.lit("DOC_EXTRACTION")))
        .withColumn("source_text", F.coalesce("source_text", F.lit("Extracted evidence text")))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.95)))
        .withColumn("extraction_method", F.coalesce("extraction_method", F.lit(source))).withColumn("source_rank", F.lit(rank))
    )


def first_wins(df: DataFrame, key: str) -> DataFrame:
    """The row of the source that was registered first, for each id."""
    order = Window.partitionBy(key).orderBy("source_rank", F.xxhash64(*[c for c in df.columns if c not in ("extras", "properties")]))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def conflicts(entities: DataFrame) -> DataFrame:
    """Later rows of an id whose label differs from the first one's."""
    shown = entities.select("id", "source_rank", "source", F.coalesce("name", "title", "phone_number", "registration_number", "identifier").alias("label"))
    order = Window.partitionBy("id").orderBy("source_rank")
    first = shown.withColumn("existing", F.first("label").over(order)).withColumn("first_rank", F.min("source_rank").over(Window.partitionBy("id")))
    other = first.where((F.col("source_rank") > F.col("first_rank")) & (F.col("existing") != "") & (F.col("label") != "") & (F.col("existing") != F.col("label")))
    return other.select(F.lit("NAME_CONFLICT").alias("kind"), "id", "existing", F.col("label").alias("conflicting"), "source")


@dataclass(frozen=True)
class Ingested:
    graph: EvidenceGraph
    conflicts: DataFrame
    provenance: DataFrame
    rejects: DataFrame


def ingest(spark, sources: list) -> Ingested:
    """Reads every source in order; one that fails to be read is logged as FAILED
    and the others go on.  Bad rows go to rejects, never the rest of a source."""
    parts: dict[str, list[DataFrame]] = {"entities": [], "relationships": [], "evidence": []}
    log = []
    shape = {"entities": (normalize_entities, ENTITY), "relationships": (normalize_edges, RELATIONSHIP), "evidence": (normalize_evidence, EVIDENCE)}
    for rank, source in enumerate(sources):
        try:
            fetched = source.fetch_records()
            made = {k: shape[k][0](df, source.source_type, rank) for k, df in fetched.items() if k in shape and df is not None}
        except Exception as error:  # a source of any kind may fail in any way; it is logged
            log.append(spark.createDataFrame([(source.name, source.source_type, "FAILED", str(error)[:200])], "source string, source_type string, status string, detail string").withColumn("offered", F.lit(0).cast("long")))
            continue
        for k, df in made.items():
            parts[k].append(df)
            log.append(df.agg(F.count(F.lit(1)).alias("offered")).select(F.lit(source.name).alias("source"), F.lit(source.source_type).alias("source_type"), F.lit("OK").alias("status"), F.lit(k).alias("detail"), "offered"))
    whole = {}
    for k, dfs in parts.items():
        df = dfs[0] if dfs else shape[k][0](spark.createDataFrame([], shape[k][1]), "NONE", 0)
        for other in dfs[1:]:
            df = df.unionByName(other)
        whole[k] = df
    bad_edge = F.col("source_id").isNull() | F.col("target_id").isNull() | ~F.col("relationship").isin(*RELATIONSHIP_TYPES) | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True))
    bad_entity = F.col("id").isNull() | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)) | ~F.coalesce(F.col("age").between(0, 150), F.lit(True)) | ~F.coalesce(F.col("latitude").between(-90, 90), F.lit(True)) | ~F.coalesce(F.col("longitude").between(-180, 180), F.lit(True))
    e, r = whole["entities"], whole["relationships"]
    reject = lambda df, bad, kind: df.where(bad).select(F.lit(kind).alias("kind"), F.col("id"), F.col("source_rank"))
    provenance = log[0] if log else spark.createDataFrame([], "source string, source_type string, status string, detail string, offered long")
    for x in log[1:]:
        provenance = provenance.unionByName(x)
    good = e.where(~bad_entity)
    graph = EvidenceGraph(first_wins(good, "id").drop("source_rank"), first_wins(r.where(~bad_edge), "id").drop("source_rank"), first_wins(whole["evidence"].where("evidence_id is not null"), "evidence_id").drop("source_rank"))
    return Ingested(graph, conflicts(good), provenance, reject(e, bad_entity, "entity").union(reject(r, bad_edge, "relationship")))


__all__ = ["Ingested", "conflicts", "first_wins", "ingest", "label", "normalize_edges", "normalize_entities", "normalize_evidence"]
