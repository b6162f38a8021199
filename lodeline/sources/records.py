"""Where records come from, and where they go."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EvidenceGraph
from ..schema import ENTITY, EVIDENCE, RELATIONSHIP, conform

_PARTS = {"entities": ENTITY, "relationships": RELATIONSHIP, "evidence": EVIDENCE}


class DataSource(ABC):
    """A named feed of entities, relationships and evidence."""

    source_type = "SOURCE"

    def __init__(self, name: str):
        self.name = name

    @abstractmethod
    def fetch_records(self) -> dict[str, DataFrame]:
        """DataFrames by part; parts may be absent."""


class JsonSource(DataSource):
    source_type = "SYNTHETIC_DATASET"

    def __init__(self, spark: SparkSession, name: str, path: str):
        super().__init__(name)
        self.spark, self.path = spark, path

    def fetch_records(self) -> dict[str, DataFrame]:
        return _json_parts(self.spark, self.path)


class ManualSource(DataSource):
    source_type = "MANUAL_INVESTIGATION"

    def __init__(self, name: str, parts: dict[str, DataFrame]):
        super().__init__(name)
        self.parts = parts

    def fetch_records(self) -> dict[str, DataFrame]:
        return self.parts


class ExternalSource(ManualSource):
    """Any reader's DataFrames (csv, json, parquet, jdbc) under a feed's name."""

    source_type = "EXTERNAL_CONNECTOR"


def _json_parts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON file {entities|nodes: [...], relationships|edges: [...], evidence: [...] or {id: ...}}."""
    raw = spark.read.json(path, multiLine=True)
    out = {}
    for part, other in (("entities", "nodes"), ("relationships", "edges"), ("evidence", "evidence")):
        c = part if part in raw.columns else other
        if c not in raw.columns:
            continue
        kind = raw.schema[c].dataType
        rows = F.col(c) if kind.typeName() == "array" else F.array(*[F.to_json(F.col(f"{c}.`{k}`")) for k in kind.names])
        if kind.typeName() == "array":
            out[part] = raw.select(F.inline(rows))
        else:
            out[part] = raw.select(F.explode(rows).alias("j")).select(F.from_json("j", EVIDENCE).alias("v")).select("v.*")
    return out


def read_json(spark: SparkSession, path: str) -> EvidenceGraph:
    parts = _json_parts(spark, path)
    whole = {k: conform(parts[k], s) if k in parts else conform(spark.createDataFrame([], s), s) for k, s in _PARTS.items()}
    return EvidenceGraph(whole["entities"], whole["relationships"], whole["evidence"])


def write_json(graph: EvidenceGraph, path: str) -> None:
    """One JSON-lines folder for each part."""
    for part in _PARTS:
        getattr(graph, part).write.json(f"{path}/{part}")


def write_parquet(graph: EvidenceGraph, path: str) -> None:
    """A new version of the graph; entities are laid out by type, so filters on it skip files."""
    graph.entities.repartition("entity_type").write.partitionBy("entity_type").parquet(f"{path}/entities")
    graph.relationships.write.parquet(f"{path}/relationships")
    graph.evidence.write.parquet(f"{path}/evidence")


def read_parquet(spark: SparkSession, path: str) -> EvidenceGraph:
    return EvidenceGraph(*(spark.read.parquet(f"{path}/{p}") for p in _PARTS))


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name), text: a folder of text files, each one document."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), F.col("value").alias("text"))


def cypher(graph: EvidenceGraph) -> DataFrame:
    """One statement a row, nodes before edges (`part` 0 and 1)."""
    quote = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    value = lambda c: F.regexp_extract(quote(c), r'^\{"v":(.*)\}$', 1)
    nodes = graph.entities.select(F.lit(0).alias("part"), "id", F.concat(F.lit("MERGE (n:"), "entity_type", F.lit(" {id: "), value("id"), F.lit("}) SET n.label = "), F.regexp_extract(F.to_json(F.struct(F.coalesce("name", "title", "phone_number", "id").alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit(";")).alias("statement"))
    edges = graph.relationships.select(F.lit(1).alias("part"), "id", F.concat(F.lit("MATCH (a {id: "), value("source_id"), F.lit("}), (b {id: "), value("target_id"), F.lit("}) MERGE (a)-[r:"), "relationship", F.lit(" {id: "), value("id"), F.lit("}]->(b);")).alias("statement"))
    return nodes.union(edges)
