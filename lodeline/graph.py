"""The evidence graph: three DataFrames and the edge views over them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which spark.checkpoint.dir names.  Where it is
    unset, local mode, as in tests, takes a folder of its own; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def delete_at_exit(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder, so that what reads it twice works
    it out once, and by columns.  The files go when the application ends."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, buckets: int | None = None) -> DataFrame:
    """df, written once like checkpointed() but dealt into buckets by a column and sorted
    in them: joins on it don't shuffle the table again, and filters on values of it read
    their buckets only.  The name that the table needs in the catalog goes at once."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(n, by).write.option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(name)
    delete_at_exit(spark, path)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def numbered(ids: DataFrame, *more: str | Column) -> DataFrame:
    """id, n and more columns of each different id, written once: n is a long, and numbers
    are in the order of the ids, so the least number is that of the least id.  Steps over
    many rounds deal out numbers, not strings."""
    one = ids.where("id is not null").dropDuplicates(["id"]).repartitionByRange("id").sortWithinPartitions("id")
    return checkpointed(one.select("id", F.monotonically_increasing_id().alias("n"), *more))


@dataclass(frozen=True)
class EvidenceGraph:
    """entities(id, entity_type, ...), relationships(id, source_id, relationship,
    target_id, confidence, evidence_ids, ...), evidence(evidence_id, ...).  Who made the
    graph may know a short way to missing(id): ends of relationships that no entity has."""

    entities: DataFrame
    relationships: DataFrame
    evidence: DataFrame
    missing: Callable[[], DataFrame] | None = None
    kinds: dict[str, tuple[str, str]] | None = None

    def known(self, r: DataFrame) -> DataFrame:
        """Of relationships those with both ends.  Where the missing ends can be told, the
        relationships are not dealt anew by either end."""
        if self.missing is None:
            ids = self.entities.select("id")
            return r.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        r = r.where("source_id is not null and target_id is not null")
        gone = checkpointed(self.missing().select("id").distinct())
        if gone.isEmpty():
            return r
        return r.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")

    def linked(self, *more: str) -> EvidenceGraph:
        """This graph with only the columns of relationships that routes need, and more,
        of those with both ends, written once; edges(known=False) of it are views of that."""
        r = self.known(self.relationships.select("id", "source_id", "target_id", "relationship", "confidence", "evidence_ids"))
        kept = checkpointed(r.where("source_id <> target_id").select("source_id", "target_id", "confidence", *more))
        given = [c for c in ("id", "relationship", "evidence_ids") if c not in more]
        types = {"id": "string", "relationship": "string", "evidence_ids": "array<string>"}
        return EvidenceGraph(self.entities, kept.withColumns({c: F.lit(None).cast(types[c]) for c in given}) if given else kept, self.evidence)

    def edges(self, direction: str = "undirected", known: bool = True) -> DataFrame:
        """src, dst, rel_id, relationship, confidence, evidence_ids; an undirected
        edge is seen from both ends, a loop once.  With known, both ends exist."""
        r = self.relationships.select("id", "source_id", "target_id", "relationship", "confidence", "evidence_ids")
        if known:
            r = self.known(r)
        rest = [F.col("id").alias("rel_id"), "relationship", "confidence", "evidence_ids"]
        ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        out, back = ends("source_id", "target_id"), ends("target_id", "source_id")
        if direction == "undirected":  # one scan gives both views
            both = F.when(F.col("source_id") == F.col("target_id"), F.array(out)).otherwise(F.array(out, back))
            return r.select(F.explode(both).alias("e"), *rest).select("e.src", "e.dst", "rel_id", "relationship", "confidence", "evidence_ids")
        return r.select((out if direction == "outgoing" else back).alias("e"), *rest).select("e.src", "e.dst", "rel_id", "relationship", "confidence", "evidence_ids")

    def only(self, *relationships: str) -> EvidenceGraph:
        return EvidenceGraph(self.entities, self.relationships.where(F.col("relationship").isin(*relationships)), self.evidence, self.missing, self.kinds)
