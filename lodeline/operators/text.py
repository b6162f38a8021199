"""Mentions and relations from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X


def _marked(values: Column, kind: str, confidence: float) -> Column:
    return F.transform(values, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("value"), F.lit(confidence).alias("confidence")))


def line_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), kind, value, confidence: mentions per line; `first`
    marks the line where a document has a value first."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).where("trim(text) <> ''")
    kinds = [("PHONE", X.phones("text"), 0.95), ("VEHICLE", X.plates("text"), 0.94), ("PERSON", X.persons_of_line("text"), 0.92)]
    all_ = F.flatten(F.array(*[_marked(F.array_distinct(v), k, c) for k, v, c in kinds]))
    out = lines.select("doc_id", (F.col("pos") + 1).alias("line"), "text", F.explode(all_).alias("m")).select("doc_id", "line", "text", "m.*")
    return out.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "kind", "value").orderBy("line")) == 1)


def uses_relations(docs: DataFrame) -> DataFrame:
    """doc_id, person, resource, line: on lines that speak of use, every person
    and every phone or plate whose text is on the line."""
    m = line_mentions(docs).where(F.col("text").rlike(X.USES))
    p, r = m.where("kind = 'PERSON'"), m.where("kind <> 'PERSON'")
    return p.select("doc_id", "line", F.col("value").alias("person")).join(r.select("doc_id", "line", F.col("value").alias("resource")), ["doc_id", "line"]).select("doc_id", "person", "resource", F.lit("USES").alias("relationship"), F.lit(0.91).alias("confidence"), "line").distinct()


def _entities(distinct_persons: bool) -> Column:
    persons = F.array_distinct(X.persons_given("text")) if distinct_persons else X.persons_given("text")
    plain = lambda values: F.transform(values, lambda m: F.struct(m.alias("value"), F.lit(None).cast("string").alias("given")))

    def marked(values: Column, kind: str, confidence: float) -> Column:
        return F.transform(values, lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), F.lit(confidence).alias("confidence"), m["given"].alias("given")))

    phones, plates = F.array_distinct(X.found("text", X.PHONE_BOUND)), F.array_distinct(X.found("text", X.PLATE_BOUND))
    return F.flatten(F.array(marked(plain(phones), "PHONE", 0.96), marked(plain(plates), "VEHICLE", 0.94), marked(persons, "PERSON", 0.95)))


def document_entities(docs: DataFrame, distinct_persons: bool = False) -> DataFrame:
    """doc_id, kind, value, confidence, entity_id: of a person the id that the document
    gives in brackets, else one made from kind and value.  Nothing is made up for a
    document without mentions."""
    out = docs.select("doc_id", F.explode(_entities(distinct_persons)).alias("m")).select("doc_id", "m.*")
    return out.withColumn("entity_id", F.coalesce("given", X.mention_id(F.col("kind"), F.col("value")))).drop("given")


def document_relations(docs: DataFrame) -> DataFrame:
    """Every person of a document with each of its plates (USED) and phones (USES)."""
    d = document_entities(docs, True)
    p = d.where("kind = 'PERSON'").select("doc_id", F.col("value").alias("person")).distinct()
    r = d.where("kind <> 'PERSON'").select("doc_id", F.col("value").alias("resource"), "kind")
    vehicle = F.col("kind") == "VEHICLE"
    return p.join(r, "doc_id").select("doc_id", "person", "resource", F.when(vehicle, "USED").otherwise("USES").alias("relationship"), F.when(vehicle, 0.92).otherwise(0.93).alias("confidence"))


def document_evidence(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit("EVID_"), F.col("doc_id").cast("string")).alias("evidence_id"), F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("source_text"), F.lit(0.95).alias("confidence"))


def case_mentions(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(X.case_refs("text"))).alias("case_id"))
