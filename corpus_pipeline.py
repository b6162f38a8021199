"""A corpus pipeline: each stage is an operator over what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import decontaminate, mixing, ngram_join, pii, quality
from lodeline.llm._common import named, small, stage, table, whole_row

#: No SQL expresses boosted trees, so none gives the rows of run().
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Edges: null and empty texts are scored as texts with all statistics zero;
    without labels every score is 0.5, which keeps all; repeated rows stay or go
    together; columns may have any names; an empty table stays empty.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.select("text", whole_row(docs).alias("row")), model)
    return scored.where("predicted = 1").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row, of the least id.

    Edges: null and blank texts are near copies of nothing but rows equal to them
    in id and text; a null id comes after all others; ties go to the least hash;
    columns may have any names; an empty table stays empty.
    """
    # Ids may recur or be null, so rows go by a hash of id and text; rows equal in both are one.
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keyed = docs.select(key.alias("key"), "doc_id", "text", whole_row(docs).alias("row"))
    groups = ngram_join.join(keyed.select(F.col("key").alias("doc_id"), "text"), words=5, p=80, q=100)
    groups = stage(groups.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("group"), F.count(F.lit(1)).alias("n")), "groups")
    several = small(stage(groups.groupBy("group").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("group"), "several"))
    shared = groups.join(several, "group").select("key", "group")
    named = stage(shared.join(keyed.select("key", "doc_id").distinct(), "key"), "shared")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first"))
    extra = stage(named.join(small(stage(first, "first")), "group").where("key <> first").select("key"), "extra")
    held = keyed.select("key", "row").join(extra, "key", "left_anti")
    # Where no kept row recurs, texts needn't be shuffled.
    again = groups.where("n > 1").join(extra, "key", "left_anti")
    return (held if again.isEmpty() else held.dropDuplicates(["key"])).select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Edges: as decontaminate.clean: null and empty texts stay, so do all where there
    are no items; equal rows stay or go together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms, and n_chars, where
    the table has it, put right.

    Edges: as pii.pseudonymise: null texts stay null, texts without such data stay
    as they are, byte for byte; repeated rows get equal texts.
    """
    out = pii.pseudonymise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[named(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; documents it takes none of go.

    Edges: as mixing.mix: null and empty texts have no words, so go; null sources
    are one source; repeated rows are rows of their own; an empty table stays empty.
    """
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
