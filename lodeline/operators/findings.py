"""Findings brought together: correlations, their filters, and short lists.

Whatever is found is a lead for review; nothing here merges or judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import score_tier

CORRELATION = "kind string, first_id string, second_id string, confidence double, detail string"


def correlations(conflicts: DataFrame | None = None, candidates: DataFrame | None = None, connections: DataFrame | None = None) -> DataFrame:
    """One table of what speaks for or against each other.

    conflicts(id, existing, conflicting) are CONTRADICTION, candidates(a, b, score)
    SAME_RESOLVED_ENTITY, connections(source_id, target_id, confidence, path)
    CROSS_CASE_CORRELATION.  Any of them may be left out, not all.
    """
    parts = []
    if conflicts is not None:
        parts.append(_row(conflicts, "CONTRADICTION", F.col("id"), F.col("id"), F.lit(1.0), F.concat_ws(" / ", "existing", "conflicting")))
    if candidates is not None:
        parts.append(_row(candidates, "SAME_RESOLVED_ENTITY", F.col("a"), F.col("b"), F.col("score"), F.lit("PENDING_REVIEW")))
    if connections is not None:
        parts.append(_row(connections, "CROSS_CASE_CORRELATION", F.col("source_id"), F.col("target_id"), F.col("confidence"), F.col("path")))
    if not parts:
        raise ValueError("correlations of nothing")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _row(df: DataFrame, kind: str, first: Column, second: Column, confidence: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), first.alias("first_id"), second.alias("second_id"), confidence.cast("double").alias("confidence"), detail.alias("detail"))


def correlation_filter(found: DataFrame, kind: str | None = None, min_confidence: float | None = None) -> DataFrame:
    if kind and kind.upper() != "ALL":
        found = found.where(F.col("kind") == kind.upper())
    return found if min_confidence is None else found.where(F.col("confidence") >= min_confidence)


def correlation_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("max_confidence"))


def candidate_filter(found: DataFrame, entity_id: str | None = None, tier: str | None = None, status: str | None = None) -> DataFrame:
    """Candidates(a, b, score, status, and has_conflict where known) of an entity,
    a tier of the score, a status; CONFLICT stands for those with one, too."""
    if entity_id:
        found = found.where((F.col("a") == entity_id) | (F.col("b") == entity_id))
    if tier:
        found = found.where(score_tier("score") == tier.upper())
    if status:
        own = F.col("status") == status.upper()
        if status.upper() == "CONFLICT" and "has_conflict" in found.columns:
            own = own | F.col("has_conflict")
        found = found.where(own)
    return found


def classification(cases: Column, members: Column) -> Column:
    """Of a community by its cases."""
    return F.when(cases >= 2, "CROSS_CASE").when(cases == 1, "CASE_LOCAL").when(members >= 10, "UNLINKED_CLUSTER").otherwise("UNLINKED_GROUP")


def community_filter(found: DataFrame, kind: str | None = None, min_density: float | None = None, cross_case: bool | None = None) -> DataFrame:
    """Communities(members, cases, density) with their classification, under filters."""
    found = found.withColumn("classification", classification(F.col("cases"), F.col("members")))
    if kind:
        found = found.where(F.col("classification") == kind.upper())
    if min_density is not None:
        found = found.where(F.col("density") >= min_density)
    return found if cross_case is None else found.where((F.col("cases") >= 2) == F.lit(cross_case))


def priority_filter(found: DataFrame, level: str | None = None) -> DataFrame:
    return found.where(F.col("level") == level.upper()) if level and level.upper() != "ALL" else found


def shown_of_total(found: DataFrame, kept: Column) -> DataFrame:
    """One row: how many rows a filter shows, and of how many."""
    return found.agg(F.count_if(kept).alias("shown"), F.count(F.lit(1)).alias("total"))


def first_of(n: int, *parts: DataFrame) -> DataFrame:
    """The first n of several tables (title, rank) one after another: all of the
    first table come before those of the second; within one by rank, then title."""
    out = None
    for place, part in enumerate(parts):
        one = part.select(F.lit(place).alias("part"), "title", "rank")
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("first of nothing")
    return out.orderBy("part", "rank", "title").limit(n)
