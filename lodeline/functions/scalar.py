"""Scalar expressions over graph records; all are built-in functions, so plans
stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(c: str | Column = "confidence") -> Column:
    """A missing confidence counts as 1."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(1.0))


def tier(c: str | Column = "confidence") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 0.90, "High").when(c >= 0.70, "Medium").otherwise("Low")


def score_tier(c: str | Column) -> Column:
    """Tier of a score: 0.9 and up is HIGH, 0.7 and up MEDIUM, else LOW."""
    return F.upper(tier(c))


def label() -> Column:
    """What an entity is shown as."""
    return F.coalesce("name", "title", "phone_number", "registration_number", "identifier", "id")


def adapter_label() -> Column:
    """The order in which client views name an entity."""
    return F.coalesce("phone_number", "registration_number", "name", "title", "id")


def normal_type(c: str | Column) -> Column:
    """Entity type of a loosely written one; tests are in order, by substring."""
    u = F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("PERSON")))
    return (
        F.when(u.contains("PHONE"), "PHONE").when(u.rlike("VEHICLE|TRUCK|CAR|VAN"), "VEHICLE")
        .when(u.contains("LOC"), "LOCATION").when(u.contains("CASE"), "CASE")
        .when(u.isin("ORGANIZATION", "ACCOUNT", "EVENT"), u).otherwise("PERSON")
    )


def corroboration(sources: Column, conflict: Column) -> Column:
    return F.when(conflict, "CONFLICT DETECTED").when(sources >= 2, "CORROBORATED").otherwise("SINGLE SOURCE")


def audit_status(query_type: str | Column) -> Column:
    q = F.col(query_type) if isinstance(query_type, str) else query_type
    return F.when(q == "AUTHORIZATION_DENIAL", "DENIED").when(q.isin("SAFETY_REFUSAL", "PROVIDER_FAILURE"), "FAILURE").otherwise("SUCCESS")


#: Wording that an explanation may not use, as whole words.
GUILT = r"(?i)\b(guilty|guilt|culprit|murderer|perpetrator|criminal)\b"


def sanitize(text: Column) -> Column:
    """Explanations name leads for review, never guilt."""
    return F.regexp_replace(text, GUILT, "person of interest")


def redact(text: Column) -> Column:
    """Error texts without file paths and without tokens."""
    paths = F.regexp_replace(text, r"(?:[A-Za-z]:)?(?:[/\\][A-Za-z0-9_.\-]+){2,}", "[path]")
    return F.regexp_replace(paths, r"(?i)(bearer\s+|token\s*[=:]\s*)[A-Za-z0-9_.\-]+", "$1[redacted]")


NO_EVIDENCE = "No supporting evidence is available for this relationship."


def evidence_text(ids: Column) -> Column:
    return F.when(F.size(F.coalesce(ids, F.array().cast("array<string>"))) == 0, F.lit(NO_EVIDENCE)).otherwise(F.concat(F.lit("Supported by "), F.array_join(F.array_sort(ids), ", ")))
