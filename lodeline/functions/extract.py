"""Rule-based mention extraction from text, as regular-expression columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define a phone, plate, name and case number,
# and the capitalised phrases that are no names.
PHONE = r"(?:\+?91[\-\s]?)?[6-9][0-9]{9}"
PHONE_BOUND = r"\+?91[\-\s]?[6-9][0-9]{9}|\b[6-9][0-9]{9}\b"
PLATE = r"[A-Z]{2}[\-\s]?[0-9]{2}[\-\s]?[A-Z]{1,2}[\-\s]?[0-9]{4}"
PLATE_BOUND = r"\b[A-Z]{2}[\-\s]?[0-9]{2}[\-\s]?[A-Z]{1,2}[\-\s]?[0-9]{4}\b"
PERSON_LINE = r"(?:Mr\.|Ms\.|Shri|Officer|Suspect|Person)?\s*([A-Z][a-z]+\s+[A-Z][a-z]+)"
PERSON = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
PERSON_GIVEN = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:\s*\(PERSON_[0-9]+\))?"
CASE_REF = r"(?i)(?:CASE|FIR)[\-_\s]?([0-9]+)"
USES = r"(?i)(uses|using|operated|utilizing)"
STOP = ("Zaveri Bazaar", "Mumbai Police", "Crime Branch", "Logistics Yard", "Zaveri Bazar", "Operation Midnight", "Operation Golden")


def found(text: str | Column, pattern: str, group: int = 0) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def phones(text) -> Column:
    return found(text, PHONE)


def plates(text) -> Column:
    return found(text, PLATE)


def persons_of_line(text) -> Column:
    return F.filter(found(text, PERSON_LINE, 1), lambda p: ~p.isin(*STOP))


def persons(text) -> Column:
    return found(text, PERSON)


def persons_given(text) -> Column:
    """Each name with the id in brackets behind it, if there is one."""
    given = lambda m: F.nullif(F.regexp_extract(m, r"\((PERSON_[0-9]+)\)$", 1), F.lit(""))
    return F.transform(found(text, PERSON_GIVEN), lambda m: F.struct(F.regexp_extract(m, PERSON, 0).alias("value"), given(m).alias("given")))


def case_refs(text) -> Column:
    return F.transform(found(text, CASE_REF, 1), lambda n: F.concat(F.lit("CASE_"), n))


def mention_id(kind: Column, value: Column) -> Column:
    """The same value has the same id in every run."""
    return F.concat(kind, F.lit("_"), F.substring(F.sha2(value.cast("binary"), 256), 1, 12))
