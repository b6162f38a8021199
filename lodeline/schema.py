"""Record types of an evidence graph, and how partial records are completed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_TYPES = ("PERSON", "PHONE", "VEHICLE", "LOCATION", "ORGANIZATION", "ACCOUNT", "CASE", "EVENT")
RELATIONSHIP_TYPES = (
    "CONTACTED", "KNOWS", "ASSOCIATED_WITH", "USES", "OWNS", "VISITED", "LOCATED_AT", "INVOLVED_IN", "SEEN_AT",
    "WORKS_FOR", "OWNED_BY", "LINKED_TO", "TRANSFERRED_TO", "CALL_RECORDED", "MEETS", "DRIVES", "INVOLVES", "OCCURRED_AT",
)

_TEXT = T.StringType()
_LIST = T.ArrayType(T.StringType())
ENTITY = T.StructType(
    [T.StructField("id", _TEXT), T.StructField("entity_type", _TEXT)]
    + [T.StructField(c, _TEXT) for c in ("name", "title", "phone_number", "registration_number", "identifier", "account_type", "case_number", "description", "status", "priority", "incident_date", "event_type", "timestamp", "location_id", "owner_id", "source_id", "type", "gender", "address", "source")]
    + [T.StructField(c, _LIST) for c in ("aliases", "phone_ids", "vehicle_ids", "address_ids", "owner_ids", "source_ids")]
    + [T.StructField("age", T.IntegerType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("is_manual", T.BooleanType())]
)
RELATIONSHIP = T.StructType(
    [T.StructField(c, _TEXT) for c in ("id", "source_id", "relationship", "target_id", "source_type")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("evidence_ids", _LIST), T.StructField("properties", T.MapType(_TEXT, _TEXT))]
)
EVIDENCE = T.StructType(
    [T.StructField(c, _TEXT) for c in ("evidence_id", "source_document_id", "source_text", "timestamp", "extraction_method")]
    + [T.StructField("page_number", T.IntegerType()), T.StructField("confidence", T.DoubleType())]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema, cast, missing ones null and missing lists empty;
    columns that it doesn't know go to the map `extras`."""
    have = set(df.columns)

    def known_as(f: T.StructField):
        if f.name not in have:
            return F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)
        # A reader that infers types makes an object of unknown keys a struct.
        if isinstance(f.dataType, T.MapType) and isinstance(df.schema[f.name].dataType, T.StructType):
            return F.from_json(F.to_json(f.name), f.dataType)
        return F.col(f.name).cast(f.dataType)

    known = [known_as(f).alias(f.name) for f in schema.fields]
    extra = sorted(c for c in have - set(schema.names) if c != "extras")
    pairs = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
    extras = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*known, extras.alias("extras"))
