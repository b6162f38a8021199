"""Audit trail, access to evidence, guarded changes, and the streams beside them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodeline.graph import EvidenceGraph
from lodeline.operators import access, mutate, timeline
from lodeline.schema import ENTITY, EVIDENCE, RELATIONSHIP, conform
from lodeline.streaming import audit, pairs

FIELDS = "timestamp string, actor string, action string, resource_type string, resource_id string, case_id string, status string, details map<string,string>"


def test_different_events_are_all_kept(spark):
    n = 400_000
    events = spark.range(n).select(F.lit("2024-01-01 00:00:00").alias("timestamp"), F.lit("ann").alias("actor"), F.lit("READ").alias("action"), F.lit("EVENT").alias("resource_type"), F.col("id").cast("string").alias("resource_id"), F.lit("ALL").alias("case_id"), F.lit("SUCCESS").alias("status"), F.lit(None).cast("map<string,string>").alias("details"))
    empty = spark.createDataFrame([], access.AUDIT)
    once = access.audit_append(empty, events)
    assert once.count() == n and once.select("id").distinct().count() < n
    assert access.audit_append(once, events.union(events.limit(10))).count() == n


def test_fields_that_only_look_alike_are_two_events(spark):
    rows = [("t", "a|b", "c", "r", "i", "k", "s", None), ("t", "a", "b|c", "r", "i", "k", "s", None), ("t", "a", "b|c", "r", "i", "k", "s", None)]
    assert access.audit_append(spark.createDataFrame([], access.AUDIT), spark.createDataFrame(rows, FIELDS)).count() == 2


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([("CASE_1", "CASE", ["S1"]), ("CASE_2", "CASE", ["S2"]), ("P1", "PERSON", []), ("P2", "PERSON", ["S3"])], "id string, entity_type string, source_ids array<string>")
    r = spark.createDataFrame([("R1", "P1", "INVOLVED_IN", "CASE_1", ["V1", "V2"]), ("R2", "P2", "INVOLVED_IN", "CASE_2", ["V3"]), ("R3", "P1", "KNOWS", "P2", ["V4", "V1"])], "id string, source_id string, relationship string, target_id string, evidence_ids array<string>")
    v = spark.createDataFrame([(x,) for x in ("V1", "V2", "V3", "V4", "S1", "S2", "S3", "none")], "evidence_id string")
    return EvidenceGraph(conform(e, ENTITY), conform(r, RELATIONSHIP), conform(v, EVIDENCE))


def test_evidence_of_hidden_cases_is_hidden(spark, small):
    policy = spark.createDataFrame([("ann", "CASE_1"), ("bob", "ALL")], "username string, case_id string")
    seen = lambda u: sorted(r["evidence_id"] for r in access.visible(small, policy, u).evidence.collect())
    assert seen("ann") == ["S1", "S3", "V1", "V2", "V4"] and len(seen("bob")) == 8 and seen("eve") == ["S3", "V1", "V4"]


def test_told_types_of_ends_hide_the_same(spark, small):
    """Only relationships that end in cases are joined with the allowed ones."""
    policy = spark.createDataFrame([("ann", "CASE_1")], "username string, case_id string")
    kinds = {"INVOLVED_IN": ("PERSON", "CASE"), "USES": ("PERSON", "PHONE")}
    ends = lambda: small.entities.select("id").limit(0)
    told = EvidenceGraph(small.entities, small.relationships, small.evidence, ends, kinds)
    a, b = (access.visible(g, policy, "ann") for g in (small, told))
    for part, key in (("entities", "id"), ("relationships", "id"), ("evidence", "evidence_id")):
        assert sorted(r[key] for r in getattr(a, part).collect()) == sorted(r[key] for r in getattr(b, part).collect())
    assert sorted(r["id"] for r in b.relationships.collect()) == ["R1", "R3"]


def test_readers_change_nothing(spark, small):
    ids = spark.createDataFrame([("P1",)], "id string")
    changes = [
        lambda role: mutate.upsert(small, evidence=spark.createDataFrame([("V9",)], "evidence_id string"), role=role),
        lambda role: mutate.create_entity(small, "PERSON", "X", role=role),
        lambda role: mutate.create_case(small, "T", "CASE_9", role=role),
        lambda role: mutate.update_entity(small, ids.withColumn("name", F.lit("N")), role=role),
        lambda role: mutate.delete_entity(small, ids, role=role),
        lambda role: mutate.create_relationship(small, "P1", "P2", "KNOWS", role=role),
        lambda role: mutate.create_and_link(small, "PERSON", "X", "CASE_1", role=role),
    ]
    for change in changes:
        with pytest.raises(access.WriteDenied):
            change("read_only")
        assert change("INVESTIGATOR") is not None


def test_evidence_is_upserted(spark, small):
    new = spark.createDataFrame([("V1", "changed"), ("V9", "new")], "evidence_id string, source_text string")
    got = {r["evidence_id"]: r["source_text"] for r in mutate.upsert(small, evidence=new).evidence.collect()}
    assert got["V1"] == "changed" and got["V9"] == "new" and len(got) == 9


def said(k, hour=0, who="ann"):
    return (f"2024-01-01 {hour:02}:00:00", who, "READ", "EVENT", str(k), "ALL", "SUCCESS", None)


def test_audit_sink_adds_nothing_twice(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: spark.readStream.schema(FIELDS).json(source)
    run = lambda: audit.sink(stream(), out, state).awaitTermination()
    table = lambda: sorted(r["resource_id"] for r in spark.read.parquet(out).collect())
    spark.createDataFrame([said(1), said(2), said(2)], FIELDS).coalesce(1).write.json(source)
    run()
    assert table() == ["1", "2"]
    spark.createDataFrame([said(2), said(3), ("?", *said(4)[1:])], FIELDS).coalesce(1).write.mode("append").json(source)
    run()
    assert table() == ["1", "2", "3"]
    # The last batch fails after its write and runs again.
    commits = sorted((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert table() == ["1", "2", "3"]
    audit.undated(stream(), out + "2", state + "2").awaitTermination()
    assert [r["timestamp"] for r in spark.read.parquet(out + "2").collect()] == ["?"]


def test_streams_pair_what_the_batch_pairs(spark, tmp_path):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"E{i:03}", rng.choice(["call", "visit"]), f"{rng.choice(['P_', 'PHONE_', 'LOC_'])}{rng.randrange(6)}", start + dt.timedelta(seconds=rng.randrange(20_000), milliseconds=rng.randrange(3) * 400)) for i in range(150)]
    rows += [(f"F{i}", k, "P_1", start + dt.timedelta(seconds=777)) for i, k in enumerate(["call", "visit", "call"])] + [("G", "call", "P_1", None)]
    rows.sort(key=lambda r: r[3] or start)
    source = str(tmp_path / "in")
    schema = "event_id string, event_type string, entity_id string, ts timestamp"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").json(source)
    stream = lambda: spark.readStream.schema(schema).json(source)
    def replayed(select, name):  # noqa: E306
        query = select(pairs.close_events(stream(), stream(), 600, "1 day")).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert pairs.late_rows(query) == 0
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())
    e = conform(spark.createDataFrame([(i, "EVENT", k, t and t.isoformat(" ")) for i, k, _, t in rows], "id string, entity_type string, event_type string, timestamp string"), ENTITY)
    r = conform(spark.createDataFrame([(f"R{i}", i, "INVOLVES", p) for i, _, p, _ in rows], "id string, source_id string, relationship string, target_id string"), RELATIONSHIP)
    g = EvidenceGraph(e, r, conform(spark.createDataFrame([], "evidence_id string"), EVIDENCE))
    assert replayed(pairs.conflicts, "conflicts") == sorted(tuple(x) for x in timeline.conflicts(g, 600).collect()) != []
    assert replayed(pairs.correlations, "correlations") == sorted(tuple(x) for x in timeline.correlations(g, 600).collect()) != []


def test_late_events_are_counted(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "event_id string, event_type string, entity_id string, ts timestamp"
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    spark.createDataFrame([("A", "call", "P", at(20)), ("B", "call", "P", at(21))], schema).coalesce(1).write.json(source)
    stream = lambda: spark.readStream.schema(schema).json(source)
    def run():  # noqa: E306
        query = pairs.conflicts(pairs.close_events(stream(), stream(), 7200, "1 hour")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return pairs.late_rows(query)
    assert run() == 0
    spark.createDataFrame([("C", "call", "P", at(1))], schema).coalesce(1).write.mode("append").json(source)
    assert run() == 2  # once for each side
    assert [(r["first_event"], r["second_event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A", "B")]
