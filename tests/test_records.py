import json

import pytest
from small_graph import graph

from lodeline.operators import ingest, resolve, text
from lodeline.plans import planner
from lodeline.sources import records
from lodeline.streaming import intake


def test_json_source_and_sinks(spark, tmp_path):
    raw = {"nodes": [{"id": "PERSON_1", "name": "Ann", "type": "person"}], "edges": [{"source": "PERSON_1", "target": "CASE_1", "relationship": "INVOLVED_IN", "confidence": 0.9}], "evidence": {"E1": {"evidence_id": "E1", "source_document_id": "D", "source_text": "t", "confidence": 0.9}}}
    (tmp_path / "g.json").write_text(json.dumps(raw))
    done = ingest.ingest(spark, [records.JsonSource(spark, "file", str(tmp_path / "g.json"))])
    assert done.graph.entities.select("id", "name", "entity_type").collect() == [("PERSON_1", "Ann", "PERSON")]
    assert done.graph.relationships.select("id", "source_type").collect() == [("PERSON_1_INVOLVED_IN_CASE_1", "SYNTHETIC_DATASET")]
    assert done.graph.evidence.count() == 1
    g = graph(spark)
    records.write_parquet(g, str(tmp_path / "p"))
    assert records.read_parquet(spark, str(tmp_path / "p")).entities.count() == 34
    records.write_json(g, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/relationships")).count() == 24
    assert records.cypher(g).where("part = 1").count() == 24


def test_ingest_conflict_failure_and_rejects(spark):
    people = lambda rows: spark.createDataFrame(rows, "id string, type string, name string, confidence double")

    class Broken(records.DataSource):
        def fetch_records(self):
            raise OSError("no such feed")

    a = records.ManualSource("a", {"entities": people([("P1", "person", "Ann", 0.9), ("P2", "cargo", None, None)])})
    b = records.ManualSource("b", {"entities": people([("P1", "person", "Anne", 0.9), ("P3", "person", "Bo", 1.5)])})
    done = ingest.ingest(spark, [a, Broken("x"), b])
    assert {r["id"]: r["name"] for r in done.graph.entities.where("entity_type = 'PERSON'").collect()} == {"P1": "Ann"}
    assert done.graph.entities.where("id = 'P2'").first()["registration_number"] == "P2"
    assert [(r["existing"], r["conflicting"]) for r in done.conflicts.collect()] == [("Ann", "Anne")]
    assert [r["id"] for r in done.rejects.collect()] == ["P3"]
    assert done.provenance.where("status = 'FAILED'").count() == 1


def test_resolution(spark):
    rows = [("A", "Ravi Kumar", ["RK"], ["PH1"], []), ("B", "Rohit Kumar", [], ["PH1"], []), ("C", "Zed", [], [], ["V1"]), ("D", "Quinn", ["zed"], [], ["V1"])]
    p = spark.createDataFrame(rows, "id string, name string, aliases array<string>, phone_ids array<string>, vehicle_ids array<string>")
    assert {(r["a"], r["b"]): r["score"] for r in resolve.candidates_additive(p).collect()} == {("A", "B"): 0.75}
    similar = {(r["a"], r["b"]): r["score"] for r in resolve.candidates_similar(p).collect()}
    assert similar == {("A", "B"): 0.92, ("C", "D"): 0.94}


def test_extraction(spark):
    docs = spark.createDataFrame([("d", "Suspect Ravi Kumar uses 9876543210 and MH 12 AB 1234"), ("e", None), ("f", "")], "doc_id string, text string")
    assert {(r["kind"], r["value"]) for r in text.document_entities(docs).collect()} == {("PHONE", "9876543210"), ("VEHICLE", "MH 12 AB 1234"), ("PERSON", "Suspect Ravi Kumar")}
    assert {r["resource"] for r in text.uses_relations(docs).where("person = 'Ravi Kumar'").collect()} == {"9876543210", "MH 12 AB 1234"}


@pytest.mark.parametrize(
    "question,intent",
    [
        ("Who is guilty?", "SAFETY_REFUSAL"), ("Is the committee in case 101?", "CASE_SUMMARY"), ("How are case 101 and case 204 connected?", "CROSS_CASE_CONNECTION"), ("Summarize case 102", "CASE_SUMMARY"),
        ("vehicles in case 101", "VEHICLE_INTELLIGENCE"), ("the cargo of case 101", "CASE_SUMMARY"), ("weather tomorrow", "UNSUPPORTED"), ("shared entities", "SHARED_ENTITIES"), ("what about person 17", "ENTITY_CONNECTIONS"),
    ],
)
def test_planner(question, intent):
    assert planner.plan(question).intent == intent


def test_planner_runs(spark):
    g = graph(spark)
    both = planner.plan("connections of Case 204 and Case 102")
    assert both.case_ids == ("CASE_204", "CASE_102")
    assert planner.run(g, both, 5).count() == 1
    assert planner.plan("summarize case 204", allowed=("CASE_101",)).intent == "AUTHORIZATION_DENIAL"
    assert planner.run(g, planner.plan("weather")).count() == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id": "d", "text": "call 9876543210"}\n')
    q = intake.write(intake.mentions(intake.document_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["9876543210"]
