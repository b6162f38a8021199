"""Findings in one form, influence, priority, reports, and persons compared, on the small graph."""

import json

import pytest
from small_graph import graph

from lodeline.operators import envelope, network, report, resolve


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark)


def test_findings_are_in_one_form(g):
    found = envelope.all_patterns(g, hub_degree=3).collect()
    kinds = {r["pattern_type"] for r in found}
    assert {"HIGH_CONNECTIVITY_HUB", "UNUSUAL_PATH_PATTERN"} <= kinds <= set(envelope.LEADS)
    assert len({r["pattern_id"] for r in found}) == len(found)
    for r in found:
        assert 0 <= r["anomaly_score"] <= 1 and 0 <= r["confidence"] <= 1 and r["observed_data"] and r["computed_pattern"] and r["investigative_lead"] and "does not" in r["disclaimer"]
        assert r["severity"] == ("HIGH" if r["anomaly_score"] >= 0.8 else "MEDIUM" if r["anomaly_score"] >= 0.5 else "LOW")


def test_findings_are_narrowed(g):
    found = envelope.all_patterns(g, hub_degree=3)
    every = found.count()
    hubs = envelope.narrowed(found, g, pattern_type="high_connectivity_hub", case_id="ALL").collect()
    assert hubs and {r["pattern_type"] for r in hubs} == {"HIGH_CONNECTIVITY_HUB"}
    own = envelope.narrowed(found, g, case_id="CASE_101").count()
    assert 0 < own <= every and envelope.narrowed(found, g, case_id="CASE_NONE").count() == 0


def test_influence_filters(g):
    whole = network.influence(g).collect()
    assert [r["rank"] for r in whole] == list(range(1, len(whole) + 1)) and all(a["influence"] >= b["influence"] for a, b in zip(whole, whole[1:]))
    score = {r["id"]: r["influence"] for r in whole}
    for r in network.influence(g, entity_type="phone").collect():
        assert r["entity_type"] == "PHONE" and r["influence"] == score[r["id"]]
    assert all(r["n_cases"] >= 2 and r["role"] == "CROSS_CASE_INFLUENCER" for r in network.influence(g, cross_case=True).collect())
    assert network.influence(g, top=1).collect()[0]["rank"] == 1


def test_signals_add_up_to_the_priority(g):
    points = {}
    for r in network.priority_signals(g).collect():
        points[r["id"]] = points.get(r["id"], 0) + r["points"]
    assert points == {r["id"]: pytest.approx(r["priority"], abs=0.02) for r in network.review_priority(g).collect()}


def test_report_has_its_sections_and_is_written(g, spark, tmp_path):
    rows = report.detailed(g, "CASE_101")
    by = {}
    for r in rows.collect():
        by.setdefault(r["section"], []).append((r["key"], r["line"]))
    assert {"1_LINKS", "2_CROSS_CASE", "5_LIMITS"} <= set(by)
    assert any("PERSON_017->PHONE_042" in line for _, line in by["2_CROSS_CASE"])
    report.write(rows, str(tmp_path / "json"), "json")
    report.write(rows, str(tmp_path / "md"), "md")
    read = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted((r["section"], r["key"]) for r in read) == sorted((s, k) for s, x in by.items() for k, _ in x)
    assert spark.read.text(str(tmp_path / "md")).count() == len(read)
    with pytest.raises(ValueError):
        report.write(rows, str(tmp_path / "pdf"), "pdf")


def test_persons_compared_in_full(spark):
    schema = "id string, name string, age int, gender string, address string, location_id string, source string"
    people = spark.createDataFrame([("A", "Jon Smith", 40, None, "x", "L1", "Register"), ("B", "John Smyth", 41, "M", "x", "L1", "Manual")], schema)
    r = resolve.compare_in_full(people, "A", "B").first()
    assert (r["matching_fields"], r["conflicting_fields"], r["match_status"]) == ("address,location_id", "name,age", "CONFLICT")
    assert (r["name_score"], r["tier"], r["provenance"]) == (0.8421, "MEDIUM", "Manual,Register")
    assert r["explanation"] == "agree: address,location_id; conflict: name,age; not merged"


def test_plates_are_bounded_and_persons_keep_given_ids(spark):
    from lodeline.operators import text

    docs = spark.createDataFrame([(1, "Aarav Verma (PERSON_017) met Aarav Verma in MH-01-AB-1234, not XMH-02-AB-1234 nor MH-03-AB-12345."), (2, None)], "doc_id int, text string")
    rows = [(r["kind"], r["value"], r["entity_id"] == "PERSON_017") for r in text.document_entities(docs).collect()]
    assert sorted(rows) == [("PERSON", "Aarav Verma", False), ("PERSON", "Aarav Verma", True), ("VEHICLE", "MH-01-AB-1234", False)]
    assert text.document_relations(docs).count() == 1


def test_lookups_of_client_views(g):
    from lodeline.operators import lookup, neighbours

    assert lookup.case_detail(g, "CASE_101").count() == 1
    for wrong in ("PERSON_017", "CASE_999"):
        with pytest.raises(KeyError):
            lookup.case_detail(g, wrong)
    own = neighbours.relationship_list(g, "PERSON_017").collect()
    assert {r["direction"] for r in own} == {"IN", "OUT"} and all(r["neighbor_label"] for r in own)
    crossing = {r["id"] for r in lookup.shown_edges(g, cross_case=True).collect()}
    rest = {r["id"] for r in lookup.shown_edges(g, cross_case=False).collect()}
    assert not crossing & rest and len(crossing | rest) == 24
    assert all(r["page_number"] and r["extraction_method"] and r["confidence"] for r in lookup.evidence_shown(g).collect())


def test_answers_that_fail_late_are_failures_and_bugs_are_raised(g, spark, monkeypatch):
    from pyspark.sql import functions as F

    from lodeline.plans import planner

    policy = spark.createDataFrame([("bob", "ALL")], "username string, case_id string")
    monkeypatch.setattr(planner.neighbours, "case_nodes", lambda graph, case: graph.entities.withColumn("entity_type", F.raise_error(F.lit("broken")).cast("string")))
    p, rows = planner.answer(g, "Summarize case 101", policy, "bob")
    assert p.intent == "PROVIDER_FAILURE" and p.confidence == 0 and rows.count() == 0
    monkeypatch.setattr(planner.neighbours, "case_nodes", lambda graph, case: None.entities)
    with pytest.raises(AttributeError):
        planner.answer(g, "Summarize case 101", policy, "bob")
    p, rows = planner.answer(g, "Which entities are shared by multiple cases?", policy, "bob")
    assert p.intent == "SHARED_ENTITIES" and "PHONE_042" in {r["id"] for r in rows.collect()}
