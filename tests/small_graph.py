"""A small graph with known answers."""

from lodeline.graph import EvidenceGraph
from lodeline.schema import ENTITY, EVIDENCE, RELATIONSHIP, conform

# The edges (number, source, kind, target, confidence, evidence) that the known answers are about.
EDGES = """
001 PERSON_017 INVOLVED_IN CASE_101 0.97 EVID_101_01
002 PERSON_017 USES PHONE_042 0.95 EVID_042_01
003 PERSON_089 USES PHONE_042 0.93 EVID_042_02
004 PERSON_089 INVOLVED_IN CASE_204 0.96 EVID_204_01
005 PERSON_017 USES VEHICLE_017 0.94 EVID_101_02
006 VEHICLE_017 SEEN_AT LOC_001 0.99 EVID_101_03
007 PERSON_017 CONTACTED PERSON_005 0.95 EVID_101_04
008 PERSON_005 INVOLVED_IN CASE_101 0.92 EVID_101_05
009 PERSON_017 VISITED LOC_003 0.91 EVID_101_06
010 PERSON_017 OWNS PHONE_017 0.98 EVID_101_04
011 PERSON_089 OWNS VEHICLE_042 0.98 EVID_204_03
012 VEHICLE_042 SEEN_AT LOC_005 0.92 EVID_204_04
013 PERSON_089 WORKS_FOR ORG_002 0.97 EVID_204_05
014 PERSON_089 OWNS PHONE_089 0.97 EVID_204_01
015 PERSON_089 VISITED LOC_007 0.95 EVID_204_01
016 ACC_001 OWNED_BY PERSON_017 0.99 EVID_ACC_01
017 ACC_002 OWNED_BY PERSON_089 0.99 EVID_ACC_02
018 PERSON_044 INVOLVED_IN CASE_102 0.95 EVID_102_01
019 PERSON_044 ASSOCIATED_WITH PERSON_017 0.89 EVID_102_02
020 PERSON_056 INVOLVED_IN CASE_305 0.93 EVID_305_01
021 EVENT_001 INVOLVES PERSON_017 0.96 EVID_EV_01
022 EVENT_001 OCCURRED_AT LOC_001 0.98 EVID_EV_01
023 EVENT_002 OCCURRED_AT LOC_003 0.91 EVID_042_01
024 EVENT_003 OCCURRED_AT LOC_005 0.95 EVID_204_01
"""
IDS = {
    "PERSON": "005 017 044 056 089", "PHONE": "017 042 089 101 102", "VEHICLE": "017 042 101 102", "LOC": "001 002 003 004 005 006 007",
    "ORG": "001 002", "ACC": "001 002 003 004", "CASE": "101 102 204 305", "EVENT": "001 002 003",
}
TYPES = {"LOC": "LOCATION", "ORG": "ORGANIZATION", "ACC": "ACCOUNT"}


def graph(spark) -> EvidenceGraph:
    rows = [line.split() for line in EDGES.strip().splitlines()]
    edges = [(f"REL_{n}", s, r, t, float(c), [e]) for n, s, r, t, c, e in rows]
    nodes = [(f"{p}_{n}", TYPES.get(p, p), f"{p.title()} {n}", f"2024-01-0{n[-1]}T10:00:00" if p == "EVENT" else None, "LOC_005" if f"{p}_{n}" in ("CASE_204", "EVENT_003") else None) for p, ns in IDS.items() for n in ns.split()]
    evidence = [(e, f"DOC_{e[5:8]}", f"text of {e}", 0.95) for e in sorted({r[5] for r in rows})]
    return EvidenceGraph(
        conform(spark.createDataFrame(nodes, "id string, entity_type string, name string, timestamp string, location_id string"), ENTITY),
        conform(spark.createDataFrame(edges, "id string, source_id string, relationship string, target_id string, confidence double, evidence_ids array<string>"), RELATIONSHIP),
        conform(spark.createDataFrame(evidence, "evidence_id string, source_document_id string, source_text string, confidence double"), EVIDENCE),
    )
