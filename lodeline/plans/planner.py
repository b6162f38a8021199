"""From a question to a typed plan to a DataFrame.  No model is asked; rules are
tried in order on whole words."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EvidenceGraph
from ..operators import access, network, neighbours, paths, resolve, timeline

log = logging.getLogger(__name__)
#: What an operator fails with when its data or the cluster do, not its code.
FAILURES = (PySparkException, Py4JError, paths.UnknownEntity)


@dataclass(frozen=True)
class Plan:
    intent: str
    case_ids: tuple[str, ...] = ()
    entity_ids: tuple[str, ...] = ()
    needs_evidence: bool = False
    confidence: float = 1.0


_RULES = [
    ("SAFETY_REFUSAL", r"\b(guilt|guilty|culprit|murderer|commit|committed|responsible for)\b"),
    ("COMMUNITY_DETECTION", r"\b(community|communities|clusters?)\b"),
    ("KEY_PLAYER_INTELLIGENCE", r"\b(key players?|influencers?|central)\b"),
    ("IDENTITY_RESOLUTION", r"\b(duplicates?|same person|alias(es)?|identity)\b"),
    ("TIMELINE", r"\b(timeline|when|chronolog\w*)\b"),
    ("CASE_SUMMARY", r"\b(summari[sz]e|summary|overview)\b"),
    ("SHARED_ENTITIES", r"\b(shared|multiple cases|co-?occur\w*)\b"),
    ("CROSS_CASE_CONNECTION", r"\b(connect\w*|link\w*|path)\b"),
    ("SUSPECT_DISCOVERY", r"\b(suspects?|persons|people|who is in)\b"),
    ("VEHICLE_INTELLIGENCE", r"\b(vehicles?|cars?|trucks?)\b"),
    ("ACCOUNT_INTELLIGENCE", r"\b(accounts?|bank|transactions?|upi)\b"),
    ("COMMUNICATIONS_INTELLIGENCE", r"\b(phones?|numbers?|msisdn|calls?)\b"),
    ("INVESTIGATIVE_LEADS", r"\b(leads?|next steps?)\b"),
    ("EVIDENCE_LOOKUP", r"\b(evidence|proof|documents?)\b"),
]


def plan(question: str, case_id: str | None = None, entity_id: str | None = None, allowed: tuple[str, ...] | None = None) -> Plan:
    """allowed: the cases that the asker may see; None stands for all."""
    q = question.lower()
    said = tuple(dict.fromkeys(f"CASE_{n}" for n in re.findall(r"\bcase[\s\-_]?(\d+)", q)))
    cases = said or ((case_id,) if case_id else ())
    entities = (entity_id,) if entity_id else tuple(dict.fromkeys(f"PERSON_{n.zfill(3)}" for n in re.findall(r"\bperson[\s\-_]?(\d+)", q)))
    intent = next((name for name, rule in _RULES if re.search(rule, q)), None)
    if intent == "SAFETY_REFUSAL":
        return Plan(intent, cases, entities)
    if allowed is not None and "ALL" not in allowed and any(c not in allowed for c in cases):
        return Plan("AUTHORIZATION_DENIAL", cases, entities)
    if intent == "CROSS_CASE_CONNECTION" and len(cases) < 2:
        intent = "ENTITY_CONNECTIONS" if entities else None
    if entities and re.search(r"\b(which|what) cases?\b", q):
        intent = "ENTITY_CASES"
    if intent is None:
        intent = "ENTITY_CONNECTIONS" if entities else "CASE_SUMMARY" if cases else "UNSUPPORTED"
    return Plan(intent, cases, entities, intent in ("EVIDENCE_LOOKUP", "ENTITY_CONNECTIONS", "CROSS_CASE_CONNECTION"), 0.0 if intent == "UNSUPPORTED" else 1.0)


def checked(graph: EvidenceGraph, p: Plan) -> Plan:
    """The plan, or NOT_FOUND if the graph lacks a case or an entity that it names."""
    named = set(p.case_ids) | set(p.entity_ids)
    if not named or p.intent in ("SAFETY_REFUSAL", "AUTHORIZATION_DENIAL"):
        return p
    known = {r["id"] for r in graph.entities.where(F.col("id").isin(*named)).select("id").distinct().collect()}
    missing = tuple(sorted(named - known))
    return Plan("NOT_FOUND", tuple(c for c in missing if c in p.case_ids), tuple(e for e in missing if e in p.entity_ids), confidence=0.0) if missing else p


def answer(graph: EvidenceGraph, question: str, policy: DataFrame, user: str, case_id: str | None = None, entity_id: str | None = None) -> tuple[Plan, DataFrame]:
    """Plans and runs a question over what the user may see, and no more: hidden cases
    are taken out before any operator runs.  The answer is worked out here and kept
    (unpersist it when done), so whatever Spark fails at, early or late, is logged and
    gives PROVIDER_FAILURE, no rows and a confidence of 0.  Other errors are raised."""
    own = [r["case_id"] for r in policy.where(F.col("username") == user).select("case_id").distinct().collect()]
    seen = access.visible(graph, policy, user)
    p = plan(question, case_id, entity_id, tuple(own))
    try:
        p = checked(seen, p)
        rows = run(seen, p).persist()
        rows.count()
        return p, rows
    except FAILURES as failure:  # the asker gets no detail
        log.warning("no answer to a question of intent %s: %s", p.intent, failure)
        return Plan("PROVIDER_FAILURE", p.case_ids, p.entity_ids, confidence=0.0), graph.entities.where(F.lit(False))


def run(graph: EvidenceGraph, p: Plan, max_depth: int = 4) -> DataFrame:
    """The plan's answer; what finds nothing is an empty result, never a made-up one."""
    case = p.case_ids[0] if p.case_ids else ""
    def nodes(kind: str) -> DataFrame:
        """Of an entity what is next to it, else within two hops; of a case its nodes."""
        if p.entity_ids:
            near = neighbours.ego(graph, p.entity_ids[0], 2).join(graph.entities.where(F.col("entity_type") == kind), "id")
            least = near.agg(F.min("hop").alias("least"))
            return near.join(F.broadcast(least), near["hop"] == least["least"]).drop("hop", "least")
        return neighbours.case_nodes(graph, case).where(F.col("entity_type") == kind)

    match p.intent:
        case "CASE_SUMMARY":
            return neighbours.case_nodes(graph, case).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
        case "SUSPECT_DISCOVERY":
            return nodes("PERSON")
        case "VEHICLE_INTELLIGENCE":
            return nodes("VEHICLE")
        case "ACCOUNT_INTELLIGENCE":
            return nodes("ACCOUNT")
        case "COMMUNICATIONS_INTELLIGENCE":
            return nodes("PHONE")
        case "TIMELINE":
            return timeline.case_timeline(graph, case)
        case "CROSS_CASE_CONNECTION":
            return paths.ranked(paths.between(graph, p.case_ids[0], p.case_ids[1], max_depth))
        case "ENTITY_CONNECTIONS":
            return neighbours.neighbors(graph, p.entity_ids[0])
        case "EVIDENCE_LOOKUP":
            return neighbours.entity_evidence(graph, p.entity_ids[0]) if p.entity_ids else graph.evidence.join(neighbours.case_evidence_ids(graph, case), "evidence_id", "left_semi")
        case "ENTITY_CASES":
            return neighbours.adjacent_cases(graph).where(F.col("id") == p.entity_ids[0])
        case "INVESTIGATIVE_LEADS":
            return network.review_priority(graph).where("level <> 'LOW'")
        case "IDENTITY_RESOLUTION":
            return resolve.candidates_additive(graph.entities.where("entity_type = 'PERSON'"))
        case "SHARED_ENTITIES":
            return network.shared_members(graph)
        case "COMMUNITY_DETECTION":
            return network.communities(graph)
        case "KEY_PLAYER_INTELLIGENCE":
            return network.key_players(graph)
    return graph.entities.where(F.lit(False))
