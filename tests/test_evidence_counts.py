"""Counts of influence that are worked out without dealing out all evidence."""

from dataclasses import replace

from pyspark.sql import functions as F

from lodeline.operators import neighbours, network

from small_graph import graph


def test_evidence_of_one_and_of_several_relationships(spark):
    g = graph(spark)
    ids = F.when(F.col("id").isin("REL_001", "REL_002"), F.array(F.lit("A"), F.lit("A"), F.lit("B"))).when(F.col("id") == "REL_003", F.lit(None)).otherwise(F.array(F.col("id")))
    for r in (g.relationships, g.relationships.withColumn("evidence_ids", ids), g.relationships.withColumn("evidence_ids", F.array("id", F.concat("id", F.lit("x"))))):
        one = replace(g, relationships=r)
        want = one.edges().select("src", F.explode("evidence_ids").alias("v")).distinct().groupBy("src").count()
        got = {x["id"]: x["n_evidence"] for x in network.evidence_counts(one).collect() if x["n_evidence"]}
        assert got == {x["src"]: x["count"] for x in want.collect()}


def test_told_kinds_change_no_case(spark):
    g = graph(spark)
    told = replace(g, kinds={"USES": ("PERSON", "PHONE"), "INVOLVED_IN": ("PERSON", "CASE"), "OWNS": ("PERSON", "PHONE")})
    rows = lambda x: sorted(map(tuple, neighbours.adjacent_cases(x).collect()))
    assert rows(told) == rows(g) and len(rows(g)) == 5
    assert told.only("USES").kinds == told.kinds
