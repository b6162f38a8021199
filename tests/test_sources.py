"""Data sources, graphs changed in place, and search by postings."""

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeline.graph import EvidenceGraph
from lodeline.operators import access, mutate, postings
from lodeline.schema import ENTITY, EVIDENCE, RELATIONSHIP, conform
from lodeline.sources import files, records, versions


def graph_file(k):
    return {
        "nodes" if k % 2 else "entities": [{"id": f"P{k}", "entity_type": "PERSON", "name": f"Name {k}", "age": k, "aliases": ["x", None, 3], "confidence": 1, "odd": {"a": k}}, {"id": f"C{k}", "entity_type": "CASE"}],
        "relationships": [{"id": f"R{k}", "source_id": f"P{k}", "relationship": "INVOLVED_IN", "target_id": f"C{k}", "confidence": "0.5", "evidence_ids": [f"E{k}"], "properties": {"n": 1}}],
        "evidence": {f"E{k}": {"source_text": "t", "page_number": "7"}} if k % 3 else [{"evidence_id": f"E{k}", "confidence": "bad"}],
    }


def test_graph_json_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PARTITION_BYTES", 1)
    files.register(spark)
    for k in range(6):
        (tmp_path / f"g{k}.json").write_text(json.dumps(graph_file(k)))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".g.crc").write_text("{")
    (tmp_path / "none.json").write_text("")
    read = lambda part: spark.read.format("evidence_graph").option("part", part).load(str(tmp_path))
    e = read("entities")
    assert len(files.grouped(files.listed(str(tmp_path)), 1)) == 7
    rows = {r["id"]: r for r in e.collect()}
    assert len(rows) == 12 and rows["P4"]["aliases"] == ["x", None, "3"] and rows["P4"]["age"] == 4 and rows["P4"]["confidence"] == 1.0 and rows["P4"]["extras"] == {"odd": '{"a": 4}'} and rows["C1"]["aliases"] == []
    assert {r["id"]: (r["confidence"], r["evidence_ids"], r["properties"]) for r in read("relationships").collect()}["R3"] == (0.5, ["E3"], {"n": "1"})
    assert {r["evidence_id"]: (r["page_number"], r["confidence"]) for r in read("evidence").collect()} == {f"E{k}": (7, None) if k % 3 else (None, None) for k in range(6)}
    # The same rows as the reader of one file gives.
    one = records.read_json(spark, str(tmp_path / "g1.json")).relationships.select("id", "source_id", "confidence").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in read("relationships").where("id = 'R1'").select("id", "source_id", "confidence").collect()]


def test_document_folder_source_and_stream(spark, tmp_path):
    files.register(spark)
    source, out, state = tmp_path / "docs", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.txt").write_text("one\ntwo")
    (source / "b.txt").write_bytes(b"\xff")
    assert sorted(tuple(r) for r in spark.read.format("document_folder").load(str(source)).collect()) == [("a.txt", "one\ntwo"), ("b.txt", "�")]
    run = lambda: spark.readStream.format("document_folder").load(str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    run()
    (source / "c.txt").write_text("three")
    run()
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == ["a.txt", "b.txt", "c.txt"]


@pytest.fixture
def stored(spark, tmp_path):
    kinds = ["PERSON", "CASE", "PHONE"]
    e = conform(spark.createDataFrame([(f"N{i:03}", kinds[i % 3], f"name {i}") for i in range(200)], "id string, entity_type string, name string"), ENTITY)
    r = conform(spark.createDataFrame([(f"R{i:03}", f"N{i:03}", "USES", f"N{(i * 7) % 200:03}") for i in range(200)], "id string, source_id string, relationship string, target_id string"), RELATIONSHIP)
    v = conform(spark.createDataFrame([(f"V{i}",) for i in range(50)], "evidence_id string"), EVIDENCE)
    g = EvidenceGraph(e, r, v)
    versions.create(g, str(tmp_path / "g"))
    return g, str(tmp_path / "g")


def names(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def rows(g, part):
    return sorted(repr(sorted(r.asDict().items())) for r in getattr(g, part).collect())


def test_changes_rewrite_only_what_they_touch(spark, stored):
    g, path = stored
    before = names(path)
    assert all(rows(versions.read(spark, path), p) == rows(g, p) for p in versions.KEYS)
    # One name, one entity of another type than before, and one new one.
    new = spark.createDataFrame([("N000", "PERSON", "changed"), ("N001", "PHONE", "was a case"), ("X", "CASE", "new")], "id string, entity_type string, name string")
    cells = versions.upsert(spark, path, entities=new, evidence=spark.createDataFrame([("V1", "t")], "evidence_id string, source_text string"))
    after = names(path)
    assert 0 < len(before - after) <= cells <= 6 and len(before & after) > len(before) - 7
    want = mutate.upsert(g, entities=new, evidence=spark.createDataFrame([("V1", "t")], "evidence_id string, source_text string"))
    assert all(rows(versions.read(spark, path), p) == rows(want, p) for p in versions.KEYS)
    ids = spark.createDataFrame([("N005",), ("X",), ("absent",)], "id string")
    versions.delete(spark, path, ids)
    want = mutate.delete_entity(want, ids)
    assert all(rows(versions.read(spark, path), p) == rows(want, p) for p in versions.KEYS)


def test_cells_that_become_empty_go(spark, stored):
    g, path = stored
    phones = g.entities.where("entity_type = 'PHONE'").select("id")
    versions.delete(spark, path, phones)
    assert not any("entity_type=PHONE" in n for n in names(path))
    assert versions.read(spark, path).entities.where("entity_type = 'PHONE'").count() == 0 and versions.read(spark, path).entities.count() == 134
    with pytest.raises(access.WriteDenied):
        versions.delete(spark, path, phones, role="analyst")
    with pytest.raises(mutate.Refused):
        versions.upsert(spark, path, entities=spark.createDataFrame([("Q", "ROBOT")], "id string, entity_type string"))


def test_search_by_postings_is_contains(spark):
    rng = random.Random(8)
    letters = "abAB .é%_\\"
    texts = [(i % 150, "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(500, None), (501, "")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("text", F.lower("text"))
    found = postings.index(df.where("text is not null"), 8)
    for term in ["ab", "a", "", "aba", "bab ", "b.a", "%_", "éab", "AB\\", "zzz", "abababab", *(t[2:8] for _, t in texts[:12] if t)]:
        got = sorted(r["id"] for r in postings.search(found, term).collect())
        assert got == sorted({i for i, t in texts if t is not None and term.lower() in t.lower()}), term


def test_search_reads_only_the_buckets_of_its_trigrams(spark):
    df = spark.range(500).select("id", F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    found = postings.index(df, 16)
    # Else the plan doesn't show the buckets where it gains nothing from their order.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = postings.candidates(found, "c4ca4238")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert re.search("SelectedBucketsCount: [123] out of 16", plan)
    assert [r["id"] for r in postings.search(found, "c4ca4238").collect()] == [1]


def test_postings_take_few_rows(spark):
    """A batch of texts is one row of a trigram, not a row for each text; numbers rise within a task only."""
    df = spark.range(0, 4_000, 1, 4).select("id", F.concat(F.lit("one text \U0001f600 "), F.col("id").cast("string")).alias("text"))
    found = postings.index(df, 4)
    assert found.lists.where("gram = 'one'").count() <= 8
    counts = {r["gram"]: r["n"] for r in found.counts.collect()}
    assert counts["one"] == counts[" \U0001f600 "] == 4_000 and counts["399"] == sum("399" in str(i) for i in range(4_000))
    assert sorted(r["id"] for r in postings.search(found, "\U0001f600 399").collect()) == [i for i in range(4_000) if str(i).startswith("399")]
