"""Graphs on disk that are too large to be dealt by cells."""

import pytest

from lodeline.operators import mutate
from lodeline.sources import versions

from small_graph import graph


def test_large_parts_are_moved_not_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SMALL", 0)
    g, path = graph(spark), str(tmp_path / "g")
    versions.create(g, path)
    ids = spark.createDataFrame([("PERSON_017",), ("ORG_001",)], "id string")
    cells = versions.delete(spark, path, ids)
    want, now = mutate.delete_entity(g, ids), versions.read(spark, path)
    for part, key in versions.KEYS.items():
        rows = [sorted(repr(sorted(r.asDict().items())) for r in getattr(x, part).collect()) for x in (now, want)]
        assert rows[0] == rows[1], part
    assert cells > 1 and sorted(p.name for p in (tmp_path / "g").iterdir() if not p.name.startswith(".")) == sorted(versions.KEYS)
    with pytest.raises(FileExistsError):
        versions.create(g, path)
