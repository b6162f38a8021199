"""A graph on disk that is changed in place: a change rewrites the cells of the table
that it touches and no other file.

Entities lie in cells by type and by a hash of the id, relationships and evidence by a
hash of theirs.  A change reads the cells that it touches, works out what they become,
writes that beside the table, and moves the written cells to the place of the old ones;
a cell that becomes empty is removed.  One change at a time: two at once can lose one of
the two.  Every task writes its own files of the cells, so no row is dealt out; only what
is small is written again, one file for each cell.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import EvidenceGraph, checkpointed
from ..operators.access import may_write
from ..operators.mutate import ROLE, Refused
from ..schema import ENTITY, ENTITY_TYPES, EVIDENCE, RELATIONSHIP, conform

CELLS = 16
#: Bytes of what is written up to which it is dealt by cells.
SMALL = 1 << 20
KEYS = {"entities": "id", "relationships": "id", "evidence": "evidence_id"}
_SCHEMAS = {"entities": ENTITY, "relationships": RELATIONSHIP, "evidence": EVIDENCE}


def _by(part: str) -> list[str]:
    return ["entity_type", "cell"] if part == "entities" else ["cell"]


def _cell(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def _dealt(df: DataFrame, part: str) -> DataFrame:
    return df.withColumn("cell", _cell(KEYS[part]))


def _at(*names: str):
    return SparkSession.active()._jvm.org.apache.hadoop.fs.Path("/".join(names))


def _files(spark: SparkSession, path: str):
    return _at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(df: DataFrame, part: str, path: str) -> None:
    spark, by, loose = df.sparkSession, _by(part), f"{path}-{uuid.uuid4().hex}"
    files = _files(spark, path)
    save = lambda rows, to: rows.write.option("compression", "zstd").partitionBy(*by).parquet(to)
    save(df, loose)
    if files.getContentSummary(_at(loose)).getLength() <= SMALL:
        save(spark.read.schema(df.schema).parquet(loose).repartition(*by), path)
        files.delete(_at(loose), True)
    elif not files.rename(_at(loose), _at(path)):
        raise OSError(f"{loose} could not be moved to {path}")


def create(graph: EvidenceGraph, path: str) -> None:
    """Writes a graph as a new table; a path that is there is an error."""
    files = _files(graph.entities.sparkSession, path)
    for part in KEYS:
        if files.exists(_at(path, part)):
            raise FileExistsError(f"{path}/{part} is there")
        _write(_dealt(getattr(graph, part), part), part, f"{path}/{part}")


def read(spark: SparkSession, path: str) -> EvidenceGraph:
    return EvidenceGraph(*(_raw(spark, path, part).drop("cell") for part in KEYS))


def _raw(spark: SparkSession, path: str, part: str) -> DataFrame:
    schema = conform(spark.createDataFrame([], _SCHEMAS[part]), _SCHEMAS[part]).schema
    return spark.read.schema(schema.add("cell", T.IntegerType())).parquet(f"{path}/{part}")


def _rewrite(spark: SparkSession, path: str, part: str, new: DataFrame | None, gone: DataFrame) -> int:
    """Takes out the rows with the keys `gone`, puts `new` in, and returns how many cells that touched."""
    key, by = KEYS[part], _by(part)
    keys = gone.select(key).distinct()
    # The cell follows from the key, so only those cells are looked into for it.
    cells = [r["cell"] for r in keys.select(_cell(key).alias("cell")).distinct().collect()]
    raw = _raw(spark, path, part).where(F.col("cell").isin(cells))
    old = raw.join(keys, key, "left_semi").select(*by).distinct()
    dealt = None if new is None else checkpointed(_dealt(new, part))
    touched = [tuple(r) for r in (old if dealt is None else old.union(dealt.select(*by))).distinct().collect()]  # cells, at most CELLS for each type
    if not touched:
        return 0
    these = F.struct(*by).isin([F.struct(*[F.lit(v) for v in cell]) for cell in touched]) if len(by) > 1 else F.col("cell").isin([c for (c,) in touched])
    rest = raw.where(these).join(keys, key, "left_anti").select(raw.columns)
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    _write(rest if dealt is None else rest.unionByName(dealt.select(raw.columns)), part, staged)
    files = _files(spark, path)
    for cell in touched:
        folders = [f"{c}={v}" for c, v in zip(by, cell)]
        files.delete(_at(path, part, *folders), True)
        if files.exists(_at(staged, *folders)):
            files.mkdirs(_at(path, part, *folders[:-1]))
            if not files.rename(_at(staged, *folders), _at(path, part, *folders)):
                raise OSError(f"{'/'.join(folders)} of {part} could not be moved; it is in {staged}")
    files.delete(_at(staged), True)
    return len(touched)


def upsert(spark: SparkSession, path: str, entities: DataFrame | None = None, relationships: DataFrame | None = None, evidence: DataFrame | None = None, role: str = ROLE) -> int:
    """Puts records in, over those of equal id; returns how many cells were rewritten.
    Of rows of one id in the change itself the last by all their columns counts."""
    may_write(role)
    cells = 0
    for part, rows in (("entities", entities), ("relationships", relationships), ("evidence", evidence)):
        if rows is None:
            continue
        new = checkpointed(conform(rows, _SCHEMAS[part]))
        if part == "entities" and not new.where(F.col("entity_type").isNull() | ~F.col("entity_type").isin(*ENTITY_TYPES)).isEmpty():
            raise Refused("unknown entity type")
        key = KEYS[part]
        one = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.to_json(F.struct(*new.columns))).alias("r")).select("r.*")
        cells += _rewrite(spark, path, part, one, new)
    return cells


def delete(spark: SparkSession, path: str, ids: DataFrame, role: str = ROLE) -> int:
    """Takes entities (id) out, with every relationship that touches them."""
    may_write(role)
    r = _raw(spark, path, "relationships")
    touching = r.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id").union(r.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("id"))
    touching = checkpointed(touching.distinct())
    return _rewrite(spark, path, "relationships", None, touching) + _rewrite(spark, path, "entities", None, ids)
