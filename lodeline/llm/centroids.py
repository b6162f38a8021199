"""Centroid clustering in integers, with block-norm screening.

Vectors become integer vectors, and each is kept with the norms of its segments, as
compressed vector.  By Cauchy and Schwarz, x.c is at most the sum over the segments of
|x_s| |c_s|, so |x|^2 + |c|^2 - 2 sum |x_s| |c_s| bounds the distance from below with a
fraction of the multiplications.  The centroid of the least bound gets its exact
distance first; the others only if their bound isn't above it.  Screening never changes
a result: exact distances are integers, bounds are widened by their rounding error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stage, table

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components of a segment, of which a norm is kept.
SEGMENT = 8
#: Integer components are held within this, so that a distance of 64 of them is a long.
LIMIT = 1 << 27
#: Vectors that are compared at a time.
ROWS = 4096


def _norms(x: np.ndarray, segment: int) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt(np.add.reduceat(x * x, np.arange(0, x.shape[1], segment), axis=1))


def _compressed(scale: int, segment: int):
    """vec_id, embedding -> vec_id, x (int32 components), norms (float64 of the segments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.clip(np.floor(np.clip(flat, -LIMIT, LIMIT) * scale), -LIMIT, LIMIT).astype("<i4")
            columns = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, _norms(x, segment).astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["vec_id", "x", "norms"])

    return run


def compressed(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, x, norms of those that are whole: size
    components, none null or non-finite."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == size)
    return rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).mapInArrow(_compressed(scale, segment), "vec_id long, x binary, norms binary")


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row (the smaller one of equals), the squared
    distance, and how many exact distances it took."""
    near, squares = _norms(centroids, segment), np.einsum("ij,ij->i", norms, norms)[:, None]
    bounds = squares + np.einsum("ij,ij->i", near, near) - 2 * (norms @ near.T)
    slack = 1e-12 * (squares + (near * near).sum(1)) + 1e-6
    rows, guess = np.arange(len(x)), np.argmin(bounds, 1)
    exact = lambda i, j: np.square(x[i] - centroids[j]).sum(1)
    best, where, count = exact(rows, guess), guess, len(x)
    for j in range(len(centroids)):
        # A double can be 2 ** 10 off at distances near 2 ** 62, within the slack.
        left = np.flatnonzero((bounds[:, j] - slack[:, j] <= best) & (guess != j))
        if len(left):
            found = exact(left, np.full(len(left), j))
            better = (found < best[left]) | ((found == best[left]) & (j < where[left]))
            best[left[better]], where[left[better]] = found[better], j
            count += len(left)
    return where, best, count


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, segment: int):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<i4").reshape(part.num_rows, -1).astype(np.int64)
            norms = np.frombuffer(b"".join(part.column("norms").to_pylist()), "<f8").reshape(part.num_rows, -1)
            yield part, x, *nearest(x, norms, centroids, segment)[:2]


def _summed(centroids: np.ndarray, segment: int):
    """Sums of the vectors of each cluster, from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * centroids.shape[1] for _ in centroids], [0] * len(centroids)
        for _, x, where, _ in _blocks(batches, centroids, segment):
            for j in np.unique(where):
                own = x[where == j]
                counts[j] += len(own)
                sums[j] = [a + b for a, b in zip(sums[j], own.sum(0).tolist(), strict=True)]
        held = [j for j, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([counts[j] for j in held], pa.int64()), pa.array([sums[j] for j in held], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, where, best in _blocks(batches, centroids, segment):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(where, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def start(kept: DataFrame, clusters: int = CLUSTERS, seed: str = "1") -> np.ndarray:
    """The vectors of the least hashes of seed and vec_id; of rows of one id the least bytes first."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    few = kept.select("x", place.alias("place")).orderBy(F.asc_nulls_last("place"), "x").limit(clusters).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in few], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The centroids after a round: floors of the means; an empty one stays.  What comes
    to the driver is one row of sums for each centroid."""
    wide = kept.mapInArrow(_summed(centroids, segment), "cluster int, n long, sums array<long>")
    totals = wide.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in totals.collect():
        out[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, segment: int = SEGMENT, seed: str = "1") -> DataFrame:
    """vectors(vec_id, embedding, ...) -> vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256.

    Each round reads the staged compressed vectors once and shuffles one row of sums
    per task and centroid; the tables of centroids and inertias have `clusters` rows.

    Edges: vectors of another size, null ones and those with null or non-finite
    components are left out; a null vec_id is kept and comes last among possible
    centroids; rows of one vec_id are rows of their own; with fewer vectors than
    clusters each vector starts one; equal centroids are all kept, and the first gets
    the vectors; integer components beyond 2 ** 27 either way are taken as that; an
    empty table gives an empty result; other columns are not read.
    """
    kept = stage(compressed(vectors, size, scale, segment), "compressed")
    centroids = start(kept, clusters, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids, segment)
    rows = stage(kept.mapInArrow(_assigned(centroids, segment), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    return rows.join(F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


_NEAR = "{a} AS MATERIALIZED (SELECT row, vec_id, v, arg_min(number, (d, number)) AS cluster, min(d) AS distance FROM (SELECT row, vec_id, v, number, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept CROSS JOIN {c}) GROUP BY row, vec_id, v)"
_MOVE = "{c} AS MATERIALIZED (SELECT number, coalesce(any_value(n.c), any_value(o.c)) AS c FROM {o} o LEFT JOIN (SELECT cluster, list(m ORDER BY place) AS c FROM (SELECT cluster, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM {a}) GROUP BY cluster, place) GROUP BY cluster) n ON n.cluster = o.number GROUP BY number)"
OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [CAST(floor(64 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS number, v AS c FROM kept ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) LIMIT 16),
{", ".join(x for i in range(3) for x in (_NEAR.format(a=f"a{i}", c=f"c{i}"), _MOVE.format(c=f"c{i + 1}", o=f"c{i}", a=f"a{i}")))},
{_NEAR.format(a="a3", c="c3")}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON cluster = number
"""
