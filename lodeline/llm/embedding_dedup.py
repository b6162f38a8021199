"""Embedding near-duplicates with an inverted multi-index.

Vectors are cut in halves, each half with a codebook of its own; the pairs of
codewords form a grid of cells, far finer than one codebook of that cost.  Every
vector lies in one cell and asks the cells nearest to it, in the order in which
multi-sequence traversal meets them, as many as the target recall takes.  What
shares a visited cell is verified by its cosine in double precision.

Equal vectors count as one with a weight.  A cell's members and askers are dealt
in blocks, so a cell of any size is many tasks; a block gives sums and a forest
of links, not pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_order, small, stage, table
from ._graph import components

COSINE = 0.95
#: Vectors that codebooks are fitted on, the first by a hash, and their bytes at
#: most; of them, those on which visits are calibrated.
SAMPLE, SAMPLE_BYTES, CALIBRATED = 20_000, 64 << 20, 4000
#: Vectors that a cell holds on average, and bounds of codewords per half.
PER_CELL, CODES = 32, (2, 1024)
#: Part of partners at just the threshold whose cell must be visited.
RECALL = 0.99
#: Rows of a cell's members, or askers, in a block.
BLOCK = 1024


def _apart(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _apart(x, codes).argmin(1)
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


class MultiIndex:
    """Two codebooks and the cells that have vectors."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.cut = k, sample.shape[1] // 2
        self.codes = [codebook(h, k, rng) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        self.full: set[int] | None = None
        self.visits = 1

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _apart(x[:, : self.cut], self.codes[0]), _apart(x[:, self.cut :], self.codes[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.apart(x)
        return a.argmin(1).astype(np.int64) * self.k + b.argmin(1)

    def traverse(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Non-empty cells by rising sum of the halves' distances: the two sorted
        lists of codewords are walked with a heap, each cell after the one before
        it in either list."""
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db = a[oa].tolist(), b[ob].tolist()
        oa, ob = oa.tolist(), ob.tolist()
        heap, row = [(da[0] + db[0], 0, 0)], [-1] * self.k
        while heap:
            _, i, j = heapq.heappop(heap)
            row[i] = j
            cell = oa[i] * self.k + ob[j]
            if self.full is None or cell in self.full:
                yield cell
            if i + 1 < self.k and row[i + 1] == j - 1:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
            if j + 1 < self.k and (i == 0 or row[i - 1] > j):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))

    def nearest(self, x: np.ndarray) -> list[list[int]]:
        out = []
        for a, b in zip(*self.apart(x)):
            found = []
            for cell in self.traverse(a, b):
                found.append(cell)
                if len(found) >= self.visits:
                    break
            out.append(found)
        return out

    def calibrate(self, sample: np.ndarray, cosine: float, recall: float, seed: int = 11) -> None:
        """Sets visits so that a partner at just the threshold, in a random
        direction, has its cell among those visited with the target recall."""
        rng = np.random.default_rng(seed)
        side = rng.standard_normal(sample.shape)
        side -= (side * sample).sum(1)[:, None] * sample
        side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
        asked = cosine * sample + np.sqrt(max(0.0, 1 - cosine * cosine)) * side
        ranks = []
        for want, a, b in zip(self.cells(sample), *self.apart(asked)):
            ranks.append(next((r for r, cell in enumerate(self.traverse(a, b), 1) if cell == want), self.k * self.k))
        self.visits = int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def _unit(column: pa.Array, n: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _celled(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(index.value.cells(_unit(batch.column("v"), batch.num_rows)))], ["node", "cell"])

    return run


def _asking(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column("v"), batch.num_rows)
                out = {"own": pa.array(index.value.cells(x)), "visits": pa.array(index.value.nearest(x), pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([*batch.columns, *out.values()], [*batch.schema.names, *out])

    return run


def _block(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums of links and a forest for one block of a cell.  An asker is
        credited with what it finds; a member is too, unless it finds the asker
        itself when it asks the asker's cell."""
        m, q = rows[rows["member"]], rows[~rows["member"]]
        if not len(m) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x, y = (np.stack(part["v"].to_numpy()).astype(np.float64) for part in (q, m))
        x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
        a, b = q["node"].to_numpy(), m["node"].to_numpy()
        linked = (x @ y.T >= cosine) & (a[:, None] != b[None, :])
        i, j = np.nonzero(linked)
        if not len(i):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        found = np.bincount(i, m["weight"].to_numpy()[j], len(a)).astype(np.int64)
        # Members that visit the asker's cell find the asker there themselves.
        visits = m["visits"].to_list()
        cells, place = np.unique(np.concatenate([q["own"].to_numpy(), *visits]), return_inverse=True)
        asked = np.repeat(np.arange(len(b)), [len(v) for v in visits]) * len(cells) + place[len(a) :]
        once = ~np.isin(j * len(cells) + place[i], asked)
        back = np.bincount(j[once], q["weight"].to_numpy()[i[once]], len(b)).astype(np.int64)
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        s, t = forest(len(names), place[i], place[len(a) + j])
        rows = [(a[found > 0], a[found > 0], found[found > 0]), (b[back > 0], b[back > 0], back[back > 0]), (names[s], names[t], np.zeros(len(s), np.int64))]
        return pd.DataFrame(dict(zip("abn", (np.concatenate(x) for x in zip(*rows)))))

    return run


def forest(n: int, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links among n nodes, enough to join what all of them join."""
    root, kept = np.arange(n), [np.zeros(0, np.int64)]
    at = np.flatnonzero(s != t)
    while len(at):
        low, high = np.minimum(root[s[at]], root[t[at]]), np.maximum(root[s[at]], root[t[at]])
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], np.diff(high[order]) != 0])]
        root[high[first]] = low[first]
        kept.append(at[first])
        while (root[root] != root).any():
            root = root[root]
        at = at[root[s[at]] != root[t[at]]]
    kept = np.concatenate(kept)
    return s[kept], t[kept]


def _sample(nodes: DataFrame, count: int, rows: int, salt: str) -> np.ndarray:
    """About so many vectors of length one, those first by a hash."""
    place = F.shiftrightunsigned(in_order(["node"], salt), 11).cast("double") / float(1 << 53)
    few = nodes.where(place < min(1.0, rows / max(count, 1))).select("v").limit(2 * rows).toArrow().column("v").combine_chunks()
    if not len(few):
        few = nodes.orderBy("node").limit(1).select("v").toArrow().column("v").combine_chunks()
    return _unit(few, len(few))


def fit(nodes: DataFrame, count: int) -> MultiIndex | None:
    if not count:
        return None
    size = nodes.select(F.size("v")).first()[0]
    sample = _sample(nodes, count, max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size))), "codebook")
    k = int(np.clip(np.sqrt(count / PER_CELL), *CODES))
    return MultiIndex(sample, min(k, len(sample)), 7)


def link(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> vec_id, n_links, component_id, kept.

    Edges: null, empty and zero vectors and those with null or non-finite
    components link with nothing and are groups of their own; vectors of
    different lengths don't link; rows with equal vectors link with each other;
    a null vec_id is not kept and names no group; an empty table gives an empty
    result; other columns are not read.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    clean = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    most = F.array_max(F.transform("v", F.abs))
    # Squares of very large and very small components would not be numbers any more.
    near = F.when((most < 1e150) & (most > 1e-150), F.col("v")).otherwise(F.transform("v", lambda x: x / most))
    marked = rows.withColumn("v", F.when(F.coalesce(clean, F.lit(False)), near)).withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    marked = stage(marked.withColumn("size", F.size("v")), "vectors")
    classes = stage(marked.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"), F.first("size").alias("size")), "classes")
    lengths = [r["size"] for r in classes.groupBy("size").count().orderBy("size").collect()]
    found = None
    for size in lengths:
        part = classes.where(F.col("size") == size).drop("size")
        one = _links(part, cosine, recall)
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stage(found, "links")
    sums = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n = 0").select("a", "b"))
    labelled = marked.select("vec_id", "node").join(classes.select("node", "weight"), "node", "left").join(sums, "node", "left").join(roots, "node", "left")
    labelled = labelled.withColumn("group", F.coalesce("root", "node"))
    least = labelled.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("component_id"))
    out = labelled.join(least, "group", "left").withColumn("component_id", F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    n = F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    return out.select("vec_id", n.cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(classes: DataFrame, cosine: float, recall: float) -> DataFrame:
    """classes(node, weight, v) -> a, b, n: n links of a where a = b, else a link."""
    spark = classes.sparkSession
    count = classes.count()
    index = fit(classes, count)
    shared = spark.sparkContext.broadcast(index)
    cells = classes.select("node", "v").mapInArrow(_celled(shared), "node long, cell long")
    sizes = stage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members")), "cells")
    # At most CODES squared cells.
    index.full = {r["cell"] for r in sizes.select("cell").collect()}
    if index:
        size = index.cut + index.codes[1].shape[1]
        index.calibrate(_sample(classes, count, max(1, min(CALIBRATED, SAMPLE_BYTES // (8 * size))), "visits"), cosine, recall)
    shared = spark.sparkContext.broadcast(index)
    asking = stage(classes.mapInArrow(_asking(shared), "node long, weight long, v array<double>, own long, visits array<long>"), "asking")
    visits = asking.select("node", F.explode("visits").alias("cell"))
    loads = small(stage(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("askers")).join(sizes, "cell"), "loads"), CODES[1] ** 2)
    member_blocks, asker_blocks = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil(F.col("askers") / BLOCK).cast("int")
    deal = lambda blocks: F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int")
    members = asking.withColumn("cell", F.col("own")).join(loads, "cell").select("cell", deal(member_blocks).alias("i"), F.explode(F.sequence(F.lit(0), asker_blocks - 1)).alias("j"), F.lit(True).alias("member"), "node", "weight", "v", "own", "visits")
    askers = asking.select("*", F.explode("visits").alias("cell")).join(loads, "cell").select("cell", F.explode(F.sequence(F.lit(0), member_blocks - 1)).alias("i"), deal(asker_blocks).alias("j"), F.lit(False).alias("member"), "node", "weight", "v", "own", F.lit(None).cast("array<long>").alias("visits"))
    return members.union(askers).groupBy("cell", "i", "j").applyInPandas(_block(cosine), "a long, b long, n long")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


OP4_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
clean AS MATERIALIZED (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id, least(v.vec_id, coalesce(m.b, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN least m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
