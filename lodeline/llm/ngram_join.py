"""Jaccard join of word n-gram sets by universe partition and pigeonhole.

Sets are dealt into bands by size.  For the sizes that may meet in a band, a
similarity of p/q bounds the symmetric difference of a pair by some D.  The
universe of shingles is hashed into segments, x compared exactly and y up to one
deletion, with x + 2y = D + 1 + z.  If a pair differs nowhere else than allowed,
at least z + 1 of the exact segments agree, or a one-deletion segment differs by
one element at most.  So every set may leave out its z worst exact segments
(those of fewest elements, ties by hash): the best segment on which two sets
agree is among neither's z worst, because both see it and all worse agreeing ones
in one order.  y and z come from a cost model, the same for all sets of a band.

Sets that share a key are candidates.  Each key gets the member that shares most
keys as its centre; all candidates of a centre make its family, which holds
every pair that shares one of these keys.  Members are compared with the centre
first.  Only those that are not linked to it are then compared with the rest of
the family, in blocks, by a matrix product over the shingles that occur twice.
All comparisons are of whole sets; nothing is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small, stage, table
from ._graph import components
from ._words import mix, shingle_sets

#: Sizes in a band go up to this times the least.
BAND_RATIO = 1.2
#: Cost model: candidates that a set is expected to share content with, the part
#: they share, and the cost of verifying one in units of a signature.
EXPECTED, SHARED, VERIFY = 32, 0.5, 20.0
#: Members of a family that are compared as one block, and members to a salt of a centre.
BLOCK, SALT = 256, 2048
#: Rows of a key in a batch that are dealt by the key alone, and keys in a batch.
FREQUENT, ROWS = 8, 1 << 20


@lru_cache(maxsize=None)
def _starts() -> list[int]:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND_RATIO)))
    return starts


def band(size: int) -> int:
    return int(np.searchsorted(_starts(), size, side="right")) - 1


def allowed(a: int, b: int, p: int, q: int) -> int:
    """The largest symmetric difference of sets of these sizes with similarity p/q or more."""
    return (q - p) * (a + b) // (q + p)


@lru_cache(maxsize=None)
def allocation(b: int, p: int, q: int) -> tuple[int, int, int]:
    """(x, y, z) of a band: exact segments, one-deletion segments, segments to leave out."""
    top = _starts()[b + 1] - 1
    need = allowed(top, top * q // p, p, q) + 1
    best = None
    for y in range(0, need // 2 + 1):
        for z in sorted({0, (need - 2 * y) // 4, (need - 2 * y) // 2}):
            x = need - 2 * y + z
            k = top / max(1, x + 2 * y)  # a one-deletion segment is twice as large
            lost = 2 * k * (1 - SHARED)
            agree = math.exp(-lost) * (x - z) / max(1, 1 + z) + y * math.exp(-2 * lost) * (1 + 2 * lost)
            empty = math.exp(-k) if not z else 0.0
            cost = x - z + y * (2 * k + 1) + VERIFY * EXPECTED * (agree + empty * x) / need
            if best is None or cost < best[0]:
                best = (cost, x, y, z)
    return best[1:]


def signatures(s: np.ndarray, p: int, q: int) -> np.ndarray:
    """Keys of a sorted shingle set, for its own band and for the lower ones in
    which a similar set may lie.  Sets as similar as p/q have a key in common."""
    out = []
    mixed = mix(s)
    for b in range(band(-(-len(s) * p // q)), band(len(s)) + 1):
        x, y, z = allocation(b, p, q)
        at = ((s >> np.uint64(32)) * np.uint64(x + 2 * y)) >> np.uint64(32)
        at = np.where(at < x, at, x + (at - np.uint64(x)) // np.uint64(2)).astype(np.int64)  # one-deletion ones are twice as wide
        order = np.argsort(at, kind="stable")
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mixed[order], out=total[1:])
        count = np.bincount(at, minlength=x + y)
        end = np.cumsum(count)
        sums = total[end] - total[end - count]
        name = mix(np.arange(x + y, dtype=np.uint64) + np.uint64((b + 1) << 32))
        keys = mix(sums + name)
        out.append(keys[:x][np.lexsort((keys[:x], count[:x]))[z:]])
        if y:
            out.append(keys[x:])
            in_y = at >= x
            out.append(mix(sums[at[in_y]] - mixed[in_y] + name[at[in_y]]))
    return np.unique(np.concatenate(out))


def node(s: np.ndarray) -> int:
    """A set's name; equal sets have equal names."""
    value = mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)), (s ^ (s << np.uint64(13))).sum(dtype=np.uint64)], np.uint64))
    return int((value[0] ^ (value[1] >> np.uint64(7))).astype(np.int64))


def _sets(column: pa.Array, n: int):
    return shingle_sets([t or b"" for t in column.cast(pa.large_binary()).to_pylist()], n)


def _named(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for s in _sets(batch.column("text"), n):
                sizes.append(len(s))
                nodes.append(node(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "n_shingles", "node"])

    return run


def _signed(n: int, p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, seen, rows = [], [], set(), 0
            for s in _sets(batch.column("text"), n):
                if len(s) and (name := node(s)) not in seen:
                    seen.add(name)
                    keys.append(signatures(s, p, q))
                    nodes.append(np.full(len(keys[-1]), name, np.int64))
                    rows += len(keys[-1])
                    if rows > ROWS:
                        yield _key_rows(np.concatenate(keys).view(np.int64), np.concatenate(nodes))
                        keys, nodes, rows = [], [], 0
            if keys:
                yield _key_rows(np.concatenate(keys).view(np.int64), np.concatenate(nodes))

    return run


def _key_rows(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows with a salt: 0 for those that a key is dealt by; of a key that is
    frequent in the batch, which therefore is shared, the rows beyond the first few
    have a salt of their node's."""
    order = np.argsort(key, kind="stable")
    line = key[order]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
    salt = np.where(rank < FREQUENT, 0, 1 + node % 4093).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(salt)], ["key", "node", "salt"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by salt, key and node, distinct ones whose key has another
    node; all of those with a salt have."""
    last: list = []  # rows of the key that the previous batch ended with: the first, and whether it was given out

    for batch in batches:
        k, v, salt = (batch.column(c).to_numpy() for c in ("key", "node", "salt"))
        if (salt > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(k[salt > 0]), pa.array(v[salt > 0])], ["key", "node"])
        k, v = k[salt == 0], v[salt == 0]
        if not len(k):
            continue
        if last:
            k, v = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], v])
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
        given = bool(last) and last[2]
        k, v = k[fresh], v[fresh]
        same = np.concatenate([[False], k[1:] == k[:-1], [False]])
        keep = same[:-1] | same[1:]
        lone_end = not keep[-1] and not (len(k) == 1 and given)
        if given:
            keep[0] = False
        out = keep.copy()
        last = [k[-1], v[-1], not lone_end]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(v[out])], ["key", "node"])


def _arrays(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, data = [], []
            for s in _sets(batch.column("text"), n):
                if len(s):
                    nodes.append(node(s))
                    data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], ["node", "data"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    if min(len(a), len(b)) * q < p * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return q * n >= p * (len(both) - n)


def _with_centre(p: int, q: int):
    """Rows sorted by centre and salt, the centre's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            cs, ns, ok = [], [], []
            for c, v, d in zip(batch.column("centre").to_pylist(), batch.column("node").to_pylist(), batch.column("data")):
                s = np.frombuffer(d.as_py(), np.uint64)
                if c == v:
                    centre, own = c, s
                elif c == centre:
                    cs.append(c)
                    ns.append(v)
                    ok.append(_linked(own, s, p, q))
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ns, pa.int64()), pa.array(ok, pa.bool_())], ["centre", "node", "linked"])

    return run


def _block(p: int, q: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links within a block pair, as a forest: what one link joins, others needn't."""
        rows = rows.drop_duplicates("node")
        nodes = rows["node"].to_numpy()
        loose = ~rows["tied"].to_numpy(bool)
        sets = [np.frombuffer(d, np.uint64) for d in rows["data"]]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        twice = count[place] > 1
        owner, place = owner[twice], column[place[twice]]
        common = np.zeros((len(sets), len(sets)), np.float64)
        width = 1 << 13
        for at in range(0, int(np.count_nonzero(count > 1)), width):
            part = (place >= at) & (place < at + width)
            there = np.zeros((len(sets), width), np.float32)
            there[owner[part], place[part] - at] = 1
            common += there @ there.T
        linked = q * common >= p * (size[:, None] + size[None, :] - common)
        linked &= loose[:, None] | loose[None, :]
        root = np.arange(len(sets))
        out = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1))):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def join(docs: DataFrame, words: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id: groups linked
    by shingle sets of similarity p/q or more.

    Edges: a null or blank text has the empty set and is a group of its own; a
    text of fewer words is one shingle; equal texts link; a null id never names
    a group (a group without other ids is named null); repeated rows are kept;
    an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = stage(rows.mapInArrow(_named(words), f"doc_id {kind}, n_shingles long, node long"), "named")
    signed = rows.mapInArrow(_signed(words, p, q), "key long, node long, salt int")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = signed.repartition(parts, "key", "salt").sortWithinPartitions("salt", "key", "node")
    shared = stage(keyed.mapInArrow(_shared, "key long, node long"), "shared")
    score = shared.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    scored = shared.join(score, "node")
    centres = scored.groupBy("key").agg(F.max(F.struct("keys", "node"))["node"].alias("centre"))
    family = stage(shared.join(centres, "key").where("node <> centre").select("centre", "node").distinct(), "family")
    edges = verified(rows, named, family, words, p, q)
    labelled = named.join(components(edges), "node", "left").withColumn("group", F.coalesce("root", "node"))
    least = small(stage(labelled.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id")), "least"))
    grouped = labelled.where("group is not null").join(least, "group").select("doc_id", "n_shingles", "component_id")
    alone = labelled.where("group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.union(alone)


def verified(rows: DataFrame, named: DataFrame, family: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """family(centre, node) -> edges(a, b) that join all linked pairs of a family."""
    members = family.select("node").union(family.select(F.col("centre").alias("node"))).distinct()
    wanted = stage(named.where("node is not null").join(members, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id")), "wanted")
    texts = rows.join(small(wanted.select("id").distinct()), rows["doc_id"].eqNullSafe(F.col("id")), "left_semi")
    arrays = texts.mapInArrow(_arrays(words), "node long, data binary").join(small(wanted.select("node")), "node", "left_semi")
    arrays = stage(arrays.groupBy("node").agg(F.first("data").alias("data")), "arrays")
    sizes = family.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
    salts = sizes.withColumn("salts", F.least(F.ceil(F.col("n") / SALT), F.lit(1 << 16)).cast("int"))
    dealt = family.join(salts, "centre").select("centre", "node", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    heads = salts.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = dealt.union(heads).join(arrays, "node").select("centre", "salt", "node", "data")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = pairs.repartition(parts, "centre", "salt").sortWithinPartitions("centre", "salt", F.col("node") != F.col("centre"))
    star = stage(lined.mapInArrow(_with_centre(p, q), "centre long, node long, linked boolean"), "star")
    near = star.where("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    # The rest of a family: members not linked to its centre, against all others.
    loose = star.groupBy("centre").agg(F.sum(F.when(F.col("linked"), 0).otherwise(1)).alias("free"), F.count(F.lit(1)).alias("n")).where("free > 0 and n > 1")
    rest = star.join(loose, "centre").withColumn("tied", F.col("linked"))
    of = F.when(F.col("tied"), F.col("n") - F.col("free")).otherwise(F.col("free"))
    rest = rest.withColumn("blocks", F.ceil(of / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    free_blocks = F.ceil(F.col("free") / BLOCK).cast("int")
    tied_blocks = F.ceil((F.col("n") - F.col("free")) / BLOCK).cast("int")
    # Block pairs are (free i, free j >= i) and (free i, tied j); tied ones are numbered after all free ones.
    with_free = F.transform(F.sequence(F.lit(0), free_blocks - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    with_tied = F.when(tied_blocks > 0, F.transform(F.sequence(F.lit(0), F.greatest(tied_blocks - 1, F.lit(0))), lambda j: F.struct(F.col("own").alias("i"), (j + free_blocks).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    to_free = F.transform(F.sequence(F.lit(0), free_blocks - 1), lambda i: F.struct(i.alias("i"), (F.col("own") + free_blocks).alias("j")))
    placed = rest.select("centre", "node", "tied", F.explode(F.when(F.col("tied"), to_free).otherwise(F.concat(with_free, with_tied))).alias("pair"))
    blocks = placed.select("centre", "node", "tied", "pair.i", "pair.j").join(arrays, "node")
    far = blocks.groupBy("centre", "i", "j").applyInPandas(_block(p, q), "a long, b long")
    return near.union(far)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), words=4, p=85, q=100)


OP2_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.n
"""
