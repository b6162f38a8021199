"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) -> node, root: the smallest node of its component, for every
    node that has an edge to another.

    Alternates two steps until the edges are stars: all larger neighbours of a
    node move to its smallest neighbour, then all smaller ones.  Each step is a
    grouped minimum and a join; the number of steps follows the logarithm of the
    number of nodes.  Edges live in staged tables, never in the driver.

    Edges of the input: null ends and loops join nothing; repeated edges count
    once; no edges give an empty result; other columns are not read.
    """
    now = stage(edges.select("a", "b").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)).alias("h")).first()
    return r["n"], r["h"] or 0
