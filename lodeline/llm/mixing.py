"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents, and each document has an entry in
it for every time that it may be repeated.  An entry's virtual finish time is the
words its source has served with it, divided by the source's target.  All entries
are put in the order of these times and summed up, and the mix ends where the sum
reaches the total budget.  Targets add up to the budget, so that is at virtual time
one.  The one entry of a source that is begun before and finished after that is
split into entries of one word each, so a source comes within a word of its target,
however long its documents are.

Running sums are not made in one task: rows fall into buckets of the shuffled
order, and entries into slots of virtual time; the few totals of buckets and slots
are summed up first, and each is then scanned by itself.  Their number follows the
number of rows.  A source with a third of all rows is spread over as many tasks as
any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stage, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
REPEATS = 2
#: Rows in a bucket of a source's shuffled order, or a slot of the queue, on
#: average at most, and the least number of these.
BUCKET_ROWS, BUCKETS = 200_000, 256
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column | str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, repeats: int = REPEATS) -> DataFrame:
    """source, source_size -> target.  The budget is shared by weight; what a
    source cannot fill with its repeats is shared again among the others.  The
    level at which this ends is found from running sums over the sources by
    capacity per unit of weight.  One row per source comes in, so the windows
    here see as many rows as there are sources."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("fill", "place")
    seen = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * repeats
    return (
        sizes.withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", weight)
        .withColumn("fill", cap / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * (percent / 100.0))
        .withColumn("capped", F.sum(cap).over(seen) - cap)
        .withColumn("open", F.sum("weight").over(whole) - F.sum("weight").over(seen) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(whole))
        .withColumn("target", F.when(cap <= F.col("weight") * F.col("level"), cap.cast("double")).otherwise(F.coalesce(F.col("weight") * F.col("level"), cap.cast("double"))))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, turn.

    One row per document, in the order of its first turn (the virtual finish
    time).  `taken` counts the words the mix takes of it, repeats counted.

    Edges: a null text has size 0 and is taken 0 times; null sources are one
    source, sorted last; rows with equal ids and texts are kept as rows of their
    own; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.md5(text)))
    base = docs.select("doc_id", "source", words().alias("size"), place.alias("place"))
    # Rows alike in all of these are told apart by nothing: they are one row with a count.
    keyed = stage(base.groupBy("doc_id", "source", "size", "place").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    buckets = max(BUCKETS, -(-keyed.count() * repeats // BUCKET_ROWS))
    keyed = keyed.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    keyed = keyed.withColumn("all", F.col("size") * F.col("copies"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("all").alias("bucket_size"))
    goals = stage(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, percent, repeats), "targets")
    budget = goals.agg(F.sum(F.floor("target"))).first()[0] or 0
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    sources = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "bucket", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    served = keyed.withColumn("before", F.coalesce(F.sum("all").over(inside), F.lit(0)))
    joined = served.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    rows = joined.select("d.doc_id", "d.place", "d.size", "d.copies", "s.source_size", "s.target", (F.col("offset") + F.col("before")).alias("start"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rows = rows.withColumn("start", F.col("start") + (F.col("copy") - 1) * F.col("size"))
    taken = truncated(stage(entries(rows, repeats), "queue"), budget, buckets)
    out = taken.groupBy(*_ROW).agg(F.sum("taken").alias("taken"), F.min("finish").alias("turn")).drop("place", "copy")
    return out.select("doc_id", "size", "source_size", "target", "taken", "turn").repartitionByRange(F.col("turn"), F.col("doc_id")).sortWithinPartitions("turn", "doc_id")


_ROW = ["doc_id", "place", "copy", "size", "source_size", "target"]


def entries(rows: DataFrame, repeats: int) -> DataFrame:
    """The queue: an entry for each row and repeat with its words and virtual finish
    time; the one that time one falls into is an entry for each of its words."""
    begins = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.col("start") + r * F.col("source_size"))
    whole = lambda b: F.array(F.struct(b.alias("begin"), F.col("size").alias("words")))
    single = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda k: F.struct((b + k).alias("begin"), F.lit(1).cast("long").alias("words")))
    split = lambda b: (b < F.col("target")) & (b + F.col("size") > F.col("target")) & (F.col("size") > 1)
    every = rows.withColumn("e", F.explode(F.flatten(F.transform(begins, lambda b: F.when(split(b), single(b)).otherwise(whole(b))))))
    finish = F.coalesce(F.try_divide(F.col("e.begin") + F.col("e.words"), F.col("target")), F.lit(0.0))
    return every.select(*_ROW, F.col("e.begin").alias("begin"), F.col("e.words").alias("words"), finish.alias("finish"))


def truncated(queue: DataFrame, budget: int, slots: int) -> DataFrame:
    """Entries in the order of their finish times, cut where their words reach the
    total budget; one row per slot is in the window that sums up slots."""
    placed = queue.withColumn("slot", F.floor(F.col("finish") / (F.col("finish") + 1) * slots).cast("int"))
    totals = placed.groupBy("slot").agg(F.sum("words").alias("total"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("slot", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    line = Window.partitionBy("slot").orderBy("finish", "place", "copy", "begin").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.col("offset") - F.coalesce(F.sum("words").over(line), F.lit(0))
    return placed.join(offsets, "slot").select(*_ROW, F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), left)).alias("taken"), "finish")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS place FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, 2 * source_size AS cap, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sizes),
filled AS (SELECT *, cap / weight AS fill, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM weighed),
opened AS (SELECT *, sum(cap) OVER w - cap AS capped, sum(weight) OVER () - sum(weight) OVER w + weight AS open FROM filled WINDOW w AS (ORDER BY fill, n ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, (budget - capped) / open AS level FROM opened),
goals AS (SELECT source, source_size, cap, weight, max(CASE WHEN level <= fill THEN level END) OVER () AS level FROM levels),
aims AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap::DOUBLE ELSE coalesce(weight * level, cap::DOUBLE) END AS target FROM goals),
starts AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken,
  coalesce((start + CASE WHEN size > 1 AND start < target AND start + size > target THEN 1 ELSE size END) / nullif(target, 0), 0) AS turn
FROM starts s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
"""
