"""Benchmark decontamination with a positional inverted index, in SQL functions.

Postings are (term, document, position).  Only those are stored that a search
begins with: for every window of a benchmark item its rarest terms by corpus
counts.  Shifted by their offsets in the item, the lists of a window's two rarest
terms are intersected; where both hit one alignment, the whole window is compared
with the document's words there.  That gives exact phrases; a proximity match
asks for the two rarest terms near their places and some share of the others
around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, small, stage, table

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str = "text") -> Column:
    """Words of a text in order, A-Z lower-cased; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _text_key(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))


def item_windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """items(item_id, text) -> window, phrase (its words): distinct windows, and
    the items that have each as item_ids; a shorter item is one window."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    runs = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, length))).alias("phrase"))
    return runs.withColumn("window", F.concat_ws(" ", "phrase")).select("item_id", "window", "phrase").distinct()


def _terms(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.posexplode(words()).alias("pos", "term"))


def matches(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int | None = None, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Where windows of the items occur in docs(doc_id, text).

    Returns (found, items of windows).  found has doc_id, text_key, window, pos
    (first word, from 0), n (words): one row per window and place, for each
    distinct (doc_id, text).  With slop, it has proximity matches instead: the
    two rarest terms at most slop words off their distance, and at least `share`
    of the window's distinct terms within the window's length plus slop.
    """
    owned = stage(item_windows(items, length), "windows")
    windows = owned.groupBy("window").agg(F.first("phrase").alias("phrase"))
    vocabulary = windows.select(F.explode("phrase").alias("term")).distinct()
    few = small(stage(vocabulary, "vocabulary"))
    counts = stage(_terms(docs).join(few, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "counts")
    # The two rarest places of every window; a window of one word has one.
    places = windows.select("window", F.posexplode("phrase").alias("offset", "term")).join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.col("df") == 0, "df", "offset"))
    ranked = places.withColumn("rank", rank)
    # A window with a term that the corpus lacks cannot occur.
    possible = ranked.groupBy("window").agg(F.min("df").alias("least"), F.count(F.lit(1)).alias("n")).where(F.lit(slop is not None) | (F.col("least") > 0))
    anchors = stage(ranked.where("rank <= 2").join(possible, "window").select("window", "term", "offset", "rank", "n"), "anchors")
    terms = small(stage(anchors.select("term").distinct(), "terms"))
    keyed = docs.select("doc_id", "text").withColumn("text_key", _text_key())
    postings = stage(_terms(keyed, "doc_id", "text_key").join(terms, "term").distinct(), "postings")
    first, second = anchors.where("rank = 1"), anchors.where("rank = 2")
    near = [postings.join(x, "term").select("doc_id", "text_key", "window", "n", (F.col("pos") - F.col("offset")).alias("at")).distinct() for x in (first, second)]
    a, b = near[0].alias("a"), near[1].alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.window") == F.col("b.window"))
    if slop is None:
        both = a.join(b, same & (F.col("a.at") == F.col("b.at")), "left_semi").where("n > 1").union(near[0].where("n = 1"))
    else:
        # Alignments off by at most slop lie in one or the next cell of slop + 1 words.
        cell = lambda x, by: F.floor(F.col(x) / (slop + 1)).cast("long") + by
        spread = near[1].select("*", F.explode(F.array(*[cell("at", k) for k in (-1, 0, 1)])).alias("cell")).alias("b")
        close = near[0].withColumn("cell", cell("at", 0)).alias("a").join(spread, same & (F.col("a.cell") == F.col("b.cell")) & (F.abs(F.col("a.at") - F.col("b.at")) <= slop), "left_semi")
        both = close.where("n > 1").drop("cell").union(near[0].where("n = 1"))
    candidates = stage(both.where("at >= 0") if slop is None else both, "candidates")
    return _verified(keyed, candidates, windows, slop, share), owned.select("item_id", "window")


def _verified(keyed: DataFrame, candidates: DataFrame, windows: DataFrame, slop: int | None, share: float) -> DataFrame:
    """Compares candidates with the words of their documents; those texts alone are read again."""
    ids = candidates.select(F.col("doc_id").alias("id"), F.col("text_key").alias("of")).distinct()
    ids = small(stage(ids, "hit_ids"))
    texts = keyed.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("of")), "left_semi")
    held = texts.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("id"), F.col("text_key").alias("of"), words().alias("w"))
    there = candidates.join(windows, "window")
    joined = there.join(held, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("of")))
    if slop is None:
        holds = F.slice("w", F.col("at") + 1, F.col("n").cast("int")) == F.col("phrase")
    else:
        begin = F.greatest(F.col("at") - slop, F.lit(0))
        around = F.slice("w", begin + 1, (F.col("n") + 2 * slop).cast("int"))
        holds = F.size(F.array_intersect(F.array_distinct("phrase"), around)) >= F.ceil(F.lit(share) * F.size(F.array_distinct("phrase")))
    return joined.where(holds).select("doc_id", "text_key", "window", F.col("at").alias("pos"), "n")


def report(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...), items(item_id, text) -> one row per document with
    n_words, n_hit (words inside any occurrence of a window), n_items,
    items_sha256 (of the sorted, comma-joined item ids) and contaminated.

    Edges: null and empty texts have no words and no hits; empty items have no
    windows; a null item_id is no item; with an empty items table nothing is hit;
    repeated documents are kept as rows and equal ones have equal values; other
    columns are not read.
    """
    found, owners = matches(docs, items.where("item_id is not null"), length)
    found = stage(found, "found")
    key = ["doc_id", "text_key"]
    covered = found.select(*key, F.explode(F.sequence(F.col("pos"), (F.col("pos") + F.col("n") - 1).cast("int"))).alias("at")).distinct()
    hit = covered.groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    held = found.select(*key, "window").distinct().join(owners, "window").select(*key, "item_id").distinct()
    held = held.groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    h, g = hit.alias("h"), held.alias("g")
    marks = h.join(g, F.col("h.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("h.text_key") == F.col("g.text_key"))).select(F.col("h.doc_id").alias("id"), F.col("h.text_key").alias("of"), "n_hit", "item_ids")
    marks = small(stage(marks, "marks"), BROADCAST_ROWS // 10)
    base = docs.select("doc_id", _text_key().alias("text_key"), F.size(words()).cast("long").alias("n_words"))
    out = base.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("of")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs; all their columns.

    Edges: documents with null or empty texts stay; so do all where there are no
    items or none with words; rows with equal ids and texts stay or go together;
    columns may have any names; an empty table gives an empty result.
    """
    found, _ = matches(docs, items.where("item_id is not null"), length)
    hits = found.select("doc_id", "text_key").distinct()
    hits = small(stage(hits, "hits"))
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]) & (_text_key(docs["text"]) == hits["text_key"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH dw AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS MATERIALIZED (SELECT DISTINCT item_id, len(s) AS n, array_to_string(s, ' ') AS s FROM (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: w[i:i + 9])) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
runs AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, lens WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT r.doc_id, r.i, r.n, x.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM runs) r JOIN wins x ON x.s = r.s AND x.n = r.n),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN spots s ON s.doc_id = d.doc_id LEFT JOIN owned o ON o.doc_id = d.doc_id
"""
