"""Document quality: histogram gradient-boosted trees over text statistics.

Statistics are computed for whole texts in numpy passes over their bytes.  The
trees are grown on histograms of binned statistics, on a bounded sample of the
labelled rows, and flattened into arrays (split statistic, threshold, children,
leaf value), over which a batch of documents steps down all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import held_out, in_order, table
from ._words import chunks, windows, word_hashes

#: Labelled documents that trees are fitted on: those that come first by a hash.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST_LEAF, PENALTY = 120, 4, 64, 0.1, 20, 1.0

#: Punctuation whose shares are statistics of their own.
_MARKS = b".,!?#%&$*|<>{}=/\\@:;()[]\"'-_+~^`"
FEATURES = (
    ["bytes", "words", "lines", "word_len", "word_len_sd", "longest_word", "line_words", "upper", "lower", "digit", "space", "high", "control", "punct", "upper_words", "marked_words", "distinct_words", "top_word", "repeat_next", "distinct_pairs", "distinct_fours", "distinct_lines", "short_words", "distinct_bytes"]
    + [f"mark_{m}" for m in _MARKS]
)
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 high, 6 control, 7 punctuation
_CLASS[:32], _CLASS[127], _CLASS[128:], _CLASS[33:127] = 6, 6, 5, 7
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; all but counts are shares, an empty
    text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in chunks(texts):
        words, first = word_hashes(texts[a:b])
        pairs, fours = windows(words, 2), windows(words, 4)
        for i in range(a, b):
            if texts[i]:
                _one(texts[i], words, pairs, fours, first[i - a], first[i - a + 1], out[i])
    return out


def _one(text: bytes, words: np.ndarray, pairs: np.ndarray, fours: np.ndarray, lo: int, hi: int, out: np.ndarray) -> None:
    raw = np.frombuffer(text, np.uint8)
    size, n = len(raw), hi - lo
    of_byte = np.bincount(raw, minlength=256)
    of_class = np.bincount(_CLASS, of_byte, minlength=8)
    kind = _CLASS[raw]
    gap = np.concatenate([[True], kind == 4, [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    lengths = ends - starts
    lines = text.split(b"\n")
    out[0], out[1], out[2] = np.log1p(size), np.log1p(n), np.log1p(len(lines))
    out[7:14] = of_class[1:8] / size
    out[21] = len(set(lines)) / len(lines)
    out[23] = np.count_nonzero(of_byte) / 256
    out[24:] = of_byte[list(_MARKS)] / size
    if n:
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        lower = np.concatenate([[0], np.cumsum(kind == 2)])
        lasts = raw[ends - 1]
        own = words[lo:hi]
        _, counts = np.unique(own, return_counts=True)
        out[3], out[4], out[5], out[6] = lengths.mean(), lengths.std(), lengths.max(), n / len(lines)
        out[14] = np.mean((upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts]))
        out[15] = np.mean((_CLASS[lasts] == 7) & (lasts != 46) & (lasts != 44))
        out[16], out[17], out[22] = len(counts) / n, counts.max() / n, np.mean(lengths <= 2)
        if n > 1:
            out[18] = np.mean(own[1:] == own[:-1])
            out[19] = len(np.unique(pairs[lo : hi - 1])) / (n - 1)
        if n > 3:
            out[20] = len(np.unique(fours[lo : hi - 3])) / (n - 3)


class Trees:
    """Boosted trees in flat arrays; leaves point to themselves."""

    def __init__(self, bias: float):
        self.bias, self.roots = bias, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def _node(self, value: float) -> int:
        at = len(self.feature)
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (0, np.inf, at, at, value)):
            column.append(x)
        return at

    def flat(self) -> "Trees":
        self.feature, self.left, self.right = (np.array(x, np.int32) for x in (self.feature, self.left, self.right))
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting; splits by gain on histograms of gradients."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model.flat()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    width = x.shape[1]
    slot = binned + np.arange(width) * BINS
    total = np.full(len(y), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        root = model._node(0.0)
        model.roots.append(root)
        todo = [(root, np.arange(len(y)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = None
            if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
                flat = slot[rows].ravel()
                hist = [np.bincount(flat, w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (np.repeat(grad[rows], width), np.repeat(hess[rows], width), None)]
                gl, hl, nl = hist
                ok = (nl >= LEAST_LEAF) & (len(rows) - nl >= LEAST_LEAF)
                gain = np.where(ok, gl**2 / (hl + PENALTY) + (g - gl) ** 2 / (h - hl + PENALTY) - g**2 / (h + PENALTY), -1.0)
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                best = (int(f), int(b)) if gain[f, b] > 1e-6 and b < len(edges[f]) else None
            if best is None:
                model.value[node] = -RATE * g / (h + PENALTY)
                total[rows] += model.value[node]
                continue
            f, b = best
            goes = binned[rows, f] <= b
            model.feature[node], model.threshold[node] = f, float(edges[f][b])
            model.left[node], model.right[node] = model._node(0.0), model._node(0.0)
            todo += [(model.left[node], rows[goes], depth + 1), (model.right[node], rows[~goes], depth + 1)]
    return model.flat()


def _rows(texts: pa.Array) -> np.ndarray:
    return statistics([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _rows(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["y", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the documents that have a label quality 0 or 1 and aren't held
    out.  At most about `rows` of them are used, those first by a hash of their id.

    Edges: labels other than 0 and 1, null labels and null ids are not used; of an
    id's labels the greater counts; every document of a labelled id is used; empty
    tables give a model without trees; other columns, of any names, are not read.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    place = F.shiftrightunsigned(in_order(["doc_id"], "quality"), 11).cast("double") / float(1 << 53)
    known = marked.count()
    marked = marked.where(place < min(1.0, rows / max(known, 1)))
    used = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "y")
    data = used.mapInArrow(_features, "y int, x array<double>").collect()
    order = sorted(data, key=lambda r: (r["x"], r["y"]))
    return fit(np.array([r["x"] for r in order]).reshape(len(order), len(FEATURES)), np.array([r["y"] for r in order], float))


def classify(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to docs.

    Edges: null and empty texts are scored alike, as texts with all statistics
    zero; a model fitted on no rows or on one label gives every document that label's share; repeated rows are kept; all columns of docs are passed on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.round(shared.value.score(_rows(batch.column("text"))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
