"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (one to `GRAM`
letters, words padded with blanks), most frequent first.  A document is given
the language from whose profile its own is least out of place: the sum over its
n-grams of how far apart the two ranks are, with a full profile length for an
n-gram that the language lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import held_out, in_order, small, stage, table

GRAM = 3
#: Ranks in a profile.
PROFILE = 300
#: Distinct texts per language that profiles are learned from, the first in a
#: hashed order.
LEARN_DOCS = 2000
_RUN = 1 << 18
_folded: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it isn't a letter."""
    if not _folded:
        fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _folded.append(fold)
    return _folded[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers (21 bits a letter, the first
    highest, blanks 0 at word ends, the top bit for pairs) and their counts; the whole text is counted,
    in runs, so memory does not follow its length but its variety."""
    fold = _letters()
    found, counts, carry = [], [], np.zeros(0, np.uint64)
    for at in range(0, len(text), _RUN):
        code = fold[np.frombuffer(text[at : at + _RUN].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        last = at + _RUN >= len(text)
        code = np.concatenate([carry if at else np.zeros(1, np.uint64), code, np.zeros(1 if last else 0, np.uint64)])
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]  # one blank between words
        own = []
        for n in range(1, GRAM + 1):
            m = len(code) - n + 1 if last else len(code) - GRAM + 1
            if m <= 0:
                continue
            value = code[:m].copy()
            inner = np.ones(m, bool)
            for k in range(1, n):
                value = (value << np.uint64(21)) | code[k : k + m]
                if k < n - 1:
                    inner &= code[k : k + m] != 0
            value = value[inner & (value != 0)]
            own.append(value << np.uint64(42) if n == 1 else value | np.uint64(1 << 63) if n == 2 else value)
        carry = code[max(0, len(code) - GRAM + 1) :] if not last else carry
        if own:
            u, c = np.unique(np.concatenate(own), return_counts=True)
            found.append(u)
            counts.append(c)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0], counts[0]
    u, inverse = np.unique(np.concatenate(found), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def ranked(gram: np.ndarray, count: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, in order; ties by the n-gram's value."""
    if len(count) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        keep = count >= least
        gram, count = gram[keep], count[keep]
    return gram[np.lexsort((gram, -count))][:size]


class RankProfiles:
    """Profiles of all languages by n-gram: for each the languages that have it and
    its ranks there, so memory follows the profiles' lengths, whatever their number."""

    def __init__(self, langs: list[str], profiles: list[np.ndarray], size: int = PROFILE):
        self.langs, self.size = langs, size
        whole = np.concatenate(profiles) if profiles else np.zeros(0, np.uint64)
        order = np.argsort(whole, kind="stable")
        self.lang = np.repeat(np.arange(len(profiles)), [len(p) for p in profiles])[order]
        self.rank = np.concatenate([np.arange(len(p)) for p in profiles])[order] if profiles else np.zeros(0, np.int64)
        self.gram, self.first = np.unique(whole[order], return_index=True)
        self.count = np.diff(np.concatenate([self.first, [len(whole)]]))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.gram, profile), len(self.gram) - 1)
        known = np.flatnonzero(self.gram[at] == profile)
        n = self.count[at[known]]
        post = np.repeat(self.first[at[known]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = self.size - np.abs(self.rank[post] - np.repeat(known, n))
        return self.size * len(profile) - np.bincount(self.lang[post], near, len(self.langs)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much nearer it is than a profile with nothing in common."""
        profile = ranked(*grams(text or ""), self.size)
        if not len(profile) or not self.langs:
            return "und", 0.0
        far = self.distances(profile)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(profile)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            own = total.setdefault(lang, {})
            for g, c in zip(*(x.astype(np.int64).tolist() for x in grams(text or ""))):
                own[g] = own.get(g, 0) + c
        for lang in [k for k, v in total.items() if len(v) > 200_000]:
            yield _counted({lang: total.pop(lang)})
    yield _counted(total)


def _counted(total: dict[str, dict[int, int]]) -> pa.RecordBatch:
    lang = [k for k, v in total.items() for _ in v]
    gram = [g for v in total.values() for g in v]
    count = [c for v in total.values() for c in v.values()]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.int64()), pa.array(count, pa.int64())], ["lang", "gram", "n"])


def learn(docs: DataFrame, learn_docs: int = LEARN_DOCS, size: int = PROFILE) -> RankProfiles:
    """Profiles from docs(text, lang) of every language.  At most learn_docs distinct
    texts of each are used, each once, those that come first by a hash of the text;
    what reaches the driver is `size` n-grams for each language."""
    used = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    place = (F.shiftrightunsigned(in_order(["text"], "profile"), 11).cast("double")) / float(1 << 53)
    used = used.withColumn("place", place)
    texts = used.select("lang", "place").distinct()
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.min("place").alias("least"))
    # A threshold on the hash that some more than learn_docs texts of the language
    # pass, one at least; of them the first are taken.
    most = learn_docs + 6 * learn_docs**0.5
    limits = small(stage(sizes.select("lang", F.greatest("least", F.lit(most) / F.col("texts")).alias("limit")), "limits"))
    passed = used.join(limits, "lang").where(F.col("place") <= F.col("limit")).dropDuplicates(["lang", "text"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    sample = passed.withColumn("first", first).where(F.col("first") <= learn_docs).select("text", "lang")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    by: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").select("lang", "gram").collect():
        by.setdefault(r["lang"], []).append(r["gram"])
    return RankProfiles(list(by), [np.array(v, np.int64).astype(np.uint64) for v in by.values()], size)


def identify(docs: DataFrame, model: RankProfiles) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score.

    Edges: a text that is null or has no letter gives `und` and score 0, so does
    a model of no language; equal distances go to the language that comes first by code point;
    repeated rows are kept; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            said = [own.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    said = identify(docs, model)
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
