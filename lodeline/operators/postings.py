"""Search for any part of a text, by a table of trigram postings.

Each text is listed under every run of three characters in it.  What contains a term
contains all its trigrams, so of the few rarest ones the lists are intersected, and what
is left is tried against the term itself.  Texts are listed by numbers, a batch of them as
one row of a trigram with the gaps between its texts, which takes few bytes.  The table is
bucketed by trigram and sorted, so a search reads the buckets of the chosen trigrams only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import bucketed, checkpointed
from .lookup import SEARCHED

GRAM = 3
BUCKETS = 64
#: Trigrams of a term whose lists are intersected.
RAREST = 3


@dataclass(frozen=True)
class Postings:
    """texts(n, id, text) with each text in small letters and its number; lists(gram,
    first, gaps), bucketed by gram: the first number of a batch, and how far each text
    that has it is from the one before, the first from there; counts(gram, n) of texts."""

    texts: DataFrame
    lists: DataFrame
    counts: DataFrame


def texts_of(df: DataFrame, key: str = "id", columns: tuple[str, ...] = SEARCHED, aliases: str | None = "aliases") -> DataFrame:
    """id, text: every searched text of every row; ids may have several."""
    found = F.array(*[F.col(c).cast("string") for c in columns])
    if aliases:
        found = F.concat(found, F.coalesce(aliases, F.array().cast("array<string>")))
    return df.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.transform(found, lambda t: F.lower(t)))).alias("text")).where("text is not null")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts by number the lists of each batch.  A trigram is three code points in one long."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        # Numbers of one task's texts rise by one; where another task's begin, so do other lists.
        cuts = [0, *(np.flatnonzero(n[1:] >> 33 != n[:-1] >> 33) + 1).tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:]):
            texts = batch.column("text").slice(a, b - a).to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            of = np.repeat(np.arange(b - a), sizes)
            inside = np.flatnonzero(of[GRAM - 1 :] == of[: len(of) - GRAM + 1]) if len(of) >= GRAM else np.zeros(0, np.int64)
            gram = points[inside] << 42 | points[inside + 1] << 21 | points[inside + 2] if len(inside) else inside
            order = np.lexsort((of[inside], gram))
            gram, at = gram[order], n[a:b][of[inside][order]] if len(inside) else gram[:0]
            fresh = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])])[: len(gram)])
            gram, at = gram[fresh], at[fresh]
            begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
            first = int(n[a:b].min()) if b > a else 0
            gaps = np.diff(at, prepend=first)
            gaps[begin] = at[begin] - first
            names = ["".join(chr(g >> k & 0x1FFFFF) for k in (42, 21, 0)) for g in gram[begin].tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(gram)), pa.int32()), pa.array(gaps, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(begin), first, np.int64)), lists], ["gram", "first", "gaps"])


def index(texts: DataFrame, buckets: int = BUCKETS) -> Postings:
    """texts(id, text) -> their postings, written once in the shared folder."""
    kept = checkpointed(texts.select(F.monotonically_increasing_id().alias("n"), "id", "text"))
    lists = kept.where(F.length("text") >= GRAM).select("n", "text").mapInArrow(_listed, "gram string, first long, gaps array<int>")
    stored = bucketed(lists, "gram", buckets)
    return Postings(kept, stored, checkpointed(stored.groupBy("gram").agg(F.sum(F.size("gaps")).alias("n"))))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of the texts of lists."""
    for batch in batches:
        gaps, sizes = batch.column("gaps").flatten().to_numpy().astype(np.int64), np.diff(np.asarray(batch.column("gaps").offsets))
        total = np.concatenate([[0], np.cumsum(gaps)])
        begin = np.cumsum(sizes) - sizes
        yield pa.RecordBatch.from_arrays([pa.array(total[1:] + np.repeat(batch.column("first").to_numpy() - total[begin], sizes))], ["n"])


def candidates(postings: Postings, term: str, rarest: int = RAREST) -> DataFrame | None:
    """n: texts that the lists of the rarest trigrams of the term have in common; None for
    a term that is too short to have any."""
    low = term.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return None
    known = {r["gram"]: r["n"] for r in postings.counts.where(F.col("gram").isin(grams)).collect()}
    if len(known) < len(grams):
        return postings.texts.select("n").limit(0)
    few = sorted(grams, key=lambda g: (known[g], g))[:rarest]
    held = postings.lists.where(F.col("gram").isin(few))
    numbers = held.mapInArrow(_numbers, "n long")
    return numbers.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(few)).select("n")


def search(postings: Postings, term: str) -> DataFrame:
    """id: what contains the term, in any case, in one of its texts; each id once.  An
    empty term is in every text; terms of one or two characters are looked for in all."""
    found = candidates(postings, term)
    texts = postings.texts if found is None else postings.texts.join(found, "n", "left_semi")
    return texts.where(F.col("text").contains(term.lower())).select("id").distinct()
