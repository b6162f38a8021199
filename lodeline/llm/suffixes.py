"""Substrings of a given length that recur across documents, by blockwise suffix order.

Positions whose place in their document is, modulo a period, in a difference cover are
the sample.  Any two positions come to sample positions by one and the same shift below
the period, so two equal substrings of `length` bytes contain two sample suffixes that
agree for at least length - period + 1 bytes.

1. Sample suffixes, to that depth, are dealt into buckets by leading bits of their keys
   and each bucket is sorted by itself; this gives each sample suffix its rank among
   those of all documents, of which only one bit matters: whether others tie with it.
2. A suffix that no tied sample supports within the period ties with none in another
   document.  The others are dealt into buckets by themselves, and each bucket is sorted
   to the full length; of those that tie, the least document keeps the substring.
3. What a bucket found out goes back as one bit for each key that a batch had sent.

Step 2 goes over the buckets in PASSES, a part of them at a time: a pass deals out only
the keys of its own buckets, and its shuffle is given up before the next one, so the
disk holds a part of the keys at any time.

Keys are 64-bit hashes, not the bytes: equality matters, order doesn't.  The keys of
samples may be shorter, as collisions there only make step 2 look at more suffixes.
Only one key of each kind leaves a batch of texts, however often it recurs in it, so no
bucket is filled by a frequent substring.  Batches of texts are written once, bucketed,
and never shuffled; the bits are brought to them by a join on the bucketing.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import delete_at_exit, give_up_shuffles, shared_dir, stage, table
from ._words import substring_hashes

LENGTH = 50
#: Perfect difference sets by period; fixed values.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (1, 6, 7, 9, 19, 38, 42, 49)}
#: Bytes that sample suffixes are compared by at least, where the length allows it.
DEPTH = 16
#: Bytes of text in a batch, batches in a part, and bytes of text in a bucket of the staged table.
BATCH, PART, TABLE_BUCKET = 4 << 20, 8, 16 << 20
#: Keys in a suffix bucket on average, and the least number of such buckets, as a power of 2.
BUCKET_KEYS, BUCKET_BITS = 1 << 20, 8
#: Parts of the buckets that step 2 takes one after another.
PASSES = 4
#: Bits by which the keys of sample suffixes are longer than their number needs.
SPARE_BITS = 8
LAST = np.iinfo(np.int64).max

_BATCHES = "part long, batch int, ids array<long>, ends array<long>, data binary"
_BITS = "bucket long, part long, batch int, bits binary"


def period_for(length: int) -> int:
    return max(p for p in COVERS if p == 1 or p - 1 + DEPTH <= length)


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task in batches, each in the order of its ids, nulls last."""
    part, number, held, size = int.from_bytes(os.urandom(7), "big"), 0, [], 0
    schema = pa.schema([("part", pa.int64()), ("batch", pa.int32()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])

    def row():
        held.sort(key=lambda x: x[0])
        ends = np.cumsum([len(t) for _, t in held])
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, number, [i for i, _ in held], ends, b"".join(t for _, t in held)), schema, strict=True)], schema=schema)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, text in zip(ids, batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            if held and size + len(text) > BATCH:
                yield row()
                number, held, size = number + 1, [], 0
                if number == PART:
                    part, number = int.from_bytes(os.urandom(7), "big"), 0
            held.append((LAST if i is None else i, text))
            size += len(text)
    if held:
        yield row()


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The low bytes of integers, all lowest ones first: high bytes of sorted keys hardly differ, so blocks compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


class _Texts:
    """A batch and its suffixes; the same batch always gives the same keys in the same order."""

    def __init__(self, row: dict, length: int, key_bytes: int) -> None:
        self.row, self.length, self.key_bytes = row, length, key_bytes
        self.raw = np.frombuffer(row["data"], np.uint8)
        self.ids = np.array(row["ids"], np.int64)
        self.ends = np.array(row["ends"], np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.sample()
        self.rank = np.cumsum(np.concatenate([[0], self.ids[1:] != self.ids[:-1]])).astype(np.int32)

    def sample(self) -> None:
        """Finds the sample positions whose suffix is deep enough, and the documents they are in."""
        period = period_for(self.length)
        self.depth = self.length - period + 1
        blocks = np.maximum(-(-(self.ends - self.starts) // period), 0)
        doc = np.repeat(np.arange(len(blocks)), blocks)
        first = self.starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * period
        at = (first[:, None] + np.array(COVERS[period])).reshape(-1)
        doc = np.repeat(doc, len(COVERS[period]))
        deep = at + self.depth <= self.ends[doc]
        self.at, self.at_doc = at[deep], doc[deep].astype(np.int32)

    def sample_keys(self) -> np.ndarray:
        return substring_hashes(self.raw, self.at, self.depth) >> np.uint64(64 - 8 * self.key_bytes)

    def windows(self, tied: np.ndarray) -> np.ndarray:
        """Keys to the full length of all suffixes that a tied sample supports."""
        at, doc = self.at[tied], self.at_doc[tied]
        low = np.maximum(at - (self.length - self.depth), self.starts[doc])
        high = np.minimum(at, self.ends[doc] - self.length)
        some = high >= low
        low, high, doc = low[some], high[some], doc[some]
        # Both ends grow with the position, so each interval adds what lies beyond the one before.
        low = np.maximum(low, np.concatenate([[0], high[:-1] + 1])) if len(low) else low
        n = np.maximum(high - low + 1, 0)
        self.at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at_doc = np.repeat(doc, n)
        return substring_hashes(self.raw, self.at, self.length)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where in it each different one begins."""
    order = np.argsort(keys)
    there = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])) if len(keys) else order[:0]


def _spread(order: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A value for each different key, given out to all places of the key."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(first, len(order))))
    return out


def _flags(row: dict, name: str, n: int) -> np.ndarray:
    """The bits that came back for the n keys of a batch, in the order of its buckets."""
    found, at = np.zeros(n, bool), 0
    for x in sorted(row[name] or [], key=lambda x: x["bucket"]):
        bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8))
        size = int(np.frombuffer(x["bits"][-4:], "<u4")[0])
        found[at : at + size] = bits[:size]
        at += size
    return found


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes() + np.array([len(flags)], "<u4").tobytes()


def _cut(keys: np.ndarray, bits: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by the leading bits of sorted keys, and the bounds of each."""
    buckets = (keys >> np.uint64(bits - bucket_bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(keys) else np.zeros(0, int)
    return buckets[at], np.append(at, len(keys))


def _rows(texts: _Texts, buckets: np.ndarray, columns: list[list[bytes]]) -> pa.RecordBatch:
    n = len(buckets)
    arrays = [pa.array(buckets, pa.int64()), pa.array([texts.row["part"]] * n, pa.int64()), pa.array([texts.row["batch"]] * n, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "part", "batch", "keys", "more"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _samples(length: int, key_bytes: int, bucket_bits: int):
    """Different sample keys of each batch, by bucket, with a bit for those in two of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            texts = _Texts(row, length, key_bytes)
            keys = texts.sample_keys()
            order, first = _grouped(keys)
            rank = texts.rank[texts.at_doc][order]
            several = np.minimum.reduceat(rank, first) != np.maximum.reduceat(rank, first) if len(first) else first.astype(bool)
            keys = keys[order][first]
            buckets, cut = _cut(keys, 8 * key_bytes, bucket_bits)
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield _rows(texts, buckets, [[_planes(keys[a:b], key_bytes) for a, b in spans], [_bits(several[a:b]) for a, b in spans]])

    return run


def _ranked_samples(key_bytes: int):
    """Sorts the sample keys of a bucket; a bit for each says whether it ties with one of another document."""

    def run(group: pa.Table) -> pa.Table:
        keys = [_unplaned(k, key_bytes) for k in group.column("keys").to_pylist()]
        own = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)] for m, k in zip(group.column("more").to_pylist(), keys, strict=True)]
        order, first = _grouped(np.concatenate(keys))
        tied = (np.diff(np.append(first, len(order))) > 1) | (np.maximum.reduceat(np.concatenate(own)[order], first) > 0)
        return _answers(group, keys, _spread(order, first, tied))

    return run


def _answers(group: pa.Table, keys: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    parts = np.split(flags, np.cumsum([len(k) for k in keys])[:-1])
    return group.select(["bucket", "part", "batch"]).append_column("bits", pa.array([_bits(p) for p in parts], pa.binary()))


def _tied(length: int, key_bytes: int):
    """One bit for each sample position of a batch, in their order: whether it ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            texts = _Texts(row, length, key_bytes)
            order, first = _grouped(texts.sample_keys())
            bits = _bits(_spread(order, first, _flags(row, "ties", len(first))))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([row["part"]], pa.int64()), pa.array([row["batch"]], pa.int32()), pa.array([bits], pa.binary())], names=["bucket", "part", "batch", "bits"])

    return run


def _tied_windows(row: dict, length: int, key_bytes: int) -> tuple[_Texts, np.ndarray]:
    texts = _Texts(row, length, key_bytes)
    return texts, texts.windows(_flags(row, "tied", len(texts.at)))


def _candidates(length: int, key_bytes: int, bucket_bits: int, low: int, high: int):
    """Different full keys of each batch, by bucket from low to high, with the least
    document of the batch that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            texts, keys = _tied_windows(row, length, key_bytes)
            bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64)
            own = np.flatnonzero((bucket >= low) & (bucket < high))
            keys, at_doc = keys[own], texts.at_doc[own]
            order, first = _grouped(keys)
            docs = texts.ids[np.minimum.reduceat(at_doc[order], first)] if len(first) else first
            keys = keys[order][first]
            buckets, cut = _cut(keys, 64, bucket_bits)
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield _rows(texts, buckets, [[_planes(keys[a:b]) for a, b in spans], [_planes(docs[a:b]) for a, b in spans]])

    return run


def _ranked_windows(group: pa.Table) -> pa.Table:
    """Sorts the full keys of a bucket; a bit for each says whether a smaller document has it."""
    keys = [_unplaned(k) for k in group.column("keys").to_pylist()]
    docs = np.concatenate([_unplaned(m).astype(np.int64) for m in group.column("more").to_pylist()])
    order, first = _grouped(np.concatenate(keys))
    return _answers(group, keys, _spread(order, first, np.minimum.reduceat(docs[order], first)) < docs)


def _removed(row: dict, length: int, key_bytes: int) -> tuple[_Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The batch, and begin, end and document of each maximal run to remove."""
    texts, keys = _tied_windows(row, length, key_bytes)
    order, first = _grouped(keys)
    rank = texts.rank[texts.at_doc]
    least = np.minimum.reduceat(rank[order], first) if len(first) else first
    gone = _spread(order, first, _flags(row, "smaller", len(first))) | (_spread(order, first, least) < rank)
    at, doc = texts.at[gone], texts.at_doc[gone]
    new = np.concatenate([[True], (at[1:] > at[:-1] + length) | (doc[1:] != doc[:-1])]) if len(at) else gone[:0]
    begin = np.flatnonzero(new)
    return texts, at[begin], (at[np.append(begin[1:], len(at)) - 1] + length) if len(at) else at, doc[begin]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _kept(length: int, key_bytes: int, digest: bool):
    schema = _OUT.append(pa.field("kept_sha256", pa.string())) if digest else _OUT.append(pa.field("spans", _SPANS)).append(pa.field("kept", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            texts, begin, end, doc = _removed(row, length, key_bytes)
            bounds, data, out = np.searchsorted(doc, np.arange(len(texts.ids) + 1)), memoryview(row["data"]), []
            for i, (a, b) in enumerate(zip(texts.starts.tolist(), texts.ends.tolist(), strict=True)):
                own = slice(bounds[i], bounds[i + 1])
                runs = list(zip(begin[own].tolist(), end[own].tolist(), strict=True))
                pieces = [data[x:y] for x, y in zip([a, *(y for _, y in runs)], [*(x for x, _ in runs), b], strict=True)]
                base = (None if texts.ids[i] == LAST else int(texts.ids[i]), b - a, sum(y - x for x, y in runs), len(runs))
                if digest:
                    sha = hashlib.sha256()
                    for p in pieces:
                        sha.update(p)
                    out.append((*base, sha.hexdigest()))
                else:
                    out.append((*base, [{"begin": x - a, "end": y - a} for x, y in runs], b"".join(pieces)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _staged(docs: DataFrame, size: int) -> DataFrame:
    """Batches of texts, written once and bucketed by part; the name in the catalog goes at once."""
    spark, name = docs.sparkSession, f"suffix_batches_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batched, _BATCHES)
    rows.write.option("path", path).option("compression", "zstd").bucketBy(max(8, min(-(-size // TABLE_BUCKET), 50_000)), "part").saveAsTable(name)
    delete_at_exit(spark, path)
    batches = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return batches


def _with(batches: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """The batches with their own bits.  The batches stay where they are: bits are dealt like them."""
    each = bits.groupBy("part", "batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("b"))
    parts = each.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("batch", "b"))).alias("m"))
    joined = batches.join(parts.hint("shuffle_hash"), "part", "left")
    return joined.withColumn(name, F.try_element_at("m", F.col("batch"))).drop("m")


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, spans, kept: each
    text without the bytes covered by a `length`-byte string that also starts in a
    document with a smaller doc_id.  With digest, kept_sha256 stands for the last two.

    Edges: a null text is an empty one; texts shorter than length lose nothing; a null
    doc_id is larger than all others, and like rows that share an id, rows without one
    take nothing from each other; repeated rows give repeated rows; the bytes kept need
    not be valid UTF-8; a text of any size is read in one task, in pieces for hashing;
    an empty table gives an empty result; other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    key_bytes = min(8, -(-(max(size, 1).bit_length() + SPARE_BITS) // 8))
    share = len(COVERS[period_for(length)]) / period_for(length)
    bucket_bits = min(8 * key_bytes, max(BUCKET_BITS, int(size * share / BUCKET_KEYS).bit_length()))
    batches = _staged(docs, size)
    keyed = "bucket long, part long, batch int, keys binary, more binary"
    samples = batches.mapInArrow(_samples(length, key_bytes, bucket_bits), keyed)
    ties = stage(samples.groupBy("bucket").applyInArrow(_ranked_samples(key_bytes), _BITS), "ties")
    tied = stage(_with(batches, ties, "ties").mapInArrow(_tied(length, key_bytes), _BITS), "tied")
    del samples, ties
    smaller, cuts = None, [p * (1 << bucket_bits) // PASSES for p in range(PASSES + 1)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        give_up_shuffles(docs.sparkSession)
        windows = _with(batches, tied, "tied").mapInArrow(_candidates(length, key_bytes, bucket_bits, low, high), keyed)
        found = stage(windows.groupBy("bucket").applyInArrow(_ranked_windows, _BITS), "smaller")
        smaller = found if smaller is None else smaller.union(found)
    del windows
    give_up_shuffles(docs.sparkSession)
    told = _with(_with(batches, tied, "tied"), smaller, "smaller")
    fields = "kept_sha256 string" if digest else "spans array<struct<begin:long,end:long>>, kept binary"
    return told.mapInArrow(_kept(length, key_bytes, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {fields}")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, p, md5(substr(h, 2 * p - 1, 100)) AS s FROM (SELECT row, doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
f AS MATERIALIZED (SELECT row, p FROM w JOIN m USING (s) WHERE first < doc_id OR (doc_id IS NULL AND first IS NOT NULL)),
b AS (SELECT row, p, pair, max(f.p) OVER (PARTITION BY row ORDER BY p ROWS 49 PRECEDING) IS NOT NULL AS gone
  FROM (SELECT row, p, substr(h, 2 * p - 1, 2) AS pair FROM (SELECT row, h, unnest(range(1, len(h) // 2 + 1)) AS p FROM d)) LEFT JOIN f USING (row, p)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY p), false) AS opens FROM b),
g AS (SELECT row, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(pair, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM e GROUP BY row)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (row)
"""
