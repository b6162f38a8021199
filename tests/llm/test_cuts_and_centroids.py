"""Fill-in-middle, centroid clustering and suffix dedup against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lodeline.llm import centroids, fill_middle, suffixes

DOCS = "doc_id long, text string, form string, part long, source string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def expected_cut(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def test_fill_in_middle(spark):
    rng = random.Random(3)
    alphabet = "aB zé\n<>PSM_7ſK😀"
    texts = [None, "", "a", " ", "<P>", "x<S>y", "<M", "one two", "\x00", "İı", "ſtop", "a" * 200_000, ("ab" * 70_000 + ".") * 2, "é" * 70_000, "a b" * 60_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(300)] + ["one two", "one two"]
    ids = [*range(len(texts) - 3), None, 5, 5]
    rows = table(spark, texts, ids)
    want = sorted((expected_cut(i, t) for i, t in zip(ids, texts, strict=True)), key=repr)
    got = [tuple(r) for r in fill_middle.fill_in_middle(rows).collect()]
    assert sorted(got, key=repr) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [tuple(r) for r in fill_middle.fill_in_middle(rows, digest=True).collect()]
    assert sorted(digests, key=repr) == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(rows.limit(0)).count() == 0


def expected_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes())
    centres = [v for _, v in sorted(kept, key=place)[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((square(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        where = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, k) in zip(kept, where, strict=True) if k == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    where = assign()
    inertia = [sum(d for d, k in where if k == j) for j in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, inertia[k], sum(inertia), sha[k]) for (i, _), (d, k) in zip(kept, where, strict=True)), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster int, x string"


@pytest.mark.parametrize("n", [0, 1, 9, 400])
def test_centroids(spark, n):
    rng = np.random.default_rng(n)
    means = rng.normal(size=(9, 64))
    rows = [(i, [float(np.float32(x)) for x in means[i % 9] + rng.normal(scale=0.3, size=64)]) for i in range(n)]
    if n > 20:
        rows += [(None, rows[0][1]), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (900, [0.0] * 64), (901, [-0.001] * 64), (902, [float(np.float32(3e5))] * 64)]
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [1.0] * 65), (1003, [None] + [1.0] * 63), (1004, [float("nan")] * 64), (1005, [float("inf")] + [0.0] * 63), (1006, [])]
    got = centroids.cluster(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_clusters(rows)


def test_centroids_of_any_magnitude(spark):
    rows = [(i, [3e38 * (-1) ** (i + k) for k in range(64)]) for i in range(20)]
    got = centroids.cluster(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)).collect()
    assert len(got) == 20 and {r["distance"] for r in got} == {0}


def test_screening_spares_distances_and_changes_none():
    rng = np.random.default_rng(1)
    centres = rng.integers(-64, 64, (16, 64)) * (rng.random((16, 8)) < 0.3).repeat(8, 1)
    x = (centres[rng.integers(0, 16, 3000)] + rng.integers(-3, 4, (3000, 64))).astype(np.int64)
    x[0] = (centres[3] + centres[5]) // 2
    where, best, exact = centroids.nearest(x, centroids._norms(x, 8), centres)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (where == every.argmin(1)).all()
    assert exact < 0.5 * every.size


def expected_removals(rows, length):
    first: dict[bytes, float] = {}
    key = lambda i: math.inf if i is None else i
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, math.inf), key(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        runs = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((i, len(b), sum(gone), len(runs), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def removals(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length,tasks", [(50, 1), (50, 5), (22, 3), (8, 4), (3, 2), (80, 3)])
def test_repeats(spark, length, tasks):
    rng = random.Random(length)
    letters = lambda n, of="abcdefgh é": "".join(rng.choice(of) for _ in range(n))
    shared = [letters(rng.randint(length - 2, 3 * length)) for _ in range(12)]
    texts = [letters(rng.randint(0, 60)) + "".join(rng.choice(shared) + letters(rng.randint(0, 40)) for _ in range(rng.randint(0, 4))) for _ in range(120)]
    texts += [None, "", "x" * length, "x" * (length - 1), "x" * (3 * length), shared[0][:length], texts[3], texts[3], texts[5] + texts[6], "ab" * length, "ba" * length]
    texts += [shared[1][:-1], shared[1][1:], shared[2], shared[2] + shared[3], letters(200, "ab")] * 2
    ids = [rng.randrange(10**12) for _ in texts]
    ids[3], ids[4], ids[10], ids[11] = None, None, ids[12], ids[12]
    rows = list(zip(ids, texts, strict=True))
    got = removals(suffixes.remove_repeats(table(spark, texts, ids).repartition(tasks), length))
    assert got == expected_removals(rows, length)
    assert sum(r[2] for r in got) > 0


def test_repeats_of_long_and_no_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2_600_000))
    passage = long[(1 << 20) - 30 : (1 << 20) + 30]
    docs = table(spark, [long, "start " + passage + " end", long[-50:], "y" * 49], [5, 9, 2, 1])
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    assert bytes(got[9]["kept"]) == b"start  end" and got[5]["n_removed"] == 50 and got[2]["n_removed"] == got[1]["n_removed"] == 0
    sha = {r["doc_id"]: r["kept_sha256"] for r in suffixes.remove_repeats(docs, digest=True).collect()}
    assert sha == {i: hashlib.sha256(bytes(r["kept"])).hexdigest() for i, r in got.items()}
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_covers_bring_any_two_places_together():
    for period, cover in suffixes.COVERS.items():
        for i in range(period):
            assert any((i + k) % period in cover and k % period in cover for k in range(period))
