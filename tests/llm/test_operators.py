"""Operators against brute force, with nulls, empty texts, ties, repeats, extra columns."""

import hashlib
import html
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import _words, decontaminate, embedding_dedup, language, licenses, mixing, ngram_join, pages, passages, pii, quality

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 8)))


def prose(rng, n, vocabulary=None):
    return " ".join(rng.choice(vocabulary) if vocabulary else word(rng) for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = word(rng)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, base = [], [prose(rng, rng.randint(60, 200)) for _ in range(20)]
    for i, b in enumerate(base):
        rows.append(b)
        if i % 2 == 0:
            rows += [edited(rng, b, rng.randint(1, 6)) for _ in range(3)]
        if i % 5 == 0:
            rows.append(b.upper())
    rows += [None, "", " \n\t ", "one two", "ONE  two", "one two three", "One two three", "the " * 300, "the " * 299]
    # The last columns clash with names that operators use themselves.
    return [(i, t, ["en", None][i % 2], ["a", "b", None][i % 3], len(t or ""), "x", 1.5) for i, t in enumerate(rows)] + [(3, rows[3], "en", "a", 1, "x", 1.5)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score double"


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(t))


def test_word_hashes_are_those_of_words():
    texts = ["Ab cd\tEF", "", "x", "é É ab", "ab cd ef"]
    h, at = _words.word_hashes([t.encode() for t in texts])
    seen = {}
    for i, t in enumerate(texts):
        assert at[i + 1] - at[i] == len(words_of(t))
        for w, v in zip(words_of(t), h[at[i] : at[i + 1]]):
            assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n,p,q", [(4, 85, 100), (5, 80, 100)])
def test_ngram_join(docs, corpus, n, p, q):
    sets = {}
    for i, t, *_ in corpus:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = ngram_join.join(docs, n, p, q).collect()
    assert len(got) == len(corpus)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), top(i)) for i in sets}


def test_ngram_join_of_a_large_group(spark):
    """Keys that many sets of a batch share; copies of copies link others that are unlike."""
    rng = random.Random(51)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randint(1, 4)) for _ in range(90)] + [prose(rng, 120) for _ in range(5)]
    chain = base
    for _ in range(12):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, 4, 85, 100).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 6


def test_one_row_of_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(6)
    base, alone = prose(rng, 100), [prose(rng, 100) for _ in range(3)]
    copy = lambda: edited(rng, base, 1)
    other = prose(rng, 100)
    third = prose(rng, 100)
    rows = [(3, base), (None, copy()), (None, alone[0]), (7, copy()), (7, alone[1]), (8, alone[2]), (8, alone[2])]
    rows += [(9, other), (9, edited(rng, other, 1)), (None, third), (None, edited(rng, third, 1))]
    got = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 3, 7, 8, 9]
    assert {base, *alone} <= {r["text"] for r in got}


def test_pipeline_stages_on_edges(spark, tmp_path, corpus):
    """Nulls, empty texts, ties, repeated rows, columns that clash, and empty tables."""
    import corpus_pipeline

    rng = random.Random(61)
    rows = [(i, t, s, len(t or ""), "x", 0.5, 7) for i, t, _, s, *_ in corpus] + [(None, None, None, 0, None, None, None), (None, "", None, 0, None, None, None)]
    rows += [(900, "mail a@b.example.com now " + prose(rng, 60), "a", 1, "x", 0.5, 7)]
    rows = [(*r, "k", "dot", "tick", "row", 5) for r in rows]
    schema = "doc_id long, text string, source string, n_chars long, node string, score double, predicted int, key string, `a.b` string, tick string, row string, group int"
    docs = spark.createDataFrame(rows, schema)
    inner = corpus[5][1].split()
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(inner[5:30])), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        whole = 0 if given is not docs else len(rows)
        kept = {}
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, given, str(tmp_path))
            kept[name] = [tuple(r) for r in out.collect()]
            assert len(kept[name]) <= whole and (name == "mixing" or out.columns == docs.columns)
        if whole:
            copies = {r[1] for r in kept["near_copies"]}
            assert len(kept["near_copies"]) == len(set(kept["near_copies"])) and None in copies and "" in copies
            assert corpus[5][1] not in {r[1] for r in kept["decontamination"]} and len(kept["pii"]) == whole
            said = next(r for r in kept["pii"] if r[0] == 900)
            assert "example" not in said[1] and said[3] == len(said[1]) and said[4:] == ("x", 0.5, 7, "k", "dot", "tick", "row", 5)
            assert all(r[4] > 0 for r in kept["mixing"])


def test_signatures_meet_at_the_threshold():
    rng = np.random.default_rng(3)
    for p, q in ((85, 100), (80, 100), (60, 100)):
        for size in (1, 3, 5, 9, 20, 60, 150, 400):
            for _ in range(12):
                a = np.unique(_words.mix(rng.integers(0, 1 << 62, size).astype(np.uint64)))
                k = int(rng.integers(0, max(1, ngram_join.allowed(len(a), len(a), p, q)) + 1))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[k // 2 :]], _words.mix(rng.integers(0, 1 << 62, k - k // 2).astype(np.uint64))]))
                same = len(np.intersect1d(a, b))
                if len(b) and q * same >= p * (len(a) + len(b) - same):
                    assert len(np.intersect1d(ngram_join.signatures(a, p, q), ngram_join.signatures(b, p, q)))


def test_pseudonyms(spark, docs, none):
    texts = ["card 4111 1111 1111 1111 and 4111-1111-1111-1111", "4111111111111112 no card", "born 1987-02-28, 2023-02-30", "ssn 123-45-6789", "a@b.example.com A@B.EXAMPLE.COM", "10.0.0.1 and 999.1.1.1", "plain text stays", None, "", "DE89 3704 0044 0532 0130 00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kinds", F.lit("old"))
    got = {r["doc_id"]: r for r in pii.pseudonymise(df).collect()}
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[0]["text"])
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert digits[0] == digits[1] != "4" + "1" * 15 and digits[0][0] == "4" and got[0]["n_values"] == 2
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[0])) % 10 == 0
    for i in (1, 6, 7, 8):
        assert got[i]["text"] == texts[i] and got[i]["n_values"] == 0
    assert re.fullmatch(r"born 19\d\d-\d\d-\d\d, 2023-02-30", got[2]["text"]) and "1987-02-28" not in got[2]["text"]
    assert "123-45-6789" not in got[3]["text"] and re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", got[3]["text"])
    assert len(set(got[4]["text"].split())) == 1 and "example" not in got[4]["text"].lower()
    assert got[5]["text"].endswith("999.1.1.1") and "10.0.0.1" not in got[5]["text"]
    iban = re.sub(" ", "", got[9]["text"])
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert pii.pseudonymise(docs).count() == docs.count() and pii.pseudonymise(none).count() == 0


def test_pseudonyms_beside_other_groups(spark):
    card, iban, long = "4111111111111111", "ES9121000418450200051332", "aB3" * 60
    texts = ["pay 4111 1111 1111 1111 123 now", f"{card} 12/27", f"{iban} BIC", f"{card} 123-45-6789", f"token={long} end", "4111111111111112 123"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert re.fullmatch(r"pay 4\d{3} \d{4} \d{4} \d{4} 123 now", got[0]) and "4111 1111 1111 1111" not in got[0]
    assert re.fullmatch(r"4\d{15} 12/27", got[1]) and card not in got[1]
    assert re.fullmatch(r"ES\d{22} BIC", got[2]) and iban not in got[2]
    assert re.fullmatch(r"4\d{15} \d{3}-\d{2}-\d{4}", got[3]) and card not in got[3] and "123-45-6789" not in got[3]
    assert re.fullmatch(r"token=[0-9a-f]{180} end", got[4]) and got[5] == texts[5]


def plain_pseudonym(kind, m, key=pii.KEY):
    """The pseudonym of a valid value, worked out again without Spark."""
    import calendar
    from datetime import date, timedelta

    def rand(tweak, step, x, below):
        return int(hashlib.sha256(f"{key}|{tweak}|{step}|{x}".encode()).hexdigest()[:15], 16) % below

    def feistel(a, b, size_a, size_b, tweak):
        for r in range(pii.ROUNDS):
            a, b = ((a + rand(tweak, r, b, size_a)) % size_a, b) if r % 2 == 0 else (a, (b + rand(tweak, r, a, size_b)) % size_b)
        return a, b

    def permute(d, tweak):
        h = len(d) // 2
        a, b = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), f"{tweak}|{len(d)}")
        return f"{a:0{h}d}{b:0{len(d) - h}d}"

    def fill(shape, d):
        it = iter(d)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def day(d):
        c = d.year // 100
        size, wide = (75, 487) if c % 4 == 0 else (92, 397)
        a, b = feistel(*divmod((d - date(c * 100, 1, 1)).days, wide), size, wide, f"date{c}")
        return date(c * 100, 1, 1) + timedelta(a * wide + b)

    d = re.sub(r"\D", "", m)
    if kind == "card":
        body = d[0] + permute(d[1:-1], "card" + d[0])
        return fill(m, next(body + str(k) for k in range(10) if sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate((body + str(k))[::-1])) % 10 == 0))
    if kind == "phone":
        lead = max(len(d) - 10, 0)
        return fill(m, d[:lead] + permute(d[lead:], "phone" + d[:lead]))
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        a, b = feistel(areas.index(int(m[:3])) * 99 + int(m[4:6]) - 1, int(m[7:]) - 1, 898 * 99, 9999, "ssn")
        return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "ip":
        o = list(map(int, m.split(".")))
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))
    if kind == "iban":
        v = m.replace(" ", "")
        body = fill(v[4:], permute(re.sub(r"\D", "", v[4:]), "iban" + v[:2]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + v[:2] + "00")) % 97
        return fill(m, f"{check:02d}" + re.sub(r"\D", "", body))
    if kind == "iso":
        return day(date.fromisoformat(m)).isoformat()
    if kind == "date":
        mark = "/" if "/" in m else "."
        x, y, z = m.split(mark)
        wide = 2 if len(x) == len(y) == 2 else 1
        n = day(date(int(z), int(y), int(x)) if int(y) <= 12 else date(int(z), int(x), int(y)))
        a, b = (n.day, n.month) if int(y) <= 12 else (n.month, n.day)
        return f"{a:0{wide}d}{mark}{b:0{wide}d}{mark}{n.year}"
    if kind == "written":
        name, number, year = re.search("[A-Z][a-z]+", m)[0], int(re.search(r"\b\d{1,2}(?!\d)", m)[0]), int(m[-4:])
        n = day(date(year, [x[:3] for x in pii.MONTHS].index(name[:3]) + 1, number))
        new = calendar.month_name[n.month] if len(name) > 3 or n.month == 5 else calendar.month_abbr[n.month]
        end = ({1: "st", 2: "nd", 3: "rd"}.get(n.day % 10, "th") if n.day not in (11, 12, 13) else "th") if re.search(r"\d(st|nd|rd|th)", m) else ""
        comma = "," if "," in m else ""
        return f"{new} {n.day}{end}{comma} {n.year}" if m[0].isalpha() else f"{n.day}{end} {new}{comma} {n.year}"


def test_pseudonyms_against_plain_python(spark):
    rng = random.Random(31)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = []
    for _ in range(12):
        c = rng.choice("3456") + digits(rng.choice((11, 13, 14, 17)))
        c += next(str(k) for k in range(10) if sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate((c + str(k))[::-1])) % 10 == 0)
        values += [("card", c), ("card", " ".join(c[i : i + 4] for i in range(0, len(c), 4)))]
        v = digits(18)
        v = f"DE{98 - int(v + str(int('D', 36)) + str(int('E', 36)) + '00') % 97:02d}{v}"
        values += [("iban", v), ("iban", " ".join(v[i : i + 4] for i in range(0, 22, 4)))]
        y, mo, d = rng.randint(1600, 2199), rng.randint(1, 12), rng.randint(1, 28)
        name = rng.choice(pii.MONTHS)
        values += [("iso", f"{y}-{mo:02d}-{d:02d}"), ("date", f"{d:02d}/{mo:02d}/{y}"), ("date", f"{d}.{mo}.{y}"), ("date", f"{mo}/{rng.randint(13, 28)}/{y}"), ("written", f"{name} {d}, {y}"), ("written", f"{d} {name[:3]} {y}"), ("written", f"{name} {rng.choice(('1st', '2nd', '3rd', '4th', '11th'))} {y}")]
        values += [("ssn", f"{rng.choice((1, 665, 667, 899)):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"), ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))), ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", f"+{rng.randint(1, 9)}{digits(11)}")]
    rows = [(i, f"before {m}; after", kind, m) for i, (kind, m) in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, old string, cut string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df).collect()}
    for i, text, kind, m in rows:
        assert got[i]["text"] == f"before {plain_pseudonym(kind, m)}; after" and (got[i]["old"], got[i]["cut"]) == (kind, m), (kind, m)
        assert got[i]["kinds"] == ["date" if kind in ("iso", "written") else kind]
    # Equal dates of any form have equal pseudonyms.
    three = spark.createDataFrame([(0, "1987-02-05 05/02/1987 5/2/1987 5.2.1987 February 5, 1987 5 Feb 1987 Feb 5th 1987")], "doc_id long, text string")
    said = pii.pseudonymise(three).first()["text"]
    y, mo, d = said.split()[0].split("-")
    assert said.split()[1:4] == [f"{d}/{mo}/{y}", f"{int(d)}/{int(mo)}/{y}", f"{int(d)}.{int(mo)}.{y}"] and said.count(y) == 7


def test_pseudonyms_in_hostile_texts(spark):
    """Long runs that patterns could go into or back over without end."""
    n = 1 << 20
    texts = ["x@" + "a." * (n // 2), "a" * n, "1" * n, "1 " * (n // 2), "1-" * (n // 2), "AB12 " + "ABCD " * (n // 5), "+1" * (n // 2), "a@b." * (n // 4), "token=" + "a" * n, "1.1." * (n // 4), "x@" + "a-" * (n // 2), "May 1" * (n // 5), "4111 1111 1111 1111 " * (n // 80)]
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.length("text").alias("n"), "n_values").collect()
    assert len(got) == len(texts)
    values = {r["doc_id"]: r["n_values"] for r in got}
    assert values[12] == n // 80 and values[8] == 1 and values[1] == values[2] == 0
    assert {r["doc_id"]: r["n"] for r in got}[8] == len(texts[8])


def test_feistel_is_a_permutation(spark):
    n = spark.range(12 * 7).select(F.floor(F.col("id") / 7).alias("a"), (F.col("id") % 7).alias("b"))
    moved = n.select(pii.feistel(F.col("a"), F.col("b"), F.lit(12), F.lit(7), F.lit("t"), "k").alias("s")).select("s.a", "s.b").collect()
    assert sorted(map(tuple, moved)) == [(a, b) for a in range(12) for b in range(7)]


def test_quality(spark, docs, none):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) if i % 2 else " ".join(w + "###" for w in prose(rng, 80).split()), i % 2) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.learn(d, d.select("doc_id", "quality"))
    got = quality.classify(d, model).collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 396
    whole = quality.classify(docs, model)
    assert whole.count() == docs.count() and whole.where("score is null or score < 0 or score > 1").count() == 0
    assert len({r["score"] for r in whole.where("coalesce(text, '') = ''").collect()}) == 1
    assert quality.classify(none, model).count() == 0
    empty = quality.learn(none, none.select("doc_id", F.lit(1).alias("quality")))
    assert {r["score"] for r in quality.classify(d, empty).collect()} == {0.5}


def test_trees_step_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:20], m.score(x)[:20]):
        total = m.bias
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if row[m.feature[at]] <= m.threshold[at] else m.right[at]
            total += m.value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("size", [3, 7])
def test_embeddings(spark, size):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, size))
    v = np.concatenate([base, base[:10] + rng.normal(size=(10, size)) * 0.02, base[:5]]).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(100, None, 1), (101, [0.0] * size, 1), (102, [float("nan")] * size, 1), (103, [1.0, 2.0], 1), (104, [], 1), (105, [None] + [1.0] * (size - 1), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.link(df).collect()}
    assert len(got) == len(rows)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    for i in range(len(v)):
        assert got[i]["n_links"] == links[i].sum() - 1
        reach, todo = {i}, [i]
        while todo:
            for j in map(int, np.flatnonzero(links[todo.pop()])):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i]["component_id"] == min(reach) and got[i]["kept"] == (i == min(reach))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(100, 106))


def test_embeddings_of_any_magnitude(spark):
    x = [1.0, 2.0, -3.0]
    rows = [(1, [1e200 * c for c in x]), (2, [1e-200 * c for c in x]), (3, x), (3, x), (4, [float("inf"), 1.0, 1.0]), (None, x), (5, [-c for c in x])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("n")).withColumn("cell", F.lit(1))
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link(df).collect())
    assert got == [(0, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    assert embedding_dedup.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("halves", [False, True])
def test_recall_of_the_index(spark, halves):
    """20,000 vectors, 1,500 of them with a partner at cosine 0.951, that may differ in one half only."""
    rng = np.random.default_rng(41)
    n, size = 18_500, 64
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(1500, size))
    if halves:
        side[:, size // 2 :] = 0
    side -= (side * x[:1500]).sum(1)[:, None] * x[:1500] if not halves else 0
    if halves:  # turned within the first half, so far that the whole has the cosine
        h = x[:1500, : size // 2]
        own = (h * h).sum(1)
        side = side[:, : size // 2] - ((side[:, : size // 2] * h).sum(1) / own)[:, None] * h
        side *= (np.sqrt(own) / np.linalg.norm(side, axis=1))[:, None]
        c = np.clip(1 - (1 - 0.951) / own, -1, 1)
        y = np.concatenate([h * c[:, None] + side * np.sqrt(1 - c * c)[:, None], x[:1500, size // 2 :]], 1)
    else:
        y = 0.951 * x[:1500] + np.sqrt(1 - 0.951**2) * side / np.linalg.norm(side, axis=1)[:, None]
    v = np.concatenate([x, y])
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": list(v)}))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link(df).collect()}
    links = np.concatenate([(v[i : i + 2000] @ v.T >= 0.95).sum(1) - 1 for i in range(0, len(v), 2000)])
    assert links.sum() >= 2900 and all(got[i] <= links[i] for i in range(len(v)))
    assert sum(got.values()) >= 0.98 * links.sum()


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (10, 6), (200, 150), (200, 3000)):
        s, t = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = embedding_dedup.forest(n, s, t)
        roots = []
        for x, y in ((s, t), (a, b)):
            root = np.arange(n)
            for _ in range(n):
                low = np.minimum(root[x], root[y])
                np.minimum.at(root, x, low)
                np.minimum.at(root, y, low)
            roots.append(root)
        assert (roots[0] == roots[1]).all() and len(a) == n - len(set(roots[0].tolist()))


def test_traversal_is_in_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6))
    index = embedding_dedup.MultiIndex(x, 8)
    a, b = index.apart(x[:5])
    for i in range(5):
        cells = list(index.traverse(a[i], b[i]))
        far = [a[i][c // 8] + b[i][c % 8] for c in cells]
        assert sorted(cells) == list(range(64)) and far == sorted(far)


def test_licenses(spark, docs, none):
    rows = [("a/LICENSE", "Released under the MIT License.", 1), ("a/b/x.py", "code", 1), ("a/b/c/COPYING", "Licensed under CC BY-NC 4.0.", 1), ("a/b/c/y.py", "", 1), ("q/z", None, 1), (None, "w", 1), ("y", "# Licensed under the Apache License, Version 2.0.\ncode", 1), ("a/b/x.py", "code", 1)]
    df = spark.createDataFrame(rows, "path string, text string, score int")
    got = sorted((r["path"] or "", r["license"] or "", r["origin"] or "") for r in licenses.scan(df).collect())
    assert got == [("", "", ""), ("a/LICENSE", "MIT", "own"), ("a/b/c/COPYING", "CC-BY-NC-4.0", "own"), ("a/b/c/y.py", "CC-BY-NC-4.0", "inherited"), ("a/b/x.py", "MIT", "inherited"), ("a/b/x.py", "MIT", "inherited"), ("q/z", "", ""), ("y", "Apache-2.0", "own")]
    path = F.col("doc_id").cast("string").alias("path")
    assert licenses.scan(docs.select(path, "text")).where("license is null").count() == docs.count()
    assert licenses.scan(none.select(path, "text")).count() == 0


def test_licenses_beside_copyright(spark):
    rows = [("a", "Copyright 2021 Example Corp. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("b", "# Copyright (c) 2019 Jane Doe and contributors. Released under the MIT License.", "MIT"), ("c", "Copyright (C) 2020 Acme Ltd. SPDX-License-Identifier: MIT", "MIT"), ("d", "// Copyright 2020 Acme SPDX-License-Identifier: Apache-2.0 */ int x;", "Apache-2.0"), ("e", "Copyright 2020 Acme Ltd. and friends.", None)]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string, want string")).collect()
    assert [(r["path"], r["license"]) for r in sorted(got)] == [(p, w) for p, _, w in rows]


def test_licenses_of_a_source(spark, tmp_path):
    """Documents inherit from those of their source that are a notice and hardly more."""
    gpl, mit = "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."
    long = prose(random.Random(3), 60)
    rows = [
        (1, "two words\n" + gpl, "a"), (2, long, "a"), (3, None, "a"), (4, long + "\n" + mit, "a"), (5, long, "a/b"), (6, "zq SPDX-License-Identifier: Zq-7.7", "a"),  # a states GPL
        (7, long + "\n" + gpl, "c"), (8, long, "c"), (9, "nd by", "c"),  # c states nothing: long text, or not a notice in full
        (10, gpl, "d"), (11, "\n" + mit + "\n\n", "d"), (12, "", "d"), (12, "", "d"),  # d states two
        (13, gpl, None), (14, long, None), (15, gpl, ""), (16, long, ""), (17, long, "e"),  # no source: rules nobody
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["origin"], r["license"], r["licenses"]) for r in licenses.op5_licenses(spark, str(tmp_path)).collect())
    assert len(got) == len(rows)
    inherited = [(i, x, all_) for i, origin, x, all_ in got if origin == "inherited"]
    assert inherited == [(i, "GPL-3.0", ["GPL-3.0"]) for i in (2, 3, 5)] + [(12, "GPL-3.0", ["GPL-3.0", "MIT"])] * 2
    assert {i: x for i, origin, x, _ in got if origin == "own"} == {1: "GPL-3.0", 4: "MIT", 7: "GPL-3.0", 9: "CC-BY-ND-4.0", 10: "GPL-3.0", 11: "MIT", 13: "GPL-3.0", 15: "GPL-3.0"}
    assert [i for i, origin, *_ in got if not origin] == [6, 8, 14, 16, 17]


def test_licenses_with_an_unknown_tag_are_not_inherited(spark):
    rows = [("a/LICENSE", "Released under the MIT License.", "MIT"), ("a/x.py", "code", "MIT"), ("a/y.py", "# SPDX-License-Identifier: Zq-7.7\ncode", None), ("a/b/__init__.py", "# Released under the MIT License.", "MIT"), ("a/c.py", "# Licensed under CC BY 4.0.", "CC-BY-4.0")]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string, want string")).collect()
    assert [(r["path"], r["license"]) for r in sorted(got)] == sorted((p, w) for p, _, w in rows)


def test_mixing(docs, corpus, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in corpus)
    totals = {}
    for r in corpus:
        totals[r[3]] = totals.get(r[3], 0) + size(r[1])
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(totals.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * totals[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ -= full
    source = {r[0]: r[3] for r in corpus}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == totals[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert [r["turn"] for r in got] == sorted(r["turn"] for r in got)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("sizes", [{c: [20] * 10 for c in "abcdef"}, {c: [7, 13, 180] for c in "abc"}, {"a": [5, 0, 40]}, {"a": [0], "b": [0, 0]}, {"a": [1000], "b": [3] * 50, None: [100, 1]}, {"a": [1] * 9, "b": [1] * 9, "c": [1] * 9}])
def test_mixing_against_a_queue(spark, sizes):
    """One queue of words in the order of virtual time, cut at the budget; also where sources are alike."""
    rows = [(i, " ".join(["w"] * n), None, s, 1, "x", 1.5) for i, (s, n) in enumerate((s, n) for s in sizes for n in sizes[s])]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {r["doc_id"]: r for r in got}
    words = []
    for s in sizes:
        own, served = sorted((r for r in got if rows[r["doc_id"]][3] == s), key=lambda r: (r["turn"], r["size"] > 0)), 0
        for _ in range(2):
            for r in own:
                for _ in range(r["size"]):
                    served += 1
                    words.append((served / r["target"], r["doc_id"]))
    words.sort()
    budget = sum(math.floor({rows[r["doc_id"]][3]: r["target"] for r in got}[s]) for s in sizes)
    assert budget <= 1.5 * sum(map(sum, sizes.values())) < budget + len(sizes) + 1e-6
    for s in sizes:
        ids = [r["doc_id"] for r in got if rows[r["doc_id"]][3] == s]
        want = sum(1 for _, d in words[:budget] if d in ids)
        assert sum(by_id[d]["taken"] for d in ids) == want == math.floor(by_id[ids[0]]["target"])
    assert all(r["taken"] == sum(1 for _, d in words[:budget] if d == r["doc_id"]) for r in got)


def test_decontamination(spark, docs, none, corpus):
    rng = random.Random(9)
    inner = corpus[0][1].split()
    items = [(1, " ".join(inner[5:30])), (2, prose(rng, 30)), (3, None), (4, ""), (5, "one TWO"), (6, " ".join(inner[40:49]) + " other"), (7, " ".join(inner[5:30])), (8, "the " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    wins = {i: {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} for i, t in items if (w := split(t))}
    want = set()
    for i, t, *_ in corpus:
        w, hit, own = split(t), set(), set()
        for item, ws in wins.items():
            for s in ws:
                for k in range(len(w) - len(s) + 1):
                    if tuple(w[k : k + len(s)]) == s:
                        hit |= set(range(k, k + len(s)))
                        own.add(str(item))
        want.add((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.report(docs, bench).collect()
    assert len(got) == len(corpus) and {tuple(r) for r in got} == want
    assert decontaminate.clean(docs, bench).count() == sum(1 for r in got if not r["contaminated"])
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    near, _ = decontaminate.matches(docs, spark.createDataFrame([(1, " ".join(inner[5:9] + ["zzz"] + inner[9:14]))], "item_id long, text string"), slop=2)
    assert 0 in {r["doc_id"] for r in near.collect()}


def test_language(spark, docs, none):
    rng = random.Random(2)
    en, de = [word(rng) for _ in range(60)], [word(rng) + "ü" for _ in range(60)]
    rows = [(i, prose(rng, 60, en if i % 2 else de), "en" if i % 2 else "de") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(d.where("doc_id < 100"))
    got = {r["doc_id"]: r for r in language.identify(d, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "ü")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(edge, model).orderBy("doc_id").collect()] == ["und", "und", "und", "de"]
    assert language.identify(none, model).count() == 0 and language.learn(none).langs == []


def test_language_learns_from_distinct_texts(spark):
    rng = random.Random(4)
    en, de = [word(rng) for _ in range(60)], [word(rng) + "ü" for _ in range(60)]
    rows = [("zzz zzzz qqq", "en")] * 3000 + [(prose(rng, 60, en), "en") for _ in range(40)] + [(prose(rng, 60, de), "de") for _ in range(40)]
    d = spark.createDataFrame(rows, "text string, lang string")
    once = language.learn(d.distinct(), learn_docs=20)
    model = language.learn(d, learn_docs=20)
    assert model.langs == once.langs == ["de", "en"] and (model.gram == once.gram).all() and (model.rank == once.rank).all() and (model.lang == once.lang).all()
    assert language.learn(d, learn_docs=1).langs == ["de", "en"]


def test_grams_count_whole_texts():
    text = "Ab cab " * (language._RUN // 5)
    g, c = language.grams(text)
    n = len(text.split()) // 2
    a, b = ord("a"), ord("b")
    assert dict(zip(g.tolist(), c.tolist()))[(a << 21 | b) | 1 << 63] == 2 * n
    assert dict(zip(g.tolist(), c.tolist()))[ord("c") << 42] == n


def test_passages(spark, docs, none):
    rng = random.Random(7)
    shared = prose(rng, 70).split()
    changed = shared[:30] + [word(rng)] + shared[31:50] + shared[52:]
    rows = [(0, prose(rng, 300)), (1, " ".join(prose(rng, 100).split() + shared + prose(rng, 90).split())), (2, " ".join(prose(rng, 40).split() + changed + prose(rng, 200).split())), (3, prose(rng, 49)), (4, None), (5, " ".join(prose(rng, 60).split() + shared[:40]))]
    rows += [(6, rows[0][1]), (7, rows[3][1])]
    got = {r["doc_id"]: r for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 6}
    assert (got[1]["start_word"], got[1]["end_word"], got[1]["partner_doc_id"]) == (100, 170, 2)
    assert (got[2]["start_word"], got[2]["end_word"]) == (40, 108)
    assert (got[0]["start_word"], got[0]["end_word"], got[0]["partner_doc_id"], got[6]["partner_doc_id"]) == (0, 300, 6, 0)
    assert passages.passages(docs).count() > 0 and passages.passages(none).count() == 0


def test_passages_apart_in_both_texts(spark):
    rng = random.Random(8)
    for n, gap in ((60, 70), (100, 100), (200, 200)):
        one, two = prose(rng, n), prose(rng, n)
        rows = [(i, " ".join([prose(rng, 30), one, prose(rng, gap), two, prose(rng, 30)])) for i in range(2)]
        got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == [(i, at, at + n) for i in range(2) for at in (30, 30 + n + gap)]


def test_passages_at_the_threshold(spark):
    """Every passage that is 0.8 alike is found: one word in eight or in five replaced, or any."""
    rng = random.Random(11)
    rows, at = [], {}
    for n, k in ((60, 8), (60, 5), (1000, 8)) + ((60, 0),) * 60:
        one = prose(rng, n).split()
        two = list(one)
        for i in range(k - 1, n - 1, k) if k else rng.sample(range(1, n - 1), 12):
            two[i] = word(rng)
        for w in (one, two):
            at[len(rows)] = n
            rows.append((len(rows), " ".join([prose(rng, 30), *w, prose(rng, 30)])))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(at)
    assert all(30 <= r["start_word"] and r["end_word"] <= 30 + at[r["doc_id"]] and r["n_words"] >= max(50, at[r["doc_id"]] - 20) for r in got)


def test_passages_of_frequent_lines(spark):
    """Two texts share 60 words in three lines, each of which many other texts have."""
    rng = random.Random(12)
    lines = [prose(rng, 20) for _ in range(3)]
    rows = [" ".join([prose(rng, 40), *(lines if k == 3 else [lines[k]]), prose(rng, 40)]) for k in [0, 1, 2] * 15 + [3, 3]]
    # Also where each two lines that meet are frequent.
    more = [prose(rng, 20) for _ in range(3)]
    rows += [" ".join([prose(rng, 40), *(more if k == 2 else more[k : k + 2]), prose(rng, 40)]) for k in [0, 1] * 15 + [2, 2]]
    got = passages.passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == {(i, 40, 100) for i in (45, 46, 77, 78)}


def test_chains_are_collinear():
    x = np.array([0, 10, 20, 500, 30, 40])
    y = np.array([100, 110, 121, 5, 131, 141])
    first = passages.chains(x, y, np.array([4, 4, 4, 9, 4, 4]))[0]
    assert first.tolist() == [0, 1, 2, 4, 5]


def test_passages_of_parts_found_elsewhere(spark):
    """A and B share 70 words; C has the first 40 of them and D the last 40, also where each part is in many texts."""
    rng = random.Random(13)
    for others in (1, 30):
        one = prose(rng, 70).split()
        parts = [one, one] + [one[:40], one[30:]] * others
        rows = [(i, " ".join([prose(rng, 60), *p, prose(rng, 60)])) for i, p in enumerate(parts)]
        got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == {(0, 60, 130), (1, 60, 130)}


def test_passages_of_exact_runs_in_many_texts(spark):
    """A and B share 51 words of which each 41 to 49 in a row are in many texts, which decide by whole windows."""
    rng = random.Random(14)
    one = prose(rng, 51).split()
    parts = [one, one] + [one[k : k + 49] for k in (0, 1, 2)] * 20 + [one[k : k + 42] for k in range(10)] * 12
    rows = [(i, " ".join([prose(rng, 60), *p, prose(rng, 60)])) for i, p in enumerate(parts)]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(0, 60, 111), (1, 60, 111)} <= got and len(got) == 2


def test_passages_of_long_texts(spark):
    """Texts of many segments: their own repeats don't count, what others share is whole."""
    rng = random.Random(15)
    one, again = prose(rng, 3000), prose(rng, 80)
    rows = [(0, f"{prose(rng, 700)} {one} {prose(rng, 900)} {again} {prose(rng, 2000)} {again}"), (1, f"{prose(rng, 33)} {one}"), (2, None), (3, f"{again} x"), (None, f"y {again}")]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.passages(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()}
    assert got == {(0, 700, 3700), (1, 33, 3033)}
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 700, 3700), (0, 4600, 4680), (0, 6680, 6760), (1, 33, 3033), (3, 0, 80), (None, 1, 81)}


def test_passages_against_brute_force(spark):
    """Every pair of texts on every diagonal, word by word; edits are replacements."""
    rng = random.Random(16)
    bank = [prose(rng, rng.randint(50, 90)) for _ in range(12)]
    rows = []
    for i in range(120):
        w: list[str] = []
        for _ in range(rng.randint(1, 3)):
            w += prose(rng, rng.randint(0, 60)).split()
            passage = rng.choice(bank)
            w += edited(rng, passage, rng.randint(0, len(passage.split()) // 6)).split()
        rows.append((i, " ".join(w + prose(rng, 10).split())))
    split = [t.split() for _, t in rows]
    wanted: dict[int, set[int]] = {}
    for i, a in enumerate(split):
        for j, b in enumerate(split[:i]):
            for shift in range(-len(a) + 50, len(b) - 49):
                lo, hi = max(0, -shift), min(len(a), len(b) - shift)
                equal = np.array([a[k] == b[k + shift] for k in range(lo, hi)], int)
                if equal.sum() < 40:
                    continue
                total = np.concatenate([[0], np.cumsum(equal)])
                for k in range(len(equal) - 49):
                    if equal[k] and equal[k + 49] and total[k + 50] - total[k] >= 40:
                        wanted.setdefault(i, set()).update(range(lo + k, lo + k + 50))
                        wanted.setdefault(j, set()).update(range(lo + k + shift, lo + k + shift + 50))
    got: dict[int, set[int]] = {}
    for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    found = sum(len(v & got.get(i, set())) for i, v in wanted.items())
    all_ = sum(map(len, wanted.values()))
    over = sum(len(v - wanted.get(i, set())) for i, v in got.items())
    assert all_ > 5000 and found >= 0.98 * all_ and over <= 0.1 * all_, (found, all_, over)


def test_pages(spark):
    rng = random.Random(3)
    body = [f"<p>{prose(rng, 30)}</p>" for _ in range(12)]
    furniture = "<header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><aside>side</aside>"
    rows = [(i, f"http://h.example/{i}", f"<html><head><title>t</title><style>p{{}}</style></head><body>{furniture}<article><h1>A &amp; B {i}</h1>{b}<div class=box>Read our other pages too</div></article><section id=comments><p>nice</p></section><form><input></form><script>var a='</p>';</script><footer>f</footer></body></html>") for i, b in enumerate(body)]
    rows += [(20, None, None), (21, "http://h.example/x", ""), (22, "http://o.example", "plain <b>te</b>xt &lt;x&gt;\n\n more<br>line<p>cut <a hre")]
    got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, b in enumerate(body):
        assert got[i]["text"] == html.unescape(f"A & B {i} " + re.sub("<.*?>", "", b)) and got[i]["n_chars"] == len(got[i]["text"])
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "plain text <x> more line cut"


def test_pages_named_around_articles():
    art = "<article><div class='post-header'><h1>Head</h1></div><div class='header'><h2>Sub</h2></div><p>Body text.</p><div class='share'>Share</div></article>"
    for page in (f"<div class='layout has-sidebar'>{art}</div>", f"<div id=page class='menu-closed'>{art}</div>", f"<div class='sidebar'>{art}</div>", f"<div class='related'><article>Other</article></div>{art}"):
        assert pages.main_text(pages.parse(f"<html><body>{page}</body></html>")) == "Head Sub Body text."
    assert pages.main_text(pages.parse("<div class='cookie-notice'>x</div><div class='site-footer'>y</div><p>Text</p>")) == "Text"


LEAKS = """comments-area comments-section comment-body user-comments reader-comments js-comments commentThread disqus_thread related-posts social-icons share-buttons ad-container
ad-slot ad-unit ads-wrapper ad_300x250 advert-block sponsored-content newsletter-form cookie-bar cookieConsent post-footer entry-footer main-nav comment comments-list"""
STAY = "side-by-side social-science notice-period has-sidebar no-comment-policy adversary admission commentary footnote header-free navigator editor-comment content-sidebar-wrap"


@pytest.mark.parametrize("name", LEAKS.split())
def test_furniture_by_name(name):
    text = lambda page: pages.main_text(pages.parse(page))
    for a in (f'class="{name}"', f"id='{name}'", f'class="x {name}"'):
        assert text(f"<article><h1>Head</h1><p>Body</p><div {a}><p>Leak</p></div></article>") == "Head Body"
        assert text(f"<article><h1>Head</h1><p>Body</p></article><section {a}><article><p>Leak</p></article></section>") == "Head Body"


@pytest.mark.parametrize("name", STAY.split())
def test_names_of_no_furniture(name):
    assert pages.main_text(pages.parse(f'<article><h1>Head</h1><div class="{name}"><p>Body</p></div></article>')) == "Head Body"


def test_articles_of_others_and_remarks():
    text = lambda page: pages.main_text(pages.parse(page))
    assert text('<article><h1>Own</h1><p>Body</p><p class="comment">Editor says.</p></article><div class="comments-area"><article class="comment-body">Reader says.</article></div>') == "Own Body Editor says."
    assert text("<main><article><h2>Own</h2><p>Body</p><article><h3><a href=/x>Next</a></h3>teased</article></article><article><h2><a href=/y>Other</a></h2>teased</article></main>") == "Own Body"
    assert text("<article><h2><a href=/own>Own</a></h2><p>Body</p></article>") == "Own Body"
    assert text("<article><header><h4>Own</h4></header><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><object data=a>Fall back</object></article>") == "Own Let x=1 be. Fall back"


def test_subtrees_are_counted_as_by_hand(spark):
    """Which containers recur on a host, against a count over the pages; repeated pages count once."""
    rng = random.Random(4)
    blocks = [f"<div><p>{prose(rng, 6)}</p></div>" for _ in range(12)]
    held = [sorted(rng.sample(range(12), rng.randint(0, 6))) for _ in range(60)]
    rows = [(i, f"http://h{i % 3}.example/{i}", "<article>" + f"<p>Own words {i // 2}</p>" + "".join(blocks[k] for k in held[i]) + "</article>") for i in range(60)] + [(99, None, None)]
    rows += [(i + 100, u, h) for i, u, h in rows[:9]]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(docs).collect()}
    plain = lambda h: " ".join(re.sub("<.*?>", " ", h or "").split())
    contents: dict = {}
    for i, u, h in rows[:60]:
        contents.setdefault(i % 3, {})[plain(h)] = held[i]
    for i, u, h in rows:
        if h:
            host = contents[i % 100 % 3]
            gone = [k for k in held[i % 100] if (n := sum(k in x for x in host.values())) >= 5 and n >= 0.2 * len(host)]
            for k in gone:
                h = h.replace(blocks[k], " ")
        assert got[i] == plain(h)
    assert pages.extract(docs.limit(0)).count() == 0


def test_markup_never_gets_into_the_text():
    text = lambda page: pages.main_text(pages.parse(page))
    assert text('<article><p>one</p><a href="x>link</a><p>two</p></article>') == "one link two"
    assert text("<p title='x>y'>a < b and <3 c</p><p title=it's>d</p></3 e> f<a") == "a < b and <3 c d f"
    assert text("<script>var s = '<a href=\"';</script><p>one \"two\"</p><style>p{}</style>three") == 'one "two" three'
    assert text("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>e<td>f</table>") == "a b c d e f"


def test_pages_of_a_megabyte_take_little_time():
    """Each of these took time with the square of its length, or would."""
    for page in ("<a " * 330_000 + '">', "<b>" * 150_000 + "</i>" * 150_000, "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, "<div class=header>" * 50_000, '<a b="' * 150_000, "<div><p>" * 100_000, "<ul>" + "<li>x<b>" * 100_000, "<" * 1_000_000):
        began = time.time()
        pages.key(pages.parse(page))
        pages.main_text(pages.parse(page))
        assert time.time() - began < 40


def test_licenses_against_brute_force(spark):
    """All columns' names clash with internal ones; long texts, nulls, ties and repeats."""
    from collections import Counter

    rng = random.Random(21)
    names = [n for n, _ in licenses.TEMPLATES]
    split = lambda t: re.findall("[a-z0-9]+", t.lower())
    w = licenses.Weights(licenses.TEMPLATES)
    known = [t for _, n in licenses.TEMPLATES for t in split(n)]

    def unit(u):
        c = Counter(split(u))
        own = {t: n * w.idf.get(t, w.other) for t, n in c.items()}
        norm = sum(x * x for x in own.values()) ** 0.5
        cos = [sum(own[t] * k[t] * w.idf[t] for t in own if t in k) / m / norm for k, m in zip(w.counts, w.norms)] if norm else []
        return min(((-round(s, 6), n) for s, n in zip(cos, names) if round(s, 6) >= licenses.THRESHOLD), default=None)

    def units(t):
        lines = re.split(r"\r?\n", t)
        out = lines + [s for x in lines for s in re.split(r"(?<=[.!?|])\s+", x)] + re.split(r"\r?\n[ \t]*\r?\n", t)
        return [x.strip(" ") for x in out + re.findall(r"(?i)\bSPDX-License-Identifier:[ \t]*[A-Za-z0-9.+\-]+", t)]

    texts = [None, "", "bare CC BY 4.0", prose(rng, 40) + "\nReleased under the MIT License.\n" + prose(rng, 40)]
    for _, notice in licenses.TEMPLATES:
        x = notice.split()
        texts += [notice, " ".join(x[: max(3, len(x) * 2 // 3)]), " ".join(rng.sample(x, len(x))) + " " + prose(rng, 3), f"{prose(rng, 9)} {notice} {prose(rng, 9)}\n\n{prose(rng, 20)}"]
    texts += [" ".join(rng.choice(known) for _ in range(n)) + " " + prose(rng, n // 2) for n in range(2, 60, 3)]
    texts += [prose(rng, 160_000), "the license " * 60_000 + prose(rng, 2000)]
    texts += texts[:6]
    rows = [(f"d/{i}", t, 1, "s", "f", "p", 0.5, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "path string, text string, start int, named string, folder string, own string, _key double, kept string, b string")
    got = {r["path"]: r for r in licenses.scan(df).collect()}
    assert len(got) == len(rows) and all(r["kept"] == "x" and r["start"] == 1 for r in got.values())
    for path, text, *_ in rows:
        found = sorted(x for u in units(text or "") if (x := unit(u)))
        r = got[path]
        assert (r["license"], r["licenses"]) == (found[0][1] if found else None, sorted({n for _, n in found})), text
        assert not found or r["score"] == pytest.approx(-found[0][0], abs=2e-6)
    assert sum(r["origin"] == "own" for r in got.values()) > 60
