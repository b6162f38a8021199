"""Routes, forests, bridges and communities against brute force on small graphs."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from lodeline.graph import EvidenceGraph
from lodeline.operators import bridges, clusters, routes
from lodeline.schema import ENTITY, EVIDENCE, RELATIONSHIP, conform


def graph_of(spark, edges, nodes=(), kinds=None):
    kinds = kinds or {}
    ids = sorted({x for a, b, _ in edges for x in (a, b)} | set(nodes))
    e = spark.createDataFrame([(i, kinds.get(i, "PERSON")) for i in ids], "id string, entity_type string")
    r = spark.createDataFrame([(f"R{k}", a, "USES", b, c, [f"E{k}"]) for k, (a, b, c) in enumerate(edges)], "id string, source_id string, relationship string, target_id string, confidence double, evidence_ids array<string>")
    return EvidenceGraph(conform(e, ENTITY), conform(r, RELATIONSHIP), conform(spark.createDataFrame([], "evidence_id string"), EVIDENCE))


def random_graph(seed, n, m):
    rng = random.Random(seed)
    return [(f"N{rng.randrange(n):02}", f"N{rng.randrange(n):02}", rng.choice([None, 0.5, 0.6, 0.7, 0.7, 0.8, 0.9])) for _ in range(m)]


def simple_paths(edges, source, depth, directed=False):
    best = defaultdict(float)
    for a, b, c in edges:
        if a != b:
            for x, y in ((a, b),) if directed else ((a, b), (b, a)):
                best[x, y] = max(best[x, y], 1.0 if c is None else c)
    out, todo = defaultdict(list), [([source], 1.0)]
    while todo:
        path, conf = todo.pop()
        for (x, y), c in best.items():
            if x == path[-1] and y not in path:
                step = ([*path, y], min(conf, c))
                out[y].append(step)
                if len(step[0]) <= depth:
                    todo.append(step)
    return out


@pytest.mark.parametrize("seed,n,m,depth,directed", [(1, 14, 22, 6, False), (2, 9, 30, 4, False), (3, 12, 30, 6, True), (4, 20, 15, 3, False)])
@pytest.mark.parametrize("by", ["hops", "confidence"])
def test_search_is_the_best_of_all_simple_paths(spark, seed, n, m, depth, directed, by):
    edges = random_graph(seed, n, m)
    g = graph_of(spark, edges, [f"N{i:02}" for i in range(n)])
    ends = spark.createDataFrame([(f"N{i:02}",) for i in range(3)] + [("N00",), ("absent",)], "id string")
    got = routes.search(routes.links(g, directed), ends, g.entities.select("id"), depth, by).collect()
    want = {}
    for s in ("N00", "N01", "N02"):
        for t, found in simple_paths(edges, s, depth, directed).items():
            key = (lambda p: (len(p[0]), -p[1], "->".join(p[0]))) if by == "hops" else (lambda p: (-p[1], len(p[0]), "->".join(p[0])))
            path, conf = min(found, key=key)
            want[s, t] = (len(path) - 1, conf, "->".join(path))
    assert {(r["source_id"], r["target_id"]): (r["hop_count"], r["confidence"], r["path"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed,n,m", [(5, 30, 60), (6, 30, 20), (7, 3, 0), (8, 40, 400)])
def test_bottlenecks_are_those_of_the_strongest_routes(spark, seed, n, m):
    edges = random_graph(seed, n, m)
    links = routes.links(graph_of(spark, edges, [f"N{i:02}" for i in range(n)]))
    trees = routes.forest(links)
    strong = {}
    for a, b, c in edges:
        if a != b:
            strong[tuple(sorted((a, b)))] = max(strong.get(tuple(sorted((a, b))), 0), 1.0 if c is None else c)
    part, kept = {f"N{i:02}": f"N{i:02}" for i in range(n)}, {}
    find = lambda x: x if part[x] == x else find(part[x])
    for (a, b), c in sorted(strong.items(), key=lambda e: (-e[1], e[0])):
        if find(a) != find(b):
            part[find(a)] = find(b)
            kept[a, b] = c
    assert {(r["src"], r["dst"]): r["confidence"] for r in trees.edges.collect()} == kept
    pairs = [(f"N{a:02}", f"N{b:02}") for a, b in combinations(range(n), 2)] + [("N00", "N00"), ("N00", "N01")]
    got = {(r["source_id"], r["target_id"]): r["confidence"] for r in routes.bottlenecks(trees, spark.createDataFrame(pairs, "source_id string, target_id string")).collect()}
    want = {}
    for s in {a for a, _ in pairs}:
        reach = {s: 1.0}
        while True:
            more = {(y, min(reach[x], c)) for (a, b), c in strong.items() for x, y in ((a, b), (b, a)) if x in reach and min(reach[x], c) > reach.get(y, 0)}
            if not more:
                break
            for y, c in more:
                reach[y] = max(reach.get(y, 0), c)
        want |= {(s, t): reach[t] for a, t in pairs if a == s and t != s and t in reach}
    assert got == want
    if kept:
        one = spark.createDataFrame([("N00",)], "id string")
        rest = spark.createDataFrame([(f"N{i:02}",) for i in range(n)], "id string")
        assert {r["target_id"]: r["confidence"] for r in routes.tree_routes(trees, one, rest).collect()} == {t: c for (s, t), c in want.items() if s == "N00"}


@pytest.mark.parametrize("hub", [1000, 3])
def test_bridges_of_all_cases(spark, hub):
    rng = random.Random(9)
    cases, people, phones = ([f"{k}{i:02}" for i in range(n)] for k, n in (("C", 14), ("P", 7), ("T", 5)))
    edges = [(p, c, 0.5) for c in cases for p in rng.sample(people, rng.choice([1, 1, 1, 2]))] + [(p, t, rng.choice([0.6, 0.7, 0.9])) for p in people for t in rng.sample(phones, 2)]
    g = graph_of(spark, edges, ["C99"], {c: "CASE" for c in [*cases, "C99"]})
    links, ids = routes.links(g), g.entities.where("entity_type = 'CASE'").select("id")
    member = {r["case_id"]: r["class_id"] for r in bridges.classes(links, ids).collect()}
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    assert member == {c: min(d for d in cases if near[d] == near[c]) for c in cases}
    got = bridges.between_classes(links, ids, hub).collect()
    pairs = {(r["first_class"], r["second_class"]): r for r in got if r["kind"] == "CLASSES"}
    strength = {(a, b): c for x, y, c in edges for a, b in ((x, y), (y, x))}
    label = defaultdict(dict)
    for k in set(member.values()):
        own = {c for c in cases if member[c] == k}
        for a in near[k]:
            label[a][k] = (0, 1.0)
        for a in near[k]:
            for x in near[a] - own - near[k]:
                label[x][k] = (1, max(label[x].get(k, (1, 0))[1], strength[a, x]))
    crowds = {x: len(ks) for x, ks in label.items()}
    want = {}
    for x, ks in label.items():
        if crowds[x] <= hub:
            for a, b in combinations(sorted(ks), 2):
                way = (2 + ks[a][0] + ks[b][0], -min(ks[a][1], ks[b][1]), x)
                want[a, b] = min(want.get((a, b), way), way)
    size = Counter(member.values())
    assert {k: (r["hop_count"], -r["confidence"], r["via"]) for k, r in pairs.items() if k[0] != k[1]} == want
    assert all(r["case_pairs"] == size[a] * size[b] for (a, b), r in pairs.items() if a != b)
    hubs = {r["via"]: r["case_pairs"] for r in got if r["kind"] == "HUB"}
    assert hubs == {x: sum(size[a] * size[b] for a, b in combinations(ks, 2)) for x, ks in label.items() if len(ks) > hub}
    if hub == 1000:  # every two cases that a path of four steps joins
        joined = {(a, b) for a, b in combinations(cases, 2) if b in simple_paths(edges, a, 4)}
        shown = {(a, b) for a, b in combinations(cases, 2) if tuple(sorted((member[a], member[b]))) in pairs}
        assert joined == shown
    else:
        assert {r["node"] for r in bridges.hub_members(links, ids, hub).collect()} == set(hubs)


def test_label_propagation(spark):
    rng = random.Random(11)
    edges = [(f"A{i}", f"A{j}", 0.9) for i, j in combinations(range(5), 2)] + [(f"B{i}", f"B{j}", 0.7) for i, j in combinations(range(5), 2)] + [("A0", "B0", 0.5)]
    edges += [(f"X{rng.randrange(12)}", f"X{rng.randrange(12)}", 0.8) for _ in range(30)]
    g = graph_of(spark, edges, ["alone"], {"A1": "CASE", "A2": "CASE", "B1": "PHONE"})
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {"alone"})
    weight = Counter()
    for a, b, _ in edges:
        if a != b:
            weight[a, b] += 1
            weight[b, a] += 1
    label = {x: x for x in nodes}
    for k in range(clusters.ROUNDS):
        votes = defaultdict(Counter)
        for (a, b), n in weight.items():
            if (hashlib.md5(a.encode()).hexdigest() >= "8") == k % 2:
                votes[a][label[b]] += n
        label |= {x: min(v, key=lambda j: (-v[j], j)) for x, v in votes.items()}
    labels = clusters.propagated(g)
    assert {r["id"]: r["label"] for r in labels.collect()} == label
    assert label["A3"] == label["A4"]
    found = {r["community"]: r for r in clusters.communities(g, labels=labels).collect()}
    size = Counter(label.values())
    assert set(found) == {k for k, n in size.items() if n > 1}
    for k, r in found.items():
        inner = [c for a, b, c in edges if label[a] == label[b] == k]
        outer = sum((label[a] == k) != (label[b] == k) for a, b, _ in edges)
        assert (r["members"], r["internal_edges"], r["external_edges"]) == (size[k], len(inner), outer)
        assert r["modularity"] == pytest.approx(len(inner) / len(edges) - ((2 * len(inner) + outer) / 2 / len(edges)) ** 2, abs=1e-7)
        assert r["confidence"] == pytest.approx(sum(inner) / max(len(inner), 1), abs=1e-4) and 0 <= r["density"] <= 1 and r["evidence"] == len(inner)
        assert r["classification"] == ("COMMUNICATION_RING" if inner else "POTENTIAL_GROUP")
    one = found[label["A3"]]
    assert one["linked_cases"] == 2 and one["cross_case"]
    roles = {r["id"]: r for r in clusters.members(g, labels=labels).collect()}
    assert roles["A3"]["inside"] == 4 and roles["A3"]["role"] == "CORE" and "alone" not in roles
    assert {tuple(r) for r in clusters.shared_assets(g, labels).collect()} == {(label["B1"], "PHONE", 1)}
    with pytest.raises(KeyError):
        clusters.detail(clusters.members(g, labels=labels), "nothing")


def test_rounds_deal_out_numbers_in_the_order_of_ids(spark):
    g = graph_of(spark, [("B", "A", 0.9), ("C", "C", 0.9), ("B", "C", 0.9)], ["D"], {})
    names = clusters._names(g)
    assert [r["id"] for r in names.orderBy("n").collect()] == ["A", "B", "C", "D"]
    ends = clusters._ends(clusters._linked(g, names))
    assert {kind for _, kind in ends.dtypes} == {"bigint"} and ends.count() == 6
    assert {kind for _, kind in clusters._spread(names, ends, 1).dtypes} == {"bigint"}


def test_rounds_of_the_forest_are_of_numbers(spark):
    trees = routes.forest(routes.links(graph_of(spark, random_graph(6, 30, 60), [f"N{i:02}" for i in range(30)]), directed=True))
    assert trees.rounds and all(dict(r.dtypes) == {"part": "bigint", "into": "bigint", "confidence": "double"} for r in trees.rounds)


@pytest.mark.parametrize("n,block,few", [(1_010, 256, 127), (40, 3, 127), (40, 3, 5)])
def test_no_size_of_a_crowd_leaves_pairs_out(spark, monkeypatch, n, block, few):
    """Few or many different confidences and beginnings of ids, and more classes than blocks hold."""
    monkeypatch.setattr(bridges, "BLOCK", block)
    monkeypatch.setattr(bridges, "FEW", few)
    people = [f"P{i:04}" for i in range(n)]
    case = {p: f"K\n{i}\n" if i % 20 == 3 else f"C{i}" for i, p in enumerate(people)}
    strength = {p: round(0.5 + i / 4_000, 4) for i, p in enumerate(people)}
    g = graph_of(spark, [(p, case[p], 0.9) for p in people] + [(p, "T", strength[p]) for p in people], (), {c: "CASE" for c in case.values()})
    ids = g.entities.where("entity_type = 'CASE'").select("id")
    got = bridges.between_classes(g.edges().select("src", "dst", "confidence"), ids)
    of = {case[p]: strength[p] for p in people}
    want = {(a, b): ("CLASSES", 4, min(of[a], of[b]), "T", 1) for a, b in combinations(sorted(of), 2)}
    assert {(r["first_class"], r["second_class"]): (r["kind"], r["hop_count"], r["confidence"], r["via"], r["case_pairs"]) for r in got.collect()} == want
