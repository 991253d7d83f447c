from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from tarn.operators import communities

SCHEMA = "a long, b long, weight double"


def planted(groups: int, size: int, edges: int, inside: float, seed: int) -> dict[tuple[int, int], float]:
    draw, out = random.Random(seed), {}
    while len(out) < edges:
        x = draw.randrange(groups * size)
        y = x // size * size + draw.randrange(size) if draw.random() < inside else draw.randrange(groups * size)
        if x != y:
            out[min(x, y), max(x, y)] = float(draw.randint(1, 3))
    return out


def quality(edges: dict, labels: dict, resolution: float) -> float:
    m = sum(edges.values())
    ends, inside = Counter(), 0.0
    for (x, y), w in edges.items():
        ends[labels[x]] += w
        ends[labels[y]] += w
        inside += w * (labels[x] == labels[y])
    return inside / m - resolution * sum(e * e for e in ends.values()) / (4 * m * m)


def sequential(edges: dict, resolution: float) -> dict:
    """Node after node, level after level."""
    level, member = dict(edges), {n: n for e in edges for n in e}
    doubled = 2 * sum(edges.values())
    while True:
        near: dict = defaultdict(Counter)
        strength = Counter()
        for (x, y), w in level.items():
            strength[x] += w
            strength[y] += w
            if x != y:
                near[x][y] += w
                near[y][x] += w
        label, total = {n: n for n in strength}, Counter(strength)
        moved = True
        while moved:
            moved = False
            for n in sorted(strength):
                votes = Counter()
                for other, w in near[n].items():
                    votes[label[other]] += w
                total[label[n]] -= strength[n]
                worth = lambda c: votes[c] - resolution * strength[n] * total[c] / doubled  # noqa: B023, E731
                best = max(votes, key=lambda c: (worth(c), -c), default=label[n])
                if worth(best) > worth(label[n]) + 1e-9:
                    label[n], moved = best, True
                total[label[n]] += strength[n]
        member = {n: label[c] for n, c in member.items()}
        if len(set(label.values())) == len(label):
            return member
        fresh = Counter()
        for (x, y), w in level.items():
            fresh[min(label[x], label[y]), max(label[x], label[y])] += w
        level = dict(fresh)


def frame(spark, edges: dict):
    return spark.createDataFrame([(x, y, w) for (x, y), w in edges.items()], SCHEMA)


def labels_of(df) -> dict:
    rows = df.collect()
    out = {r.node: r.community for r in rows}
    assert len(out) == len(rows)
    return out


def pieces(edges: dict, labels: dict) -> dict:
    """Least node of each connected part of a community."""
    up = {n: n for n in labels}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for x, y in edges:
        if labels[x] == labels[y]:
            i, j = sorted((top(x), top(y)))
            up[j] = i
    return {n: top(n) for n in labels}


def test_as_good_as_the_sequential_search_and_finer_with_the_resolution(spark):
    edges = planted(25, 60, 10_000, 0.7, 4)
    df, counts = frame(spark, edges).cache(), []
    for resolution in (1.0, 4.0):
        got = labels_of(communities.louvain(df, resolution))
        assert set(got) == {n for e in edges for n in e}
        assert pieces(edges, got) == got  # connected, and named by the least node
        assert quality(edges, got, resolution) >= 0.98 * quality(edges, sequential(edges, resolution), resolution)
        row = communities.modularity(df, spark.createDataFrame(list(got.items()), "node long, community long"), resolution).first()
        assert row.modularity == pytest.approx(quality(edges, got, resolution), abs=1e-9) and row.communities == len(set(got.values()))
        counts.append(len(set(got.values())))
    assert counts[1] > counts[0] >= 10


def test_contraction_against_plain_sums(spark):
    edges = planted(4, 12, 200, 0.6, 8)
    label = {n: n % 5 for e in edges for n in e}
    links = communities.both_ways(frame(spark, edges), "a", "b", "weight").withColumnRenamed("weight", "w")
    strength = Counter()
    for (x, y), w in edges.items():
        strength[x] += w
        strength[y] += w
    nodes = spark.createDataFrame([(n, 0.5, strength[n], c) for n, c in label.items()], "node long, loop double, strength double, community long")
    
    out_links, out_nodes = communities.contracted(links, nodes)
    between, inner, total = Counter(), Counter(), Counter()
    for (x, y), w in edges.items():
        if label[x] == label[y]:
            inner[label[x]] += w
        else:
            between[label[x], label[y]] += w
            between[label[y], label[x]] += w
    for n, c in label.items():
        inner[c] += 0.5
        total[c] += strength[n]
    assert {(r.node, r.near): r.w for r in out_links.collect()} == between
    assert {r.node: (r.loop, r.strength, r.community) for r in out_nodes.collect()} == {c: (inner[c], total[c], c) for c in total}


def test_odd_edges(spark):
    """Loops, parallel edges, nulls and weights that are not above 0, a hub, no edges at all."""
    rows = [(1, 2, 1.0), (2, 1, 1.0), (1, 1, 2.0), (3, 3, 1.0), (None, 4, 1.0), (4, 5, None), (5, 6, -1.0), (5, 7, 0.0), (8, 9, 1.0)]
    assert labels_of(communities.louvain(spark.createDataFrame(rows, SCHEMA))) == {1: 1, 2: 1, 3: 3, 8: 8, 9: 8}
    assert communities.louvain(spark.createDataFrame([], SCHEMA)).collect() == []
    star = {(0, k): 1.0 for k in range(1, 400)}
    assert set(labels_of(communities.louvain(frame(spark, star))).values()) == {0}


def test_names_as_nodes(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0)], "a string, b string, weight double")
    assert labels_of(communities.louvain(df)) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_components_against_union_find(spark):
    draw = random.Random(2)
    edges = {(draw.randrange(900), draw.randrange(900)): 1.0 for _ in range(500)} | {(k, k + 1): 1.0 for k in range(1000, 1300)} | {(2000, 2000): 1.0}
    got = {r.node: r.component for r in communities.components(frame(spark, edges).union(spark.createDataFrame([(None, 5, 1.0)], SCHEMA))).collect()}
    assert got == pieces(edges, {n: 0 for e in edges for n in e})
