"""Components, spanning forests and signs against brute force, on long paths too."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import facets, graph


def test_path_of_100000_nodes(spark):
    path = spark.range(99_999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(path)
    assert got.count() == 100_000 and got.where("component <> 0").count() == 0
    mixed = F.pmod(F.col("id") * 48_271, F.lit(99_991))  # the same path with its nodes out of order
    ring = spark.range(99_990).select(mixed.alias("a"), F.pmod((F.col("id") + 1) * 48_271, F.lit(99_991)).alias("b"))
    assert graph.components(ring).select("component").distinct().count() == 1


def test_components_with_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (5, 9), (9, 7)], "a long, b long")
    assert sorted(map(tuple, graph.components(edges).collect())) == [(1, 1), (2, 1), (5, 5), (7, 5), (9, 5)]
    nodes = spark.createDataFrame([(1,), (3,), (4,), (4,), (None,)], "node long")
    assert sorted(map(tuple, graph.components(edges, nodes).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (7, 5), (9, 5)]
    assert graph.components(edges.limit(0)).count() == 0


def kruskal(edges):
    parent, out = {}, []

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for w, a, b in sorted(edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b, w))
    return sorted(out)


def test_spanning_forest(spark):
    rng = random.Random(2)
    rows = {(min(a, b), max(a, b)): rng.randrange(20) / 4 for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(400)) if a != b}
    df = spark.createDataFrame([(b, a, w) for (a, b), w in rows.items()], "a long, b long, w double")
    want = kruskal([(w, a, b) for (a, b), w in rows.items()])
    assert sorted(map(tuple, graph.spanning_forest(df).collect())) == want
    assert sorted(map(tuple, graph.spanning_forest(df, most_small=10_000).collect())) == want


@pytest.mark.parametrize("deep", [3, 400])
def test_signs(spark, deep):
    rng = random.Random(4)
    sign, rows = {}, []
    for tree in range(3):
        for k in range(deep):
            node = tree * 1000 + k
            if not k:
                sign[node] = 1
                continue
            up, flip = node - 1 if deep > 100 else tree * 1000 + rng.randrange(k), rng.choice((1, -1))
            sign[node] = sign[up] * flip
            rows.append((up, node, flip) if k % 2 else (node, up, flip))
    tree = spark.createDataFrame(rows, "a long, b long, flip int")
    roots = spark.createDataFrame([(0,), (1000,), (2000,), (7777,)], "node long")
    assert {r.node: r.sign for r in graph.signs(tree, roots).collect()} == sign | {7777: 1}


def test_orientation(spark):
    """Normals of a sphere's cap, some turned round, come out on one side."""
    rng = np.random.default_rng(5)
    p = rng.normal((0, 0, 2.5), 0.5, (120, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    turned = p * np.where(rng.random(120) < 0.5, -1, 1)[:, None]
    normals = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(turned)], "pid long, x double, y double, z double")
    near = spark.createDataFrame([(i, j) for i in range(120) for j in np.argsort(-(p @ p[i]))[1:7].tolist()], "a long, b long")
    got = {r.pid: r.sign for r in facets.propagate_orientation(normals, near).collect()}
    up = np.array([turned[i] * got[i] for i in range(120)])
    assert len(got) == 120 and (up[:, 2] > 0).all()


def test_maximal_cliques_of_random_graphs(spark):
    """Against plain branching over the whole graph, for sizes, isolated parts and repeated edges."""
    rng = random.Random(5)
    for n, share in ((14, 0.5), (40, 0.25), (25, 0.7)):
        pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < share] + [(100, 101), (101, 102), (102, 100), (200, 201)]
        adjacent = {}
        for a, b in pairs:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
        edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:20]] + [(3, 3)], "a int, b int")
        for least in (2, 3, 4):
            got = graph.maximal_cliques(edges, least).collect()
            assert sorted(sorted(r.clique) for r in got) == sorted(graph.cliques_of(adjacent, least))
            assert all(r.component == 100 for r in got if r.clique[0] >= 100 and r.clique[0] < 200)
        taken = graph.exclusive_cliques(edges).collect()
        members = [v for r in taken for v in r.clique]
        assert len(members) == len(set(members)) and all(len(r.clique) >= 3 for r in taken) and [100, 101, 102] in [sorted(r.clique) for r in taken]


def test_segments_that_meet_within_their_tolerance(spark):
    """The tolerance is one of the segments' parameters, so long segments reach further than it across their boxes."""
    from strataspark.operators.pairs import segment_hits

    ends = [(1, 0.0, 0.0, 100.0, 100.0), (2, 100.05, 100.1, 200.0, 0.0), (3, 100.3, 100.6, 200.0, 150.0)]
    rows = spark.createDataFrame([(i, (a, b, 0.0), (c, d, 0.0)) for i, a, b, c, d in ends], "id long, p1 struct<x:double,y:double,z:double>, p2 struct<x:double,y:double,z:double>")
    assert {tuple(r) for r in segment_hits(rows, 5.0).collect()} == {(1, 2)}


def test_crossing_segments_come_once_without_a_shuffle_of_pairs(spark):
    """Segments of very unlike lengths, points among them: a pair is told in one of the cells that both are in."""
    import random

    from strataspark.operators.pairs import segment_hits

    rng = random.Random(12)
    ends = [(i, *(p := (rng.uniform(-9, 9), rng.uniform(-9, 9))), *(c + rng.uniform(-1, 1) * rng.choice([0.3, 2, 15]) for c in p)) for i in range(120)] + [(200, 1.0, 1.0, 1.0, 1.0)]
    rows = spark.createDataFrame([(i, (a, b, 0.0), (c, d, 0.0)) for i, a, b, c, d in ends], "id long, p1 struct<x:double,y:double,z:double>, p2 struct<x:double,y:double,z:double>")

    def cross(p, q):
        dx1, dy1, dx2, dy2 = p[3] - p[1], p[4] - p[2], q[3] - q[1], q[4] - q[2]
        det = dx1 * dy2 - dy1 * dx2
        if abs(det) <= 1e-12:
            return False
        t, k = ((q[1] - p[1]) * dy2 - (q[2] - p[2]) * dx2) / det, ((q[1] - p[1]) * dy1 - (q[2] - p[2]) * dx1) / det
        return -1e-3 <= t <= 1.001 and -1e-3 <= k <= 1.001

    want = sorted((p[0], q[0]) for p in ends for q in ends if p[0] < q[0] and cross(p, q))
    told = segment_hits(rows, 5.0)
    assert len(want) > 100 and sorted(map(tuple, told.collect())) == want
    assert "Aggregate" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert segment_hits(rows.where("id < 0"), 5.0).count() == 0 and segment_hits(rows.where("id = 200"), 5.0).count() == 0
