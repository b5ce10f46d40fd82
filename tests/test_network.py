"""Faces and blocks of networks of segments: grids of planes, loose ends, open bodies, and the queries' SQL."""

import itertools
from collections import Counter

import pytest
from tests_common import against_duckdb

from strataspark.operators import network

SF = "/root/testdata/sf0.001"
SEGMENT = "id long, s1 long, s2 long, p1 struct<x: double, y: double, z: double>, p2 struct<x: double, y: double, z: double>"


@pytest.mark.parametrize("name", ["b6_network_faces", "b6_network_blocks", "j15_common_surfaces"])
def test_against_duckdb(spark, name):
    against_duckdb(spark, name, SF)


def grid(cuts):
    """Planes across each axis at the given places, all within their common box, and the segments where two meet."""
    low, high = [c[0] for c in cuts], [c[-1] for c in cuts]
    planes = [(axis, at) for axis in range(3) for at in cuts[axis]]
    segments = []
    for (i, (a, p)), (j, (b, q)) in itertools.combinations(enumerate(planes), 2):
        if a != b:
            free = 3 - a - b
            ends = []
            for end in (low[free], high[free]):
                x = [0.0] * 3
                x[a], x[b], x[free] = p, q, end
                ends.append(tuple(map(float, x)))
            segments.append((len(segments), i, j, *ends))
    return segments, [(i, *[1.0 if k == axis else 0.0 for k in range(3)], -float(at)) for i, (axis, at) in enumerate(planes)]


def made(spark, segments, planes, width=1.5):
    s = spark.createDataFrame(segments, SEGMENT)
    p = spark.createDataFrame(planes, "surface long, a double, b double, c double, d double")
    nodes, edges = network.network(s, width)
    found, sides = network.faces(nodes, edges, p)
    blocks, shells = network.blocks(nodes, found, sides, p)
    return nodes, edges, found, sides, blocks, shells


def test_grid_of_planes(spark):
    """2 x 3 x 1 boxes of different sizes share faces, edges and nodes."""
    cuts = [[0, 1, 3], [0, 2, 2.5, 4], [0, 1.5]]
    nodes, edges, found, sides, blocks, shells = made(spark, *grid(cuts))
    assert nodes.count() == 3 * 4 * 2
    sizes = [[b - a for a, b in itertools.pairwise(c)] for c in cuts]
    want = Counter(round(x * y * z, 6) for x, y, z in itertools.product(*sizes))
    got = blocks.collect()
    assert Counter(round(r.volume, 6) for r in got) == want and all(r.closed and r.n_faces == 6 for r in got)
    areas = Counter(round(x * y, 6) for x, y in itertools.product(sizes[0], sizes[1]) for _ in range(2)) + Counter(round(x * z, 6) for x, z in itertools.product(sizes[0], sizes[2]) for _ in range(4)) + Counter(round(y * z, 6) for y, z in itertools.product(sizes[1], sizes[2]) for _ in range(3))
    assert Counter(round(r.area, 6) for r in found.collect()) == areas and all(r.n == 4 for r in found.collect())
    assert Counter(r["count"] for r in shells.groupBy("face").count().collect())[2] == 7  # inner faces bound two blocks
    assert sides.count() == 4 * found.count() and edges.where("i >= j").count() == 0


def test_loose_ends_and_open_bodies(spark):
    """Segments that end freely bound no face; a box without a lid bounds no block."""
    segments, planes = grid([[0, 1], [0, 1], [0, 1]])
    loose = [(101, 4, 50, (0.5, 0.0, 0.0), (0.5, -3.0, 0.0)), (102, 4, 51, (0.5, 0.0, 0.0), (0.5, 0.4, 0.0))]
    nodes, edges, found, _, blocks, _ = made(spark, segments + loose, planes + [(50, 1.0, 0.0, 0.0, -0.5), (51, 1.0, 0.0, 0.0, -0.5)])
    assert found.count() == 6 and [round(r.volume, 9) for r in blocks.collect()] == [1.0]
    lid = [p for p in planes if p[0] != 5]
    _, _, found, _, blocks, _ = made(spark, segments, lid)
    assert found.count() == 5 and blocks.where("closed").count() == 0
    _, _, found, _, blocks, _ = made(spark, segments[:0], planes)
    assert found.count() == 0 and blocks.count() == 0


def test_oblique_cut(spark):
    """A slanted plane through a cube makes two wedges; surfaces meet at angles other than right ones."""
    segments, planes = grid([[0, 1], [0, 1], [0, 1]])
    # the plane x + z = 1 meets the sides y = 0, y = 1 along diagonals and two edges of the cube
    cut = [(200, 6, 2, (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (201, 6, 3, (1.0, 1.0, 0.0), (0.0, 1.0, 1.0)), (202, 6, 1, (1.0, 0.0, 0.0), (1.0, 1.0, 0.0)), (203, 6, 0, (0.0, 0.0, 1.0), (0.0, 1.0, 1.0))]
    _, _, found, _, blocks, _ = made(spark, segments + cut, planes + [(6, 1.0, 0.0, 1.0, -1.0)])
    assert sorted(round(r.volume, 9) for r in blocks.collect()) == [0.5, 0.5] and all(r.n_faces == 5 and r.closed for r in blocks.collect())
    assert found.where("n = 3").count() == 4


def test_crossings(spark):
    point = lambda *p: tuple(map(float, p))
    rows = [(1, 7, 8, point(0, 0, 0), point(10, 0, 0)), (2, 7, 9, point(4, -1, 0), point(4, 1, 0)), (3, 5, 6, point(5, -1, 0), point(5, 1, 0)), (4, 8, 9, point(6, -1, 1), point(6, 1, 1)), (5, 7, 8, point(10, 0, 0), point(10, 5, 0)), (6, 7, 8, point(2, 0, 0), point(12, 0, 0))]
    got = sorted((r.surface, r.a, r.b, round(r.x, 6), round(r.y, 6)) for r in network.crossings(spark.createDataFrame(rows, SEGMENT), 3.0).collect())
    assert got == [(7, 1, 2, 4.0, 0.0), (7, 1, 5, 10.0, 0.0), (7, 2, 6, 4.0, 0.0), (7, 5, 6, 10.0, 0.0), (8, 1, 5, 10.0, 0.0), (8, 5, 6, 10.0, 0.0)]
