"""The spanning tree takes all planes: held to brute force."""

import numpy as np
import pytest

from strataspark.plans import geometry


def brute_tree(p):
    """Weights of a minimum spanning tree of all pairs, by Prim."""
    w = np.round(1 - np.abs(p @ p.T), 9)
    best, done, out = w[0].copy(), np.zeros(len(p), dtype=bool), []
    done[0] = True
    for _ in range(len(p) - 1):
        k = int(np.argmin(np.where(done, np.inf, best)))
        out.append(best[k])
        done[k] = True
        best = np.minimum(best, w[k])
    return out


def test_spanning_tree_takes_all_planes(spark):
    rng = np.random.default_rng(3)
    # two far bunches, so that the first bound leaves several components
    p = np.vstack([rng.normal((9, 0, 0), 1, (70, 3)), -rng.normal((0, 9, 0), 1, (50, 3))])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid long, x double, y double, z double")
    tree = geometry.axis_tree(rows).collect()
    assert len(tree) == 119 and sum(r.w for r in tree) == pytest.approx(sum(brute_tree(p)), abs=1e-7)


def test_spanning_tree_query_counts_all_planes(spark):
    n = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert n > 40 and geometry.g2_spanning_tree(spark, "/root/testdata/sf0.01").first().edges == n - 1
