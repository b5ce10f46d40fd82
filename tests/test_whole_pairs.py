"""Corners that share planes, each pair once and dealt evenly."""

import itertools
import random

from pyspark.sql import functions as F

from strataspark.operators import graph


def test_pairs_of_corners_come_once_and_dealt(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(3), 3 + rng.randrange(2), 5 + rng.randrange(2)]) for i in range(150)]
    rows += [(150, [1, 1, 2]), (151, [1, 2, 1]), (152, [1, 1, 2])]
    two = lambda t: {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])}
    want = sorted((i, j) for (i, p), (j, q) in itertools.combinations(rows, 2) if two(p) & two(q))
    told = graph.share_two(spark.createDataFrame(rows, "corner long, planes array<int>"))
    assert sorted(tuple(r) for r in told.collect()) == want
    same = graph.share_two(spark.createDataFrame([(i, [1, 2, 3]) for i in range(200)], "corner long, planes array<int>"))
    parts = [r["n"] for r in same.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 19900 and len(parts) > 1 and max(parts) < 0.7 * sum(parts)
