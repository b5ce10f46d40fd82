"""A cloud's planes are extracted however many they are."""

import random

from strataspark.operators import ransac


def test_extract_all_has_no_bound_of_planes(spark):
    # 24 parallel planes of distinct sizes, far apart beside the threshold; no other plane holds many of the points
    rng = random.Random(4)
    rows = [(100 * k + i, rng.uniform(0, 10), rng.uniform(0, 10), 100.0 * k) for k in range(24) for i in range(30 + k)]
    cloud = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    found = ransac.extract_all(cloud, 0.02, 4000, share=0.02, stop=0).collect()
    assert len(found) == 24 and sorted(r.inliers for r in found) == list(range(30, 54))


def test_planes_of_packs_are_those_of_points(spark):
    """Groups in several packs: counts by numpy, and draws by a bound of hashes, give the planes of all points."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(g, 1000 * g + i, rng.uniform(0, 10), rng.uniform(0, 10), rng.choice([0.0, 3.0, rng.uniform(0, 10)])) for g, n in ((0, 700), (1, 90), (2, 2)) for i in range(n)]
    cloud = spark.createDataFrame(rows, "g int, pid long, x double, y double, z double").repartition(3)
    packs = ransac.packs(cloud, ["g"], most=60)
    sizes = packs.groupBy("g").agg(F.sum(F.size("points")).alias("left"))
    assert {r.g: r.left for r in sizes.collect()} == {0: 700, 1: 90, 2: 2} and packs.count() > 12
    told = lambda df: sorted((r.g, r.iter, r.inliers, round(r.a, 9), round(r.d, 9)) for r in df.collect())
    for sample in (40, None):
        want = told(ransac.best_planes(cloud, ["g"], 0.1, 60, 5, strict=True, sample=sample))
        assert len(want) == 2 and told(ransac.best_of_packs(packs, sizes, ["g"], 0.1, 60, 5, sample)) == want
