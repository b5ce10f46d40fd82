"""Quantiles without one task that holds all values."""

import random

from pyspark.sql import functions as F

from strataspark.operators import analysis


def test_quantiles_are_those_of_percentile(spark):
    rng = random.Random(3)
    for values in ([7.5], [1.0, 1.0, 2.0], [round(rng.uniform(0, 50), 1) for _ in range(997)] + [None]):
        df = spark.createDataFrame([(v,) for v in values], "y double")
        for share in (0.0, 0.25, 0.9, 1.0):
            assert analysis.quantile_of(df, "y", share).first()["q"] == df.agg(F.percentile("y", F.lit(share))).first()[0]
    assert "percentile" not in analysis.score_cut(df, "y", quantile=0.9)._jdf.queryExecution().toString()
    assert analysis.quantile_of(df.limit(0), "y", 0.5).first()["q"] is None
