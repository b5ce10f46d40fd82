"""The trusted target takes every document labelled good."""

from pyspark.sql import functions as F

from strataspark.llm import quality_rules


def test_target_has_no_bound(spark):
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert set(quality_rules.ratio_table(docs, labels)) == {0.0}
    mixed = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), (F.col("id") % 17).cast("string"), F.lit(" end")).alias("text"))
    some = mixed.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    assert quality_rules.ratio_table(mixed, some, part=9) == quality_rules.ratio_table(mixed, some) != [0.0] * quality_rules.BUCKETS
