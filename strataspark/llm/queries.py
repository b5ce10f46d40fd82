"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataspark.llm import decontaminate, jaccard, line_dedup, merkle, mixing, quality_classifier, quality_rules, secrets, substring_dedup, suffix_dedup, url_filter, warc
from strataspark.llm.base import Store, materialize, shared_folder, table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join's own output: each document's number of links."""
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_bytes(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_words(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.train(secrets.samples(spark), secrets.corpus_samples(docs)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are removed once their records are read."""
    folder = shared_folder(spark, "warc")
    records = materialize(warc.archive(table(spark, sf_dir, "pages"), folder))
    warc.remove(folder)
    return records


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's levels are removed once the manifest is whole."""
    store = Store(spark, "merkle")
    try:
        return materialize(merkle.report(table(spark, sf_dir, "documents"), store))
    finally:
        store.clear()


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "line-dedup")
    try:
        return materialize(line_dedup.report(table(spark, sf_dir, "documents"), store))
    finally:
        store.clear()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_ngram_jaccard, op2_ngram_jaccard_links, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_quality_classifier, op6_url_filter, op7_quality_rules, op8_substring_dedup, op9_secret_scan, op10_warc, op11_merkle_manifest, op12_line_dedup)}
ORACLES: dict[str, str] = {"op1_source_mixing": mixing.MIX_SQL.format(docs="documents"), "op2_ngram_jaccard": jaccard.CLUSTER_SQL, "op2_ngram_jaccard_links": jaccard.LINKS_SQL, "op6_url_filter": url_filter.JUDGE_SQL, "op11_merkle_manifest": merkle.REPORT_SQL, "op12_line_dedup": line_dedup.REPORT_SQL}
