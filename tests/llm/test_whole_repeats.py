"""Repeated passages beside many copies: texts that a bitmap takes for copies are read like all others."""

import random

import pytest
from pyspark.sql import functions as F

from strataspark.llm import substring_dedup, suffix_dedup

PASSAGES, COPIES = 300, 4000


@pytest.fixture(scope="module")
def beside_copies(spark):
    """Pairs of texts that share a passage, and 4,000 short texts that occur twice, which take a sixteenth of 65,536 bits."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    rows = [(i, f"copy {i % COPIES}") for i in range(2 * COPIES)]
    for k in range(PASSAGES):
        passage = " ".join(word() for _ in range(40))
        rows += [(10_000 + 2 * k + side, f"{word()} {word()} {passage} {word()}") for side in (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8).persist()


def test_bytes_beside_copies(beside_copies):
    got = suffix_dedup.kept_bytes(beside_copies).where("doc_id >= 10000").select("n_removed").collect()
    assert len(got) == 2 * PASSAGES and all(r.n_removed >= 40 * 8 - 1 for r in got)


def test_words_beside_copies(beside_copies):
    got = substring_dedup.kept_words(beside_copies).where("doc_id >= 10000").groupBy("n_removed").agg(F.count("*").alias("n")).collect()
    assert [(r.n_removed, r.n) for r in got] == [(40, 2 * PASSAGES)]
