"""The methods themselves: recall of the fingerprints, held-out secrets, ids of WARC records, clashing columns."""

import random

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from strataspark.llm import decontaminate, jaccard, mixing, quality_classifier, secrets, warc
from strataspark.llm.base import shared_folder


def test_recall_of_fingerprints():
    """Windows of edited items against a search without fingerprints."""
    rng = random.Random(11)
    items = [" ".join(f"q{rng.randrange(3000)}" for _ in range(rng.randrange(15, 70))) for _ in range(60)]
    texts = []
    for k in range(400):
        w = items[k % 60].split()
        for _ in range(rng.randrange(3)):
            w[rng.choice((rng.randrange(3), len(w) - 1 - rng.randrange(3)))] = "edit"
        texts.append(" ".join([f"x{rng.randrange(500)}" for _ in range(rng.randrange(40))] + w + ["tail"] * rng.randrange(20)))
    index = decontaminate.index_items(list(range(60)), items)
    found = total = 0
    for k, text in enumerate(texts):
        alone = decontaminate.index_items([0], [text])
        h, n = alone.shingles[0], int(alone.words[0])
        hits = np.flatnonzero(np.isin(h, index.vocabulary))
        exact = decontaminate.match_text(h, index, hits, n, 0.8, decontaminate.BITS)
        got = decontaminate.match_text(h, index, hits, n, 0.8, decontaminate.RADIUS)
        item = k % 60
        width = len(items[item].split()) - 4
        brute = any(decontaminate.weighted_similarity(h[p : p + width], index.shingles[item]) >= 0.8 for p in range(max(1, len(h) - width + 1)))
        assert brute == (item in {x for x, _, _ in exact}) and {x for x, _, _ in got} <= {x for x, _, _ in exact}
        total += brute
        found += item in {x for x, _, _ in got}
    assert total > 150 and found >= 0.9 * total


def test_fingerprints_of_unrelated_texts_are_far():
    rng = np.random.default_rng(1)
    prints = decontaminate.fingerprints(rng.integers(-9, 10, (2000, 64)))
    assert decontaminate.near(prints[:200], prints[200:]).mean() < 0.002


def test_held_out_secrets(spark):
    """Precision and recall on tokens that no model has seen, and on ordinary tokens of the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    corpus = secrets.corpus_samples(docs)
    weights = secrets.train(secrets.samples(spark), corpus)
    fresh = secrets.samples(spark, 9000).where(F.length("token") >= 20).join(secrets.samples(spark, 4000).select("token"), "token", "left_anti")
    told = fresh.select("random", (secrets.markov_score(F.col("token"), weights) > 0.4).alias("hit")).groupBy("random", "hit").count().collect()
    n = {(r.random, r.hit): r["count"] for r in told}
    right, wrong, missed = n.get((True, True), 0), n.get((False, True), 0), n.get((True, False), 0)
    assert right > 500 and right / (right + wrong) > 0.97 and right / (right + missed) > 0.97
    plain = corpus.where("NOT random AND length(token) >= 12").select((secrets.markov_score(F.col("token"), weights) > 0.4).alias("hit"))
    assert plain.count() > 0 and plain.where("hit").count() <= 0.02 * plain.count()
    assert corpus.where("random").count() > 0 and secrets.corpus_samples(docs.limit(0)).count() == 0


def test_warc_revisits_name_records(spark):
    rows = [(k, f"http://a/{k}", "<p>same</p>" if k % 2 else f"<p>{k}</p>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = shared_folder(spark, "warc-ids")
    files = warc.write_archives(warc.planned(pages), _made(folder)).collect()
    ids, named = {}, {}
    for f in files:
        fs, path = pafs.FileSystem.from_uri(f.path)
        with fs.open_input_stream(path, compression=None) as stream:
            for raw in warc.split_records(warc.inflated(stream)):
                headers, _, _ = warc.parse(raw)
                assert ids.setdefault(headers["warc-record-id"], headers["x-page-id"]) == headers["x-page-id"]
                if "warc-refers-to" in headers:
                    named[headers["x-page-id"]] = headers["warc-refers-to"]
    assert len(ids) == 20 and len(named) == 9 and {ids[x] for x in named.values()} == {"19"}
    warc.remove(folder)


def _made(folder):
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return folder


CLASH = ("x", "score", "size", "k1", "k2", "held_out", "predicted", "target", "taken", "n_shingles", "_spans", "_hits", "_before", "node", "key", "v0", "n_words", "source_size")


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(6)
    text = lambda n: "Plain words of a calm text, " + " ".join(f"w{rng.randrange(500)}" for _ in range(n)) + "."
    rows = [(k, text(30 + k), "en", f"s{k % 3}", 7) for k in range(40)]
    rows += [(100 + k, rows[k][1], "en", "s1", 7) for k in range(5)] + [(3, rows[3][1], "en", "s0", 7), (50, None, None, None, None), (51, "", "en", "s0", 0), (52, "token = abcdefghij0123456789", "en", "s0", 28), (None, text(25), "en", None, 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def test_stages_with_clashing_columns(spark, clashing):
    stages = pytest.importorskip("corpus_pipeline").STAGES
    docs = clashing
    for name, stage in stages:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        none = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert none.count() == 0 and none.columns == got.columns
        rows = got.collect()
        assert rows, name
        if name == "mix":
            made = {"size", "source_size", "target", "taken"}
            assert set(got.columns) == set(docs.columns) | made and all(r[c] == f"own {c}" for r in rows for c in CLASH if c not in made)
        else:
            assert got.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in CLASH)
        # the pipeline gives each stage what the one before it wrote; the first stage's verdicts need no more than that
        docs = spark.createDataFrame(rows, got.schema) if name != "mix" else docs


def test_keep_of_operators(spark, clashing):
    assert jaccard.cluster(clashing, keep=("text", "k1", "node")).columns == ["doc_id", "text", "k1", "node", "n_shingles", "component_id"]
    kept = mixing.mix(clashing, keep=("source", "key", "size")).collect()
    assert all(r.key == "own key" and r["size"] != "own size" for r in kept) and len(kept) == clashing.count()
    out = quality_classifier.classify(clashing, None, keep=("x", "score"))
    assert out.columns == ["doc_id", "x", "held_out", "score", "predicted"] and out.where("x <> 'own x'").count() == 0
