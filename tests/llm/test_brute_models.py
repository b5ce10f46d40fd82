"""The learned operators and the pipeline's stages against plain Python: statistics and densities, hashed n-grams,
Markov chains, and what each stage keeps."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from test_ops import brute_components, brute_spans, make_docs, words

import corpus_pipeline
from strataspark.llm import quality_classifier, quality_rules, secrets

SF = "/root/testdata/sf0.001"


def statistics(text):
    t = text or ""
    n, w = max(len(t), 1), words(t)
    lines = [x for x in t.split("\n") if x]
    some, found = max(len(w), 1), max(len(lines), 1)
    count = lambda p: math.sqrt(len(regex.findall(p, t)) / n)
    return [math.log1p(len(w)), math.log1p(sum(map(len, w)) / some), math.sqrt(len(set(w)) / some), math.sqrt((len(lines) - len(set(lines))) / found), count(r"[#*$%&<>@\\^~_={}\[\]]"), count(r"\p{Lu}"), count(r"[0-9]"), count(r"\|"), count(r"[!?]"), count(r"[.,;:]"), math.log1p(n / found), math.exp(-len(w) / 20)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def scores(rows, quality, shrinkage=0.05):
    """Probability of class 1 by the two Gaussians, computed with the full matrices."""
    x = np.array([statistics(t) for _, t in rows])
    groups = [np.array([v for v, (i, _) in zip(x, rows, strict=True) if i in quality and quality[i] == c and not held(i)]) for c in (0, 1)]
    total = sum(map(len, groups))
    cov = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * np.diag(c) for g, c in zip(groups, cov, strict=True)) / total + 1e-6
    logs = []
    for g, c in zip(groups, cov, strict=True):
        sigma = (1 - shrinkage) * c + shrinkage * np.diag(pooled) + 1e-9 * np.eye(len(pooled))
        d = x - g.mean(axis=0)
        logs.append(math.log(len(g) / total) - np.linalg.slogdet(sigma)[1] / 2 - np.einsum("ij,ij->i", d @ np.linalg.inv(sigma), d) / 2)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


@pytest.fixture(scope="module")
def corpus(spark):
    """The smallest documents beside odd rows: nulls, ties, repeated rows, a very long text, columns that clash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    odd = [(10_000 + k, t, None, None, None) for k, t in enumerate([None, "", "\n\n", "A", "same text here", "same text here", "word " * 30_000, "é😀 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "AKIA" + "Q7Z1X9" * 4])]
    odd += [(10_004, "same text here", None, None, None), (None, "a row without an id", "en", "s", 1), (None, None, None, None, None)]
    rows += odd
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return spark.createDataFrame([(*r, "clash", 7.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, bucket double").repartition(5), rows, labels


def test_classifier(spark, corpus):
    docs, rows, labels = corpus
    want = scores([r[:2] for r in rows], labels)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = Counter((r.doc_id, r.held_out, round(r.score, 5), r.predicted) for r in quality_classifier.classify(docs, model).collect())
    assert got == Counter((i, held(i), round(float(s), 5), int(s >= 0.7)) for (i, *_), s in zip(rows, want, strict=True))


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed


def grams(text):
    t = regex.findall(quality_rules.TOKEN, text or "")
    return [spark_hash(x) % 4096 for x in t] + [spark_hash(*x) % 4096 for x in zip(t, t[1:], strict=False)]


def test_quality_rules(spark, corpus):
    docs, rows, labels = corpus
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if labels.get(i) == 1:
            target.update(grams(t))
    all_raw, all_target = sum(raw.values()) + 4096, sum(target.values()) + 4096
    weight = lambda b: math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw)
    ratio = {}
    for i, t, *_ in rows:
        g = grams(t)
        ratio.setdefault((i, len(words(t))), sum(map(weight, g)) / max(len(g), 1))
    got = quality_rules.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(got) == len(rows) and {r.kept for r in got} == {True, False}
    for r in got:
        assert r.llr == pytest.approx(ratio[r.doc_id, r.n_words], abs=2e-6)
        assert r.kept == (not r.base_failed and r.llr >= -0.25)


def chain(counts):
    """Smoothed log probabilities of a first-order chain from counts of pairs."""
    n = len(secrets.ALPHABET)
    m = np.ones((n, n))
    for (a, b), k in counts.items():
        m[secrets.ALPHABET.index(a), secrets.ALPHABET.index(b)] += k
    return m / m.sum(axis=1, keepdims=True)


def weights_of(tables):
    means = []
    for label in (False, True):
        models = []
        for table in tables:
            pairs = Counter()
            for token, random, n in table:
                if random == label:
                    for a, b in zip(token, token[1:], strict=False):
                        if a in secrets.ALPHABET and b in secrets.ALPHABET:
                            pairs[a, b] += n
            if pairs:
                models.append(chain(pairs))
        means.append(sum(models) / len(models))
    return np.log(means[1]) - np.log(means[0])


def spans_of(text, weights):
    t = text or ""
    base = brute_spans(t)
    taken = [tuple(map(int, s.split(":")[1:])) for s in base]
    out = [(int(s.split(":")[1]), k, s) for k, kind in enumerate(("assign", "access", "hex")) for s in base if s.startswith(kind)]
    for m in regex.finditer(secrets.TOKEN, t):
        if not any(s < m.end() and m.start() < e for s, e in taken):
            at = [secrets.ALPHABET.index(c) for c in m[0]]
            if sum(weights[a, b] for a, b in zip(at, at[1:], strict=False)) / (len(at) - 1) > 0.4:
                out.append((m.start(), 3, f"markov:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def planted(rows):
    """Some texts get a random token that no pattern finds, others an ordinary one."""
    rng = random.Random(3)
    names = ["getUserNameFromServerRequest", "release_version_number_update", "current-session-manager-cache", "-" * 40, "=" * 24, "2024-11-28-00012345-000017"]
    token = lambda k: names[k // 2 % 6] if k % 2 else "".join(rng.choice(secrets.ALPHABET[:64]) for _ in range(24 + k % 17))
    return [(i, t if t is None or k % 9 else f"{t} é {token(k)} end", *rest) for k, (i, t, *rest) in enumerate(rows)]


def test_secrets(spark, corpus):
    _, rows, _ = corpus
    rows = planted(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made, seen = secrets.samples(spark), secrets.corpus_samples(docs)
    tables = [[(r.token, r.random, 1) for r in made.collect()], [(r.token, r.random, r.n) for r in seen.collect()]]
    learned = Counter()
    for i, t, *_ in rows:  # what the corpus gives: found by the patterns, or of texts where they find nothing
        if not held(i):
            hits = [m for kind, (p, g, least) in secrets.KINDS for m in regex.findall(p.replace("(?i:", "(?ai:"), t or "") for m in ([m[g - 1]] if isinstance(m, tuple) else [m]) if len(m) >= least]
            learned.update([(m, True) for m in hits] or [(m, False) for m in regex.findall(secrets.TOKEN.replace("{20,}", "{8,}"), t or "")])
    assert {(a, b): n for a, b, n in tables[1]} == {k: n for k, n in learned.items() if k[1] or n >= 5}
    want = weights_of(tables)
    weights = secrets.train(made, seen)
    assert np.allclose(np.array(weights).reshape(want.shape), want)
    got = Counter((r.doc_id, r.spans) for r in secrets.report(docs, weights).collect())
    assert got == Counter((i, spans_of(t, want)) for i, t, *_ in rows)
    hidden = {i: t for (i, t, *_), (_, before, *_) in zip(rows, corpus[1], strict=True) if t != before}
    random_ones = {i for i, t in hidden.items() if not regex.search("getUser|release_version|current-session|-----|=====|2024-11", t)}
    told = {i for i, s in got if "markov" in s}
    assert len(random_ones) > 8 and len(told & random_ones) >= 0.9 * len(random_ones) and not told - random_ones


def test_stage_quality(spark, corpus):
    docs, rows, labels = corpus
    kept = scores([r[:2] for r in rows], labels) >= 0.7
    got = corpus_pipeline.keep_quality(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter((*r, "clash", 7.0) for r, k in zip(rows, kept, strict=True) if k)


def test_stage_near_copies(spark):
    rows = make_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, t long, size string, key string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    least, want = {}, []
    for (i, _, component), row in zip(brute_components(rows, 5, 80), rows, strict=True):
        empty = not words(row[1])
        if empty or i is None or (i == component and component not in least):
            want.append(row)
            least.setdefault(component, i)
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r[0]) for r in want)


def test_stage_secrets(spark, corpus):
    _, rows, _ = corpus
    rows = planted(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = weights_of([[(r.token, r.random, 1) for r in secrets.samples(spark).collect()], [(r.token, r.random, r.n) for r in secrets.corpus_samples(docs).collect()]])

    def masked(text):
        if text is None:
            return None
        out, at = "", 0
        found = sorted((tuple(map(int, s.split(":")[1:])) for s in spans_of(text, weights).split(",") if s))
        for s, e in found:
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        return out + text[at:]

    want = [(i, masked(t), lang, source, n if masked(t) == t else len(masked(t))) for i, t, lang, source, n in rows]
    got = corpus_pipeline.mask_secrets(spark, docs, SF)
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(a != b for a, b in zip(want, rows, strict=True)) > 5


def test_stages_of_nothing(spark, corpus):
    docs = corpus[0].drop("score", "bucket").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
