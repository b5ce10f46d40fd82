"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document.

Each class is a Gaussian over the statistics. A class's covariance is shrunk towards the diagonal of the pooled
covariance; its Cholesky factor is inverted once at fitting, so that a document's Mahalanobis distance is a sum of
squares of linear forms. The score is the logistic of the difference of the two log-densities, priors included.

Statistics and scores are built-in expressions in one scan of the texts. Fitting joins the labels with the statistics
only (no text is shuffled), and its moments are sums that Spark pre-aggregates: the driver gets one row a class.

Defined cases: null and empty texts have statistics of 0 and a score; without labels of either class every score is
0.5; repeated rows each count, repeated labels count once a document (the least); an empty table gives an empty
result; extra columns are ignored. Labels, lang, source and doc_id are never statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.base import carried, carry, let, unpacked, words

HELD_OUT_OF, HELD_OUT = 4, 2
NAMES = ("length", "word_length", "distinct", "repeated_lines", "symbols", "upper", "digits", "bars", "shouts", "stops", "line_length", "short_text")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(HELD_OUT_OF)) == HELD_OUT, F.lit(False))


def statistics(text: Column) -> Column:
    """struct of doubles, named NAMES."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.sqrt(F.regexp_count(text, F.lit(pattern)) / n)

    def of(w: Column, lines: Column) -> Column:
        some = F.greatest(F.size(w), F.lit(1))
        found = F.greatest(F.size(lines), F.lit(1))
        values = (
            F.log1p(F.size(w)), F.log1p(F.length(F.array_join(w, "")) / some), F.sqrt(F.size(F.array_distinct(w)) / some), F.sqrt((F.size(lines) - F.size(F.array_distinct(lines))) / found),
            count(r"[#*$%&<>@\\^~_={}\[\]]"), count(r"\p{Lu}"), count(r"[0-9]"), count(r"\|"), count(r"[!?]"), count(r"[.,;:]"), F.log1p(n / found), F.exp(-F.size(w) / 20),
        )
        return F.struct(*[v.cast("double").alias(k) for k, v in zip(NAMES, values, strict=True)])

    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    return let(F.struct(words(text).alias("w"), lines.alias("l")), lambda s: of(s["w"], s["l"]))


@dataclass(frozen=True)
class Model:
    """Per class 0 and 1: log prior less half the log-determinant, mean, inverse of the Cholesky factor."""

    offsets: tuple[float, float]
    means: np.ndarray
    inverses: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.05, label: str = "quality") -> Model | None:
    """The model from all labelled documents that are not held out; None where a class has none."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("_label"))
    stats = docs.where(~held_out(F.col("doc_id"))).select("doc_id", statistics(F.col("text")).alias("x")).select("doc_id", "x.*")
    p = len(NAMES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    # covariance aggregates update means and co-moments together: no difference of large sums
    sums = [F.avg(k).alias(f"s{i}") for i, k in enumerate(NAMES)] + [F.covar_pop(NAMES[i], NAMES[j]).alias(f"m{i}_{j}") for i, j in pairs]
    rows = {r["_label"]: r for r in stats.join(known, "doc_id").groupBy("_label").agg(F.count("*").alias("n"), *sums).collect()}  # a row a class
    if not {0, 1} <= rows.keys():
        return None
    total = rows[0]["n"] + rows[1]["n"]
    means, covs = [], []
    for c in (0, 1):
        r = rows[c]
        mu = np.array([r[f"s{i}"] for i in range(p)])
        cov = np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"m{i}_{j}"]
        means.append(mu)
        covs.append(cov)
    pooled = np.diag(sum(rows[c]["n"] * covs[c].diagonal() for c in (0, 1)) / total) + 1e-6 * np.eye(p)
    offsets, inverses = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * covs[c] + shrinkage * pooled + 1e-9 * np.eye(p))
        inverses.append(np.linalg.inv(factor))
        offsets.append(float(np.log(rows[c]["n"] / total) - np.log(factor.diagonal()).sum()))
    return Model((offsets[0], offsets[1]), np.array(means), np.array(inverses))


def score(x: Column, model: Model | None) -> Column:
    """Probability of class 1 for a struct of statistics."""
    if model is None:
        return F.lit(0.5)
    logs = []
    for c in (0, 1):
        distance = F.lit(0.0)
        for i in range(len(NAMES)):
            form = F.lit(float(-(model.inverses[c][i] @ model.means[c])))
            for j in range(i + 1):
                form = form + F.lit(float(model.inverses[c][i, j])) * x[NAMES[j]]
            distance = distance + form * form
        logs.append(F.lit(model.offsets[c]) - distance / 2)
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), logs[0] - logs[1]))))


def classify(docs: DataFrame, model: Model | None, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, held_out, score, predicted; a kept column of a name that the result has gives way."""
    made = ("held_out", "score", "predicted")
    packed = carry(docs, "doc_id", columns=["doc_id", "text", *[c for c in keep if c != "text"]])
    x = packed.select("*", statistics(unpacked("text")).alias("_x"))
    scored = x.select("*", held_out(F.col("doc_id")).alias("held_out"), score(F.col("_x"), model).alias("score"))
    scored = scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return carried(scored, ["doc_id", *[c for c in keep if c != "doc_id"]], ("doc_id",), *made)
