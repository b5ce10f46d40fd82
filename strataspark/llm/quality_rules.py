"""Quality rules: counts that a reader of the text would make, and a hashed n-gram log-likelihood ratio.

Tokens (runs of letters and digits, runs of other marks) and pairs of them are hashed into a fixed number of buckets. Two multinomials over the buckets are counted:
that of the raw corpus (every document) and that of a trusted target (every document labelled good). A document's ratio is the mean over its n-grams of the log of
target share over raw share; documents whose mean is under the threshold are not kept.

The ids of good documents are sent to the executors in parts of bounded size; from the second part on, each part is a
pass of its own that reads only its documents' tokens. The buckets' weights are a table of fixed size (2^12 numbers), so they may go into the plan as a literal. Everything
else stays in one scan without a shuffle of texts.

Defined cases: a null text has no words; without labels the ratio is 0 for every text and the base rules decide;
repeated rows each count; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.base import let, words

BUCKETS = 4096
SYMBOLS = r"[#*$%&|<>]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"


def _window_hashes(w: Column, width: int = 5) -> Column:
    return F.when(
        F.size(w) >= width,
        F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, width: int = 5) -> Column:
    """Number of words in windows whose hash is found twice or more."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
    total = lambda at: F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total(let(placed, repeated)))


def repeat_words(w: Column, width: int = 5) -> Column:
    return let(_window_hashes(w, width), lambda h: _covered(h, width))


def base_rules(text: Column, w: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w).cast("long"),
    }


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and runs of other characters between them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def grams(w: Column) -> Column:
    """Buckets of the tokens and of the pairs of neighbouring tokens."""
    return F.concat(
        F.transform(w, lambda x: _bucket(x)),
        F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: _bucket(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<int>")),
    )


def ratio_table(docs: DataFrame, labels: DataFrame, part: int = 500_000) -> list[float]:
    """log(target share / raw share) for each bucket, both with one added to every count. part: about how many ids
    of good documents are broadcast at once."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted_id")).distinct()
    parts = max(1, math.ceil(trusted.count() / part))
    texts = docs.select("doc_id", "text")

    def tally(k: int, how: str) -> list:
        flags = F.broadcast(trusted.where(F.pmod(F.xxhash64("trusted_id"), F.lit(parts)) == k))
        tallied = texts.join(flags, F.col("doc_id") == F.col("trusted_id"), how).select(F.col("trusted_id").isNotNull().alias("good"), F.explode(let(tokens(F.col("text")), grams)).alias("bucket"))
        return tallied.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum(F.col("good").cast("long")).alias("target")).collect()  # at most BUCKETS rows

    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for k in range(parts):
        for row in tally(k, "left" if k == 0 else "inner"):
            raw[row.bucket] += row.raw if k == 0 else 0
            target[row.bucket] += row.target
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    total = math.log(sum(target)) - math.log(sum(raw))
    return [math.log(t) - math.log(r) - total for t, r in zip(target, raw, strict=True)]


def ratio(t: Column, weights: list[float]) -> Column:
    """Mean log ratio of a text's n-grams; 0 without any."""
    literal = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(literal, x)) / F.greatest(F.size(b), F.lit(1))
    return let(grams(t), total)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.25) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr."""
    weights = ratio_table(docs, labels)

    def judged(w: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in base_rules(F.col("text"), w).items()], let(tokens(F.col("text")), lambda t: ratio(t, weights)).alias("llr"))

    rows = docs.select("doc_id", let(words(F.col("text")), judged).alias("r")).select("doc_id", "r.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
