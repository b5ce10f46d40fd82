"""Secret scans: three patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns give the base spans. Long tokens that no base span touches are scored by the two models: the mean over
the token's pairs of neighbouring characters of log p(next | this) under the model of random strings, less the same
under the model of identifiers. Tokens over the threshold become further spans of kind markov.

Both models are first-order chains over the characters that tokens can hold, counted by Spark from labelled samples
and smoothed by adding one. The weights are a table of fixed size. Samples are the tokens of the corpus itself (what the
base patterns find is random, tokens of documents where they find nothing are ordinary if they are found often enough,
for a secret that the patterns miss is found once or twice; a quarter of the documents is held out for measuring), beside
samples made by rule: encoded digests of counters as random strings, and names composed
of common words, ruled lines and dates with numbers as ordinary ones. Each kind of sample has the same part in a model.

Spans count code points, end exclusive. Defined cases: a null text is empty; empty texts have no spans and the digest
of the empty string; repeated rows give repeated rows; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.base import carried, carry, let

#: Patterns, with the group whose length counts and its least length. Fixed values.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12)
ACCESS = (r"(AKIA[A-Z0-9]+)", 1, 18)
HEX = (r"([0-9a-f]+)", 1, 16)
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
#: What tokens are made of. Fixed value.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Parts of the identifiers that the sample generator composes. Fixed values.
PARTS = (
    "get", "set", "user", "name", "value", "index", "count", "total", "file", "path", "list", "item", "data", "table", "column", "row", "key", "config", "option", "default", "server", "client", "request", "response", "handler", "manager",
    "service", "factory", "builder", "parser", "reader", "writer", "buffer", "stream", "message", "event", "listener", "thread", "process", "memory", "cache", "session", "account", "address", "number", "string", "object", "array", "version",
    "release", "update", "delete", "create", "insert", "select", "order", "group", "member", "window", "button", "image", "color", "height", "width", "length", "start", "finish", "first", "last", "next", "previous", "current", "parent", "child",
)


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of the pattern's matches as array of struct(s, e, k): what splitting leaves gives the places."""
    gaps, found, measured = (F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("k"))))).otherwise(a["out"]).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), measured.alias("part"))
    placed = F.aggregate(F.slice(zipped, 1, F.size(found)), start, step)["out"]
    return placed


def _pattern(kind: str) -> tuple[str, int, int]:
    pattern, group, least = dict(KINDS)[kind]
    if kind != "assign":  # a run of a class either is long enough or holds no match
        head = pattern[1:-2]
        fixed = len("AKIA") if kind == "access" else 0
        pattern = f"({head}{{{least - fixed},}})"
    return pattern, group, least


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    parts = []
    for k, (kind, _) in enumerate(KINDS):
        pattern, group, least = _pattern(kind)
        parts.append(F.when(text.rlike(pattern), _spans(text, pattern, k, group, least)).otherwise(none))
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))


def samples(spark: SparkSession, each: int = 4000) -> DataFrame:
    """(token, random): `each` strings of either label, made by rule."""
    i = F.col("id").cast("string")
    digests = F.array(F.sha1(i), F.base64(F.unhex(F.sha2(i, 256))), F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("k"), i), 512))), 1, 40), F.concat(F.lit("AKIA"), F.upper(F.substring(F.conv(F.substring(F.md5(i), 1, 15), 16, 36), 1, 12))))
    random = spark.range(each).select(F.element_at(digests, (F.col("id") % 4 + 1).cast("int")).alias("token"), F.lit(True).alias("random"))
    word = lambda n: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.floor(F.col("id") / n), F.lit(len(PARTS))) + 1).cast("int"))
    a, b, c = word(1), word(7), word(61)
    id_ = F.col("id")
    rule = F.repeat(F.element_at(F.array(*map(F.lit, "-_=/+")), (F.floor(id_ / 9) % 5 + 1).cast("int")), (20 + id_ % 21).cast("int"))
    numbers = F.concat_ws("-", (1900 + id_ % 200).cast("string"), F.lpad((id_ % 12 + 1).cast("string"), 2, "0"), F.lpad((id_ % 28 + 1).cast("string"), 2, "0"), F.lpad((id_ * 7919 % 100000).cast("string"), 8, "0"), F.lpad(id_.cast("string"), 6, "0"))
    names = F.array(F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", a, b, c), F.concat(a, b, c), F.concat_ws("/", a, b, c), F.concat(F.initcap(a), F.initcap(b), F.initcap(c), (id_ % 10).cast("string")), rule, numbers)
    plain = spark.range(each).select(F.element_at(names, (id_ % 9 + 1).cast("int")).alias("token"), F.lit(False).alias("random"))
    return random.unionByName(plain)


def corpus_samples(docs: DataFrame, least: int = 8, common: int = 5) -> DataFrame:
    """(token, random, n): tokens of all documents but the held-out ones (crc32 of doc_id mod 4 = 2) with their number of
    occurrences. What the base patterns find is labelled random; tokens of `least` characters or more of documents
    without any base span are labelled ordinary where there are `common` of them or more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.where(~F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))).select(text.alias("text"))
    hits = []
    for kind, (_, group, _) in KINDS:
        pattern, _, size = _pattern(kind)
        of = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        hits.append((F.col("text").rlike(pattern), F.filter(of, lambda t, size=size: F.length(t) >= size)))
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(has, tokens).otherwise(none) for has, tokens in hits])
    plain = F.regexp_extract_all("text", F.lit(f"({TOKEN.replace('{20,}', f'{{{least},}}')})"), F.lit(1))
    told = seen.withColumn("found", found).select((F.size("found") > 0).alias("random"), F.when(F.size("found") > 0, F.col("found")).otherwise(plain).alias("tokens"))
    return told.select("random", F.explode("tokens").alias("token")).groupBy("random", "token").agg(F.count("*").alias("n")).where(F.col("random") | (F.col("n") >= common)).select("token", "random", "n")


def train(*labelled: DataFrame) -> list[float]:
    """Tables (token, random, n if there are counts) -> log ratio for each pair of characters, row by row over the
    alphabet. A model is the mean of the tables' models, so that none drowns another by its size; a table without tokens
    of a label has no part in it."""
    n = len(ALPHABET)
    models: list[list[list[float]]] = [[], []]
    for table in labelled:
        weighted = table.withColumn("n", F.lit(1)) if "n" not in table.columns else table
        pairs = weighted.select("random", "token", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.length("token") - 1, F.lit(1)))).alias("i")).where(F.length("token") > 1)
        pairs = pairs.select("random", "n", F.expr(f"instr('{ALPHABET}', substring(token, i, 1)) - 1").alias("a"), F.expr(f"instr('{ALPHABET}', substring(token, i + 1, 1)) - 1").alias("b")).where("a >= 0 AND b >= 0")
        counts = [[1.0] * (n * n) for _ in range(2)]
        some = [False, False]
        for row in pairs.groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect():  # at most 2 x 67 x 67 rows
            counts[bool(row.random)][row.a * n + row.b] += row.n
            some[bool(row.random)] = True
        for label in (0, 1):
            if some[label]:
                rows = [sum(counts[label][k * n : k * n + n]) for k in range(n)]
                models[label].append([c / rows[i // n] for i, c in enumerate(counts[label])])
    means = [[sum(p) / len(p) for p in zip(*m, strict=True)] if m else [1 / n] * (n * n) for m in models]
    return [math.log(r) - math.log(p) for p, r in zip(*means, strict=True)]


def markov_score(token: Column, weights: list[float]) -> Column:
    """Mean log ratio a pair of characters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")
    at = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    total = lambda p: F.aggregate(
        p, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), lambda a, x: F.struct((a["sum"] + F.when((a["last"] >= 0) & (x >= 0), F.get(table, a["last"] * len(ALPHABET) + x)).otherwise(0.0)).alias("sum"), x.alias("last"))
    )["sum"] / F.greatest(F.size(p) - 1, F.lit(1))
    return let(at, total)


def markov_spans(text: Column, base: Column, weights: list[float], threshold: float) -> Column:
    """Spans of tokens over the threshold that touch no base span."""
    none = F.array().cast("array<struct<s:int,e:int,k:int>>")
    found = F.filter(
        _spans(text, f"({TOKEN})", len(KINDS), 1, 20),
        lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])) & (markov_score(F.substring(text, c["s"] + 1, c["e"] - c["s"]), weights) > threshold),
    )
    return F.when(text.rlike(TOKEN), found).otherwise(none)


def scan(docs: DataFrame, weights: list[float], threshold: float = 0.4, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, base and all spans as arrays of struct(s, e, k), by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    by_start = lambda x: F.array_sort(x, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))

    def both(base: Column) -> Column:
        return F.struct(base.alias("base"), by_start(F.concat(base, markov_spans(text, base, weights, threshold))).alias("spans"))

    return docs.select("doc_id", *keep, let(base_spans(text), both).alias("r")).select("doc_id", *keep, "r.base", "r.spans")


def rendered(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, _ in KINDS], F.lit("markov"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, weights: list[float], threshold: float = 0.4) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs, weights, threshold)
    count = lambda k: F.size(F.filter(F.col("base"), lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(KINDS)], F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, weights: list[float], threshold: float = 0.4, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span of their texts replaced by the mask, other columns as they were (n_chars is
    counted anew where a text changed). Null texts stay null."""
    columns, own = docs.columns, ("text", "n_chars")
    docs = carry(docs, *own)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("*", let(base_spans(text), lambda b: F.array_sort(F.concat(b, markov_spans(text, b, weights, threshold)), lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).otherwise(x["e"] - y["e"]))).alias("_spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), out.alias("out"))

    cut = let(F.aggregate("_spans", start, step), lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.lit(2**31 - 1) - a["at"])))
    changed = F.size("_spans") > 0
    out = found.withColumn("text", F.when(changed, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return carried(out, columns, tuple(c for c in own if c in columns))
