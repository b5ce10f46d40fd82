"""Robustness tables: parameters in file names, merges with a manifest, and the group-bys behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataspark.operators.graph import cut_lineage

PARAMS = ("Gno", "Grid", "Sin", "Ben")
#: RGB triples for ids, a choice of ours.
PALETTE = ((230, 25, 75), (60, 180, 75), (255, 225, 25), (0, 130, 200), (245, 130, 48), (145, 30, 180), (70, 240, 240), (240, 50, 230))
GREY = (128, 128, 128)


def name_params(name: Column) -> list[Column]:
    """The numbers after Gno, Grid, Sin and Ben in a file name, in either case; null where there is none."""
    return [F.nullif(F.regexp_extract(name, f"(?i){k}(\\d+)", 1), F.lit("")).cast("int").alias(k.lower()) for k in PARAMS]


def merge_missing(results: DataFrame, manifest: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """results left-joined with the manifest; what results lack is filled from it."""
    other = manifest.select(F.col(on).alias("_on"), *[F.col(c).alias(f"m_{c}") for c in columns])
    joined = results.join(other, F.col(on) == F.col("_on"), "left")
    return joined.select(*[c for c in results.columns if c not in columns], *[F.coalesce(c, f"m_{c}").alias(c) for c in columns])


def mean_std(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def mean_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def heat_map(df: DataFrame, rows: str, columns: str, value: str, known: list) -> DataFrame:
    return df.groupBy(rows).pivot(columns, known).agg(F.avg(value))


def quantile_bands(df: DataFrame, on: str, by: str, value: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), half: int = 10) -> DataFrame:
    """Mean of value by `by` in bands of +-half around the truncated quantiles of `on`."""
    cuts = df.agg(F.percentile(on, F.array(*map(F.lit, quantiles))).alias("q")).select(F.posexplode("q").alias("band", "q")).select("band", F.col("q").cast("int").alias("q"))
    inside = df.join(F.broadcast(cuts), F.col(on).between(F.col("q") - half, F.col("q") + half))  # one row a quantile
    return inside.groupBy("band", "q", by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def quantile_of(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row, q: the interpolated quantile, as percentile() gives it. Values are placed by prefix sums of their counts
    over a range sort, so no task holds all of them."""
    from strataspark.sources.bodies import offsets

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = cut_lineage(offsets(counts, "_v", "_n"))
    at = placed.agg((F.lit(share) * (F.sum("_n") - 1)).alias("_at"))
    ends = placed.crossJoin(F.broadcast(at))
    held = lambda place: F.max(F.when((F.col("offset") <= place) & (F.col("offset") + F.col("_n") > place), F.col("_v")))
    two = ends.agg(held(F.floor("_at")).alias("low"), held(F.ceil("_at")).alias("high"), F.max("_at").alias("_at"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("low") + (F.col("_at") - F.floor("_at")) * F.col("high")
    return two.select(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("q"))


def score_cut(df: DataFrame, score: str, quantile: float | None = None, k: float | None = None) -> DataFrame:
    """Rows of at least a quantile of the score, or the mean less k deviations."""
    limit = quantile_of(df, score, quantile) if quantile is not None else df.agg((F.avg(score) - F.lit(k) * F.stddev_pop(score)).alias("q"))
    return df.crossJoin(F.broadcast(limit.select(F.col("q").alias("_limit")))).where(F.col(score) >= F.col("_limit")).drop("_limit")


def colour(spec: Column) -> Column:
    """struct(r, g, b) of 'RRGGBB' (with or without '#'), 'rgb(r,g,b)' in either case, 'r,g,b' or 'r g b' (0-255, or
    0-1 where no part is over 1), rounded half to even and clipped; grey otherwise."""
    s = F.trim(spec)
    hexed = F.regexp_extract(s, r"^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("int")
    inside = F.coalesce(F.nullif(F.regexp_extract(s, r"^(?i)rgb\(\s*([0-9.]+\s*,\s*[0-9.]+\s*,\s*[0-9.]+)\s*\)$", 1), F.lit("")), s)
    three = r"^([0-9.]+)[,\s]+([0-9.]+)[,\s]+([0-9.]+)$"
    value = lambda i: F.nullif(F.regexp_extract(inside, three, i + 1), F.lit("")).try_cast("double")
    unit = F.greatest(*[value(i) for i in range(3)]) <= 1
    scaled = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.when(unit, value(i) * 255).otherwise(value(i))).cast("int")))
    ok = F.coalesce(value(0).isNotNull() & value(1).isNotNull() & value(2).isNotNull(), F.lit(False))
    grey = F.struct(*[F.lit(c).alias(k) for c, k in zip(GREY, "rgb", strict=True)])
    return F.when(hexed != "", F.struct(*[part(i).alias(k) for i, k in enumerate("rgb")])).when(ok, F.struct(*[scaled(i).alias(k) for i, k in enumerate("rgb")])).otherwise(grey)


def first_seen(df: DataFrame, key: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, number): keys numbered from 0 by their first place in the order."""
    first = df.groupBy(*by, key).agg(F.min(order).alias("_first"))
    return first.select(*by, key, (F.row_number().over(Window.partitionBy(*by).orderBy("_first", key)) - 1).alias("number"))


def palette_index(df: DataFrame, key: str, order: str, n: int = len(PALETTE)) -> DataFrame:
    """(key, colour): the id itself where it is an index of the palette, else the order of first appearance modulo n."""
    return first_seen(df, key, order).select(key, F.when(F.col(key).between(0, n - 1), F.col(key)).otherwise(F.col("number") % n).cast("int").alias("colour"))


def vertex_offsets(bodies: DataFrame, key: str, count: str) -> DataFrame:
    """bodies with offset: the number of vertices of all bodies before, by key."""
    from strataspark.sources.bodies import offsets

    return offsets(bodies, key, count)


def loop_edges(polygons: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, at, i, j): the closed loop of every polygon."""
    n = F.size(ids)
    rows = polygons.select(key, ids, n.alias("n"), F.posexplode(ids).alias("at", "i"))
    return rows.select(key, "at", "i", F.col(ids)[F.pmod(F.col("at") + 1, F.col("n"))].alias("j"))


def distinct_edges(loops: DataFrame) -> DataFrame:
    return loops.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): how often each value occurs in each group. Counts of parts of a table add up to those of the
    whole, and means, deviations and quantiles follow from them."""
    return df.groupBy(*by, value).agg(F.count("*").alias("n"))


def summary_of_counts(counts: DataFrame, by: list[str], value: str, quantiles: dict[str, float], fence: float = 1.5) -> DataFrame:
    """(by, n_rows, n, total, mean, std, quantiles, n_outside) of value_counts(), or of several of them together. A
    quantile q is the least value that a share q of the rows does not exceed; n_outside counts values beyond the
    outermost of the quantiles by more than `fence` times their distance. Rows of a null value are in n_rows alone."""
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = counts.groupBy(*by, value).agg(F.sum("n").alias("n"))
    known = F.col(value).isNotNull()
    weight = F.when(known, F.col("n")).otherwise(F.lit(0))
    total = F.sum(F.col(value) * weight)
    placed = merged.withColumns({"_n": F.sum(weight).over(whole), "_at": F.sum(weight).over(upto), "_mean": total.over(whole) / F.nullif(F.sum(weight).over(whole), F.lit(0))})
    placed = placed.withColumns({f"_{k}": F.min(F.when(known & (F.col("_at") >= q * F.col("_n")), F.col(value))).over(whole) for k, q in quantiles.items()})
    low, high = min(quantiles, key=quantiles.get), max(quantiles, key=quantiles.get)
    reach = fence * (F.col(f"_{high}") - F.col(f"_{low}"))
    outside = known & ((F.col(value) < F.col(f"_{low}") - reach) | (F.col(value) > F.col(f"_{high}") + reach))
    spread = F.sum(weight * (F.col(value) - F.col("_mean")) * (F.col(value) - F.col("_mean")))
    std = F.sqrt(spread / F.nullif(F.sum(weight) - 1, F.lit(0)))
    return placed.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.sum(weight).alias("n"), total.alias("total"), F.first("_mean").alias("mean"), std.alias("std"),
        *[F.first(f"_{k}").alias(k) for k in quantiles], F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_outside"),
    )
