"""How many directions the normals of a group have: spherical k-means for one, two and three, for all groups at once.

A group's starts are picked from a bounded sample of it, which a hash chooses, by farthest points; all starts of all
groups go through a round together, in one aggregation of sums that tasks combine before the shuffle. Silhouettes under
the cosine distance need only each cluster's sum and size, so no pairs are formed. A group may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.vec import unit, vec
from strataspark.operators.graph import cut_lineage
from strataspark.operators.prototype import to_hemisphere
from strataspark.operators.ransac import sampled

XYZ = ("x", "y", "z")
_VECTOR = "struct<x: double, y: double, z: double>"


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _apart(a: Column, b: Column) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"])


def _starts(normals: DataFrame, by: list[str], key: str, ks: tuple[int, ...], inits: int, seed: int) -> DataFrame:
    """by, k, init, centers: the first center is the init-th of the sample, each next one the point of the sample
    farthest from those before."""
    most = 8 * inits
    few = sampled(normals, by, most, seed, key).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", *XYZ))).alias("s"))  # `most` entries
    few = few.select(*by, F.transform("s", lambda e: F.struct(*[e[a].alias(a) for a in XYZ])).alias("s"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("init")) for k in ks for i in range(inits)])).alias("c"))
    rows = few.select(*by, "c.k", "c.init", "s").withColumn("centers", F.array(F.get("s", F.pmod("init", F.size("s")))))
    for n in range(2, max(ks) + 1):
        nearest = lambda p: F.array_min(F.transform("centers", lambda c: _apart(p, c)))
        far = F.array_max(F.transform("s", lambda p: F.struct(nearest(p).alias("d"), p.alias("p"))))["p"]  # noqa: B023
        rows = rows.withColumn("centers", F.when(F.col("k") >= n, F.concat("centers", F.array(far))).otherwise(F.col("centers")))
    return rows.drop("s")


def _assigned(normals: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """normals, once for each start of their group: k, init, cluster, far (squared distance)."""
    packed = now.groupBy(*by).agg(F.collect_list(F.struct("k", "init", "centers")).alias("starts"))  # the group's starts
    p = F.struct(*[F.col(a).alias(a) for a in XYZ])
    best = lambda s: F.array_min(F.transform(s["centers"], lambda c, i: F.struct(_apart(p, c).alias("far"), i.alias("cluster"))))
    told = F.transform("starts", lambda s: F.struct(s["k"].alias("k"), s["init"].alias("init"), best(s).alias("b")))
    rows = normals.join(packed, by).withColumn("t", F.explode(told))
    return rows.drop("starts").select("*", "t.k", "t.init", F.col("t.b.cluster").alias("cluster"), F.col("t.b.far").alias("far")).drop("t")


def clusters(normals: DataFrame, by: list[str], ks: tuple[int, ...] = (2, 3), inits: int = 10, rounds: int = 15, seed: int = 0, key: str = "pid") -> DataFrame:
    """by, k, centers: for each group of unit normals (by, key, x, y, z) and each k the centers of least inertia among
    the starts. An empty cluster keeps its center."""
    now = cut_lineage(_starts(normals, by, key, ks, inits, seed))
    for _ in range(rounds):
        sums = _assigned(normals, now, by).groupBy(*by, "k", "init", "cluster").agg(F.count("*").alias("m"), *[F.sum(a).alias(a) for a in XYZ])
        packed = sums.groupBy(*by, "k", "init").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct(*[(F.col(a) / F.col("m")).alias(a) for a in XYZ])))).alias("moved"))  # k entries
        joined = now.join(packed, [*by, "k", "init"])
        centers = F.transform("centers", lambda c, i: F.coalesce(F.try_element_at("moved", i), c))
        now = cut_lineage(joined.select(*by, "k", "init", centers.cast(f"array<{_VECTOR}>").alias("centers")))
    inertia = _assigned(normals, now, by).groupBy(*by, "k", "init").agg(F.sum("far").alias("inertia"))
    best = now.join(inertia, [*by, "k", "init"]).groupBy(*by, "k").agg(F.min_by("centers", F.struct(F.round("inertia", 9), "init")).alias("centers"))
    return cut_lineage(best)


def evaluate(normals: DataFrame, by: list[str], inits: int = 10, rounds: int = 15, single: float = 0.85, least: float = 0.35, seed: int = 0, key: str = "pid") -> tuple[DataFrame, DataFrame]:
    """(groups, labels) of normals (by, key, x, y, z), which are made unit vectors and turned to one side of each group.

    groups: by, n, best_k, score, kind, is_clustered, proportions, pair_angles (degrees), centers (unit vectors, the
    largest cluster first). k = 1 scores the mean cosine to the mean direction; k = 2 and 3 the silhouette under the
    cosine distance, -1 where only one cluster has points. The greatest score is the best, the lesser k in a tie.
    labels: by, key, label (place of the center)."""
    given, by = by, [f"by{n}_" for n in range(len(by))]  # names of its own: those of the groups may be any
    u = unit(vec(*XYZ))
    named = normals.select(*[F.col(c).alias(b) for c, b in zip(given, by, strict=True)], F.col(key).alias("key_"), *[c.alias(a) for a, c in zip(XYZ, u.parts(), strict=True)])
    own, key = key, "key_"
    rows = cut_lineage(to_hemisphere(named, by))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in XYZ])
    mean = F.struct(*[c.alias(a) for a, c in zip(XYZ, unit(vec(*XYZ)).parts(), strict=True)])
    one = whole.select(*by, F.lit(1).alias("k"), vec(*XYZ).norm().alias("score"), F.array(mean).cast(f"array<{_VECTOR}>").alias("centers"))
    found = clusters(rows, by, (2, 3), inits, rounds, seed, key)
    told = cut_lineage(_assigned(rows, found.withColumn("init", F.lit(0)), by).select(*by, key, *XYZ, "k", "cluster"))
    sums = told.groupBy(*by, "k", "cluster").agg(F.count("*").alias("m"), *[F.sum(a).alias(f"s{a}") for a in XYZ])
    packed = sums.groupBy(*by, "k").agg(F.collect_list(F.struct("cluster", "m", "sx", "sy", "sz")).alias("s"))  # k entries
    dot = lambda e: F.col("x") * e["sx"] + F.col("y") * e["sy"] + F.col("z") * e["sz"]
    joined = told.join(packed, [*by, "k"]).withColumn("_own", F.filter("s", lambda e: e["cluster"] == F.col("cluster"))[0])
    inner = F.when(F.col("_own.m") > 1, (F.col("_own.m") - dot(F.col("_own"))) / (F.col("_own.m") - 1))
    outer = F.array_min(F.transform(F.filter("s", lambda e: e["cluster"] != F.col("cluster")), lambda e: 1 - dot(e) / e["m"]))
    width = F.when(F.size("s") < 2, -1.0).otherwise(F.coalesce((outer - inner) / F.greatest(inner, outer, F.lit(1e-15)), F.lit(0.0)))
    scored = joined.withColumn("_w", width).groupBy(*by, "k").agg(F.avg("_w").alias("score")).join(found, [*by, "k"]).select(*by, "k", "score", "centers")
    best = one.unionByName(scored).groupBy(*by).agg(F.max_by(F.struct("k", "score", "centers"), F.struct(F.round("score", 12), (-F.col("k")).alias("n"))).alias("b"))
    best = cut_lineage(best.select(*by, F.col("b.k").alias("best_k"), F.col("b.score").alias("score"), "b.centers"))
    labelled = _assigned(rows, best.select(*by, F.lit(0).alias("k"), F.lit(0).alias("init"), "centers"), by).select(*by, key, "cluster")
    counts = labelled.groupBy(*by, "cluster").agg(F.count("*").alias("m"))
    sizes = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "m"))).alias("m"))  # three entries
    normed = lambda c: F.struct(*[(c[a] / F.greatest(F.sqrt(_dot(c, c)), F.lit(1e-12))).alias(a) for a in XYZ])
    entry = F.transform("centers", lambda c, i: F.struct((-F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("less"), i.alias("cluster"), normed(c).alias("c")))
    ordered = cut_lineage(best.join(sizes, by).join(whole.select(*by, "n"), by).withColumn("o", F.array_sort(entry)))
    angle = lambda a, b: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b)))))
    pairs = F.flatten(F.transform("o", lambda p, i: F.transform(F.slice("o", i + 2, F.size("o")), lambda q: angle(p["c"], q["c"]))))
    groups = ordered.select(
        *by, "n", "best_k", "score", F.when(F.col("best_k") == 1, "dispersion").otherwise("silhouette").alias("kind"), F.when(F.col("best_k") == 1, F.col("score") >= single).otherwise(F.col("score") >= least).alias("is_clustered"),
        F.transform("o", lambda e: -e["less"] / F.col("n")).alias("proportions"), pairs.alias("pair_angles"), F.transform("o", lambda e: e["c"]).alias("centers"),
    )
    places = ordered.select(*by, F.posexplode("o").alias("label", "e")).select(*by, "label", F.col("e.cluster").alias("cluster"))
    back = [F.col(b).alias(c) for c, b in zip(given, by, strict=True)]
    return groups.select(*back, *[c for c in groups.columns if c not in by]), labelled.join(places, [*by, "cluster"]).select(*back, F.col(key).alias(own), "label")


#: Colours of the first, second and third cluster, by parts of 255, and of what has none. A choice of ours.
LABEL_COLOURS = ((230, 80, 60), (60, 160, 230), (80, 200, 120))
NO_LABEL = (170, 170, 170)


def label_colours(label: Column) -> list[Column]:
    """red, green, blue of a label, repeating."""
    pick = lambda k: F.coalesce(F.element_at(F.array(*[F.lit(c[k]) for c in LABEL_COLOURS]), F.pmod(label, F.lit(len(LABEL_COLOURS))).cast("int") + 1), F.lit(NO_LABEL[k]))
    return [pick(k).cast("int").alias(name) for k, name in enumerate(("red", "green", "blue"))]


def text_of(groups: DataFrame) -> DataFrame:
    """groups with proportions, pair_angles and centers as text of fixed decimals, parted by ';'."""
    joined = lambda c, form: F.array_join(F.transform(c, lambda v: F.format_string(form, v)), ";")
    centers = F.array_join(F.transform("centers", lambda c: F.format_string("%.5f,%.5f,%.5f", c["x"], c["y"], c["z"])), ";")
    return groups.withColumns({"proportions": joined("proportions", "%.4f"), "pair_angles_deg": joined("pair_angles", "%.2f"), "centers": centers}).drop("pair_angles")

