"""Facets against each other: segments of disks, slabs, mutual inclusion, near points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.vec import cross_xy, in_slab, solve3, vec, vec_of
from strataspark.operators.cluster import chains, places
from strataspark.operators.graph import cut_lineage, dealt
from strataspark.operators.spatial import ball_pairs, inner_cells, radius_join

XYZ = ("x", "y", "z")


def disk_segments(disks: DataFrame, most: float, extension: float = 2.0, key: str = "id") -> DataFrame:
    """a, b, p1, p2, length: the common segment of every two elliptic disks (key, center, n, u, v structs, ra, rb).

    Candidates are disks whose balls overlap (radius: the greater of ra and rb, which is at most `most`, times the extension,
    or as it is where the extension is greater, for no ellipse reaches beyond that ball), and of which each reaches the
    other's plane; the line of the two planes is cut with each ellipse, and the common interval is kept where it is longer than 1e-6."""
    extension = min(extension, 1 + 1e-6)
    disk = F.struct(*[F.col(c) for c in ("center", "n", "u", "v", "ra", "rb")])
    balls = disks.select(key, F.col("center.x").alias("x"), F.col("center.y").alias("y"), F.col("center.z").alias("z"), (F.greatest("ra", "rb") * extension).alias("r"), disk.alias("disk"))
    # disks go with their balls: candidates, which are as many as the square of the disks in a box, are not shuffled
    joined = ball_pairs(balls, key, most * extension)
    reach = lambda p, q: sum((vec_of(f"{q}_disk.n").dot(vec_of(f"{p}_disk.{axis}")) * F.col(f"{p}_disk.{size}")) ** 2 for axis, size in (("u", "ra"), ("v", "rb")))
    for p, q in ("ab", "ba"):
        off = vec_of(f"{q}_disk.n").dot(vec_of(f"{p}_disk.center") - vec_of(f"{q}_disk.center"))
        joined = joined.where(off * off <= reach(p, q) * (1 + 1e-6) + 1e-12)
    lined = joined.select("a", "b", *[F.col(f"{p}_disk.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("center", "n", "u", "v", "ra", "rb")])
    lined = _named(lined, _l=vec_of("a_n").cross(vec_of("b_n")).struct(), _da=vec_of("a_n").dot(vec_of("a_center")), _db=vec_of("b_n").dot(vec_of("b_center")))
    lined = _named(lined, _len=vec_of("_l").norm()).where("_len >= 1e-8")
    lined = _named(lined, dir=vec_of("_l").over(F.col("_len")).struct()).where(F.col("dir.x").isNotNull())
    lined = _named(lined, p0=solve3((vec_of("a_n"), vec_of("b_n"), vec_of("dir")), (F.col("_da"), F.col("_db"), F.lit(0.0)), 1e-30).struct())
    for p in "ab":
        q = vec_of("p0") - vec_of(f"{p}_center")
        u, v, ra, rb = vec_of(f"{p}_u"), vec_of(f"{p}_v"), F.col(f"{p}_ra"), F.col(f"{p}_rb")
        parts = {"x": q.dot(u) / ra, "y": q.dot(v) / rb, "e": vec_of("dir").dot(u) / ra, "h": vec_of("dir").dot(v) / rb}
        lined = _named(lined, **{f"_{p}{k}": c for k, c in parts.items()})
        x, y, e, h = (F.col(f"_{p}{k}") for k in "xyeh")
        lined = _named(lined, **{f"_{p}q": e * e + h * h})
        lined = _named(lined, **{f"_{p}m": -(x * e + y * h) / F.col(f"_{p}q")})
        lined = _named(lined, **{f"_{p}r": F.sqrt(F.greatest(F.lit(0.0), F.col(f"_{p}m") * F.col(f"_{p}m") - (x * x + y * y - 1) / F.col(f"_{p}q")))}).where(F.col(f"_{p}r") * 2 > 1e-9)
    low, high = (f(*[F.col(f"_{p}m") + side * F.col(f"_{p}r") for p in "ab"]) for f, side in ((F.greatest, -1), (F.least, 1)))
    cut = _named(lined, t1=low, t2=high).where("t2 - t1 > 1e-6")
    at = lambda t: vec_of("p0") + vec_of("dir") * F.col(t)
    return cut.select("a", "b", at("t1").struct().alias("p1"), at("t2").struct().alias("p2"), (F.col("t2") - F.col("t1")).alias("length"))


def _named(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, which are evaluated once: a filter on them is not pushed down with copies of their formulas,
    as it would be without the generator, and nothing is written."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", made.alias("_made")).select("*", "_made.*").drop("_made")


def segment_hits(segments: DataFrame, width: float, tol: float = 1e-3, key: str = "id") -> DataFrame:
    """(a, b) of segments (key, p1, p2) that cross in the XY projection, each longer by tol of its length at both ends:
    those whose boxes share a cell, then boxes, then the exact test.

    Cells are as wide as the boxes in the square mean, so a segment is in four cells on average (width: where all boxes
    have none). A pair is told in the least cell that both boxes are in, and no pair is shuffled. The pairs are as many as
    the square of the segments in a place: cells are dealt evenly."""
    more = 1.5 * tol  # of boxes, which only tell what is tested

    def side(c: str, sign: int) -> Column:
        near, far = F.least(f"p1.{c}", f"p2.{c}"), F.greatest(f"p1.{c}", f"p2.{c}")
        return (near if sign < 0 else far) + sign * (more * (far - near) + 1e-9)

    boxed = segments.select(key, "p1", "p2", *[side(c, k).alias(f"{c}{n}") for c in "xy" for n, k in (("0", -1), ("1", 1))])
    wide = boxed.agg(*[F.sqrt(F.avg((F.col(f"{c}1") - F.col(f"{c}0")) * (F.col(f"{c}1") - F.col(f"{c}0")))).alias(c) for c in "xy"]).first()
    cells = boxed
    for c in "xy":
        size = wide[c] if wide[c] and wide[c] > 1e-6 else width
        cells = cells.withColumns({f"_f{c}": F.floor(F.col(f"{c}0") / size).cast("long"), f"_l{c}": F.floor(F.col(f"{c}1") / size).cast("long")})
    for c in "xy":
        cells = cells.withColumn(f"_c{c}", F.explode(F.sequence(f"_f{c}", f"_l{c}")))
    cells = cells.drop("_lx", "_ly")
    other = cells.select(F.col(key).alias("b"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), *[F.col(f"{c}{n}").alias(f"b{c}{n}") for c in "xy" for n in "01"], *[F.col(f"_f{c}").alias(f"b_f{c}") for c in "xy"], "_cx", "_cy")
    pairs = dealt(cells, "_cx", "_cy").join(dealt(other, "_cx", "_cy").hint("merge"), ["_cx", "_cy"]).where(F.col(key) < F.col("b"))
    for c in "xy":
        pairs = pairs.where((F.col(f"_c{c}") == F.greatest(f"_f{c}", f"b_f{c}")) & (F.col(f"{c}0") <= F.col(f"b{c}1")) & (F.col(f"b{c}0") <= F.col(f"{c}1")))
    p, q, r, s = (vec_of(c) for c in ("p1", "p2", "q1", "q2"))
    return pairs.where(cross_xy(p, q, r, s, tol)).select(F.col(key).alias("a"), "b")


def segment_graph(segments: DataFrame, hits: DataFrame, decimals: int = 6, key: str = "id") -> DataFrame:
    """(src, dst) as coordinate strings: the four edges between the ends of every two crossing segments."""
    name = lambda c: F.concat_ws(",", *[F.format_string(f"%.{decimals}f", F.round(F.col(f"{c}.{k}"), decimals) + 0.0) for k in XYZ])
    ends = segments.select(key, F.array(name("p1"), name("p2")).alias("ends"))
    joined = hits.join(ends.select(F.col(key).alias("a"), F.col("ends").alias("ea")), "a").join(ends.select(F.col(key).alias("b"), F.col("ends").alias("eb")), "b")
    pairs = joined.select(F.explode("ea").alias("s"), "eb").select("s", F.explode("eb").alias("t"))
    return pairs.select(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst")).where("src <> dst").distinct()


def drop_isolated(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """Nodes that some edge touches."""
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias(key)), key, "left_semi")


def slab_hits(facets: DataFrame, points: DataFrame, near: DataFrame, tol: float | Column) -> DataFrame:
    """(a, i): neighbours i of facet a with a point behind a's plane, nearer than tol. near: (a, i); facets: facet,
    a, b, c, d; points: facet, x, y, z."""
    return _behind(facets, points, near, tol).where("hit").select("a", "i").distinct()


def _behind(facets: DataFrame, points: DataFrame, near: DataFrame, tol: float | Column) -> DataFrame:
    planes = facets.select(F.col("facet").alias("a"), F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z")).alias("n"), "d")
    joined = near.join(planes, "a").join(points.select(F.col("facet").alias("i"), *XYZ), "i")
    return joined.withColumn("hit", in_slab(vec(*XYZ), vec_of("n"), F.col("d"), tol))


def inclusion(facets: DataFrame, points: DataFrame, near: DataFrame, tol: float | Column) -> DataFrame:
    """(a, i, share): share of i's points that are in a's slab."""
    return _behind(facets, points, near, tol).groupBy("a", "i").agg(F.avg(F.col("hit").cast("double")).alias("share"))


def mutual(shares: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, where each holds at least the share of the other's points."""
    back = shares.select(F.col("i").alias("a"), F.col("a").alias("i"), F.col("share").alias("back"))
    return shares.join(back, ["a", "i"]).where((F.col("a") < F.col("i")) & (F.col("share") >= least) & (F.col("back") >= least)).select("a", F.col("i").alias("b"))


def merge_near(points: DataFrame, tol: float, key: str = "pid") -> DataFrame:
    """points with node: the least key of those that chains of steps of at most tol join."""
    held = places(points.select(key, *XYZ), float(tol), key=key)
    label = held.join(chains(held, float(tol)), "_spot").select(*[F.col(a).alias(f"r_{a}") for a in XYZ], F.col("root").alias("node"))
    at = [F.col(a) == F.col(f"r_{a}") for a in XYZ]
    return points.join(label, at, "left").withColumn("node", F.coalesce("node", key)).drop(*[f"r_{a}" for a in XYZ])


def near_other(points: DataFrame, others: DataFrame, tol: float, key: str = "pid") -> DataFrame:
    """Distinct rows of `others` within tol of some point. Places stand for their rows; where a cell within tol holds a
    point, its others need no comparison."""
    asked = cut_lineage(inner_cells(points, tol))
    told = cut_lineage(inner_cells(others, tol))
    cells = [c for c in told.columns if c not in XYZ]
    sure = told.join(asked.select(*cells).distinct(), cells, "left_semi").select(*XYZ)
    rest = told.join(asked.select(*cells).distinct(), cells, "left_anti").select(*XYZ)
    found = radius_join(asked.select(*XYZ), rest, tol).select(*[F.col(f"n_{a}").alias(a) for a in XYZ]).distinct()
    return others.join(sure.unionByName(found), list(XYZ), "left_semi")
