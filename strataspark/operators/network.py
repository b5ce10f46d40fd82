"""Blocks from a network of segments: where segments of one surface cross are nodes, between neighbouring nodes of a
segment are edges, edges bound faces in their surface's plane, and faces bound blocks in space.

Faces and blocks are found alike. In a plane, the edge that goes on around a face is the next one clockwise at the node;
in space, the face that goes on around a block is the next one around the edge. Both are a sort of what meets at a node
or an edge, and connected components of the links that it gives. Areas and volumes are sums over what a component holds,
in any order, and the outer face or block is the one that comes out negative. No facet and no component is taken to one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions.vec import V3, basis_by_x, to_plane, unit, vec, vec_of
from strataspark.operators.graph import components, cut_lineage
from strataspark.operators.pairs import merge_near

XYZ = ("x", "y", "z")


def common_surfaces(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, surface) for pairs (a, b) of segments (id, s1, s2), a row for each surface that both are in."""
    side = lambda n: segments.select(F.col("id").alias(n), F.array("s1", "s2").alias(f"s_{n}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", F.explode(F.array_intersect("s_a", "s_b")).alias("surface"))


def crossings(segments: DataFrame, width: float, tol: float = 1e-6) -> DataFrame:
    """(surface, a, b, x, y, z), a < b: where two segments (id, s1, s2, p1, p2) of a surface meet, within tol, in stripes
    of x of this width. Parallel segments have no crossing."""
    low, high = F.least("p1.x", "p2.x"), F.greatest("p1.x", "p2.x")
    stripes = F.sequence(F.floor((low - tol) / width).cast("long"), F.floor((high + tol) / width).cast("long"))
    striped = segments.select("id", "p1", "p2", F.array_distinct(F.array("s1", "s2")).alias("s"), F.explode(stripes).alias("stripe")).select("id", "p1", "p2", "stripe", F.explode("s").alias("surface"))
    other = striped.select(F.col("id").alias("b"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "surface", "stripe")
    pairs = striped.join(other, ["surface", "stripe"]).where(F.col("id") < F.col("b")).drop("stripe").dropDuplicates(["surface", "id", "b"])
    p, q = vec_of("p1"), vec_of("q1")
    u, v, w = vec_of("p2") - p, vec_of("q2") - q, p - q
    # steps are written: a filter on what they give would be pushed down with copies of their whole expressions
    steps = cut_lineage(pairs.withColumns({"_a": u.dot(u), "_b": u.dot(v), "_c": v.dot(v), "_d": u.dot(w), "_e": v.dot(w)}))
    den = F.col("_a") * F.col("_c") - F.col("_b") * F.col("_b")
    steps = steps.withColumn("_den", F.when(den > 1e-12 * F.col("_a") * F.col("_c"), den))
    steps = steps.withColumn("_s", (F.col("_b") * F.col("_e") - F.col("_c") * F.col("_d")) / F.col("_den")).withColumn("_t", (F.col("_a") * F.col("_e") - F.col("_b") * F.col("_d")) / F.col("_den"))
    steps = cut_lineage(steps)
    inside = lambda k, length2: (F.col(k) * F.sqrt(length2) >= -tol) & ((F.col(k) - 1) * F.sqrt(length2) <= tol)
    at, to = p + u * F.col("_s"), q + v * F.col("_t")
    gap = at - to
    kept = steps.where(F.col("_den").isNotNull() & inside("_s", F.col("_a")) & inside("_t", F.col("_c")) & (gap.dot(gap) <= tol * tol))
    mid = (at + to) * 0.5
    return kept.select("surface", F.col("id").alias("a"), "b", *[c.alias(k) for k, c in zip(XYZ, mid.parts(), strict=True)])


def network(segments: DataFrame, width: float, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (node, x, y, z), crossings nearer than tol being one; edges (surface, i, j), i < j, between
    neighbouring nodes along each segment, less those that end freely."""
    hits = cut_lineage(crossings(segments, width, tol).withColumn("pid", F.xxhash64("a", "b")))
    points = hits.groupBy("pid").agg(*[F.min(a).alias(a) for a in XYZ])
    merged = cut_lineage(merge_near(points, tol))
    nodes = cut_lineage(merged.groupBy("node").agg(*[F.min_by(a, "pid").alias(a) for a in XYZ]))
    on = hits.join(merged.select("pid", "node"), "pid").select("node", F.explode(F.array("a", "b")).alias("id")).distinct()
    far = (vec(*XYZ) - vec_of("p1")).dot(vec_of("p2") - vec_of("p1"))
    lined = on.join(nodes, "node").join(segments.select("id", "s1", "s2", "p1", "p2"), "id").select("id", "s1", "s2", "node", far.alias("far"))
    along = Window.partitionBy("id").orderBy("far", "node")
    pairs = lined.withColumn("to", F.lead("node").over(along)).where(F.col("to").isNotNull() & (F.col("to") != F.col("node")))
    # a segment is cut alike in both of its surfaces, so that faces of either meet along whole edges
    edges = cut_lineage(pairs.select(F.explode(F.array_distinct(F.array("s1", "s2"))).alias("surface"), F.least("node", "to").alias("i"), F.greatest("node", "to").alias("j")).distinct())
    many = edges.count()
    while True:  # an edge that ends freely bounds no face; taking it away may free the next one
        ends = edges.select("surface", F.explode(F.array("i", "j")).alias("node")).groupBy("surface", "node").count().where(F.col("count") > 1)
        side = lambda n: ends.select("surface", F.col("node").alias(n))  # noqa: B023, E731
        edges = cut_lineage(edges.join(side("i"), ["surface", "i"], "left_semi").join(side("j"), ["surface", "j"], "left_semi").select("surface", "i", "j"))
        left = edges.count()
        if left == many:
            return nodes, edges
        many = left


def _framed(rows: DataFrame, normal: str) -> DataFrame:
    """rows with u, v, the basis of the plane across a unit vector. Each step is written: their expressions would be
    copied into each other."""
    rows = cut_lineage(rows)
    u, _ = basis_by_x(vec_of(normal))
    rows = cut_lineage(rows.withColumn("u", u.struct()))
    return cut_lineage(rows.withColumn("v", vec_of(normal).cross(vec_of("u")).struct()))


def faces(nodes: DataFrame, edges: DataFrame, planes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, sides): faces (face, surface, n, area) of the edges in each surface (surface, a, b, c, d), the outer ones
    left out; sides (face, surface, i, j), the edges around each face, counter-clockwise about the plane's normal."""
    framed = _framed(planes.select("surface", unit(vec("a", "b", "c")).struct().alias("n")), "n")
    both = edges.select("surface", "i", "j").unionByName(edges.select("surface", F.col("j").alias("i"), F.col("i").alias("j")))
    end = lambda k: nodes.select(F.col("node").alias(k), F.struct(*XYZ).alias(f"p_{k}"))
    placed = both.join(end("i"), "i").join(end("j"), "j").join(framed, "surface")
    zero = V3(*[F.lit(0.0)] * 3)
    (si, ti), (sj, tj) = (to_plane(vec_of(f"p_{k}"), zero, vec_of("u"), vec_of("v")) for k in "ij")
    half = cut_lineage(placed.select("surface", "i", "j", si.alias("si"), ti.alias("ti"), sj.alias("sj"), tj.alias("tj")).withColumn("he", F.monotonically_increasing_id()))
    at_node = Window.partitionBy("surface", "i")
    turn = F.atan2(F.col("tj") - F.col("ti"), F.col("sj") - F.col("si"))
    before = half.withColumn("_turn", turn)
    ordered = at_node.orderBy("_turn", "j")
    # the edge clockwise of an edge out of a node: the one before it, or the last one for the first
    before = before.withColumn("k", F.coalesce(F.lag("j").over(ordered), F.max_by("j", F.struct("_turn", "j")).over(at_node)))
    coming = before.select("surface", F.col("j").alias("_from"), F.col("i").alias("_at"), "k")
    ids = half.select("surface", F.col("i").alias("_i"), F.col("j").alias("_j"), "he")
    joined = coming.join(ids.withColumnsRenamed({"_i": "_from", "_j": "_at", "he": "one"}), ["surface", "_from", "_at"]).join(ids.withColumnsRenamed({"_i": "_at", "_j": "k", "he": "two"}), ["surface", "_at", "k"])
    label = cut_lineage(components(joined.select(F.col("one").alias("a"), F.col("two").alias("b")), half.select(F.col("he").alias("node"))))
    told = cut_lineage(half.join(label.select(F.col("node").alias("he"), F.col("component").alias("face")), "he"))
    area = F.sum((F.col("si") * F.col("tj") - F.col("sj") * F.col("ti")) / 2)
    found = cut_lineage(told.groupBy("face", "surface").agg(F.count("*").alias("n"), area.alias("area")).where(F.col("area") > 1e-12))
    return found, cut_lineage(told.join(found.select("face"), "face", "left_semi").select("face", "surface", "i", "j"))


def blocks(nodes: DataFrame, found: DataFrame, sides: DataFrame, planes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, shells): blocks (block, n_faces, volume, area, closed) that faces() bound, the outer ones left out;
    shells (block, face, side), side 1 where the block lies on the side of the plane's normal. A block is closed unless
    it has a face on both sides."""
    n, length = vec("a", "b", "c"), vec("a", "b", "c").norm()
    unit_planes = cut_lineage(planes.select("surface", *[(c / length).alias(k) for k, c in zip("abc", n.parts(), strict=True)], (F.col("d") / length).alias("d")))
    end = lambda k: nodes.select(F.col("node").alias(k), F.struct(*XYZ).alias(f"p_{k}"))
    placed = sides.join(end("i"), "i").join(end("j"), "j").join(unit_planes, "surface")
    normal = vec("a", "b", "c")
    inward = normal.cross(vec_of("p_j") - vec_of("p_i"))  # into the face, across its edge
    low, high = F.least("i", "j"), F.greatest("i", "j")
    axis = (vec_of("p_j") - vec_of("p_i")) * F.when(F.col("i") < F.col("j"), 1.0).otherwise(-1.0)
    rows = placed.select("face", low.alias("low"), high.alias("high"), normal.struct().alias("n"), inward.struct().alias("m"), unit(axis).struct().alias("e"))
    e, m = vec_of("e"), vec_of("m")
    framed = _framed(rows, "e")
    framed = framed.withColumn("turn", F.atan2(m.dot(vec_of("v")), m.dot(vec_of("u"))))
    # the side of a face that looks towards growing angles around the edge
    side = F.when(vec_of("n").dot(e.cross(m)) > 0, 1).otherwise(-1)
    told = cut_lineage(framed.select("face", "low", "high", "turn", side.alias("side")))
    at_edge = Window.partitionBy("low", "high")
    ordered = at_edge.orderBy("turn", "face")
    after = F.struct("face", "side")
    linked = told.withColumn("to", F.coalesce(F.lead(after).over(ordered), F.min_by(after, F.struct("turn", "face")).over(at_edge)))
    name = lambda face, s: face * 2 + F.when(s > 0, 1).otherwise(0)
    links = linked.select(name(F.col("face"), F.col("side")).alias("a"), name(F.col("to.face"), -F.col("to.side")).alias("b"))
    every = found.select("face", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")).withColumn("node", name(F.col("face"), F.col("side")))
    label = components(links, every.select("node"))
    shells = cut_lineage(every.join(label, "node").select(F.col("component").alias("block"), "face", "side"))
    measured = shells.join(found, "face").join(unit_planes.select("surface", "d"), "surface")
    by_face = measured.groupBy("block", "face").agg(F.count("*").alias("sides"), F.sum(F.col("side") * F.col("d") * F.col("area") / 3).alias("volume"), F.first("area").alias("area"))
    made = by_face.groupBy("block").agg(F.count("*").alias("n_faces"), F.sum("volume").alias("volume"), F.sum("area").alias("area"), (F.max("sides") == 1).alias("closed")).where(F.col("volume") > 1e-12)
    made = cut_lineage(made)
    return made, shells.join(made.select("block"), "block", "left_semi")
