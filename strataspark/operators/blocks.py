"""Blocks: corners of three planes, closed bodies from half-spaces, and the assembly of facets into blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspark.functions import hull
from strataspark.functions.vec import three_planes, vec
from strataspark.operators.graph import closed, components, cut_lineage, dealt, exclusive_cliques, face_adjacency, share_two, triangles
from strataspark.operators.pairs import inclusion, mutual, near_other, slab_hits
from strataspark.operators.spatial import radius_join

XYZ = ("x", "y", "z")


def _side(planes: DataFrame, key: str, name: str) -> DataFrame:
    return planes.select(F.col(key).alias(name), *[F.col(c).alias(f"{name}{c}") for c in "abcd"])


def corners(triples: DataFrame, planes: DataFrame, key: str = "pid", eps: float = 1e-12) -> DataFrame:
    """triples (i, j, k) with the point x, y, z of their planes (key, a, b, c, d); triples without one are left out."""
    joined = triples
    for name in "ijk":
        joined = joined.join(_side(planes, key, name), name)
    p = three_planes(*[e for n in "ijk" for e in (vec(f"{n}a", f"{n}b", f"{n}c"), F.col(f"{n}d"))], eps=eps)
    return joined.select("i", "j", "k", *[c.alias(a) for c, a in zip(p.parts(), XYZ, strict=True)]).where("x IS NOT NULL")


def halfspace_corners(planes: DataFrame, by: str, key: str = "pid", tol: float = 1e-6, decimals: int = 8) -> DataFrame:
    """by, x, y, z: distinct corners of the bodies n.p + d <= 0 of each group of few planes: every triple of a
    group's planes, then the points that are behind all of the group's planes."""
    one = lambda n: planes.select(by, *[F.col(c).alias(f"{n}_{c}") for c in (key, "a", "b", "c", "d")])
    triples = one("i").join(one("j"), by).where(f"i_{key} < j_{key}").join(one("k"), by).where(f"j_{key} < k_{key}")
    p = three_planes(*[e for n in "ijk" for e in (vec(f"{n}_a", f"{n}_b", f"{n}_c"), F.col(f"{n}_d"))])
    points = triples.select(by, *[(F.round(c, decimals) + 0.0).alias(a) for c, a in zip(p.parts(), XYZ, strict=True)]).where("x IS NOT NULL").distinct()
    inside = points.join(planes.select(by, "a", "b", "c", "d"), by).groupBy(by, *XYZ).agg(F.max(vec("a", "b", "c").dot(vec(*XYZ)) + F.col("d")).alias("most")).where(F.col("most") <= tol)
    return inside.select(by, *XYZ)


def hull_bodies(points: DataFrame, by: str) -> DataFrame:
    """by, n_vertices, n_faces, volume, area, vertices, faces of the convex hull of each group; empty for flat ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf[list(XYZ)].to_numpy(), axis=0)
        f = hull.hull3(p)
        volume, area = hull.volume_area(p, f)
        used = np.unique(f)
        place = np.zeros(len(p), dtype=np.int64)
        place[used] = np.arange(len(used))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n_vertices": [len(used)], "n_faces": [len(f)], "volume": [volume], "area": [area], "vertices": [p[used].tolist()], "faces": [place[f].tolist()]})

    kind = dict(points.dtypes)[by]
    return dealt(points.select(by, *XYZ), by).groupBy(by).applyInPandas(run, f"{by} {kind}, n_vertices long, n_faces long, volume double, area double, vertices array<array<double>>, faces array<array<long>>")


def interior_points(planes: DataFrame, by: str) -> DataFrame:
    """by, x, y, z, radius: a point well inside each body of half-spaces; radius <= 0 where there is none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, r = hull.chebyshev(pdf[["a", "b", "c", "d"]].to_numpy())
        return pd.DataFrame({by: [pdf[by].iloc[0]], "x": [x[0]], "y": [x[1]], "z": [x[2]], "radius": [r]})

    return dealt(planes.select(by, *"abcd"), by).groupBy(by).applyInPandas(run, f"{by} {dict(planes.dtypes)[by]}, x double, y double, z double, radius double")


def tetrahedra(bodies: DataFrame, by: str) -> DataFrame:
    """by, tet, volume, x, y, z (centroid): the fan of a convex body's faces from its mean vertex."""
    v = lambda i: F.expr(f"vertices[face[{i}]]")
    mean = bodies.withColumn("o", F.expr("transform(array(0, 1, 2), k -> aggregate(vertices, 0D, (s, p) -> s + p[k]) / size(vertices))"))
    rows = mean.select(by, "o", "vertices", F.posexplode("faces").alias("tet", "face")).select(by, "tet", "o", v(0).alias("p"), v(1).alias("q"), v(2).alias("r"))
    at = lambda c: vec(*[F.col(c)[i] for i in range(3)])
    o, p, q, r = (at(c) for c in "opqr")
    center = (o + p + q + r) / 4
    return rows.select(by, "tet", (F.abs((p - o).dot((q - o).cross(r - o))) / 6).alias("volume"), *[c.alias(a) for c, a in zip(center.parts(), XYZ, strict=True)])


def body_measures(tets: DataFrame, by: str, density: float = 2700.0) -> DataFrame:
    """by, volume, weight, gravity center."""
    center = [(F.sum(F.col("volume") * F.col(a)) / F.sum("volume")).alias(a) for a in XYZ]
    return tets.groupBy(by).agg(F.sum("volume").alias("volume"), (F.sum("volume") * density).alias("weight"), *center)


def face_measures(faces: DataFrame, by: str) -> DataFrame:
    """by, stable, mode over faces (by, face, angle): stable where no face is under 45 degrees; the mode is the
    majority of slide (under 30), topple (under 60) and fall, the first seen in a tie."""
    kind = F.when(F.col("angle") < 30, "slide").when(F.col("angle") < 60, "topple").otherwise("fall")
    votes = faces.withColumn("kind", kind).groupBy(by, "kind").agg(F.count("*").alias("n"), F.min("face").alias("first"), F.max(F.col("angle") < 45).alias("under"))
    return votes.groupBy(by).agg((~F.max("under")).alias("stable"), F.max_by("kind", F.struct("n", (-F.col("first")).alias("f"))).alias("mode"))


def near_centers(facets: DataFrame, threshold: float) -> DataFrame:
    """(a, i) both ways of facets whose centers (cx, cy, cz) are nearer than the threshold."""
    c = facets.select(F.col("facet"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    pairs = radius_join(c, c, threshold).where((F.col("facet") != F.col("n_facet")) & (F.col("d2") < threshold * threshold))
    return pairs.select(F.col("facet").alias("a"), F.col("n_facet").alias("i"))


def clique_blocks(facets: DataFrame, points: DataFrame, threshold: float, tol: float, share: float = 0.2, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(blocks, facets with type and block_id): near facets, mutual inclusion in each other's slabs, exclusive cliques;
    the hull of a clique's points in each other's slabs is the block's body. Clique members are freefaces; facets
    mutual with one of them and in no clique are jointfaces."""
    near = cut_lineage(near_centers(facets, threshold))
    behind = slab_hits(facets, points, near, tol)
    both = cut_lineage(mutual(inclusion(facets, points, near.join(behind, ["a", "i"], "left_semi"), tol), share))
    blocks = cut_lineage(exclusive_cliques(both, least))
    members = blocks.select("block_id", F.explode("clique").alias("facet"))
    shell = points.join(members, "facet").select("block_id", *XYZ)
    bodies = hull_bodies(shell, "block_id")
    beside = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(members.select(F.col("facet").alias("a")), "a", "left_semi").select(F.col("b").alias("facet")).distinct().withColumn("joint", F.lit(True))
    typed = facets.join(members, "facet", "left").join(beside, "facet", "left")
    kind = F.when(F.col("block_id").isNotNull(), "freeface").when(F.col("joint"), "jointface").otherwise("undefined")
    return blocks.join(bodies, "block_id"), typed.withColumn("type", kind).drop("joint")


def component_blocks(facets: DataFrame, points: DataFrame, threshold: float, tol: float, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(bodies, facets with type and block_id) by components of mutual facets: of mutual degree 2 or more freefaces,
    of degree 1 jointfaces; the shell is the freefaces' points and the jointfaces' points within tol of them."""
    near = cut_lineage(near_centers(facets, threshold))
    both = cut_lineage(mutual(inclusion(facets, points, near, tol), share))
    degree = both.select(F.explode(F.array("a", "b")).alias("facet")).groupBy("facet").agg(F.count("*").alias("degree"))
    label = components(both).select(F.col("node").alias("facet"), F.col("component").alias("block_id"))
    typed = cut_lineage(facets.join(degree, "facet", "left").join(label, "facet", "left").withColumn("type", F.when(F.col("degree") >= 2, "freeface").when(F.col("degree") == 1, "jointface").otherwise("undefined")))
    tagged = points.join(typed.select("facet", "block_id", "type"), "facet")
    free, joint = tagged.where("type = 'freeface'"), tagged.where("type = 'jointface'")
    shell = free.select("block_id", *XYZ).unionByName(near_other(free.select("pid", *XYZ), joint, tol).select("block_id", *XYZ))
    return hull_bodies(shell, "block_id"), typed


def corner_blocks(facets: DataFrame, adjacency: DataFrame, envelope: DataFrame, merge: float, least_angle: float = 10.0, least_corners: int = 6) -> tuple[DataFrame, DataFrame]:
    """(corners with block, faces): corners of every three mutually adjacent facets whose normals differ by the angle,
    inside the envelope (one row: low and high x, y, z), the least triple of each grid cell; corners that share two
    planes are joined, and components of enough corners are blocks, with a hull on every plane of three corners."""
    three = triangles(adjacency.select("a", "b")).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("k"))
    joined = three
    for n in "ijk":
        joined = joined.join(_side(facets, "facet", n), n)
    sine = math.sin(math.radians(least_angle))
    apart = F.lit(True)
    for p, q in ("ij", "ik", "jk"):
        u, v = vec(f"{p}a", f"{p}b", f"{p}c"), vec(f"{q}a", f"{q}b", f"{q}c")
        apart = apart & (u.cross(v).norm() >= sine * u.norm() * v.norm())
    ok = joined.where(apart).select("i", "j", "k")
    found = corners(ok, facets.withColumnRenamed("facet", "pid")).crossJoin(F.broadcast(envelope))
    for a in XYZ:
        found = found.where(F.col(a).between(F.col(f"low_{a}"), F.col(f"high_{a}")))
    cells = [F.round(F.col(a) / merge).cast("long").alias(f"g{a}") for a in XYZ]
    first = found.select(F.struct("i", "j", "k", *XYZ).alias("c"), *cells).groupBy("gx", "gy", "gz").agg(F.min("c").alias("c")).select("c.*")
    numbered = cut_lineage(first.withColumn("corner", F.xxhash64("i", "j", "k")).withColumn("planes", F.array("i", "j", "k")))
    label = components(share_two(numbered), numbered.select(F.col("corner").alias("node")))
    size = label.groupBy("component").count().where(F.col("count") >= max(4, least_corners))
    kept = numbered.join(label.select(F.col("node").alias("corner"), "component"), "corner").join(size.select("component"), "component", "left_semi")
    ranked = size.select("component").withColumn("block_id", F.row_number().over(Window.orderBy("component")) - 1)  # one row a block
    blocks = cut_lineage(kept.join(ranked, "component").select("block_id", "corner", "i", "j", "k", *XYZ))
    flat = blocks.select("block_id", F.explode(F.array("i", "j", "k")).alias("facet"), *XYZ).join(facets.select("facet", "a", "b", "c"), "facet")

    def face(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[list(XYZ)].to_numpy()
        n = pdf[["a", "b", "c"]].to_numpy()[0]
        n = n / np.linalg.norm(n)
        u = np.cross(n, [0.0, 1.0, 0.0] if abs(n[0]) >= 0.9 else [1.0, 0.0, 0.0])
        u /= np.linalg.norm(u)
        q = np.column_stack([p @ u, p @ np.cross(n, u)])
        ring = hull.hull2(q)
        area = abs(hull.area_centroid(q[ring])[0]) if len(ring) > 2 else 0.0
        return pd.DataFrame({"block_id": [pdf["block_id"].iloc[0]], "facet": [pdf["facet"].iloc[0]], "n": [len(ring)], "area": [area], "ring": [p[ring].tolist()]})

    faces = dealt(flat, "block_id", "facet").groupBy("block_id", "facet").applyInPandas(face, "block_id int, facet long, n long, area double, ring array<array<double>>").where("n >= 3")
    return blocks, faces


def traversal_blocks(faces: DataFrame) -> DataFrame:
    """(block, face, closed): faces (face, ids) joined by shared edges, and whether every edge is used exactly twice."""
    label = components(face_adjacency(faces).select("a", "b"), faces.select(F.col("face").alias("node")))
    tagged = cut_lineage(faces.join(label.select(F.col("node").alias("face"), F.col("component").alias("block")), "face"))
    return tagged.select("block", "face").join(closed(tagged, "block"), "block")
