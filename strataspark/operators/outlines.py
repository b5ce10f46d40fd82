"""What facets, disks, segments and blocks look like as bodies: vertices, edges and faces for sources.bodies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.vec import vec, vec_of
from strataspark.operators.facets import fan, tessellate
from strataspark.sources.bodies import COLOURS, Bodies

#: Corners that a face of a PLY file has at most. Fixed value.
MOST_CORNERS = 255


def polygons(table: DataFrame, body: Column, points: str) -> Bodies:
    """A closed outline and a face for each row; points is an array of struct(x, y, z) in order. A polygon of two points
    is one edge, of one point none; one of more than 255 corners, which a face cannot have, becomes a fan of triangles."""
    rows = table.select(body.alias("body"), F.col(points).alias("p"), F.size(points).alias("n"))
    vertices = rows.select("body", F.posexplode("p").alias("vid", "p")).select("body", F.col("vid").cast("long").alias("vid"), "p.x", "p.y", "p.z")
    last = F.when(F.col("n") > 2, F.col("n") - 1).otherwise(F.col("n") - 2)
    edges = rows.where("n > 1").select("body", "n", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("body", F.col("i").cast("long").alias("i"), F.pmod(F.col("i") + 1, F.col("n")).cast("long").alias("j"))
    one = F.array(F.sequence(F.lit(0), F.col("n") - 1))
    fans = F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda k: F.array(F.lit(0), k, k + 1))
    faces = rows.where("n > 2").select("body", F.explode(F.when(F.col("n") <= MOST_CORNERS, one).otherwise(fans)).alias("ids"))
    return Bodies(vertices, edges, faces)


def segments(table: DataFrame, body: Column, p1: Column, p2: Column) -> Bodies:
    """Two vertices and an edge for each row, from structs (x, y, z). Rows without an end are left out."""
    rows = table.select(body.alias("body"), p1.alias("p1"), p2.alias("p2")).where("p1 IS NOT NULL AND p2 IS NOT NULL")
    vertices = rows.select("body", F.posexplode(F.array("p1", "p2")).alias("vid", "p")).select("body", F.col("vid").cast("long").alias("vid"), "p.x", "p.y", "p.z")
    edges = rows.select("body", F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("j"))
    return Bodies(vertices, edges)


def whiskers(points: DataFrame, body: Column, normal: tuple[str, str, str], scale: float) -> Bodies:
    """A line from each point along its normal, of length scale times the normal's."""
    p = vec("x", "y", "z")
    return segments(points, body, p.struct(), (p + vec(*normal) * scale).struct())


def disks(table: DataFrame, by: str, n: int = 60) -> Bodies:
    """A center, n rim points and n triangles for each disk of (by, center, u, v, a, b)."""
    vertices = tessellate(table, by, n).select(F.col(by).alias("body"), F.col("vid").cast("long").alias("vid"), "x", "y", "z")
    faces = fan(by, table, n).select(F.col(by).alias("body"), F.array("i", "j", "k").alias("ids"))
    return Bodies(vertices, None, faces)


def corners(table: DataFrame, planes: tuple[str, str, str]) -> Bodies:
    """A vertex for each row of (planes' ids, x, y, z), in a colour by the hash of the three ids."""
    h = F.xxhash64(*planes)
    colours = [F.pmod(F.shiftright(h, 8 * k), F.lit(256)).cast("int").alias(c) for k, c in enumerate(COLOURS)]
    return Bodies(table.select(F.struct(*planes).alias("body"), F.lit(0).cast("long").alias("vid"), "x", "y", "z", *colours))


def wireframes(blocks: DataFrame, block: str, facet: str, points: str, kind: str, colours: dict[str, tuple[int, int, int]], other: tuple[int, int, int] = (128, 128, 128)) -> Bodies:
    """The outlines of blocks' facets (a row for each facet of a block), in the colour of the facet's kind. A body is
    struct(block, facet), so that a file for each block takes the expression body.block."""
    made = polygons(blocks, F.struct(F.col(block).alias("block"), F.col(facet).alias("facet")), points)
    kinds = blocks.select(F.struct(F.col(block).alias("block"), F.col(facet).alias("facet")).alias("body"), F.col(kind).alias("_kind"))
    shade = lambda k: F.coalesce(*[F.when(F.col("_kind") == name, F.lit(rgb[k])) for name, rgb in colours.items()], F.lit(other[k]))
    vertices = made.vertices.join(kinds, "body").select("body", "vid", "x", "y", "z", *[shade(k).cast("int").alias(c) for k, c in enumerate(COLOURS)])
    return Bodies(vertices, made.edges)


def ring_points(center: str, u: str, v: str, a: str, b: str, n: int) -> Column:
    """The n rim points of an ellipse as an array of struct(x, y, z)."""
    turn = lambda k: k * (2 * math.pi / n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (vec_of(center) + vec_of(u) * (F.col(a) * F.cos(turn(k))) + vec_of(v) * (F.col(b) * F.sin(turn(k)))).struct())
