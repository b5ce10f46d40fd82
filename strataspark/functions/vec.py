"""Vectors, planes, lines and disks as column expressions. Nothing here leaves whole-stage code generation.

A vector is three columns (V3); a plane is a normal and an offset, n.p + d = 0. Cases without an answer (parallel
planes, zero vectors) are null unless a function says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


@dataclass(frozen=True)
class V3:
    x: Column
    y: Column
    z: Column

    def __add__(self, o: V3) -> V3:
        return V3(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: V3) -> V3:
        return V3(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, k: Column | float) -> V3:
        k = col(k)
        return V3(self.x * k, self.y * k, self.z * k)

    def __truediv__(self, k: Column | float) -> V3:
        k = col(k)
        return V3(self.x / k, self.y / k, self.z / k)

    def over(self, k: Column) -> V3:
        """self / k, null where k is 0. A filter before a division does not keep it from being computed first."""
        return V3(*[F.try_divide(c, k) for c in self.parts()])

    def dot(self, o: V3) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: V3) -> V3:
        return V3(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def where(self, condition: Column, other: V3) -> V3:
        return V3(*[F.when(condition, a).otherwise(b) for a, b in zip(self.parts(), other.parts(), strict=True)])

    def parts(self) -> tuple[Column, Column, Column]:
        return self.x, self.y, self.z

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def named(self, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{k}") for c, k in zip(self.parts(), "xyz", strict=True)]


def vec(*parts: Column | str | float) -> V3:
    return V3(*map(col, parts))


def vec_of(struct: Column | str) -> V3:
    s = col(struct)
    return V3(s["x"], s["y"], s["z"])


def axis(k: int) -> V3:
    return vec(*(1.0 if i == k else 0.0 for i in range(3)))


def clip(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """c between low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def unit(v: V3, floor: float = 1e-12) -> V3:
    """v / max(|v|, floor)."""
    return v / F.greatest(v.norm(), F.lit(floor))


def safe_unit(v: V3, eps: float = 1e-15) -> tuple[V3, Column]:
    """(unit vector, length), all zero below eps."""
    n = v.norm()
    small = n < eps
    return V3(*[F.when(small, 0.0).otherwise(c / n) for c in v.parts()]), F.when(small, 0.0).otherwise(n)


def angle(a: V3, b: V3) -> Column:
    """Radians between unit vectors."""
    return F.acos(clip(a.dot(b)))


def chord(degrees: float | Column) -> Column:
    """Chord of an angle on the unit sphere."""
    return 2 * F.sin(F.radians(col(degrees)) / 2)


def orient(n: V3, towards: V3) -> V3:
    """n, turned into the half-space of `towards`."""
    return n * F.when(n.dot(towards) < 0, -1.0).otherwise(1.0)


def orient_to_viewpoint(n: V3, p: V3, view: V3) -> V3:
    return orient(n, view - p)


def dip(n: V3) -> Column:
    return F.degrees(F.acos(clip(F.abs(n.z))))


def strike(n: V3) -> Column:
    return F.pmod(F.degrees(F.atan2(-n.y, n.x)), F.lit(360.0))


def dip_direction(n: V3) -> Column:
    """Azimuth of the normal's horizontal part, the normal taken upwards; 180 where it is turned from straight down,
    which makes its zeros negative, and 0 where it is straight up."""
    up = orient(n, axis(2))
    down = (n.x == 0) & (n.y == 0) & (n.z < 0)
    return F.when(down, 180.0).otherwise(F.pmod(F.degrees(F.atan2(up.x, up.y)), F.lit(360.0)))


def orientation(n: V3, convention: str = "strike") -> tuple[Column, Column]:
    """(dip, azimuth) in degrees: 'strike', 'complement' (90 - acos|c|, atan2(a, b)) or 'math' (acos|c|, atan2(b, a))."""
    acos = F.degrees(F.acos(clip(F.abs(n.z))))
    if convention == "complement":
        return 90 - acos, F.pmod(F.degrees(F.atan2(n.x, n.y)), F.lit(360.0))
    if convention == "math":
        return acos, F.pmod(F.degrees(F.atan2(n.y, n.x)), F.lit(360.0))
    return acos, strike(n)


def pole(x: Column, y: Column) -> tuple[Column, Column]:
    """(dip, dip direction) of a pole at (x, y) of a stereonet of radius 1."""
    return 90 * F.sqrt(x * x + y * y), 180 + F.degrees(F.atan(x / F.when(y != 0, y)))


def basis_by_z(n: V3, tol: float = 1e-6) -> tuple[V3, V3]:
    """In-plane (u, v) with helper z, or x where n is along z (either way)."""
    flat = (F.abs(n.x) <= tol) & (F.abs(n.y) <= tol)
    u = unit(n.cross(axis(0).where(flat, axis(2))))
    return u, unit(n.cross(u))


def basis_by_x(n: V3) -> tuple[V3, V3]:
    """In-plane (u, v) with helper x, or y where |n.x| >= 0.9."""
    u = unit(n.cross(axis(1).where(F.abs(n.x) >= 0.9, axis(0))))
    return u, unit(n.cross(u))


def disk_axes(n: V3, long_axis: V3 | None = None, ends: tuple[V3, V3] | None = None) -> tuple[V3, V3]:
    """Axes of a disk: the given long axis, else the direction between two rim points, else the basis of the plane."""
    u, v = basis_by_x(n)
    if ends is not None:
        by_ends, length = safe_unit(ends[1] - ends[0])
        u = by_ends.where(F.coalesce(length, F.lit(0.0)) > 0, u)
    if long_axis is not None:
        given, length = safe_unit(long_axis)
        u = given.where(F.coalesce(length, F.lit(0.0)) > 0, u)
    return u, unit(n.cross(u))


def to_plane(p: V3, origin: V3, u: V3, v: V3) -> tuple[Column, Column]:
    return (p - origin).dot(u), (p - origin).dot(v)


def from_plane(s: Column, t: Column, origin: V3, u: V3, v: V3) -> V3:
    return origin + u * s + v * t


def signed_distance(p: V3, n: V3, d: Column) -> Column:
    length = n.norm()
    return (n.dot(p) + d) / F.when(length > 0, length)


def normal_plane(n: V3, d: Column) -> tuple[V3, Column]:
    length = n.norm()
    length = F.when(length > 0, length)
    return n / length, d / length


def in_slab(p: V3, n: V3, d: Column, tol: Column | float) -> Column:
    """Behind the plane, nearer than tol."""
    s = signed_distance(p, n, d)
    return (s < 0) & (s > -col(tol))


def det3(a: V3, b: V3, c: V3) -> Column:
    return a.dot(b.cross(c))


def solve3(rows: tuple[V3, V3, V3], right: tuple[Column, Column, Column], eps: float = 1e-12) -> V3:
    """x with rows[i].x = right[i] by Cramer's rule; null where |det| < eps."""
    a, b, c = rows
    det = det3(a, b, c)
    det = F.when(F.abs(det) >= eps, det)
    return (b.cross(c) * right[0] + c.cross(a) * right[1] + a.cross(b) * right[2]) / det


def three_planes(n1: V3, d1: Column, n2: V3, d2: Column, n3: V3, d3: Column, eps: float = 1e-12) -> V3:
    return solve3((n1, n2, n3), (-d1, -d2, -d3), eps)


def two_planes(n1: V3, p1: V3, n2: V3, p2: V3, eps: float = 1e-8) -> tuple[V3, V3]:
    """(direction, point) of the line of two planes by points on them; null where they are parallel."""
    line = n1.cross(n2)
    length = line.norm()
    direction = line / F.when(length >= eps, length)
    return direction, solve3((n1, n2, direction), (n1.dot(p1), n2.dot(p2), F.lit(0.0)), 1e-30)


def cross_xy(p: V3, q: V3, r: V3, s: V3, tol: float = 1e-3) -> Column:
    """Whether segments pq and rs cross in the XY projection, within tol of their parameters."""
    dx1, dy1, dx2, dy2 = q.x - p.x, q.y - p.y, s.x - r.x, s.y - r.y
    det = dx1 * dy2 - dy1 * dx2
    safe = F.when(F.abs(det) > 1e-12, det)
    t = ((r.x - p.x) * dy2 - (r.y - p.y) * dx2) / safe
    k = ((r.x - p.x) * dy1 - (r.y - p.y) * dx1) / safe
    return F.coalesce(t.between(-tol, 1 + tol) & k.between(-tol, 1 + tol), F.lit(False))


def boxes_meet_xy(p: V3, q: V3, r: V3, s: V3, tol: float = 0.0) -> Column:
    meet = lambda a, b, c, d: (F.least(a, b) - tol <= F.greatest(c, d)) & (F.least(c, d) - tol <= F.greatest(a, b))
    return meet(p.x, q.x, r.x, s.x) & meet(p.y, q.y, r.y, s.y)


def circle_plane(center: V3, u: V3, v: V3, radius: Column, n: V3, d: Column) -> tuple[V3, V3]:
    """The two points (null if none) where a circle around `center` in the plane of u and v meets a plane."""
    a, b, c = radius * n.dot(u), radius * n.dot(v), n.dot(center) + d
    amplitude = F.sqrt(a * a + b * b)
    ratio = -c / F.when(amplitude > 0, amplitude)
    turn = F.acos(F.when(F.abs(ratio) <= 1, ratio))
    phase = F.atan2(b, a)
    at = lambda t: center + u * (radius * F.cos(t)) + v * (radius * F.sin(t))
    return at(phase + turn), at(phase - turn)


def in_box(p: V3, low: V3, high: V3) -> Column:
    """Half-open: low <= p < high."""
    parts = zip(p.parts(), low.parts(), high.parts(), strict=True)
    condition = F.lit(True)
    for a, b, c in parts:
        condition = condition & (a >= b) & (a < c)
    return condition


def rotate(v: V3, axis: V3, degrees: Column | float) -> V3:
    """v turned around a unit axis."""
    t = F.radians(col(degrees))
    return v * F.cos(t) + axis.cross(v) * F.sin(t) + axis * (axis.dot(v) * (1 - F.cos(t)))


def in_triangle(px: Column, py: Column, a: tuple, b: tuple, c: tuple, eps: float = 1e-9) -> Column:
    (ax, ay), (bx, by), (cx, cy) = ((col(p), col(q)) for p, q in (a, b, c))
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    l1 = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / det
    l2 = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / det
    return (l1 >= -eps) & (l2 >= -eps) & (1 - l1 - l2 >= -eps)


def circumradius(a: V3, b: V3, c: V3) -> Column:
    ab, bc, ca = (a - b).norm(), (b - c).norm(), (c - a).norm()
    area2 = (b - a).cross(c - a).norm()
    return ab * bc * ca / (2 * F.when(area2 > 0, area2))


def tetra_volume(a: V3, b: V3, c: V3, d: V3) -> Column:
    return F.abs(det3(b - a, c - a, d - a)) / 6


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds as text, as much as is needed."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.pmod(seconds, F.lit(60.0))
    return F.when(seconds >= 3600, F.format_string("%dh %dmin %.2fs", h, m, s)).when(seconds >= 60, F.format_string("%dmin %.2fs", m, s)).otherwise(F.format_string("%.2fs", s))


# Polygons: an array of struct(x, y, z), in order


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def newell(points: Column) -> V3:
    """Normal of a polygon by Newell's sums, of length twice its area."""
    pairs = F.arrays_zip(points.alias("p"), _next(points).alias("q"))
    sums = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, s: a + f(s["p"], s["q"]))
    return V3(
        sums(lambda p, q: (p["y"] - q["y"]) * (p["z"] + q["z"])),
        sums(lambda p, q: (p["z"] - q["z"]) * (p["x"] + q["x"])),
        sums(lambda p, q: (p["x"] - q["x"]) * (p["y"] + q["y"])),
    )


def shoelace(points: Column) -> Column:
    """Signed area in x, y."""
    pairs = F.arrays_zip(points.alias("p"), _next(points).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda a, s: a + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]) / 2


def fan_area(points: Column) -> Column:
    """Area of the fan of triangles from the first point."""
    first = vec_of(F.get(points, F.lit(0)))
    inner = F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(0)))
    pairs = F.arrays_zip(inner.alias("p"), F.slice(points, 3, F.greatest(F.size(points) - 2, F.lit(0))).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda a, s: a + (vec_of(s["p"]) - first).cross(vec_of(s["q"]) - first).norm() / 2)


def _total(points: Column, k: str) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k])


def mean_point(points: Column) -> V3:
    return V3(*[_total(points, k) / F.size(points) for k in "xyz"])


def coplanar(points: Column, tol: float = 1e-8) -> Column:
    """Whether all points lie in the plane of the first three."""
    a, b, c = (vec_of(F.get(points, F.lit(i))) for i in range(3))
    n = (b - a).cross(c - a)
    return (F.size(points) < 4) | F.forall(points, lambda p: F.abs(n.dot(vec_of(p) - a)) <= tol)


def ring(ids: Column) -> Column:
    """A cycle of ids, turned to begin with the least and to go on with the lesser of its neighbours."""
    at = F.array_position(ids, F.array_min(ids)).cast("int")
    turned = F.concat(F.slice(ids, at, F.size(ids)), F.slice(ids, F.lit(1), at - 1))
    back = F.concat(F.slice(turned, 1, 1), F.reverse(F.slice(turned, 2, F.size(turned))))
    return F.when(F.get(turned, F.lit(1)) <= F.get(back, F.lit(1)), turned).otherwise(back)


def inside_hull(p: V3, planes: Column, tol: float = 1e-9) -> Column:
    """Whether p is behind every plane of an array of struct(a, b, c, d)."""
    return F.forall(planes, lambda h: h["a"] * p.x + h["b"] * p.y + h["c"] * p.z + h["d"] <= tol)
