"""Hulls, triangulations and small linear programs of one group, in numpy: for the grouped functions of operators.

Inputs are the points of one facet or block; results are index arrays.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np


def hull2(p: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull of points (n, 2), counter-clockwise, without points on edges."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    order = [i for k, i in enumerate(order) if k == 0 or (p[i] != p[order[k - 1]]).any()]
    if len(order) < 3:
        return np.array(order, dtype=np.int64)
    tol = 1e-12 * float(np.ptp(p, axis=0).max()) ** 2

    def chain(ids: list[int]) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1:
                o, a, b = p[out[-2]], p[out[-1]], p[i]
                if (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0]) > tol:
                    break
                out.pop()
            out.append(i)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1], dtype=np.int64)


def area_centroid(poly: np.ndarray) -> tuple[float, np.ndarray]:
    """Signed area and centroid of a polygon (n, 2), by triangles from its first point."""
    q = poly - poly[0]
    nxt = np.roll(q, -1, axis=0)
    cross = q[:, 0] * nxt[:, 1] - nxt[:, 0] * q[:, 1]
    area = cross.sum() / 2
    if abs(area) < 1e-300:
        return 0.0, poly.mean(axis=0)
    return float(area), poly[0] + ((q + nxt) * cross[:, None]).sum(axis=0) / (6 * area)


def hull3(p: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Triangles (m, 3) of the convex hull of points (n, 3), oriented outwards; empty if they lie in a plane. Of the points
    outside of what is made so far the farthest one is taken next; those inside are dropped."""
    n = len(p)
    scale = max(float(np.ptp(p, axis=0).max(initial=0)), 1e-300)
    tol = eps * scale
    if n < 4:
        return np.zeros((0, 3), dtype=np.int64)
    order = np.lexsort((p[:, 2], p[:, 1], p[:, 0]))
    q = p[order]
    # of points that are equally far the first in order, which is no inner point of an edge or face
    first = lambda far: int(np.argmax(far >= far.max() - tol))
    a = 0
    b = first(np.linalg.norm(q - q[a], axis=1))
    line = (q[b] - q[a]) / max(np.linalg.norm(q[b] - q[a]), 1e-300)
    off = np.linalg.norm(np.cross(q - q[a], line), axis=1)
    c = first(off)
    if off.max() <= tol:
        return np.zeros((0, 3), dtype=np.int64)
    normal = np.cross(line, q[c] - q[a])
    normal /= np.linalg.norm(normal)
    height = np.abs((q - q[a]) @ normal)
    d = first(height)
    if height.max() <= tol:
        return np.zeros((0, 3), dtype=np.int64)
    center = q[[a, b, c, d]].mean(axis=0)

    def sides(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit normals (0 of faces without area) and offsets."""
        m = np.cross(q[f[:, 1]] - q[f[:, 0]], q[f[:, 2]] - q[f[:, 0]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return m, (m * q[f[:, 0]]).sum(axis=1)

    faces = np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]])
    m, at = sides(faces)
    faces[m @ center > at] = faces[m @ center > at][:, [0, 2, 1]]
    m, at = sides(faces)
    left = np.arange(n)
    while True:
        over = q[left] @ m.T - at
        out = over.max(axis=1)
        left, over = left[out > tol], over[out > tol]
        if not len(left):
            return np.array(sorted(map(tuple, order[faces].tolist())), dtype=np.int64)
        k = first(over.max(axis=1))
        seen = over[k] > tol
        edges = {e for f in faces[seen].tolist() for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
        new = np.array([(i, j, left[k]) for i, j in sorted(edges) if (j, i) not in edges], dtype=np.int64)
        more, more_at = sides(new)
        faces, m, at = np.concatenate([faces[~seen], new]), np.concatenate([m[~seen], more]), np.concatenate([at[~seen], more_at])
        left = np.delete(left, k)


def volume_area(p: np.ndarray, faces: np.ndarray) -> tuple[float, float]:
    if not len(faces):
        return 0.0, 0.0
    q = p - p[faces[0, 0]]
    a, b, c = q[faces[:, 0]], q[faces[:, 1]], q[faces[:, 2]]
    return float((a * np.cross(b, c)).sum() / 6), float(np.linalg.norm(np.cross(b - a, c - a), axis=1).sum() / 2)


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (m, 3), counter-clockwise, of distinct points (n, 2): each point opens the triangles whose
    circumcircle holds it and closes the hole's rim. Points come from left to right; a triangle whose circle ends left of
    them is put aside."""
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), dtype=np.int64)
    low, span = p.min(axis=0), max(float(np.ptp(p, axis=0).max()), 1e-300)
    q = (p - low) / span
    q = np.vstack([q, [[-30.0, -20.0], [31.0, -21.0], [0.5, 40.0]]])
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        a, b, c = q[t[:, 0]], q[t[:, 1]], q[t[:, 2]]
        b, c = b - a, c - a
        det = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        det = np.where(det == 0, 1e-300, det)
        bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
        u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / det, (b[:, 0] * cc - c[:, 0] * bb) / det], axis=1)
        return np.column_stack([a + u, (u * u).sum(axis=1)])

    circle, aside = circles(tri), []
    for v in np.lexsort((q[:n, 1], q[:n, 0])):
        ahead = q[v, 0] - circle[:, 0]
        past = (ahead > 0) & (ahead * ahead >= circle[:, 2])
        if past.any():
            aside.append(tri[past])
            tri, circle = tri[~past], circle[~past]
        inside = ((circle[:, :2] - q[v]) ** 2).sum(axis=1) < circle[:, 2] * (1 - 1e-12)
        edges = np.concatenate([tri[inside][:, [0, 1]], tri[inside][:, [1, 2]], tri[inside][:, [2, 0]]])
        have = {tuple(e) for e in edges.tolist()}
        rim = np.array([(i, j, v) for i, j in sorted(have) if (j, i) not in have], dtype=np.int64).reshape(-1, 3)
        tri = np.concatenate([tri[~inside], rim])
        circle = np.concatenate([circle[~inside], circles(rim)]) if len(rim) else circle[~inside]
    tri = np.concatenate([*aside, tri])
    return tri[(tri < n).all(axis=1)]


def alpha_shape(p: np.ndarray, alpha: float) -> list[np.ndarray]:
    """Outer rings (vertex indices) of the parts of the alpha shape, largest area first: Delaunay triangles of
    circumradius at most 1 / alpha."""
    t = delaunay(p)
    if not len(t):
        return []
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    area2 = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    sides = np.linalg.norm(a - b, axis=1) * np.linalg.norm(b - c, axis=1) * np.linalg.norm(c - a, axis=1)
    t = t[(area2 > 0) & (sides <= 2 * area2 / alpha)]
    have = {e for f in t.tolist() for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
    after: dict[int, list[int]] = {}
    for i, j in sorted(have):
        if (j, i) not in have:
            after.setdefault(i, []).append(j)
    rings = []
    while after:
        start = min(after)
        ring = [start]
        at = after[start].pop()
        while at != start and at in after:
            ring.append(at)
            at2 = after[at].pop()
            if not after[at]:
                del after[at]
            at = at2
        if start in after and not after[start]:
            del after[start]
        rings.append(np.array(ring))
    rings = [r for r in rings if len(r) > 2]
    return sorted(rings, key=lambda r: -abs(area_centroid(p[r])[0]))


def farthest(p: np.ndarray) -> tuple[int, int, float]:
    """The farthest pair, the first in row-major order of those."""
    d2 = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
    i, j = np.unravel_index(int(np.argmax(d2)), d2.shape)
    return int(i), int(j), float(np.sqrt(d2[i, j]))


#: Planes of which every four are tried.
FEW_PLANES = 16


@functools.cache
def _fours(n: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), 4)))


def chebyshev(planes: np.ndarray, rounds: int = 4000) -> tuple[np.ndarray, float]:
    """Center and radius of the greatest ball inside half-spaces n.x + d <= 0; radius <= 0 where there is no interior.

    Of few planes every four are tried, as the ball touches four: the best ball that all planes admit, the mean of
    those of equal radius, is the greatest if the normals that it touches have a sum of 0 with no negative weight. Many
    planes, and open bodies, go by subgradient steps that shrink, which come near."""
    norm = np.linalg.norm(planes[:, :3], axis=1)
    n, d = planes[:, :3] / norm[:, None], planes[:, 3] / norm
    if 4 <= len(d) <= FEW_PLANES:
        four = _fours(len(d))
        lhs = np.concatenate([n, np.ones((len(d), 1))], axis=1)[four]
        ok = np.abs(np.linalg.det(lhs)) > 1e-9
        found = np.linalg.solve(lhs[ok], -d[four[ok]][..., None])[..., 0]
        tol = 1e-9 * max(float(np.abs(d).max()), 1.0)
        holds = (found[:, :3] @ n.T + d + found[:, 3:]).max(axis=1, initial=-np.inf) <= tol
        if holds.any():
            top = holds & (found[:, 3] >= found[holds, 3].max() - tol)
            weights = np.linalg.solve(lhs[ok][top].transpose(0, 2, 1), np.array([0.0, 0.0, 0.0, 1.0])[:, None])[..., 0]
            if (weights >= -1e-9).all(axis=1).any():
                _, once = np.unique(np.round(found[top] / tol), axis=0, return_index=True)
                best = found[top][once].mean(axis=0)
                return best[:3], float(-(n @ best[:3] + d).max())
    x = np.linalg.lstsq(n, -d, rcond=None)[0]
    best, value = x.copy(), float(-(n @ x + d).max())
    size = max(float(np.abs(d).max()), 1.0)
    for k in range(rounds):
        s = n @ x + d
        worst = s >= s.max() - 1e-12
        x = x - n[worst].mean(axis=0) * size / (k + 2) ** 0.75
        radius = float(-(n @ x + d).max())
        if radius > value:
            best, value = x.copy(), radius
    return best, value
