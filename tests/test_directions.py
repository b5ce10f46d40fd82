"""Directions of groups against k-means and silhouettes in numpy."""

import numpy as np
import pytest

from strataspark.operators import directions


def silhouette(v, label):
    if len(set(label)) < 2:
        return -1.0
    far = 1 - v @ v.T
    out = []
    for i, own in enumerate(label):
        inner = [far[i, j] for j in range(len(v)) if label[j] == own and j != i]
        others = [np.mean([far[i, j] for j in range(len(v)) if label[j] == c]) for c in set(label) - {own}]
        out.append(0.0 if not inner else (min(others) - np.mean(inner)) / max(min(others), np.mean(inner)))
    return float(np.mean(out))


def test_groups_against_numpy(spark):
    rng = np.random.default_rng(9)
    groups = {}
    for g in range(4):
        base = rng.normal(size=(g % 3 + 1, 3))
        v = base[rng.integers(0, len(base), 90)] + rng.normal(scale=0.25, size=(90, 3))
        groups[g] = v
    groups[9] = np.array([[0.0, 0.0, 2.0]])
    rows = [(g, 100 * g + k, *map(float, x)) for g, v in groups.items() for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, pid long, x double, y double, z double")
    told, labels = directions.evaluate(df.repartition(3), ["g"], inits=6, rounds=12)
    told = {r.g: r for r in told.collect()}
    label = {}
    for r in labels.collect():
        label.setdefault(r.g, {})[r.pid] = r.label
    assert told[9].best_k == 1 and told[9].score == pytest.approx(1) and told[9].proportions == [1.0]
    for g in range(4):
        v = groups[g] / np.linalg.norm(groups[g], axis=1, keepdims=True)
        ref = np.linalg.svd(v, full_matrices=False)[2][0]
        v = v * np.where(v @ (ref * np.sign(ref[np.argmax(np.abs(ref))])) < 0, -1, 1)[:, None]
        scores = {1: np.linalg.norm(v.mean(axis=0))}
        for k in (2, 3):
            best = None
            for _ in range(40):
                c = v[rng.choice(len(v), k, replace=False)]
                for _ in range(50):
                    near = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                    c = np.array([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
                inertia = ((v - c[near]) ** 2).sum()
                if best is None or inertia < best[0] - 1e-12:
                    best = (inertia, near.tolist())
            scores[k] = silhouette(v, best[1])
        r = told[g]
        assert r.n == 90 and sorted(label[g]) == [100 * g + k for k in range(90)]
        assert r.best_k == max(scores, key=lambda k: (scores[k], -k)) and r.score == pytest.approx(scores[r.best_k], abs=1e-6)
        own = [label[g][100 * g + k] for k in range(90)]
        assert r.proportions == pytest.approx([own.count(i) / 90 for i in range(r.best_k)]) and r.proportions == sorted(r.proportions, reverse=True)
        assert r.kind == ("dispersion" if r.best_k == 1 else "silhouette") and r.is_clustered == (r.score >= (0.85 if r.best_k == 1 else 0.35))
        assert all(np.linalg.norm([c.x, c.y, c.z]) == pytest.approx(1) for c in r.centers) and len(r.pair_angles) == {1: 0, 2: 1, 3: 3}[r.best_k]
    assert directions.evaluate(df.limit(0), ["g"], inits=2, rounds=2)[0].count() == 0


def test_dip_direction_of_vertical_normals(spark):
    """Turned from straight down a normal has negative zeros, of which atan2 is 180; Spark's takes them for zeros."""
    from strataspark.functions.vec import dip_direction, vec

    rows = spark.createDataFrame([(1, 0.0, 0.0, -1.0), (2, 0.0, 0.0, 1.0), (3, 1.0, 0.0, -1.0), (4, 0.0, 1.0, -1.0)], "i int, x double, y double, z double")
    got = {r.i: r.d for r in rows.select("i", dip_direction(vec("x", "y", "z")).alias("d")).collect()}
    assert got == {1: 180.0, 2: 0.0, 3: 270.0, 4: 180.0}
