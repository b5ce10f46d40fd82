"""Queries over clouds that are made from the tables' rows, with the same for DuckDB where no random number is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators import analysis, planes, ransac, synth
from strataspark.operators.graph import cut_lineage
from strataspark.plans.clouds import cloud, sql
from strataspark.plans.vectors import r

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(
    sql("planes") + ", p AS (SELECT pid AS patch, 1 + pid % 3 / 2.0e0 AS hu, 1 + pid % 2 * 1.0e0 AS hv, pid % 4 * 0.1137213e0 AS bend, pid % 5 * 0.0513127e0 AS wave, d FROM planes), q AS (SELECT *, round(2 * hu / 0.25)::BIGINT + 1 AS nu, round(2 * hv / 0.25)::BIGINT + 1 AS nv FROM p),"
    " k AS (SELECT *, unnest(range(0, nu * nv)) AS id FROM q), g AS (SELECT *, -hu + (id // nv) * 0.25 AS u, -hv + (id % nv) * 0.25 AS v FROM k)"
    " SELECT patch, id AS pid, round(patch - v, 5) + 0.0 AS x, round(2 + u, 5) + 0.0 AS y, round(d + bend * ((u / hu) * (u / hu) + (v / hv) * (v / hv)) + wave * sin(pi() * 2 * (u + hu) / hu), 5) + 0.0 AS z FROM g"
)
def y1_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bent and waved patch for each plane. The in-plane axes of a level one are (0, 1, 0) and (-1, 0, 0)."""
    p, zero = F.col("pid"), F.lit(0.0)
    specs = cloud(spark, sf_dir, "planes").select(
        p.alias("patch"), p.cast("double").alias("cx"), F.lit(2.0).alias("cy"), F.col("d").alias("cz"), zero.alias("nx"), zero.alias("ny"), F.lit(1.0).alias("nz"), (1 + p % 3 / 2.0).alias("half_u"), (1 + p % 2 * 1.0).alias("half_v"), F.lit(0.25).alias("step"),
        zero.alias("sigma"), (p % 4 * 0.1137213).alias("bend_m"), (p % 5 * 0.0513127).alias("wave_m"), F.lit(0).alias("grid_k"), zero.alias("grid_m"),
    )
    return synth.patches(specs).select("patch", "pid", *[r(F.col(a), a, 5) for a in "xyz"])


_NUMBERS = "n AS (SELECT event_id, " + ", ".join(f"nullif(regexp_extract(file, '(?i){k}(\\d+)', 1), '')::INT AS {k.lower()}" for k in ("Gno", "Grid", "Sin", "Ben")) + " FROM runs)"


@query(
    sql("runs") + ", " + _NUMBERS + ", c AS (SELECT gno, grid, coalesce(sin, 0) AS sin, ben, min(event_id) AS first FROM n GROUP BY ALL), f AS (SELECT 'Plane1_Ang0_Ara100%_Gno' || gno || 'mm_Ben' || ben || '_Grid' || grid || '_Sin' || sin || '.ply' AS filename, first FROM c) SELECT filename, first FROM f WHERE first % 5 <> 0"
)
def y10_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different parameters of all runs with file names of their own, less those that are done."""
    runs = cloud(spark, sf_dir, "runs").select("event_id", *analysis.name_params(F.col("file")))
    specs = runs.groupBy("gno", "grid", F.coalesce("sin", F.lit(0)).alias("wave"), "ben").agg(F.min("event_id").alias("first"))
    named = synth.manifest_names(specs.select(F.lit(0).alias("angle"), F.lit(100).alias("area"), F.col("gno").alias("sigma_mm"), F.col("ben").alias("bend"), "grid", "wave", "first"))
    return synth.resume(named, named.where("first % 5 = 0")).select("filename", "first")


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of one of the thirteen corner cases for each line item."""
    rows = cloud(spark, sf_dir, "pts").select("pid", F.pmod(F.xxhash64("pid"), F.lit(len(synth.CORNER_CASES))).alias("case"))
    return cut_lineage(synth.corners_of(rows))


@query()
def y11_corner_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted planes of the faces of noisy corners."""
    c = _corners(spark, sf_dir).where("plane IS NOT NULL")
    return planes.fit_planes(c, ["case", "plane"]).select("case", "plane", "n", *[r(F.col(a), a, 3) for a in "abc"], r(F.sqrt("l1"), "rms", 4))


@query()
def r4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of these corners, one after another: how many, the inliers of the first as a share, and of all."""
    c = _corners(spark, sf_dir)
    sizes = c.groupBy("case").agg(F.count("*").alias("n"))
    found = ransac.extract_all(c, 0.03, 300, stop=200, by=["case"], sample=2_000)
    told = found.groupBy("case").agg(F.count("*").alias("planes"), F.sum("inliers").alias("inliers"), F.max(F.when(F.col("place") == 0, F.col("inliers"))).alias("first"))
    return told.join(sizes, "case").select("case", "n", "planes", r(F.col("first") / F.col("n"), "first", 4), r(F.col("inliers") / F.col("n"), "explained", 4))


@query()
def r7_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spheres over a cloud in layers, by their number of planes."""
    p = cloud(spark, sf_dir, "parts").select(F.concat(F.lit("part"), F.col("pid").cast("string")).alias("pid"), "x", "y", F.floor(F.col("z") / 4).cast("double").alias("z"))
    return ransac.sphere_classes(p, 6.0, 0.01, 60, 20).select("sphere_id", "n", "planes", "class")


@query()
def y12_icosahedron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of an icosahedron's faces for each line item, with a plane for each face."""
    p = synth.icosahedron_of(cloud(spark, sf_dir, "pts").select("pid"))
    return planes.fit_planes(p, ["face"]).select("face", "n", r(F.sqrt("l1"), "rms", 3))
