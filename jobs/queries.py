"""The jobs as queries: each runs twice into a new folder and returns what stands there after the second run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import facet_catalogue, measure_report
from jobs.common import shared_folder
from strataspark.plans.spatial import _EIG, _MOM


def _round(c: str, places: int) -> Column:
    return (F.round(c, places) + 0.0).alias(c)


def job1_facet_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facets of the cloud of line items, by joint set."""
    output = shared_folder(spark, "facet-catalogue")
    for _ in range(2):
        facet_catalogue.run(spark, f"{sf_dir}/lineitem.parquet", output)
    places = {"cx": 5, "cy": 5, "cz": 5, "dip": 3, "dip_direction": 2, "curvature": 5, "rms": 4, "zrange": 3, "trace_length": 5}
    return facet_catalogue.read(spark, output).select("joint_id", "facet_id", "n_points", *[_round(c, p) for c, p in places.items()], "trace_from")


def job2_measure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by language and source."""
    output = shared_folder(spark, "measure-report")
    for _ in range(2):
        measure_report.run(spark, f"{sf_dir}/documents.parquet", output)
    return measure_report.read(spark, output).select("lang", "source", "n_rows", "n", "total", _round("mean", 6), _round("std", 6), "q25", "median", "q75", "n_outside")


FACETS_SQL = (
    "WITH pts AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pid, l_suppkey AS grp, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"
    + _MOM.format(by="grp", src="pts") + _EIG
    + ", w AS (SELECT p.grp, (vx * (p.x - mx) + vy * (p.y - my) + vz * (p.z - mz)) / vn AS res FROM pts p JOIN u ON u.g = p.grp), g AS (SELECT grp, stddev_pop(res) AS rms, max(res) - min(res) AS zrange FROM w GROUP BY grp)"
    ", o AS (SELECT grp, arg_min(struct_pack(x := x, y := y, z := z), pid) AS o FROM pts GROUP BY grp)"
    ", s AS (SELECT p.grp, p.pid, p.x, p.y, p.z, row_number() OVER (PARTITION BY p.grp ORDER BY (p.x - o.o.x) * (p.x - o.o.x) + (p.y - o.o.y) * (p.y - o.o.y) + (p.z - o.o.z) * (p.z - o.o.z) DESC, p.pid) AS k FROM pts p JOIN o ON o.grp = p.grp)"
    ", far AS (SELECT * FROM s WHERE k = 1), t AS (SELECT p.grp, sqrt(max((p.x - far.x) * (p.x - far.x) + (p.y - far.y) * (p.y - far.y) + (p.z - far.z) * (p.z - far.z))) AS trace_length, any_value(far.pid) AS trace_from FROM pts p JOIN far ON far.grp = p.grp GROUP BY p.grp)"
    " SELECT g % 7 AS joint_id, g AS facet_id, n AS n_points, round(mx, 5) + 0.0 AS cx, round(my, 5) + 0.0 AS cy, round(mz, 5) + 0.0 AS cz, round(degrees(acos(least(1, abs(vz / vn)))), 3) + 0.0 AS dip,"
    " round((degrees(atan2(CASE WHEN vz < 0 THEN -vx ELSE vx END, CASE WHEN vz < 0 THEN -vy ELSE vy END)) + 360) % 360, 2) + 0.0 AS dip_direction, round(l1 / greatest(cxx + cyy + czz, 1e-15), 5) + 0.0 AS curvature,"
    " round(rms, 4) + 0.0 AS rms, round(zrange, 3) + 0.0 AS zrange, round(trace_length, 5) + 0.0 AS trace_length, trace_from FROM u JOIN g ON g.grp = u.g JOIN t ON t.grp = u.g"
)
REPORT_SQL = r"""
WITH v AS (SELECT lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS value FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value) AS place, count(*) OVER (PARTITION BY lang, source) AS n FROM v),
q AS (SELECT lang, source, count(*)::BIGINT AS n, sum(value)::BIGINT AS total, avg(value) AS mean, stddev_samp(value) AS std, min(value) FILTER (place >= 0.25 * n) AS q25,
             min(value) FILTER (place >= 0.5 * n) AS median, min(value) FILTER (place >= 0.75 * n) AS q75 FROM k GROUP BY lang, source)
SELECT q.lang, q.source, n AS n_rows, n, total, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, q25, median, q75,
       (SELECT count(*) FROM v WHERE v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source AND (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)))::BIGINT AS n_outside
FROM q
"""
QUERIES = {f.__name__: f for f in (job1_facet_catalogue, job2_measure_report)}
ORACLES = {"job1_facet_catalogue": FACETS_SQL, "job2_measure_report": REPORT_SQL}
