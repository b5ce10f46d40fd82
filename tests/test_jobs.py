"""The jobs: against DuckDB, run again, over growing input, and with odd rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import facet_catalogue, measure_report
from jobs.common import default_config
from jobs.queries import ORACLES, QUERIES
from strataspark.operators.analysis import summary_of_counts, value_counts

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) + 0.0 if isinstance(v, float) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.select(*columns).collect()) == ordered(want.fetchall())


@pytest.fixture
def out(tmp_path):
    return f"file://{tmp_path}"


CLOUD = {"columns": {c: c for c in ("pid", "joint_id", "facet_id", "x", "y", "z")}, "sets": None, "least_points": 3}
POINT = "pid long, joint_id long, facet_id long, x double, y double, z double, note string"


def flat_points(joint, facet, n, tilt):
    """n points of a plane that dips to the east with this slope."""
    return [(1000 * facet + k, joint, facet, float(k % 7), float(k // 7), -tilt * (k % 7), "clash") for k in range(n)]


def test_catalogue_of_planes(spark, out):
    rows = flat_points(1, 10, 49, 1.0) + flat_points(1, 11, 49, 0.0) + flat_points(2, 20, 21, math.sqrt(3)) + flat_points(2, 21, 2, 0.0)
    rows += [(5, None, 10, 0.0, 0.0, 0.0, ""), (6, 1, 10, None, 0.0, 0.0, ""), (7, 3, 30, 1.0, 1.0, 1.0, ""), (8, 3, 30, 2.0, 2.0, 2.0, ""), (9, 3, 30, 3.0, 3.0, 3.0, "")]
    spark.createDataFrame(rows, POINT).repartition(3).write.parquet(f"{out}/points")
    told = facet_catalogue.run(spark, f"{out}/points", f"{out}/catalogue", CLOUD)
    assert (told["read"], told["incomplete"], told["used"], told["facets"], told["sets"]) == (len(rows), 2, len(rows) - 2, 4, 3)
    got = {r.facet_id: r for r in facet_catalogue.read(spark, f"{out}/catalogue").collect()}
    assert set(got) == {10, 11, 20, 30}
    assert got[10].dip == pytest.approx(45) and got[10].dip_direction == pytest.approx(90) and got[20].dip == pytest.approx(60) and got[11].dip == pytest.approx(0, abs=1e-5)
    assert got[10].rms == pytest.approx(0, abs=1e-6) and got[10].n_points == 49 and got[10].c > 0
    assert got[11].trace_length == pytest.approx(math.hypot(6, 6)) and {got[11].trace_from, got[11].trace_to} == {11000, 11048}
    assert got[30].a is None and got[30].dip is None and got[30].trace_length == pytest.approx(2 * math.sqrt(3))
    sets = {r.joint_id: r for r in spark.read.parquet(f"{out}/catalogue/sets").collect()}
    assert (sets[1].n_facets, sets[1].n_points) == (2, 98) and sets[1].mean_dip == pytest.approx(22.5)
    csv = spark.read.option("header", True).csv(f"{out}/catalogue/csv")
    assert csv.count() == 4 and {r.valid for r in csv.collect()} == {"true", "false"}


def test_catalogue_again_and_by_sets(spark, out):
    first = flat_points(1, 10, 49, 1.0) + flat_points(2, 20, 21, 2.0)
    spark.createDataFrame(first, POINT).write.parquet(f"{out}/points")
    run = lambda **more: facet_catalogue.run(spark, f"{out}/points", f"{out}/catalogue", CLOUD | more)
    shown = lambda: ordered(facet_catalogue.read(spark, f"{out}/catalogue").collect())
    run()
    before = shown()
    run()
    assert shown() == before
    spark.createDataFrame(flat_points(1, 12, 30, 0.5) + flat_points(2, 22, 30, 0.5), POINT).write.mode("append").parquet(f"{out}/points")
    setting = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    run(sets=[2])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == setting
    assert [r[1] if len(r) > 1 else r for r in sorted((r.joint_id, r.facet_id) for r in facet_catalogue.read(spark, f"{out}/catalogue").collect())] == [10, 20, 22]
    run()
    assert sorted(r.facet_id for r in facet_catalogue.read(spark, f"{out}/catalogue").collect()) == [10, 12, 20, 22]


def test_catalogue_of_nothing(spark, out):
    spark.createDataFrame([], POINT).write.parquet(f"{out}/points")
    told = facet_catalogue.run(spark, f"{out}/points", f"{out}/catalogue", CLOUD)
    assert told["read"] == 0 and told["facets"] == 0


TEXT = "doc_id long, text string, lang string, source string, value string"


def test_report_over_growing_input(spark, out):
    parts = [
        [(k, "a b c " * (k % 5), "en", f"s{k % 3}", "clash") for k in range(40)],
        [(100 + k, f"w{k} x", None if k % 2 else "de", "s0", "clash") for k in range(20)] + [(200, None, "en", None, ""), (201, " \t", "en", "s1", ""), (201, " \t", "en", "s1", "")],
        [(300, "one " * 5000, "en", "s0", "")],
    ]
    read = lambda: measure_report.read(spark, f"{out}/report")
    everything = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, TEXT).coalesce(2).write.mode("append").parquet(f"{out}/documents")
        everything += part
        told = measure_report.run(spark, f"{out}/documents", f"{out}/report")
        assert told["new_rows"] == len(part) and told["rows"] == len(everything)
        got = ordered(read().collect())
        again = measure_report.run(spark, f"{out}/documents", f"{out}/report")
        assert again["new_rows"] == 0 and ordered(read().collect()) == got
        spark.createDataFrame(everything, TEXT).write.parquet(f"{out}/whole{k}")
        measure_report.run(spark, f"{out}/whole{k}", f"{out}/report{k}")
        assert ordered(measure_report.read(spark, f"{out}/report{k}").collect()) == got
    row = read().where("lang = 'en' AND source = 's1'").first()
    values = sorted(len((t or "").split()) for _, t, lang, s, _ in everything if (lang, s) == ("en", "s1"))
    assert (row.n, row.total, row["median"]) == (len(values), sum(values), values[(len(values) + 1) // 2 - 1])


def test_report_takes_a_failed_batch_again(spark, out):
    """A batch whose counts were written but not committed replaces them."""
    spark.createDataFrame([(1, "a b", "en", "s", "")], TEXT).write.parquet(f"{out}/documents")
    config = default_config("measure_report")
    measure_report.run(spark, f"{out}/documents", f"{out}/report")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/report/checkpoint/commits/0")
    assert path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    told = measure_report.run(spark, f"{out}/documents", f"{out}/report", config)
    assert told["new_rows"] == 1 and told["rows"] == 1
    assert measure_report.read(spark, f"{out}/report").first().total == 2


def test_report_takes_many_files_in_batches(spark, out):
    """More batches than one run's progress holds, and old files that arrive late."""
    for k in range(12):
        spark.createDataFrame([(k, "a " * k, "en", "s", "")], TEXT).write.mode("append").parquet(f"{out}/documents")
    config = default_config("measure_report") | {"files_per_batch": 5}
    told = measure_report.run(spark, f"{out}/documents", f"{out}/report", config)
    assert told["batches"] >= 3 and told["new_rows"] == 12
    late = f"{out}/late"
    spark.createDataFrame([(99, "x " * 100, "en", "s", "")], TEXT).write.parquet(late)
    fs = spark._jvm.org.apache.hadoop.fs
    for status in fs.Path(late).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs.Path(late)):
        if status.getPath().getName().startswith("part-") and status.getLen():
            source = status.getPath()
            source.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(source, 1_500_000_000_000, -1)
            source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, fs.Path(f"{out}/documents/{source.getName()}"))
    assert measure_report.run(spark, f"{out}/documents", f"{out}/report", config)["new_rows"] == 1
    assert measure_report.read(spark, f"{out}/report").first().total == sum(range(12)) + 100


def test_report_of_nothing(spark, out):
    spark.createDataFrame([], TEXT).write.parquet(f"{out}/documents")
    told = measure_report.run(spark, f"{out}/documents", f"{out}/report")
    assert told["rows"] == 0 and measure_report.read(spark, f"{out}/report").collect() == []


def test_summary_of_counts(spark):
    rows = [(k % 3, (k * k * 7919) % 101 if k % 11 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "g long, v long")
    counts = value_counts(df.where("v < 50 OR v IS NULL"), ["g"], "v").unionByName(value_counts(df.where("v >= 40"), ["g"], "v")).unionByName(value_counts(df.where("v >= 40 AND v < 50"), ["g"], "v").withColumn("n", -F.col("n")))
    got = {r.g: r for r in summary_of_counts(counts, ["g"], "v", {"q25": 0.25, "q75": 0.75}, 0.25).collect()}
    for g in range(3):
        v = sorted(x for h, x in rows if h == g and x is not None)
        at = lambda q: v[max(math.ceil(q * len(v)), 1) - 1]  # noqa: B023, E731
        mean = sum(v) / len(v)
        low, high = at(0.25) - 0.25 * (at(0.75) - at(0.25)), at(0.75) + 0.25 * (at(0.75) - at(0.25))
        want = (sum(1 for h, _ in rows if h == g), len(v), sum(v), mean, math.sqrt(sum((x - mean) ** 2 for x in v) / (len(v) - 1)), at(0.25), at(0.75), sum(not low <= x <= high for x in v))
        assert tuple(got[g])[1:] == pytest.approx(want)
