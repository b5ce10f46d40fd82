"""Many small files and ranges: few tasks, the same table, names cut from paths."""

from pyspark.sql import functions as F

from strataspark.sources import bodies, files, formats


def _cloud(spark, folder, n, groups):
    rows = spark.range(n).select(F.col("id").cast("int").alias("pid"), (F.col("id") % groups).cast("string").alias("grp"), *[(F.col("id") + k).cast("double").alias(a) for k, a in enumerate("xyz")])
    files.write_ply_binary(rows, folder, "grp", [("x", "double"), ("y", "double"), ("z", "double"), ("pid", "int")]).collect()
    return rows


def test_small_ranges_share_tasks(spark, tmp_path):
    rows = _cloud(spark, str(tmp_path), 5000, 400)
    for split in (1 << 20, 97):
        back = files.read_ply(spark, f"file://{tmp_path}", split_bytes=split)
        assert back.rdd.getNumPartitions() <= 2 * formats.MOST_TASKS + 1
        assert sorted(back.select("pid", "x", "y", "z").collect()) == sorted(rows.select("pid", "x", "y", "z").collect())


def test_large_ranges_stay_a_task_each():
    pieces = [formats.Range("/top/a.ply", k * formats.SPLIT_BYTES, (k + 1) * formats.SPLIT_BYTES, 3000 * formats.SPLIT_BYTES) for k in range(3000)]
    told = formats.put_together(pieces)
    assert [len(t.held) for t in told] == [1] * 3000
    assert [(t.top + t.held[0][0], *t.held[0][1:]) for t in told] == [(p.path, p.first, p.last, p.size) for p in pieces]
    assert formats.put_together([]) == []


def test_names_of_bodies(spark, tmp_path):
    _cloud(spark, str(tmp_path / "a.b"), 6, 2)
    (tmp_path / "a.b" / "0.ply").rename(tmp_path / "a.b" / "x.y_part0.ply")
    assert {r.file for r in bodies.read_bodies(spark, str(tmp_path / "a.b")).select("file").distinct().collect()} == {"x.y_part0", "1"}
