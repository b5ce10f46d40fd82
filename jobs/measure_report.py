"""A report on a whole-number measure of rows that keep arriving, by their parameters.

    python -m jobs.measure_report ROWS OUTPUT [--config FILE] [--set NAME=JSON]

ROWS is a folder of files that grows; each file is taken once, by a file stream with a checkpoint. Of the rows that are
new, it keeps how often each value occurs for each choice of parameters, so that nothing is read again when more
arrive: means, deviations and exact quantiles of all rows follow from these counts. Below OUTPUT there are

* `counts`, Parquet by batch: parameters, value, n. A batch that is taken again after a failure replaces its own,
* `report`, Parquet by the first parameter: n, total, mean, std, quantiles, and rows outside the fences around the
  quartiles,
* `checkpoint`, the stream's own.

The configuration tells how parameters and value are made of a row. As it stands it reports on the number of words of
documents by language and source. A null value is 0 rows of no value: it counts in `n_rows` alone. Null parameters are
parameters. A run without new files leaves the same report. Files are told
apart by their paths: one that changes after it was taken is not taken again, and one that is older than the newest by
more than `max_file_age` is not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, default_config
from strataspark.operators.analysis import summary_of_counts, value_counts


def _counts(spark: SparkSession, output: str, kinds: dict[str, str], by: list[str]) -> DataFrame:
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "value long", "n long", "batch long"])
    return spark.read.schema(schema).parquet(f"{output}/counts")


def _folder(path: str, files: list[str]) -> str:
    """A path that a file stream takes: it wants folders, but also a pattern, such as one that only this file matches."""
    alone = len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rpartition("/")[2])
    return f"{path[:-1]}[{path[-1]}]" if alone else path


def run(spark: SparkSession, rows: str, output: str, config: dict | None = None) -> dict:
    """Take what is new in rows, and write the report on all rows taken so far; what was read and written, as logged."""
    config = config or default_config("measure_report")
    by, columns = config["by"], config["columns"]
    kind, options = config.get("format", "parquet"), config.get("options", {})
    there = spark.read.format(kind).options(**options).load(rows)
    reader = spark.readStream.format(kind).options(**options).schema(there.schema).option("maxFilesPerTrigger", config.get("files_per_batch", 200)).option("maxFileAge", config.get("max_file_age", "3650d"))
    stream = reader.load(_folder(rows, there.inputFiles()))
    measured = stream.select(*[F.expr(e).alias(c) for c, e in columns.items()]).withColumn("value", F.col("value").cast("long"))
    taken = []

    def keep(batch: DataFrame, number: int) -> None:
        counted = value_counts(batch, by, "value").withColumn("batch", F.lit(number).cast("long"))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/counts")
        taken.append(number)

    kinds = dict(measured.dtypes)
    nothing = spark.createDataFrame([], ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "value long", "n long", "batch long"]))
    nothing.write.mode("append").partitionBy("batch").parquet(f"{output}/counts")  # the folder is there from the first run on
    query = measured.writeStream.foreachBatch(keep).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    counts = _counts(spark, output, kinds, by)
    new = counts.where(F.col("batch") >= min(taken)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if taken else 0
    LOG.info("read %d new rows of %s in %d batches", new, rows, len(taken))
    report = summary_of_counts(counts, by, "value", config["quantiles"], config.get("fence", 1.5))
    report.coalesce(8).write.mode("overwrite").partitionBy(by[0]).parquet(f"{output}/report")
    wrote = spark.read.schema(report.schema).parquet(f"{output}/report").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first().asDict()
    LOG.info("%s/report holds %d groups of %d rows", output, wrote["groups"], wrote["rows"])
    return {"new_rows": new, "batches": len(taken), **wrote}


def read(spark: SparkSession, output: str, config: dict | None = None) -> DataFrame:
    """The report that a run has written; parameters are text."""
    config = config or default_config("measure_report")
    quantiles = ", ".join(f"{q} long" for q in config["quantiles"])
    others = ", ".join(f"`{c}` string" for c in (*config["by"][1:], config["by"][0]))
    return spark.read.schema(f"n_rows long, n long, total long, mean double, std double, {quantiles}, n_outside long, {others}").parquet(f"{output}/report")


if __name__ == "__main__":
    command_line("measure_report", {"rows": "folder that grows", "output": "folder of the report"}, run)
