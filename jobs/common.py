"""What the jobs share: their logs, their command lines, a folder for registered runs."""

from __future__ import annotations

import json
import logging
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("jobs")


def default_config(name: str) -> dict:
    """The configuration beside a job's module."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def source(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """The table at path, with the columns that the configuration makes of it as SQL expressions."""
    rows = spark.read.format(config.get("format", "parquet")).options(**config.get("options", {})).load(path)
    return rows.select(*[F.expr(e).alias(c) for c, e in config["columns"].items()])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a temporary one only where none is named and driver
    and executors are one process, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="jobs-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def command_line(name: str, arguments: dict[str, str], job: Callable[..., dict]) -> None:
    """Run a job on a session of its own. arguments: names of its paths and what they are."""
    import argparse

    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    for argument, text in arguments.items():
        parser.add_argument(argument, help=text)
    parser.add_argument("--config", help="a JSON file in place of the one beside the job")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=JSON", help="one value of the configuration")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(given.config).read_text()) if given.config else default_config(name)
    config |= {k: json.loads(v) for k, _, v in (s.partition("=") for s in given.set)}
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, *[getattr(given, a) for a in arguments], config)
    finally:
        spark.stop()
