"""Where registered queries and their SQL are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that must give the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place that all executors share; one of our own only on a local master that names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="semlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/semlake/{name}-{uuid.uuid4().hex}"
