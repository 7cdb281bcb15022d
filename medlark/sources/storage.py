"""Intermediate tables on storage that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder of this machine serves where the setting is missing and
    the master is local, and on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="medlark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write df down and read it again, which ends its lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
