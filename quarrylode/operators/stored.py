"""Tables that several parts of a plan read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without it gets a temporary
    one: on a cluster no folder of one machine would do."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_dir, "local", None):
        shared_dir.local = tempfile.mkdtemp(prefix="quarrylode-")
    return shared_dir.local


def stored(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/quarrylode-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
