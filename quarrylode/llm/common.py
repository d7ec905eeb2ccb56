"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only a local session
    without that setting (tests) gets a temporary one; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="quarrylode-")
        shared_dir.local = named
    return named


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quarrylode-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._ql_path = path
    return out


def bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """df as a table in the shared folder, in buckets by a column: groups and joins by it shuffle only
    the other side. Its name is known to the session, its files are like those of written()."""
    name = f"quarrylode_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def swept(df: DataFrame) -> DataFrame:
    """df, a table of written(), after shuffle files of what made it are let go: Spark's cleaner removes
    them once the driver has collected its garbage, which it may not do for half an hour by itself."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._ql_path)
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def unit_hash(*cols: Column) -> Column:
    """A pseudorandom double strictly between 0 and 1."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
