"""File sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylode import schemas
from quarrylode.functions.normalize import strip

SCRAPE_OR_BROKEN = T.StructType([*schemas.SCRAPE.fields, T.StructField("_corrupt_record", T.StringType())])


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-empty domains of a CSV with a header."""
    rows = spark.read.csv(path, header=True, schema=schemas.DOMAINS)
    return rows.select(strip("domain").alias("domain")).filter(F.col("domain") != "")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.NAMES, multiLine=True, escape='"')


def read_match_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Match inputs by their place in the header, whatever the columns are called."""
    return spark.read.csv(path, header=True, schema=schemas.MATCH_INPUT, enforceSchema=True, multiLine=True, escape='"')


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Scrape results from a JSON array; broken records keep their text in _corrupt_record."""
    return spark.read.schema(SCRAPE_OR_BROKEN).json(path, multiLine=True)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILE).json(path, multiLine=True)


def read_optional(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON at a path, or no rows where the path does not exist; Spark's own reader decides."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)


def clear_tables(spark: SparkSession, named: dict) -> None:
    """Empty tables in place of those at the paths given with their schemas."""
    for path, schema in named.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
