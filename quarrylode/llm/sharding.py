"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylode.llm.common import unit_hash

#: Rows of a piece of a shard; pieces are numbered independently.
PIECE_ROWS = 1 << 14


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score -weight / ln(u(key, shard)); ties go to the lower number.

    A further shard only adds a score, so a key either stays or moves to the new shard; a shard
    gets keys in proportion to its weight. A null key is a key like any other.
    """
    scores = [
        F.struct((F.lit(-float(w)) / F.ln(unit_hash(key, F.lit(i)))).alias("s"), F.lit(-i).alias("i"))
        for i, w in enumerate(weights)
    ]
    return (-F.array_max(F.array(*scores))["i"]).cast("int")


def assign_shards(docs: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, order: Sequence[str] = (), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds shard, slot and, if grown lists the weights of a larger set, grown_shard.

    Slots number the rows of a shard from 0 without gaps. A shard is cut into hashed buckets, more
    for more rows; counts of the buckets give each a starting number, and rows are numbered inside
    their bucket: no task holds a whole shard. Rows that share a key, null too, are told apart by
    the columns of order, so only rows equal in those share a bucket; they get slots one after
    another. Null keys, repeated rows and empty tables are fine.
    The columns shard, slot and grown_shard of docs, if any, are replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    kept = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    buckets = docs.count() // (piece_rows * len(weights)) + 1
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), F.col(key), *order), F.lit(buckets)).cast("int")
    places = docs.select(shard_of(F.col(key), weights).alias("_ql_shard"), bucket.alias("_ql_bucket"))
    counts = places.groupBy("_ql_shard", "_ql_bucket").agg(F.count(F.lit(1)).alias("_ql_n"))
    before = Window.partitionBy("_ql_shard").orderBy("_ql_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_ql_shard", "_ql_bucket", F.coalesce(F.sum("_ql_n").over(before), F.lit(0)).alias("_ql_start"))
    rows = docs.select(*kept, shard_of(F.col(key), weights).alias("_ql_shard"), bucket.alias("_ql_bucket"), *([shard_of(F.col(key), grown).alias("grown_shard")] if grown else []))
    inside = Window.partitionBy("_ql_shard", "_ql_bucket").orderBy(key, *order)
    numbered = rows.withColumn("_ql_row", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["_ql_shard", "_ql_bucket"]).select(
        *kept,
        F.col("_ql_shard").alias("shard"),
        (F.col("_ql_start") + F.col("_ql_row")).cast("long").alias("slot"),
        *(["grown_shard"] if grown else []),
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7 of equal weight, and where a ninth shard would put them."""
    from quarrylode.llm.common import table

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign_shards(docs, "doc_id", [1.0] * 8, [1.0] * 9, order=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
