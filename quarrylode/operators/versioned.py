"""Tables in versions: rows in buckets by a hash of their key, each version a manifest of bucket files.

A change reads and rewrites the buckets that new rows fall into, and no others, and is published by
one manifest, renamed into place only if no other change took its number. Files are never changed, so
readers keep the version they opened, and a change that failed leaves the version before it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another change was published first; begin again from its version."""


class VersionedTable:
    """path: a folder that driver and executors share. key: the column that tells rows apart."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The latest version; 0 before the first change."""
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "files": {}, "ledger": {}}
        fs, p = self._fs(f"{self.path}/versions/{version:020d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; later changes do not show."""
        return self._rows(self.manifest(version)).drop(BUCKET)

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        files = [f for b, f in manifest["files"].items() if only is None or int(b) in only]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _publish(self, base: dict, rows: DataFrame, touched: list[int], ledger: dict) -> int:
        """Writes the touched buckets, then the manifest of the next version."""
        at, number = f"{self.path}/data/{uuid.uuid4().hex}", base["version"] + 1
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != BUCKET])
        if touched:
            rows.repartition(min(len(touched), self.buckets), BUCKET).write.partitionBy(BUCKET).parquet(at)
        fs, _ = self._fs(at)
        written = {str(b): f"{at}/{BUCKET}={b}" for b in touched if fs.exists(self._fs(f"{at}/{BUCKET}={b}")[1])}
        kept = {b: f for b, f in base["files"].items() if int(b) not in touched}
        self._write(number, {"version": number, "schema": schema.jsonValue(), "files": kept | written, "ledger": base["ledger"] | ledger})
        return number

    def _write(self, number: int, manifest: dict) -> None:
        fs, target = self._fs(f"{self.path}/versions/{number:020d}.json")
        _, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # a rename that would replace a file fails, so of two changes one is told to begin again
        if fs.exists(target) or not fs.rename(draft, target):
            raise Conflict(f"version {number} exists")

    def _change(self, new: DataFrame, then, ledger: tuple[str, int] | None) -> int:
        base = self.manifest()
        if ledger and base["ledger"].get(ledger[0], -1) >= ledger[1]:
            return base["version"]
        fresh = self._bucketed(new)
        touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())  # at most the number of buckets
        old = self._bucketed(self._rows(base, touched)) if base["schema"] else None
        return self._publish(base, then(old, fresh), touched, {ledger[0]: ledger[1]} if ledger else {})

    def upsert(self, new: DataFrame, run_time: Column | None = None, ledger: tuple[str, int] | None = None) -> int:
        """The version in which new rows, one for each key, joined the table or replaced what it had.

        With run_time, updated_at of replaced rows is set to it. ledger: a feed's name and its epoch;
        an epoch that is already in the table changes nothing."""

        def then(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
            if run_time is not None:
                fresh = fresh.withColumn("updated_at", F.lit(None).cast("timestamp"))
            if old is None:
                return fresh
            if run_time is not None:
                known = old.select(self.key, F.lit(True).alias("_known"))
                fresh = fresh.join(known, self.key, "left").withColumn("updated_at", F.when(F.col("_known"), run_time.cast("timestamp"))).drop("_known")
            return old.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh, allowMissingColumns=True)

        return self._change(new, then, ledger)

    def merge(self, new: DataFrame, combine: dict[str, str], ledger: tuple[str, int] | None = None) -> int:
        """The version in which partial aggregates of new rows are merged with those in the table:
        combine names the aggregate of each column (sum, min, max, bool_or), which must be one that
        may be applied to its own results."""

        def then(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
            rows = fresh if old is None else old.unionByName(fresh)
            return rows.groupBy(BUCKET, self.key).agg(*[getattr(F, how)(c).alias(c) for c, how in combine.items()])

        return self._change(new.select(self.key, *combine), then, ledger)

    def forget_unused(self, keep: int = 2) -> int:
        """Deletes folders that none of the latest versions names; how many. Not while changes run."""
        latest = self.version()
        used = {f.rsplit("/", 2)[-2] for v in range(max(1, latest - keep + 1), latest + 1) for f in self.manifest(v)["files"].values()}
        fs, p = self._fs(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in used] if fs.exists(p) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def chunked(rows: DataFrame, key: str, checks: dict[str, Column], chunks: int) -> tuple[DataFrame, DataFrame]:
    """Rows of chunks that hold, and a report: chunk, n_rows, errors (all rows of a chunk in which a
    check failed, else 0) and failed, the names of the checks. Rows are dealt to chunks by their key; a
    key that is null or repeated in a chunk fails it, as the checks do that are not true."""
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))
    twice = dealt.groupBy("_chunk", key).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(~F.coalesce(c, F.lit(False))).alias(f"_not_{name}") for name, c in checks.items()])
    named = {"key": F.bool_or(F.col(key).isNull() | (F.col("n") > 1)), **{name: F.bool_or(f"_not_{name}") for name in checks}}
    found = twice.groupBy("_chunk").agg(F.sum("n").alias("n_rows"), *[c.alias(f"_{name}") for name, c in named.items()])
    failed = F.filter(F.array(*[F.when(F.col(f"_{name}"), F.lit(name)) for name in named]), lambda x: x.isNotNull())
    report = found.select(F.col("_chunk").alias("chunk"), "n_rows", F.when(F.size(failed) > 0, F.col("n_rows")).otherwise(0).alias("errors"), failed.alias("failed"))
    fine = dealt.join(report.filter("errors = 0").select(F.col("chunk").alias("_chunk")), "_chunk", "left_semi").drop("_chunk")
    return fine, report


#: Columns of a company's row, in order.
COMPANY = ("domain", "commercial_name", "legal_name", "all_names", "phone_numbers", "phone_numbers_raw", "primary_email", "emails", "facebook_url", "facebook_id", "social_links", "addresses", "short_description", "technologies", "logo_url", "industry_keywords", "year_founded", "crawl_status", "crawl_timestamp")
#: What a company's row must satisfy to be accepted.
COMPANY_CHECKS = {"status": lambda: F.col("crawl_status").isin("success", "failed", "partial", "pending"), "empty": lambda: F.length("domain") > 0}


def company_rows(profiles: DataFrame) -> DataFrame:
    """The columns of a profile that the table of companies has."""
    return profiles.select(*COMPANY)
