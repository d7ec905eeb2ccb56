"""A crawl as a Spark data source: spark.read.format("crawl").load(frontier) asks for the urls of a
frontier, a folder of Parquet files with a column url that Spark has written.

Every file is a partition, so the frontier's files decide how many tasks ask. Filters on domain are
pushed down: urls of other domains are never asked for. The fetch function is the caller's; workers
get it with the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quarrylode.sources.pages import Fetch, retried

CRAWLED = "url string, domain string, status int, html string, error string, time_ms long, attempts int"
_ARROW = pa.schema([("url", pa.string()), ("domain", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("error", pa.string()), ("time_ms", pa.int64()), ("attempts", pa.int32())])


def domain_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url or "").hostname or "").lower() or None
    except ValueError:
        return None


class FrontierFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CrawlReader(DataSourceReader):
    """Options: path, retries (1), pause_s (1), parallel (8 urls of a task at once), deadline_s (20, of
    the whole answer of a url with its retries) and rows (256 of a file at once)."""

    def __init__(self, options, fetch: Fetch):
        self.fetch, self.uri = fetch, options["path"]
        self.retries, self.pause = int(options.get("retries", 1)), float(options.get("pause_s", 1))
        self.parallel, self.deadline, self.rows = int(options.get("parallel", 8)), float(options.get("deadline_s", 20)), int(options.get("rows", 256))
        self.domains: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("domain",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.domains = asked if self.domains is None else self.domains & asked
            else:
                yield f

    def partitions(self) -> list[FrontierFile]:
        store, folder = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet"))
        return [FrontierFile(p) for p in files] or [FrontierFile("")]

    def _row(self, url: str, pool: ThreadPoolExecutor) -> dict:
        try:
            return pool.submit(retried, self.fetch, url, self.retries, self.pause).result(self.deadline)
        except TimeoutError:
            return {"url": url, "status": None, "html": None, "error": f"no answer within {self.deadline:g} s", "time_ms": int(self.deadline * 1000), "attempts": None}

    def read(self, partition: FrontierFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        turns, inner = ThreadPoolExecutor(self.parallel), ThreadPoolExecutor(1024)
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(self.rows, columns=["url"]):
                urls = [u for u in batch.column(0).to_pylist() if u is not None and (self.domains is None or domain_of(u) in self.domains)]
                rows = [r | {"domain": domain_of(r["url"])} for r in turns.map(lambda u: self._row(u, inner), urls)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
        for pool in (turns, inner):
            pool.shutdown(wait=False, cancel_futures=True)


def crawl_source(fetch: Fetch, name: str = "crawl") -> type[DataSource]:
    """The source for a fetch function, as register_crawl() registers it."""

    class CrawlSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return CRAWLED

        def reader(self, schema) -> CrawlReader:
            return CrawlReader(self.options, fetch)

    return CrawlSource


def register_crawl(spark: SparkSession, fetch: Fetch, name: str = "crawl") -> None:
    """Makes spark.read.format(name) a crawl with this fetch function. Spark pushes filters down to
    sources in Python only if the session says so, and refuses sources that take them if not."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(crawl_source(fetch, name))


def frontier(urls: DataFrame, path: str, files: int, url: str = "url") -> str:
    """Writes each url once to so many files, dealt out by the whole url, so that a domain of very many
    urls is in all of them. The folder, for load()."""
    urls.selectExpr(f"{url} as url").filter("url is not null").distinct().repartition(files, "url").write.parquet(path)
    return path


def remaining(spark, path: str, log: DataFrame, to: str, files: int) -> str:
    """The frontier of a crawl that stopped: urls of a frontier that the rows it got (a table with a
    column url) do not have. What was fetched is not fetched again."""
    left = spark.read.parquet(path).join(log.select("url").distinct(), "url", "left_anti")
    return frontier(left, to, files)
