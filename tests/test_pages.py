"""Fetching: outcomes, deadlines, robots files; data points of very long pages."""

import time

import pytest
from pyspark.sql import functions as F

from quarrylode.functions import extract as X
from quarrylode.sources import pages as P
from quarrylode.sources.crawl_source import frontier, register_crawl


def test_outcomes_by_kind(spark):
    def fetch(u):
        if u == "slow":
            time.sleep(5)
        if u == "down":
            raise OSError("unreachable")
        return {"pdf": (200, "x", "application/pdf"), "page": (200, "<p>", "text/html; charset=utf-8"), "xml": (200, "<p>", "application/xhtml+xml"), "old": (200, "<p>"), "gone": (404, None), "broken": (503, "x", "text/html")}.get(u, (200, "ok"))

    urls = spark.createDataFrame([(u,) for u in ("slow", "down", "pdf", "page", "xml", "old", "gone", "broken", None, "page")], "url string")
    began = time.monotonic()
    got = {r.url: (r.status, r.html, r.error, r.attempts) for r in P.fetch_pages(urls, fetch, pause_s=0.01, parallel=4, deadline_s=1.0).collect()}
    assert time.monotonic() - began < 30
    assert got == {
        "slow": (None, None, "no answer within 1.0 s", None), "down": (None, None, "unreachable", 2), "pdf": (200, None, "Non-HTML content: application/pdf", 1), "page": (200, "<p>", None, 1),
        "xml": (200, "<p>", None, 1), "old": (200, "<p>", None, 1), "gone": (404, None, "HTTP 404", 1), "broken": (503, None, "HTTP 503", 2),
    }


def test_robots_files_are_asked_for_once_a_domain_and_not_again(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def fetch(url):
        (log / f"{time.time_ns()}").write_text(url)
        if "down" in url:
            raise OSError
        return (200, "User-agent: *\nDisallow: /no") if "some" in url else (404, None)

    urls = spark.createDataFrame([(f"http://some.org/{p}",) for p in ["no/1", "yes", "", *map(str, range(50))]] + [("https://SOME.org/no",), ("http://down.org/no",), ("http://none.org/no",), ("no url",), (None,)], "url string").repartition(7)
    found, texts = P.robots_verdicts(urls, fetch, "bot")
    assert sorted(r.url for r in found.filter("not allowed").collect()) == ["http://some.org/no/1", "https://SOME.org/no"] and found.count() == 58
    asked = lambda: sorted(f.read_text() for f in log.iterdir())
    first = asked()
    assert first == ["https://down.org/robots.txt", "https://none.org/robots.txt", "https://some.org/robots.txt"]
    more = urls.union(spark.createDataFrame([("http://new.org/no",)], "url string"))
    again, _ = P.robots_verdicts(more, fetch, "bot", known=texts)
    assert again.filter("not allowed").count() == 2 and sorted(asked()) == sorted([*first, "https://new.org/robots.txt"])


@pytest.mark.parametrize("n", [20_000])
def test_a_page_of_very_many_numbers_takes_seconds(spark, n):
    html = "<body>" + " ".join(f"(207) 3{i // 10000 + 20:02d}-{i % 10000:04d}" for i in range(n)) + " (207) 320-0000</body>"
    began = time.monotonic()
    points = spark.createDataFrame([(html,)], "html string").select(F.explode(X.page_phones(F.col("html"))).alias("p")).select("p.value", "p.extraction_method").collect()
    assert time.monotonic() - began < 25
    assert [r.value for r in points] == [f"+12073{i // 10000 + 20:02d}{i % 10000:04d}" for i in range(n)]


def test_first_each_keeps_order_and_first_points(spark):
    data = spark.createDataFrame([([("b", 1), ("a", 2), ("B", 3), ("a", 4), (None, 5), (None, 6)],), ([],), (None,)], "xs array<struct<value:string,n:int>>")
    got = [r[0] if r[0] is None else [x.n for x in r[0]] for r in data.select(X.first_each(F.col("xs"), lambda p: F.lower(p["value"]))).collect()]
    assert got == [[1, 2, 5], [], None]


def test_crawl_source_asks_only_for_the_domains_of_a_filter_and_keeps_its_deadline(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def fetch(url):
        (log / f"{time.time_ns()}").write_text(url)
        if url.endswith("slow"):
            time.sleep(4)
        return 200, "<p>", "text/html"

    urls = spark.createDataFrame([(f"https://{h}/{i}",) for h in ("a.org", "b.org", "C.org") for i in range(5)] + [("https://a.org/slow",), ("https://a.org/0",), (None,)], "url string")
    path = frontier(urls, str(tmp_path / "frontier"), 3)
    register_crawl(spark, fetch, "own_crawl")
    read = lambda: spark.read.format("own_crawl").options(deadline_s="1", parallel="4").load(path)
    got = {r.url: r.error for r in read().filter("domain in ('a.org', 'c.org') and status is not null or domain = 'a.org'").collect()}
    assert len(got) == 11 and got["https://a.org/slow"] == "no answer within 1 s"
    for f in log.iterdir():
        f.unlink()
    assert read().filter(F.col("domain") == "c.org").count() == 5
    assert sorted(f.read_text() for f in log.iterdir()) == [f"https://C.org/{i}" for i in range(5)]
    empty = frontier(urls.limit(0), str(tmp_path / "empty"), 2)
    assert spark.read.format("own_crawl").load(empty).count() == 0
