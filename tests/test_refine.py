"""Calls of a scripted service: which are made, which are made again, when the breaker opens."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarrylode.sources import refine as R


class Failure(Exception):
    def __init__(self, status=None):
        super().__init__(status)
        self.status = status


def scripted(*steps):
    """A call that does the next step each time, and the questions it got."""
    left, got = list(steps), []

    def call(question):
        got.append(question)
        step = left.pop(0)
        if step == "slow":
            time.sleep(1)
        if isinstance(step, int) or step is None:
            raise Failure(step)
        return step

    return call, got


@pytest.mark.parametrize(
    ("steps", "outcome", "calls", "row"),
    [
        (['{"a": 1}'], "answered", 1, 0), (['```json\n{"a": 1}\n```'], "answered", 1, 0), (["no json"], "not json", 1, 0), ([400], "failed", 1, 0), ([None], "failed", 1, 0), (["slow"], "no answer", 1, 0),
        ([503, 500, '{"a": 1}'], "answered", 3, 0), ([503] * 4, "failed", 4, 0), ([429, 429, "{}"], "answered", 3, 0), ([429, 503, 429, 400], "failed", 4, 2), ([429, 429, 429], "rate limited", 3, 3),
    ],
)
def test_one_question(steps, outcome, calls, row):
    call, got = scripted(*steps)
    breaker = R.Breaker()
    with ThreadPoolExecutor(2) as pool:
        out = R.asked(call, "q", breaker, pool, pause_s=0, deadline_s=0.3)
        assert (out["outcome"], out["calls"], breaker.row, len(got)) == (outcome, calls, row, calls)
        assert breaker.open == (row == 3)


def test_pauses_double(monkeypatch):
    pauses = []
    monkeypatch.setattr(R.time, "sleep", pauses.append)
    with ThreadPoolExecutor(1) as pool:
        R.asked(scripted(500, 500, 500, 500)[0], "q", R.Breaker(), pool)
    assert pauses == [2.0, 4.0, 8.0]


def test_an_open_breaker_skips_the_rest_of_its_partition_and_a_later_run_asks_it(spark):
    def call(question):
        if question != "ok":  # raised by a class that the workers get with the function
            raise type("Refused", (Exception,), {"status": 429 if question == "limit" else 400})
        return "{}"

    rows = [("a", "ok"), ("b", "bad"), ("c", "limit"), ("d", "ok"), ("e", "ok"), ("n", None)]
    prompts = spark.createDataFrame(rows, "domain string, prompt string").coalesce(1)
    done = R.ask(prompts, call, pause_s=0).collect()
    assert [(r.domain, r.outcome, r.status, r.calls) for r in done] == [("a", "answered", 200, 1), ("b", "failed", 400, 1), ("c", "rate limited", 429, 3), ("d", "skipped", None, 0), ("e", "skipped", None, 0)]
    later = R.unanswered(prompts.filter("prompt is not null"), spark.createDataFrame(done))
    assert {r.domain for r in later.collect()} == {"c", "d", "e"}
    assert R.ask(prompts.limit(0), call, pause_s=0).count() == 0


def test_prompts_cut_scripts_before_the_page_ends(spark):
    html = "<script>" + "s" * 70_000 + "</script><p>" + "x" * 70_000
    rows = spark.createDataFrame([("a.com", html), (None, None)], "domain string, html string")
    got = [r.p for r in rows.select(R.prompt(F.col("domain"), F.col("html"), F.struct(F.lit("Acme").alias("company_name"))).alias("p")).collect()]
    page = got[0].split("\nPage:\n", 1)[1]
    assert page == "<p>" + "x" * (R.MOST_CHARS - 3)
    assert 'Domain: a.com\nFound before: {"company_name":"Acme"}' in got[0]
    assert got[1].endswith("\nPage:\n")
