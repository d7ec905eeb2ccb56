"""Questions to a language model about pages: prompts, retries, and a breaker for rate limits.

The call is given (a client, a batch service, a test double), so there is no network code here.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.functions.extract import strip_scripts

#: The answer to a prompt; an exception's attribute status, if it has one, is the service's status.
Call = Callable[[str], str]
#: Characters of a page in a prompt, retries, first pause, seconds for an answer, 429s in a row that open the breaker.
MOST_CHARS, RETRIES, PAUSE_S, DEADLINE_S, BREAKER = 60_000, 3, 2.0, 30.0, 3
ASKED = "answer string, outcome string, status int, calls int"

_TASK = """Read the web page below and say what it tells about the company behind it. What patterns found
before is given as well: correct it where the page says otherwise, and leave out what is not the
company's own, such as sample addresses, numbers from scripts or links, and profiles of others.
A year of copyright is not a year of foundation. Phones are in E.164, a logo is an absolute url.
Answer with one JSON object that has company_name, emails, phone_numbers, addresses,
short_description, year_founded, logo_url, social_links (by platform) and confidence_notes."""


def prompt(domain: Column, html: Column, known: Column) -> Column:
    """The question about one page: known is a struct of what was found before. Scripts and styles are
    cut first, then the page ends after MOST_CHARS characters. A null page is an empty one."""
    page = F.left(strip_scripts(F.coalesce(html, F.lit(""))), F.lit(MOST_CHARS))
    return F.concat(F.lit(_TASK + "\n\nDomain: "), F.coalesce(domain.cast("string"), F.lit("")), F.lit("\nFound before: "), F.coalesce(F.to_json(known), F.lit("{}")), F.lit("\n\nPage:\n"), page)


class Breaker:
    """Counts answers of status 429 in a row; open once there are so many, and then for good."""

    def __init__(self, most: int = BREAKER):
        self.most, self.row = most, 0

    @property
    def open(self) -> bool:
        return self.row >= self.most


def _is_json(text: str) -> bool:
    """Whether a fenced or plain text is JSON; refinements() reads its fields."""
    text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text, flags=re.I).strip())
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def asked(call: Call, question: str, breaker: Breaker, pool: ThreadPoolExecutor, retries: int = RETRIES, pause_s: float = PAUSE_S, deadline_s: float = DEADLINE_S) -> dict:
    """One question: 429 and 5xx are tried again after pauses that double, other failures are not.

    outcome: answered, not json, failed, no answer (in time), rate limited (429 to the end, or the
    breaker opened), skipped (it was open before)."""
    if breaker.open:
        return {"answer": None, "outcome": "skipped", "status": None, "calls": 0}
    for attempt in range(retries + 1):
        try:
            text = pool.submit(call, question).result(deadline_s)
            if not isinstance(text, str) or not _is_json(text):
                return {"answer": None, "outcome": "not json", "status": None, "calls": attempt + 1}
            breaker.row = 0
            return {"answer": text, "outcome": "answered", "status": 200, "calls": attempt + 1}
        except Exception as e:  # the row carries what went wrong
            status = getattr(e, "status", None)
            kind = "no answer" if isinstance(e, TimeoutError) and status is None else "failed"
        breaker.row += status == 429
        again = status is not None and (status == 429 or status >= 500)
        if breaker.open or not again or attempt == retries:
            break
        time.sleep(pause_s * 2**attempt)
    return {"answer": None, "outcome": "rate limited" if status == 429 else kind, "status": status, "calls": attempt + 1}


def ask(prompts: DataFrame, call: Call, key: str = "domain", partitions: int | None = None, retries: int = RETRIES, pause_s: float = PAUSE_S, deadline_s: float = DEADLINE_S, most_429: int = BREAKER) -> DataFrame:
    """prompts(key, prompt) -> key, answer, outcome, status, calls: one row for each row with a prompt.

    A task asks one question after the other under one breaker, so the number of partitions bounds the
    calls at a time; once the breaker is open, the rest of the partition is skipped at no cost and
    unanswered() finds it for a later run. Write the result: reading it twice asks twice."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker, pool = Breaker(most_429), ThreadPoolExecutor(64)
        for b in batches:
            rows = [asked(call, q.as_py(), breaker, pool, retries, pause_s, deadline_s) for q in b.column(1)]
            out = pa.RecordBatch.from_pylist(rows, pa.schema([("answer", pa.string()), ("outcome", pa.string()), ("status", pa.int32()), ("calls", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *out.columns], names=[key, *out.schema.names])
        pool.shutdown(wait=False, cancel_futures=True)

    put = prompts.select(key, "prompt").filter("prompt is not null")
    return (put.repartition(partitions) if partitions else put).mapInArrow(run, f"`{key}` {kind}, {ASKED}")


def unanswered(prompts: DataFrame, done: DataFrame, key: str = "domain") -> DataFrame:
    """Prompts that a later run asks: never asked, skipped, rate limited, or failed by the service."""
    final = done.filter((F.col("outcome") == "answered") | (F.col("outcome") == "not json") | ((F.col("outcome") == "failed") & (F.coalesce("status", F.lit(0)) < 500)))
    return prompts.join(final.select(key), key, "left_anti")
