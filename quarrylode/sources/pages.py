"""Pages as a Spark source: a fetch function runs where Spark puts the partitions of a url list.

The function is given (HTTP client, browser, archive reader, test double), so the source itself is
free of network code. Concurrency is the number of partitions times cores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (status, html) or (status, html, content type) of a url; raises on network failure.
Fetch = Callable[[str], tuple]
FETCHED = "url string, status int, html string, error string, time_ms long, attempts int"


def retried(fetch: Fetch, url: str, retries: int = 1, pause_s: float = 1.0) -> dict:
    """One row for a url: failures of the network and 5xx are tried again, 4xx are not."""
    began, out = time.monotonic(), {}
    for attempt in range(retries + 1):
        try:
            status, html, *kind = fetch(url)
            error = None if status < 400 else f"HTTP {status}"
            if error is None and kind and not ("text/html" in (kind[0] or "") or "application/xhtml" in (kind[0] or "")):
                error = f"Non-HTML content: {kind[0] or ''}"
        except Exception as e:  # the row carries what went wrong
            status, html, error = None, None, str(e)
        out = {"url": url, "status": status, "html": html if error is None else None, "error": error, "time_ms": int((time.monotonic() - began) * 1000), "attempts": attempt + 1}
        if error is None or status is not None and status < 500:
            break
        if attempt < retries:
            time.sleep(pause_s)
    return out


def fetch_pages(urls: DataFrame, fetch: Fetch, url: str = "url", partitions: int | None = None, retries: int = 1, pause_s: float = 1.0, parallel: int = 1, deadline_s: float | None = None) -> DataFrame:
    """urls with status, html, error, time_ms and attempts, one row for each distinct url.

    A task asks for so many urls in parallel. A url that has not answered, retries included, by the
    deadline after its turn began gets a row that says so; what it still does is left behind."""

    def asked_for(u: str, pool: ThreadPoolExecutor) -> dict:
        late = {"url": u, "status": None, "html": None, "error": f"no answer within {deadline_s} s", "time_ms": int((deadline_s or 0) * 1000), "attempts": None}
        try:
            return pool.submit(retried, fetch, u, retries, pause_s).result(deadline_s)
        except TimeoutError:
            return late

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, inner = ThreadPoolExecutor(parallel), ThreadPoolExecutor(1024)
        for b in batches:
            if deadline_s is None:
                rows = list(turns.map(lambda u: retried(fetch, u, retries, pause_s), b.column(0).to_pylist()))
            else:
                rows = list(turns.map(lambda u: asked_for(u, inner), b.column(0).to_pylist()))
            kinds = [("url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("error", pa.string()), ("time_ms", pa.int64()), ("attempts", pa.int32())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
        for pool in (turns, inner):
            pool.shutdown(wait=False, cancel_futures=True)

    asked = urls.select(F.col(url).alias("url")).filter("url is not null").distinct()
    return (asked.repartition(partitions) if partitions else asked).mapInArrow(run, FETCHED)


def robots_verdicts(urls: DataFrame, fetch: Fetch, agent: str, url: str = "url", known: DataFrame | None = None, deadline_s: float | None = 3.0, parallel: int = 8) -> tuple[DataFrame, DataFrame]:
    """urls with allowed and crawl_delay, and the robots texts (domain, text) for the next run's known.

    Every domain's robots.txt is asked for once, however many urls it has, and not at all if known has
    the domain; one that fails or is not there allows everything. Urls without a host are allowed. The
    texts are stored before they are joined, so the join asks nobody again."""
    from quarrylode.operators.crawl import path_allowed, robots_rules
    from quarrylode.operators.stored import stored

    named = urls.withColumn("_host", F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))))
    domains = named.select(F.col("_host").alias("domain")).filter("domain is not null").distinct()
    new = domains.join(known.select("domain"), "domain", "left_anti") if known is not None else domains
    asked = new.select("domain", F.concat(F.lit("https://"), F.col("domain"), F.lit("/robots.txt")).alias("url"))
    got = fetch_pages(asked, lambda u: fetch(u)[:2], retries=0, parallel=parallel, deadline_s=deadline_s)
    texts = stored(got.select(F.regexp_extract("url", "^https://(.*)/robots\\.txt$", 1).alias("domain"), F.col("html").alias("text")))
    every = texts if known is None else texts.unionByName(known.select("domain", "text"))
    rules = every.select(F.col("domain").alias("_host"), robots_rules(F.col("text"), agent).alias("_rules"))
    path = F.coalesce(F.nullif(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), F.lit("/"))
    found = named.join(rules, "_host", "left").withColumns({"allowed": F.coalesce(path_allowed(path, F.col("_rules")), F.lit(True)), "crawl_delay": F.col("_rules.crawl_delay")})
    return found.drop("_host", "_rules"), every


def rendered_only(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages of a browser that loaded: status under 400 and 50 characters of text or more."""
    from quarrylode.functions.extract import body_of, text_of
    from quarrylode.functions.normalize import strip

    return pages.filter((F.coalesce("status", F.lit(200)) < 400) & (F.length(strip(text_of(body_of(F.col(html))))) >= 50))


def candidate_urls(domains: DataFrame) -> DataFrame:
    """domain, rank, url: the four ways to reach a domain, best first."""
    ways = [F.concat(F.lit(p), F.col("domain")) for p in ("https://", "http://", "https://www.", "http://www.")]
    return domains.select("domain", F.posexplode(F.array(*ways)).alias("rank", "url"))


def first_success(tried: DataFrame) -> DataFrame:
    """Of each domain's fetched candidates the one of lowest rank that has html."""
    cols = [c for c in tried.columns if c != "domain"]
    fine = tried.filter(F.col("html").isNotNull())
    return fine.groupBy("domain").agg(F.min_by(F.struct(*cols), "rank").alias("p")).select("domain", "p.*")


def resolving(domains: DataFrame, resolves: DataFrame) -> DataFrame:
    """Domains that a table (domain, resolves) finds, by themselves or with www. in front."""
    known = resolves.filter("resolves").select(F.regexp_replace("domain", r"^www\.", "").alias("domain")).distinct()
    return domains.join(known, "domain", "left_semi")


def refinements(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Parsed answers of a language model: fences cut, fields of a wrong type dropped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, r"(?i)^```json\s*", ""), r"(?i)^```\s*", ""), r"(?i)\s*```\s*$", ""))
    v = F.try_parse_json(plain)
    is_text = lambda x: F.startswith(F.schema_of_variant(x), F.lit("STRING"))
    strings = lambda p: F.coalesce(F.transform(F.filter(F.try_variant_get(v, p, "array<variant>"), is_text), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))
    text = lambda p: F.when(is_text(F.try_variant_get(v, p, "variant")), F.try_variant_get(v, p, "string"))
    number = F.when(~is_text(F.try_variant_get(v, "$.year_founded", "variant")), F.try_variant_get(v, "$.year_founded", "int"))
    return answers.filter(v.isNotNull()).select(
        *[c for c in answers.columns if c != answer],
        F.try_variant_get(v, "$.company_name", "string").alias("company_name"),
        strings("$.emails").alias("emails"),
        strings("$.phone_numbers").alias("phone_numbers"),
        strings("$.addresses").alias("addresses"),
        F.try_variant_get(v, "$.short_description", "string").alias("short_description"),
        number.alias("year_founded"),
        text("$.logo_url").alias("logo_url"),
        F.coalesce(F.try_variant_get(v, "$.social_links", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("social_links"),
        F.coalesce(text("$.confidence_notes"), F.lit("")).alias("confidence_notes"),
    )
