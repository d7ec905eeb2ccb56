"""Fill rates, rankings, error breakdowns and match reports: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def fill_tests() -> dict[str, Column]:
    """What counts as filled, for each measure of a scrape."""
    return {
        "phone": filled(F.col("phone_numbers")),
        "facebook": F.coalesce(F.map_contains_key("social_links", F.lit("facebook")), F.lit(False)),
        "social": filled(F.col("social_links")),
        "address": filled(F.col("addresses")),
        "email": filled(F.col("emails")),
        "description": F.col("short_description").isNotNull(),
        "technology": filled(F.col("technologies")),
        "logo": given(F.col("logo_url")),
        "year_founded": F.col("year_founded").isNotNull(),
    }


def fill_counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(t).alias(f"with_{n}") for n, t in tests.items()])


def fill_rates(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Shares of all rows; 0 for an empty table."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("total"), *[(F.count_if(t) / n).alias(f"{k}_rate") for k, t in tests.items()])


def percent(part: Column, whole: Column) -> Column:
    """Per cent to one decimal; null where the whole is 0."""
    return F.when(whole > 0, F.round(100 * part / whole, 1))


def ranking(df: DataFrame, items: str, n: int) -> DataFrame:
    """The n commonest items of an array column; ties by name."""
    # the outer form keeps the optimizer from testing the array's size first, which makes it twice
    counts = df.select(F.explode_outer(items).alias("item")).filter("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "item").limit(n)


def error_class(error: Column) -> Column:
    """The first class that fits; HTTP errors keep their text."""
    e = F.coalesce(F.nullif(error, F.lit("")), F.lit("unknown"))
    has = lambda *words: F.rlike(e, F.lit("|".join(words)))
    return F.when(has("timeout", "deadline exceeded"), "timeout").when(has("DNS resolution failed", "ENOTFOUND"), "DNS failure").when(has("ECONNREFUSED"), "Connection refused").when(has("SSL", "TLS", "certificate"), "SSL/TLS error").when(has("HTTP"), e).otherwise("other")


def error_counts(df: DataFrame, error: str, timeout: tuple[str, ...] = ("deadline", "timeout")) -> DataFrame:
    """dns, http_4xx, http_5xx, timeout, counted apart though they may overlap; other by difference."""
    has = lambda p: F.count_if(F.rlike(error, F.lit(p)))
    counts = df.agg(F.count(F.lit(1)).alias("failed"), has("DNS resolution failed").alias("dns"), has("HTTP 4[0-9][0-9]").alias("http_4xx"), has("HTTP 5[0-9][0-9]").alias("http_5xx"), has("|".join(timeout)).alias("timeout"))
    return counts.withColumn("other", F.expr("failed - dns - http_4xx - http_5xx - timeout"))


def run_summary(scrapes: DataFrame) -> DataFrame:
    """The record of a run: counts, times, pages."""
    pages, time = F.coalesce(F.sum(F.size("pages_crawled")), F.lit(0)), F.coalesce(F.sum("crawl_time_ms"), F.lit(0))
    n = F.count(F.lit(1))
    return scrapes.agg(n.alias("total_domains"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), time.alias("total_time_ms"), pages.alias("total_pages_crawled"), F.round(time / n).cast("long").alias("avg_crawl_time_ms"))


def success_rate(done: Column, total: Column) -> Column:
    return F.when(total > 0, 100 * done / total).otherwise(F.lit(0.0))


def coverage(runs: DataFrame, order: str = "started_at") -> DataFrame:
    """What the latest run covered: its counts, the per cent crawled to one decimal (0 for an empty
    run), its seconds to one decimal and the mean milliseconds of a domain."""
    total, done, ms = F.col("total_domains"), F.col("successful"), F.coalesce("total_time_ms", F.lit(0))
    share, each = F.coalesce(percent(done, total), F.lit(0.0)), F.when(total > 0, F.round(ms / total)).otherwise(0)
    return latest(runs, 1, order).select(order, "total_domains", F.col("successful").alias("crawled"), F.col("failed"), share.alias("coverage_pct"), F.round(ms / 1000, 1).alias("total_crawl_time_s"), each.cast("long").alias("avg_crawl_time_ms"))


def probes(tables: dict[str, DataFrame]) -> DataFrame:
    """part, n_rows, ok: which of a few named tables answer a count and have rows. No column is read."""
    each = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows", (F.col("n_rows") > 0).alias("ok")) for name, df in tables.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def latest(runs: DataFrame, n: int, order: str = "started_at") -> DataFrame:
    return runs.orderBy(F.desc(order)).limit(n)


#: Lower bounds (exclusive) of the confidence buckets.
BUCKETS = (("high", 0.7), ("medium", 0.4), ("low", 0.2), ("none", float("-inf")))


def bucket(confidence: Column) -> Column:
    c, out = F.coalesce(confidence, F.lit(0.0)), F.lit("none")
    for name, low in reversed(BUCKETS[:-1]):
        out = F.when(c > low, name).otherwise(out)
    return out


def confidence_histogram(df: DataFrame, confidence: str) -> DataFrame:
    """bucket, n for all buckets, those without rows too."""
    counts = [F.count_if(bucket(F.col(confidence)) == b).alias(b) for b, _ in BUCKETS]
    return df.agg(*counts).select(F.inline(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b, _ in BUCKETS])))


def match_summary(results: DataFrame, confidence: str = "confidence", accept: float = 0.2) -> DataFrame:
    hit = F.col(confidence) > accept
    n, matched = F.count(F.lit(1)), F.count_if(hit)
    return results.agg(n.alias("total"), matched.alias("matched"), (matched / F.greatest(n, F.lit(1))).alias("match_rate"), F.coalesce(F.avg(F.when(hit, F.col(confidence))), F.lit(0.0)).alias("avg_confidence"))


def search_rows(df: DataFrame, query: str, columns: tuple[str, ...]) -> DataFrame:
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return df.filter(test)


def page_of(df: DataFrame, page: int, size: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def in_language(c: Column | str, locale: str = "UNICODE") -> Column:
    """A key that orders texts as people do: by letters first, then accents, then small before capital."""
    return F.collate(c, locale)


def sorted_entries(m: Column) -> Column:
    """A map's entries, largest value first, ties by key."""
    return F.array_sort(F.map_entries(m), lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def grouped_provenance(records: DataFrame) -> DataFrame:
    """For each company and field its data points, most trusted first."""
    each = F.struct((-F.col("confidence")).alias("o"), "field_value", "source_url", "extraction_method", "confidence")
    return records.groupBy("company_id", "field_name").agg(F.array_sort(F.collect_list(each)).alias("points"))


def all_healthy(parts: DataFrame, ok: str = "ok", by: tuple[str, ...] = ()) -> DataFrame:
    """Whether all parts are, of the whole table or of each group."""
    return parts.groupBy(*by).agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("healthy"))
