"""Crawl decisions as DataFrame operators: robots rules, subpages, retries, page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylode.functions.extract import Page, page_fields
from quarrylode.functions.normalize import strip


def robots_rules(text: Column, agent: str) -> Column:
    """struct(disallowed, crawl_delay) for an agent, from the lines of a robots.txt.

    Lines of * and of agents whose name contains agent count; the first other agent after such a
    block of our own ends the reading. A null text allows everything.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("own"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("no"), F.lit(None).cast("double").alias("delay"))

    def step(a: Column, line: Column) -> Column:
        key, value = F.lower(strip(F.substring_index(line, ":", 1))), F.when(F.contains(line, F.lit(":")), strip(F.regexp_replace(line, r"^[^:]*:", ""))).otherwise("")
        ours = F.contains(F.lower(value), F.lit(agent.lower()))
        named, fits = key == "user-agent", (value == "*") | ours
        over = a["over"] | (named & ~fits & a["inside"] & a["own"])
        rule = ~named & a["inside"] & ~over
        seconds = F.try_to_number(F.regexp_extract(value, r"^[0-9]+(?:\.[0-9]+)?", 0), F.lit("99999999.999999")).cast("double")
        return F.struct(
            F.when(over, a["inside"]).when(named, fits).otherwise(a["inside"]).alias("inside"),
            (a["own"] | (named & ours & ~over)).alias("own"),
            over.alias("over"),
            F.when(rule & (key == "disallow") & (value != ""), F.concat(a["no"], F.array(value))).otherwise(a["no"]).alias("no"),
            F.when(rule & (key == "crawl-delay") & (seconds > 0), seconds).otherwise(a["delay"]).alias("delay"),
        )

    return F.aggregate(lines, start, step, lambda a: F.struct(a["no"].alias("disallowed"), a["delay"].alias("crawl_delay")))


def path_allowed(path: Column, rules: Column) -> Column:
    return ~F.exists(rules["disallowed"], lambda d: (d == "/") | F.startswith(path, d))


def retry_candidates(scrapes: DataFrame) -> DataFrame:
    """Failures that a second attempt may mend: not those that say the site is not there."""
    error = F.coalesce("error", F.lit(""))
    hopeless = F.contains(error, F.lit("DNS resolution failed")) | F.contains(error, F.lit("HTTP 404")) | F.rlike(error, F.lit("(?i)SSL|TLS|certificate|CERT_")) | F.contains(error, F.lit("ECONNREFUSED"))
    return scrapes.filter(~F.col("success") & ~hopeless)


def pages_needed(pages: DataFrame, key: str, rank: str, wanted: tuple[str, ...], most: int | None = 3) -> DataFrame:
    """Pages that a crawl in order of rank reads: while any of the wanted flags is still unset in
    the pages before, the first always, and at most so many after it."""
    before = Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy(key).orderBy(rank)
    complete = F.lit(True)
    for c in wanted:
        complete = complete & F.coalesce(F.max(F.col(c)).over(before), F.lit(False))
    kept = pages.withColumns({"_done": complete, "_at": F.row_number().over(place)}).filter(~F.col("_done"))
    return (kept.filter(F.col("_at") <= most + 1) if most is not None else kept).drop("_done", "_at")


def first_filled(pages: DataFrame, key: str, rank: str, arrays: tuple[str, ...]) -> DataFrame:
    """Of each array column the value of the first page where it is not empty."""
    return pages.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.size(c) > 0, F.col(rank))).alias(c) for c in arrays])


def first_socials(pages: DataFrame, key: str, rank: str, socials: str = "social_links") -> DataFrame:
    """For each key a map platform -> value of the first page that has the platform."""
    each = pages.select(key, rank, F.explode(socials).alias("platform", "value"))
    one = each.groupBy(key, "platform").agg(F.min_by("value", rank).alias("value"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "value")))).alias(socials))


def merged_emails(pages: DataFrame, key: str, rank: str, emails: str = "emails") -> DataFrame:
    """For each key the e-mails of its pages in order of rank, each once."""
    lists = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(emails).alias("e")))).alias("all"))
    return lists.select(key, F.array_distinct(F.flatten(F.transform("all", lambda p: p["e"]))).alias(emails))


def joined_html(pages: DataFrame, key: str, rank: str) -> DataFrame:
    """For each key all pages' html in order, each after a line that names its url."""
    marked = F.concat(F.lit("<!-- PAGE: "), F.col("url"), F.lit(" -->\n"), F.col("html"))
    lists = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), marked.alias("h")))).alias("all"))
    return lists.select(key, F.array_join(F.transform("all", lambda p: p["h"]), "\n").alias("html"))


def replace_failures(scrapes: DataFrame, retried: DataFrame, key: str = "domain") -> DataFrame:
    """Failed rows replaced by retried ones that succeeded; all other rows as they were."""
    cols = [c for c in scrapes.columns if c != key]
    again = retried.filter("success").select(key, F.struct(*cols).alias("_new"))
    use = ~F.col("success") & F.col("_new").isNotNull()
    return scrapes.join(again, key, "left").select(key, *[F.when(use, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def worst_first(scored: DataFrame, pages: DataFrame, threshold: int = 70, key: str = "domain") -> DataFrame:
    """Scored rows under the threshold whose pages were kept, worst first."""
    return scored.filter(F.col("score") < threshold).join(pages.select(key).distinct(), key, "left_semi").orderBy("score", key)


def limited(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by order: a --limit as the feature."""
    return df.orderBy(order).limit(n)


def sampled(df: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """n rows drawn uniformly: a --sample as the feature."""
    return df.orderBy(F.rand(seed)).limit(n)


def assemble(pages: DataFrame, current_year: int, most: int = 3) -> DataFrame:
    """One scrape a domain from its pages (domain, url, rank, html), the first one being home.

    Home decides names, description and logo. Further pages are read in order of rank only while
    phones, e-mails or addresses are missing, and at most so many: they give the first phones and
    addresses found, platforms not seen before, and more e-mails.
    """
    # pages beyond the most that any crawl reads are dropped before anything is read from them
    place = Window.partitionBy("domain").orderBy("rank")
    pages = pages.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= most + 1)
    parts, page = Page.cut(pages)
    read = parts.select("domain", "url", "rank", *[c.alias(n) for n, c in page_fields(page, current_year).items()])
    flags = {f"_{c}": F.size(c) > 0 for c in ("phone_numbers", "emails", "addresses")}
    read = pages_needed(read.withColumns(flags), "domain", "rank", tuple(flags), most).drop(*flags)
    own = ("company_name", "short_description", "logo_url", "year_founded", "technologies", "industry_keywords")
    home = read.groupBy("domain").agg(*[F.min_by(c, "rank").alias(c) for c in own], F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("p"))
    home = home.withColumn("pages_crawled", F.transform("p", lambda x: x["url"])).drop("p")
    filled = first_filled(read, "domain", "rank", ("phone_numbers", "jsonld_phones", "addresses"))
    out = home.join(filled, "domain").join(merged_emails(read, "domain", "rank"), "domain").join(first_socials(read, "domain", "rank"), "domain", "left")
    return out.withColumn("success", F.lit(True))
