"""Registered queries of versioned tables, feeds, fetching and orders of a language."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylode.operators import analytics as A
from quarrylode.operators import etl, versioned
from quarrylode.operators.stored import shared_dir
from quarrylode.operators.versioned import VersionedTable
from quarrylode.plans.queries import _SCRAPES, query, scrapes, t
from quarrylode.sources import pages as P
from quarrylode.sources import refine
from quarrylode.sources.crawl_source import frontier, register_crawl, remaining

#: Quiet time between bursts of a user's events, and how late they may come; events are hours apart.
QUIET_H, LATE_H = 12, 24


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/quarrylode-{uuid.uuid4().hex}"


@query("select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then -1.0::double else o_totalprice end as price, o_orderkey % 3 = 0 and o_orderkey % 2 = 0 as updated from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def versioned_upsert(spark, d):
    """Two upserts of a table in versions: the second replaces and adds rows, in their buckets only."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    table = VersionedTable(spark, _folder(spark), "o_orderkey", 32)
    table.upsert(o.filter("o_orderkey % 2 = 0"), F.lit("2025-01-01"))
    table.upsert(o.filter("o_orderkey % 3 = 0").withColumn("price", F.lit(-1.0)), F.lit("2025-01-02"))
    return table.read().select("o_orderkey", "o_custkey", "price", F.col("updated_at").isNotNull().alias("updated"))


@query(f"""with {_SCRAPES} select domain, case when doc_id % 4 > 0 then 'Acme ' || doc_id end as commercial_name, null::varchar as legal_name, case when doc_id % 4 > 0 then 'a,b' else '' end as all_names,
array_to_string(phones, ',') as phone_numbers, array_to_string(phones, ',') as phone_numbers_raw, emails[1] as primary_email, array_to_string(emails, ',') as emails, case when doc_id % 2 = 0 then 'https://facebook.com/p' || doc_id end as facebook_url, case when doc_id % 2 = 0 then 'p' || doc_id end as facebook_id,
case when doc_id % 2 = 0 then 'facebook=https://facebook.com/p' || doc_id else '' end as social_links, 0::bigint as addresses, case when n_chars > 1000 then text end as short_description, case when lang = 'en' then source || ',' || lang else lang end as technologies, case when doc_id % 4 = 0 then '/logo.png' end as logo_url, '' as industry_keywords,
case when doc_id % 5 = 0 then 1990 + doc_id % 60 end::bigint as year_founded, case when success then 'success' else 'failed' end as crawl_status, '2025-01-01 00:00:00' as crawl_timestamp from s""")
def company_table(spark, d):
    """All columns of the companies, checked in chunks, upserted into a table in versions and read back."""
    names = t(spark, d, "documents").filter("doc_id % 4 > 0").select(F.concat(F.lit(" D"), F.col("doc_id").cast("string"), F.lit(".com ")).alias("domain"), F.concat(F.lit("Acme "), F.col("doc_id").cast("string")).alias("company_commercial_name"), F.lit("").alias("company_legal_name"), F.lit("a|b").alias("company_all_available_names"), F.lit(1).alias("o"))
    rows = versioned.company_rows(etl.normalize_profiles(etl.merge_names(scrapes(spark, d), names, "o", F.lit("2025-01-01"))))
    fine, _ = versioned.chunked(rows, "domain", {n: c() for n, c in versioned.COMPANY_CHECKS.items()}, 64)
    table = VersionedTable(spark, _folder(spark), "domain", 32)
    table.upsert(fine)
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ",").alias(c)
    links = F.array_join(F.array_sort(F.transform(F.map_entries("social_links"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return table.read().select(
        "domain", "commercial_name", "legal_name", listed("all_names"), listed("phone_numbers"), listed("phone_numbers_raw"), "primary_email", listed("emails"), "facebook_url", "facebook_id", links.alias("social_links"), F.size("addresses").cast("long").alias("addresses"),
        "short_description", listed("technologies"), "logo_url", listed("industry_keywords"), F.col("year_founded").cast("long").alias("year_founded"), "crawl_status", F.date_format("crawl_timestamp", "yyyy-MM-dd HH:mm:ss").alias("crawl_timestamp"),
    )


def _file_stream(spark, d: str, name: str):
    return spark.readStream.schema(t(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query(f"""with e as (select user_id::varchar as key, ts, lag(ts) over (partition by user_id order by ts) as before from events where user_id is not null and ts is not null),
g as (select key, ts, sum(case when before is null or ts - before >= interval {QUIET_H} hour then 1 else 0 end) over (partition by key order by ts, before nulls first rows unbounded preceding) as burst from e)
select key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_change, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_change, count(*)::bigint as n_changes from g group by key, burst having max(ts) + interval {QUIET_H} hour <= (select max(ts) from events) - interval {LATE_H} hour""")
def debounced_changes(spark, d):
    """Bursts of every user's events, told once each by timers of a stateful stream."""
    from quarrylode.streaming.debounce import debounced

    at, conf = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        bursts = debounced(_file_stream(spark, d, "events"), "user_id", "ts", QUIET_H * 3_600_000, f"{LATE_H} hours")
        bursts.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, was) if was else spark.conf.unset(conf)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.schema("key string, first_change timestamp, last_change timestamp, n_changes long").parquet(f"{at}/out").select("key", shown("first_change"), shown("last_change"), "n_changes")


@query("select user_id, count(*)::bigint as n, max(value) as top, min(event_type) as first_type from events where user_id is not null group by 1")
def kept_up_users(spark, d):
    """A feed of the events merged into a table in versions by epochs; the feed is played twice."""
    from quarrylode.streaming.increments import keep_up

    at = _folder(spark)
    table = VersionedTable(spark, f"{at}/table", "user_id", 16)
    part = lambda b: b.filter("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("event_type").alias("first_type"))
    for log in ("first", "again"):
        keep_up(_file_stream(spark, d, "events"), "events", part, table, {"n": "sum", "top": "max", "first_type": "min"}, f"{at}/{log}", once=True).awaitTermination()
    return table.read()


_NAMED = "case p_partkey % 4 when 0 then upper(p_name) when 1 then replace(p_name, 'e', 'é') when 2 then replace(p_name, 'o', 'ö') else p_name end"


@query(f"with n as (select p_partkey, {_NAMED} as name from part) select row_number() over (order by strip_accents(lower(name)), lower(name), name desc, p_partkey)::bigint as place, p_partkey, name from n order by place limit 500")
def named_in_order(spark, d):
    """The first names as a language orders them: letters before accents before case."""
    rows = t(spark, d, "part").select("p_partkey", F.expr(_NAMED).alias("name"))
    page = A.page_of(rows, 0, 500, A.in_language("name"), "p_partkey")
    # the page has 500 rows, so one task may number them
    return page.select(F.row_number().over(Window.orderBy(A.in_language("name"), "p_partkey")).cast("long").alias("place"), "p_partkey", "name")


#: What the stand-in for robots files says, by the length of the domain.
_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nDisallow: /a\nCrawl-delay: 2\n"


def _robots(url: str) -> tuple[int, str | None]:
    domain = url.removeprefix("https://").removesuffix("/robots.txt")
    if len(domain) % 3 == 0:
        raise OSError("no route")
    return (200, _ROBOTS) if len(domain) % 3 == 1 else (404, None)


@query("with u as (select page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) as host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path from pages) select page_id, not (length(host) % 3 = 1 and host <> '' and (starts_with(path, '/en/') or starts_with(path, '/a'))) as allowed, case when length(host) % 3 = 1 then 2.0::double end as crawl_delay from u")
def robots_once(spark, d):
    """Verdicts of robots files on all page urls; each domain's file is asked for once."""
    found, _ = P.robots_verdicts(t(spark, d, "pages").select("page_id", "url"), _robots, "quarrybot")
    return found.select("page_id", "allowed", "crawl_delay")


def _answer(url: str) -> tuple:
    """A stand-in for the network: what a url gets is told by its length."""
    kind = len(url) % 5
    if kind == 0:
        raise OSError("unreachable")
    return {1: (404, None, None), 2: (503, "busy", "text/html"), 3: (200, "%PDF", "application/pdf")}.get(kind, (200, f"<p>{len(url)}</p>", "text/html; charset=utf-8"))


_ANSWERS = """case length(url) % 5 when 1 then 404 when 2 then 503 when 3 then 200 when 4 then 200 end::int as status, case when length(url) % 5 = 4 then '<p>' || length(url) || '</p>' end as html,
case length(url) % 5 when 0 then 'unreachable' when 1 then 'HTTP 404' when 2 then 'HTTP 503' when 3 then 'Non-HTML content: application/pdf' end as error, case when length(url) % 5 in (0, 2) then 2 else 1 end::int as attempts"""


def _crawl(spark, path: str):
    register_crawl(spark, _answer)
    return spark.read.format("crawl").option("pause_s", "0").load(path)


@query(f"select distinct url, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) as domain, {_ANSWERS} from pages")
def crawl_outcomes(spark, d):
    """All page urls through the crawl source, over a stand-in for the network."""
    path = frontier(t(spark, d, "pages"), _folder(spark), 8)
    return _crawl(spark, path).drop("time_ms")


@query("select case length(url) % 5 when 0 then 'network' when 1 then '4xx' when 2 then '5xx' when 3 then 'not html' else 'page' end as outcome, count(distinct url)::bigint as n from pages group by 1")
def crawl_resumed(spark, d):
    """A crawl that stopped half way, resumed from what it got: the outcomes of one whole run."""
    whole = frontier(t(spark, d, "pages"), _folder(spark), 8)
    begun = frontier(t(spark, d, "pages").filter("page_id % 2 = 0"), _folder(spark), 8)
    done, rest = _folder(spark), _folder(spark)
    _crawl(spark, begun).write.parquet(done)
    _crawl(spark, remaining(spark, whole, spark.read.parquet(done), _folder(spark), 8)).write.parquet(rest)
    rows = spark.read.parquet(done).unionByName(spark.read.parquet(rest))
    outcome = F.when(F.col("html").isNotNull(), "page").when(F.col("status").isNull(), "network").when(F.col("status") >= 500, "5xx").when(F.col("status") >= 400, "4xx").otherwise("not html")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


class _Busy(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


class _Model:
    """A stand-in for a language model: what it does is told by the length of the page it is shown,
    and it refuses some pages twice before it answers."""

    def __init__(self):
        self.last, self.times = "", 0

    def __call__(self, question: str) -> str:
        self.times = self.times + 1 if question == self.last else 1
        self.last = question
        n = len(question.split("\nPage:\n", 1)[1])
        if n % 5 == 0 or (n % 5 == 1 and self.times < 3):
            raise _Busy(400 if n % 5 == 0 else 429 if n % 2 else 503)
        return "Sorry" if n % 5 == 2 else f'```json\n{{"company_name": "C{n}", "emails": ["{n}@c.com", 5]}}\n```'


@query("""with p as (select page_id, length(left(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\\b[^>]*>.*?</script>', '', 'gis'), '<style\\b[^>]*>.*?</style>', '', 'gis'), '<noscript\\b[^>]*>.*?</noscript>', '', 'gis'), 60000)) as n from pages)
select page_id, case n % 5 when 0 then 'failed' when 2 then 'not json' else 'answered' end as outcome, case n % 5 when 1 then 3 else 1 end::int as calls, case when n % 5 not in (0, 2) then 'C' || n end as company, case when n % 5 not in (0, 2) then n || '@c.com' end as email from p""")
def refinement_calls(spark, d):
    """Every page put to a stand-in for a language model, refusals tried again; its answers read."""
    pages = t(spark, d, "pages")
    prompts = pages.select("page_id", refine.prompt(F.col("url"), F.col("html"), F.struct(F.col("url").alias("url"))).alias("prompt"))
    at = _folder(spark)
    refine.ask(prompts, _Model(), "page_id", pause_s=0.0).write.parquet(at)
    done = spark.read.parquet(at)
    read = P.refinements(done.filter("outcome = 'answered'").select("page_id", "answer"))
    fields = read.select("page_id", F.col("company_name").alias("company"), F.array_join("emails", ",").alias("email"))
    return done.select("page_id", "outcome", "calls").join(fields, "page_id", "left")
