"""Registered queries of reports: rates of successful rows, coverage, probes, numbers by country."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylode.functions import numbering
from quarrylode.functions.extract import all_of
from quarrylode.operators import analytics as A
from quarrylode.plans.queries import _SCRAPES, query, scrapes, t

#: Measures that a run's record has.
RECORDED = ("phone", "email", "address", "social", "description", "logo", "year_founded")


@query(f"""with {_SCRAPES}, o as (select * from s where success) select count(*)::bigint as total, avg((len(phones) > 0)::int) as phone_rate, avg((len(emails) > 0)::int) as email_rate, 0.0::double as address_rate, avg((doc_id % 2 = 0)::int) as social_rate,
avg((n_chars > 1000)::int) as description_rate, avg((doc_id % 4 = 0)::int) as logo_rate, avg((doc_id % 5 = 0)::int) as year_founded_rate from o""")
def success_fill_rates(spark, d):
    """Shares of the successful rows that have each field, as a run's record keeps them."""
    tests = A.fill_tests()
    return A.fill_rates(scrapes(spark, d).filter("success"), {n: tests[n] for n in RECORDED})


@query("""with r as (select date_trunc('month', o_orderdate) as started_at, count(*)::bigint as total_domains, count(*) filter (o_orderstatus <> 'O')::bigint as successful, sum(round(o_totalprice)::bigint)::bigint as ms from orders group by 1)
select started_at, total_domains, successful as crawled, total_domains - successful as failed, round(100.0 * successful / total_domains, 1)::double as coverage_pct, round(ms / 1000.0, 1)::double as total_crawl_time_s, round(ms::double / total_domains)::bigint as avg_crawl_time_ms from r order by started_at desc limit 1""")
def latest_coverage(spark, d):
    """Coverage and times of the latest run; each month of orders is a run."""
    o = t(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("started_at"))
    runs = o.agg(F.count(F.lit(1)).alias("total_domains"), F.count_if(F.col("o_orderstatus") != "O").alias("successful"), F.sum(F.round("o_totalprice").cast("long")).alias("total_time_ms"))
    return A.coverage(runs.withColumn("failed", F.col("total_domains") - F.col("successful")))


@query("select 'pages' as part, count(*)::bigint as n_rows, count(*) > 0 as ok from pages union all select 'documents', count(*), count(*) > 0 from documents union all select 'orders', count(*), count(*) > 0 from orders where o_orderkey < 0")
def table_probes(spark, d):
    """Which tables answer with rows."""
    return A.probes({"pages": t(spark, d, "pages"), "documents": t(spark, d, "documents"), "orders": t(spark, d, "orders").filter("o_orderkey < 0")})


#: The same numbers again, as the check states them by itself.
_CODES = "1 10 10;7 10 10;20 8 10;27 9 9;30 10 10;31 9 9;32 8 9;33 9 9;34 9 9;36 8 9;39 6 11;40 9 9;41 9 9;43 4 13;44 9 10;45 8 8;46 7 10;47 8 8;48 9 9;49 4 13;51 8 9;52 10 10;54 10 11;55 10 11;56 9 9;57 8 10;58 10 10;60 8 10;61 9 9;62 8 12;63 8 10;64 8 10;65 8 8;66 8 9;81 9 10;82 8 11;84 9 10;86 10 11;90 10 10;91 10 10;92 9 10;94 9 9;212 9 9;213 8 9;216 8 8;234 8 10;254 9 9;351 9 9;352 4 11;353 7 9;354 7 9;358 5 12;359 7 9;370 8 8;371 8 8;372 7 8;380 9 9;385 8 9;386 8 8;420 9 9;421 9 9;852 8 8;886 8 9;966 8 9;971 8 9;972 8 9"
_PLUS = r"\+[0-9][0-9() .-]{5,18}[0-9]"


@query(f"""with codes as (select x[1] as code, x[2]::int as least, x[3]::int as most from (select string_split(unnest(string_split('{_CODES}', ';')), ' ') as x)),
found as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_PLUS}')), '[^0-9]', '', 'g') as digits from documents),
led as (select doc_id, digits, code, least, most from found left join codes on starts_with(digits, code))
select coalesce(code, '?') as code, count(*)::bigint as n, count(*) filter (length(digits) - length(code) between least and most and (code <> '1' or regexp_matches(digits, '^1[2-9][0-9]{{2}}[2-9][0-9]{{6}}$')))::bigint as valid from led group by 1""")
def phone_countries(spark, d):
    """Numbers with a plus in all texts, by country, and how many have a length the country uses."""
    found = t(spark, d, "documents").select(F.explode(all_of(F.col("text"), _PLUS)).alias("phone"))
    code = F.coalesce(numbering.country_code(F.regexp_replace("phone", "[^0-9]", "")), F.lit("?"))
    return found.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count(numbering.international(F.col("phone"))).alias("valid"))
