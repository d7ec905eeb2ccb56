"""Registered queries of the library's operators over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylode.functions import extract as X
from quarrylode.functions import normalize as N
from quarrylode.functions import quality as Q
from quarrylode.operators import analytics as A
from quarrylode.operators import crawl, etl, match
from quarrylode.operators.overlay import overlay
from quarrylode.operators.textindex import TextIndex, expand_fuzzy, grams, name_tokens
from quarrylode.plans import sql as S
from quarrylode.sources import pages as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
YEAR = 2025


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame, key: str, most: int = 5_000) -> DataFrame:
    """Rows dealt by a key over tasks of about so many, before each is made a page: a few megabytes of
    compressed rows are one task's file, but hours of one task's work."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Normalisers


@query(f"select page_id, {S.url('url')} as domain from pages")
def url_domain(spark, d):
    return t(spark, d, "pages").select("page_id", N.normalize_url(F.col("url")).alias("domain"))


@query(f"select domain, count(*)::bigint as n from (select {S.url('url')} as domain from pages) where domain is not null group by 1 order by n desc, domain limit 10")
def pages_per_domain_topk(spark, d):
    domains = t(spark, d, "pages").select(F.array(N.normalize_url(F.col("url"))).alias("x")).filter("x[0] is not null")
    return A.ranking(domains, "x", 10).select(F.col("item").alias("domain"), "n")


_NAMED = "p_name || case p_partkey % 8 when 0 then ' Pty. Ltd.' when 1 then ' Holdings LLC.' when 2 then ' & Co.' when 3 then ' Inc' when 4 then '*' when 5 then ' Services //' when 6 then ' - Limited' else '' end"


@query(f"select p_partkey, {S.company(_NAMED)} as name from part")
def company_name_norm(spark, d):
    return t(spark, d, "part").select("p_partkey", N.normalize_company_name(F.expr(_NAMED)).alias("name"))


_PAGE = "case p_partkey % 6 when 0 then 'https://www.facebook.com/' || replace(p_name, ' ', '-') || '/' when 1 then 'facebook.com/' || replace(p_name, ' ', '.') || '?ref=' || p_partkey when 2 then 'https://facebook.com/pages' when 3 then 'https://twitter.com/x' when 4 then 'https://www.facebook.com/' else 'http://facebook.com/' || p_partkey || '/posts#a' end"


@query(f"select p_partkey, {S.facebook(_PAGE)} as page from part")
def facebook_id(spark, d):
    return t(spark, d, "part").select("p_partkey", N.normalize_facebook(F.expr(_PAGE)).alias("page"))


_RAW_PHONE = "case c_custkey % 5 when 0 then '(207) 762-' || lpad((c_custkey % 10000)::varchar, 4, '0') when 1 then '+1703-684-' || lpad((c_custkey % 10000)::varchar, 4, '0') when 2 then '(+877) 449-' || lpad((c_custkey % 10000)::varchar, 4, '0') when 3 then '123' else '+49 30 ' || (1000000 + c_custkey)::varchar end"


@query(f"select c_custkey, {S.phone(_RAW_PHONE)} as phone from customer")
def phone_norm(spark, d):
    raw = _RAW_PHONE.replace("::varchar", "").replace("(c_custkey % 10000)", "cast(c_custkey % 10000 as string)").replace("(1000000 + c_custkey)", "cast(1000000 + c_custkey as string)")
    return t(spark, d, "customer").select("c_custkey", N.normalize_phone(F.expr(raw)).alias("phone"))


_INPUT = {"website": "case when c_custkey % 2 = 0 then 'https://www.' || lower(replace(c_name, '#', '')) || '.com/a?b' end", "facebook": "case when c_custkey % 7 = 0 then 'facebook.com/' || c_name end", "phone": "case when c_custkey % 3 = 0 then '(207) 762-' || lpad(cast(c_custkey % 10000 as varchar(9)), 4, '0') end", "name": "case when c_custkey % 5 > 0 then c_name || ' Inc.' end"}
_KEYS = f"{S.url(_INPUT['website'])} as domain, {S.phone(_INPUT['phone'])} as phone, {S.facebook(_INPUT['facebook'])} as facebook_id, {S.company(_INPUT['name'])} as name"


@query(f"select input_id, domain, phone, facebook_id, name, concat_ws(',', case when domain is not null then 'website' end, case when phone is not null then 'phone' end, case when facebook_id is not null then 'facebook' end, case when name is not null then 'name' end) as usable from (select c_custkey as input_id, {_KEYS} from customer)")
def match_input_norm(spark, d):
    inputs = t(spark, d, "customer").select(F.col("c_custkey").alias("input_id"), *[F.expr(e.replace("varchar(9)", "string")).alias(k) for k, e in _INPUT.items()])
    return match.normalize_inputs(inputs).withColumn("usable", F.array_join("usable", ","))


# Extraction


@query("select distinct doc_id, '+1' || right(x, 10) as phone from (select doc_id, unnest(list_concat(regexp_extract_all(text, '(?:\\+?1[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}'), regexp_extract_all(text, '\\+1\\d{10}'))) as raw, regexp_replace(raw, '[^0-9]', '', 'g') as x from documents) where regexp_matches(x, '^1?[2-9][0-9]{2}[2-9][0-9]{6}$')")
def phone_extract_norm(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(X.phones_in(F.col("text"))).alias("phone"))


@query("select distinct doc_id, lower(x) as email, (lower(x) like '%example.com%' or lower(x) like '%sentry.io%' or lower(x) like '%wixpress.com%' or lower(x) like '%schema.org%' or lower(x) like '%json-ld.org%') as junk from (select doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) as x from documents)")
def email_extract(spark, d):
    found = F.array_distinct(F.transform(X.all_of(F.col("text"), X.EMAIL), F.lower))
    return t(spark, d, "documents").select("doc_id", F.explode(found).alias("email")).withColumn("junk", X.is_junk_email(F.col("email")))


@query("select page_id, title, nullif(trim(regexp_replace(title, '(?i)\\s*[|–—-]\\s*(home|welcome|official|main).*$', '')), '') as name from (select page_id, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)) as title from pages)")
def page_title_name(spark, d):
    title = X.title_of(F.col("html"))
    return t(spark, d, "pages").select("page_id", title.alias("title"), X.company_name_of(title).alias("name"))


@query("select page_id, nullif(regexp_extract(html, '(?is)<footer\\b[^>]*>(.*?)</footer>', 1), '') as footer from pages")
def page_footer(spark, d):
    return t(spark, d, "pages").select("page_id", X.footer_of(F.col("html")).alias("footer"))


@query("select page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', '', 'g')) as digest from pages")
def strip_scripts(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(X.strip_scripts(F.col("html"))).alias("digest"))


_PROFILE = "'https://' || case page_id % 5 when 0 then 'www.facebook.com' when 1 then 'X.com' when 2 then 'linkedin.com' when 3 then 'example.com' else 'www.github.com' end || substr(url, 9)"


@query(f"select page_id, case regexp_replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), '^www[.]', '') when 'facebook.com' then 'facebook' when 'x.com' then 'twitter' when 'twitter.com' then 'twitter' when 'linkedin.com' then 'linkedin' when 'github.com' then 'github' end as platform from (select page_id, {_PROFILE.replace('substr(url, 9)', "'/p/' || page_id")} as u from pages)")
def social_platform(spark, d):
    url = F.expr(_PROFILE.replace("substr(url, 9)", "'/p/' || cast(page_id as string)"))
    return t(spark, d, "pages").select("page_id", X.social_platform(url).alias("platform"))


@query("select page_id, case when page_id % 3 = 0 then 'https://x.com/f' || page_id else 'https://twitter.com/a' || page_id end as twitter, case when page_id % 2 = 0 then 'https://facebook.com/p' || page_id end as facebook from pages")
def page_socials(spark, d):
    id_ = F.col("page_id").cast("string")
    foot = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<footer><a href="https://x.com/f'), id_, F.lit('">x</a></footer>'))).otherwise("")
    face = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="https://facebook.com/">f</a><a href="https://facebook.com/p'), id_, F.lit('">f</a>'))).otherwise("")
    html = F.concat(F.lit('<body><a href="https://twitter.com/a'), id_, F.lit('">t</a>'), face, foot, F.lit("</body>"))
    socials = t(spark, d, "pages").select("page_id", X.page_socials(html).alias("s"))
    return socials.select("page_id", F.try_element_at("s", F.lit("twitter"))["value"].alias("twitter"), F.try_element_at("s", F.lit("facebook"))["value"].alias("facebook"))


_MARK = "case page_id % 4 when 0 then '<script src=\"/wp-content/jquery.js\"></script>' when 1 then '<script src=\"https://www.googletagmanager.com/gtm.js\"></script>' when 2 then '<link href=\"https://cdn.shopify.com/x.css\">' else '' end"


@query("select tech, count(*)::bigint as n from (select unnest(case page_id % 4 when 0 then ['WordPress', 'jQuery'] when 1 then ['Google Analytics', 'Google Tag Manager'] when 2 then ['Shopify'] else [] end) as tech from pages) group by 1 order by n desc, tech limit 10")
def tech_detect(spark, d):
    html = F.concat(F.expr(_MARK), F.coalesce("html", F.lit("")))
    return A.ranking(t(spark, d, "pages").select(X.technologies_in(html).alias("x")), "x", 10).select(F.col("item").alias("tech"), "n")


@query("select c_custkey, 'user' || c_custkey || '@acme.org' as email from customer")
def cf_email_decode(spark, d):
    plain = F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@acme.org"))
    key = (F.col("c_custkey") % 200 + 1).cast("int")
    two = lambda v: F.lpad(F.lower(F.hex(v)), 2, "0")
    code = F.concat(two(key), F.array_join(F.transform(F.sequence(F.lit(1), F.length(plain)), lambda i: two(F.ascii(F.substring(plain, i, F.lit(1))).bitwiseXOR(key))), ""))
    return spread(t(spark, d, "customer"), "c_custkey").select("c_custkey", X.decode_cf_email(code).alias("email"))


_HIDDEN = "'write to Info' || c_custkey || case c_custkey % 3 when 0 then ' [at] acme.co {dot} uk' when 1 then '(AT)acme(dot)org' else ' at acme dot org' end || ' today'"


@query(f"select c_custkey, lower(regexp_replace(regexp_replace(regexp_extract(x, '\\S+ ?[[({{](at|AT)[])}}].*[[({{]dot[])}}] ?\\w+'), ' ?[[({{](at|AT)[])}}] ?', '@'), ' ?[[({{]dot[])}}] ?', '.')) as email from (select c_custkey, {_HIDDEN} as x from customer) where regexp_matches(x, '[[(](at|AT)[])]')")
def hidden_email(spark, d):
    text = F.expr(_HIDDEN.replace("|| c_custkey ||", "|| cast(c_custkey as string) ||"))
    return spread(t(spark, d, "customer"), "c_custkey").select("c_custkey", F.explode(X.hidden_emails(text)).alias("email"))


_ADDRESS = "c_custkey % 900 + 1 || ' Elm Street, Bath Town, ' || case c_custkey % 3 when 0 then 'IL 62701' when 1 then 'ME' else 'TX 75001-1234' end || case when c_custkey % 4 = 0 then ' and P.O. Box 12, Reno, NV 89501' else '' end"


@query(f"select c_custkey, f.method, f.value from (select c_custkey, {_ADDRESS} as txt from customer), unnest(list_concat(list_transform(regexp_extract_all(txt, {S.lit(X.ADDRESS_FULL)}), lambda x: {{'method': 'regex_us_full', 'value': x}}), list_transform(regexp_extract_all(txt, {S.lit(X.ADDRESS_NO_ZIP)}), lambda x: {{'method': 'regex_us_no_zip', 'value': x}}), list_transform(regexp_extract_all(txt, {S.lit(X.ADDRESS_BOX)}), lambda x: {{'method': 'regex_po_box', 'value': trim(x)}}))) as u(f)")
def address_regex(spark, d):
    text = F.expr(_ADDRESS.replace("c_custkey % 900 + 1 ||", "cast(c_custkey % 900 + 1 as string) ||"))
    found = spread(t(spark, d, "customer"), "c_custkey").select("c_custkey", F.explode(X.tidy(X.addresses_in(text))).alias("p"))
    return found.select("c_custkey", F.col("p.extraction_method").alias("method"), F.col("p.value").alias("value"))


@query("select c_custkey, case when c_custkey % 4 < 3 then c_name end as name, case when c_custkey % 4 < 3 then 1900 + (c_custkey % 100)::bigint end as founded, case when c_custkey % 4 < 3 then c_mktsegment || ', ME' else '' end as address, case when c_custkey % 4 < 3 then 'hq@acme.org' else '' end as email from customer")
def json_ld_org(spark, d):
    body = F.to_json(F.struct(F.when(F.col("c_custkey") % 4 == 3, "Person").otherwise("Store").alias("@type"), F.col("c_name").alias("name"), (1900 + F.col("c_custkey") % 100).cast("string").alias("foundingDate"), F.lit("mailto:hq@acme.org").alias("email"), F.struct(F.col("c_mktsegment").alias("streetAddress"), F.lit("ME").alias("addressRegion")).alias("address")))
    wrapped = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"@graph":['), body, F.lit("]}"))).otherwise(body)
    html = F.concat(F.lit('<script type="application/ld+json">'), wrapped, F.lit("</script>"))
    pages, page = X.Page.cut(spread(t(spark, d, "customer"), "c_custkey").select("c_custkey", html.alias("html")))
    org = pages.select("c_custkey", X.json_ld_organisation(page, YEAR).alias("o"))
    return org.select("c_custkey", F.col("o.name").alias("name"), big("o.founded").alias("founded"), F.array_join("o.addresses", "|").alias("address"), F.array_join("o.emails", "|").alias("email"))


_YEARS = "case o_orderkey % 4 when 0 then 'since ' || (1795 + o_orderkey % 60) when 1 then '© ' || (1990 + o_orderkey % 60) when 2 then 'Founded in 1950, copyright 2001' else 'none' end"


@query(f"select o_orderkey, case when y between 1800 and 2025 then y end as year from (select o_orderkey, nullif(regexp_extract(x, '(since |© |Founded in )([0-9]{{4}})', 2), '')::bigint as y from (select o_orderkey, {_YEARS} as x from orders))")
def year_founded(spark, d):
    text = F.expr(_YEARS.replace("(1795 + o_orderkey % 60)", "cast(1795 + o_orderkey % 60 as string)").replace("(1990 + o_orderkey % 60)", "cast(1990 + o_orderkey % 60 as string)"))
    return t(spark, d, "orders").select("o_orderkey", big(X.year_founded(text, YEAR)).alias("year"))


@query("select p_partkey, array_to_string(list_slice(list_filter(list_transform(string_split(p_name || ', ' || p_type || ',ab,' || p_brand, ','), lambda k: lower(trim(k))), lambda k: length(k) between 3 and 49), 1, 10), '|') as words from part")
def meta_keywords(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(X.keywords(F.concat_ws(",", F.concat("p_name", F.lit(", "), "p_type"), F.lit("ab"), "p_brand")), "|").alias("words"))


@query("select c_custkey, lower(c_name) as name, 2::bigint as emails, null::bigint as year from customer")
def refinement_parse(spark, d):
    answer = F.concat(F.lit('```json\n{"company_name":"'), F.lower("c_name"), F.lit('","emails":["a@b.co",7,"c@d.co"],"year_founded":"x","phone_numbers":3}\n```'))
    parsed = P.refinements(t(spark, d, "customer").select("c_custkey", answer.alias("answer")))
    return parsed.select("c_custkey", F.col("company_name").alias("name"), big(F.size("emails")).alias("emails"), big("year_founded").alias("year"))


# Crawl


_ROBOTS = "# c\\nUser-agent: *\\nDisallow: /fr\\nUser-agent: OtherBot\\nDisallow: /\\nUser-agent: QuarryBot\\nDisallow: /de/\\nCrawl-delay: 2.5\\nUser-agent: Last\\nDisallow: /es"


@query(r"select page_id, not (starts_with(path, '/fr') or starts_with(path, '/de/')) as allowed, 2.5::double as delay from (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)")
def robots_allowed(spark, d):
    rules = t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), crawl.robots_rules(F.lit(_ROBOTS.replace("\\n", "\n")), "quarrybot").alias("r"))
    return rules.select("page_id", crawl.path_allowed(F.col("path"), F.col("r")).alias("allowed"), F.col("r.crawl_delay").alias("delay"))


@query("select conv_id, turn from (select conv_id, turn, row_number() over w as seq, coalesce(max((length(text) % 2 = 0)::int) over b, 0) + coalesce(max((length(text) % 3 = 0)::int) over b, 0) as have from conversations window w as (partition by conv_id order by turn), b as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)) where have < 2 and seq <= 4")
def subpage_stop(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 2 == 0).alias("phone"), (F.length("text") % 3 == 0).alias("email"))
    return crawl.pages_needed(rows, "conv_id", "turn", ("phone", "email")).select("conv_id", "turn")


@query("select conv_id, arg_min(role, turn) filter (where length(text) % 2 = 0) as first_role, arg_min(turn, turn) filter (where length(text) % 2 = 0) as first_turn from conversations group by 1")
def first_page_wins(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 2 == 0, F.array("role")).otherwise(F.array().cast("array<string>")).alias("roles"), F.when(F.length("text") % 2 == 0, F.array("turn")).otherwise(F.array().cast("array<long>")).alias("turns"))
    one = crawl.first_filled(rows, "conv_id", "turn", ("roles", "turns"))
    return one.select("conv_id", F.try_element_at("roles", F.lit(1)).alias("first_role"), F.try_element_at("turns", F.lit(1)).alias("first_turn"))


@query("select conv_id, string_agg('<!-- PAGE: ' || role || ' -->' || chr(10) || text, chr(10) order by turn) as html from conversations group by 1")
def joined_pages(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("url"), F.col("text").alias("html"))
    return crawl.joined_html(rows, "conv_id", "turn")


@query(f"with c as (select distinct {S.url('url')} as domain from pages), u as (select domain, r, ['https://', 'http://', 'https://www.', 'http://www.'][r + 1] || domain as url from c, (select unnest([0, 1, 2, 3]) as r)) select domain, arg_min(url, r) as url from u where length(domain) % 4 <= r group by 1")
def url_candidates(spark, d):
    domains = t(spark, d, "pages").select(N.normalize_url(F.col("url")).alias("domain")).distinct()
    tried = P.candidate_urls(domains).withColumn("html", F.when(F.length("domain") % 4 <= F.col("rank"), F.lit("ok")))
    return P.first_success(tried).select("domain", "url")


@query(f"with x as (select {S.url('url')} as domain, page_id, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)) as title from pages) select domain, arg_min(nullif(trim(regexp_replace(title, '(?i)\\s*[|–—-]\\s*(home|welcome|official|main).*$', '')), ''), page_id) as company_name, least(count(*), 4)::bigint as n_pages from x where domain is not null group by 1")
def scrape_assembly(spark, d):
    """Pages of a host as one crawl, in order of their ids; none of them has all contact data."""
    found = t(spark, d, "pages").select(N.normalize_url(F.col("url")).alias("domain"), "url", F.col("page_id").alias("rank"), "html").filter("domain is not null")
    return crawl.assemble(found, YEAR).select("domain", "company_name", big(F.size("pages_crawled")).alias("n_pages"))


_ERROR = "case event_id % 9 when 0 then 'DNS resolution failed for x' when 1 then 'HTTP 404' when 2 then 'HTTP 503' when 3 then 'deadline exceeded' when 4 then 'request timeout' when 5 then 'connect ECONNREFUSED' when 6 then 'SSL certificate problem' when 7 then null else 'odd' end"


@query(f"select event_id from (select event_id, event_id % 2 = 0 as success, coalesce({_ERROR}, '') as e from events) where not success and e not like '%DNS resolution failed%' and e not like '%HTTP 404%' and not regexp_matches(e, '(?i)SSL|TLS|certificate|CERT_') and e not like '%ECONNREFUSED%'")
def retry_candidates(spark, d):
    rows = t(spark, d, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("success"), F.expr(_ERROR).alias("error"))
    return crawl.retry_candidates(rows).select("event_id")


@query("select event_id, case when event_id % 3 = 0 and event_id % 2 = 1 then 'second' else 'first' end as tier, (event_id % 3 = 0 and event_id % 2 = 1) or event_id % 2 = 0 as success from events")
def replace_failures(spark, d):
    e = t(spark, d, "events")
    first = e.select("event_id", F.lit("first").alias("tier"), (F.col("event_id") % 2 == 0).alias("success"))
    again = e.filter("event_id % 2 = 1").select("event_id", F.lit("second").alias("tier"), (F.col("event_id") % 3 == 0).alias("success"))
    return crawl.replace_failures(first, again, "event_id")


# ETL


@query("select d.doc_id, l.quality::bigint as quality, coalesce(l.names, '') as names from documents d left join (select doc_id, quality, 'A ' || doc_id || '|B' as names from labels qualify row_number() over (partition by doc_id order by quality desc) = 1) l on d.doc_id = l.doc_id")
def merge_left_join(spark, d):
    names = t(spark, d, "labels").select("doc_id", "quality", F.concat(F.lit(" A "), F.col("doc_id").cast("string"), F.lit(" || B ")).alias("names"))
    one = etl.last_by_key(names.withColumn("o", F.col("quality")), "doc_id", "o")
    return t(spark, d, "documents").select("doc_id").join(one, "doc_id", "left").select("doc_id", big("quality").alias("quality"), F.array_join(N.split_names(F.col("names")), "|").alias("names"))


def scrapes(spark, d) -> DataFrame:
    """Documents as scrapes: phones and e-mails found in them, a description, no pages."""
    x = t(spark, d, "documents")
    points = lambda v, m: F.transform(v, lambda p: F.struct(p.alias("value"), F.lit("u").alias("source_url"), F.lit("e").alias("source_element"), F.lit(m).alias("extraction_method"), F.lit(0.8).alias("confidence"), F.lit(None).cast("timestamp").alias("extracted_at")))
    point = "struct<value:string,source_url:string,source_element:string,extraction_method:string,confidence:double,extracted_at:timestamp>"
    return x.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".com")).alias("domain"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Name "), F.col("doc_id").cast("string"))).alias("company_name"),
        (F.col("doc_id") % 10 > 0).alias("success"),
        points(X.phones_in(F.col("text")), "regex").alias("phone_numbers"),
        F.when(F.col("doc_id") % 2 == 0, F.map_from_arrays(F.array(F.lit("facebook")), points(F.array(F.concat(F.lit("https://facebook.com/p"), F.col("doc_id").cast("string"))), "anchor_tag"))).otherwise(F.create_map().cast(f"map<string,{point}>")).alias("social_links"),
        F.array().cast(f"array<{point}>").alias("addresses"),
        points(F.array_distinct(F.transform(X.all_of(F.col("text"), X.EMAIL), F.lower)), "regex").alias("emails"),
        F.when(F.col("n_chars") > 1000, points(F.array("text"), "meta")[0]).alias("short_description"),
        F.when(F.col("lang") == "en", F.array(F.col("source"), F.col("lang"))).otherwise(F.array("lang")).alias("technologies"),
        F.when(F.col("doc_id") % 4 == 0, "/logo.png").alias("logo_url"),
        F.array().cast("array<string>").alias("industry_keywords"),
        F.when(F.col("doc_id") % 5 == 0, (1990 + F.col("doc_id") % 60).cast("int")).alias("year_founded"),
        F.col("n_chars").alias("crawl_time_ms"),
        F.array(F.lit("u")).alias("pages_crawled"),
        F.when(F.col("doc_id") % 10 == 0, F.expr(_ERROR.replace("event_id", "cast(doc_id / 10 as bigint)"))).alias("error"),
    )


_PHONE_LIST = S.phone_list("text")
_EMAIL_LIST = S.ordered_distinct("list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'), lambda x: lower(x))")
_SCRAPES = f"s as (select 'd' || doc_id || '.com' as domain, doc_id, text, lang, source, n_chars, doc_id % 10 > 0 as success, {_PHONE_LIST} as phones, {_EMAIL_LIST} as emails from documents)"


@query(f"with {_SCRAPES} select domain, 'phone' as field_name, unnest(phones) as field_value from s where success union all select domain, 'email', unnest(emails) from s where success union all select domain, 'social_facebook', 'https://facebook.com/p' || doc_id from s where success and doc_id % 2 = 0 union all select domain, 'description', text from s where success and n_chars > 1000")
def provenance_long(spark, d):
    return etl.provenance(scrapes(spark, d)).select("domain", "field_name", "field_value")


@query(f"with {_SCRAPES} select domain, case when doc_id % 4 > 0 then 'Acme ' || doc_id end as commercial_name, len(phones)::bigint as phones, case when len(emails) > 0 then emails[1] end as primary_email, case when doc_id % 2 = 0 then 'p' || doc_id end as facebook_id, case when success then 'success' else 'failed' end as status from s")
def profiles_normalized(spark, d):
    names = t(spark, d, "documents").filter("doc_id % 4 > 0").select(F.concat(F.lit(" D"), F.col("doc_id").cast("string"), F.lit(".com ")).alias("domain"), F.concat(F.lit("Acme "), F.col("doc_id").cast("string")).alias("company_commercial_name"), F.lit("").alias("company_legal_name"), F.lit("a|b").alias("company_all_available_names"), F.lit(1).alias("o"))
    done = etl.normalize_profiles(etl.merge_names(scrapes(spark, d), names, "o", F.lit("2025-01-01")))
    return done.select("domain", "commercial_name", big(F.size("phone_numbers")).alias("phones"), "primary_email", "facebook_id", F.col("crawl_status").alias("status"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then -1.0::double else o_totalprice end as price, o_orderkey % 3 = 0 and o_orderkey % 2 = 0 as updated from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def upsert_merge(spark, d):
    o = t(spark, d, "orders")
    old = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit(-1.0).alias("price"))
    return etl.upsert(old, new, "o_orderkey", F.lit("2025-01-01")).select("o_orderkey", "price", F.col("updated_at").isNotNull().alias("updated"))


@query("select year(o_orderdate) * 100 + month(o_orderdate) as total_domains, count(*)::bigint as successful from orders group by 1 having (year(o_orderdate) * 100 + month(o_orderdate)) % 2 = 1")
def run_dedupe(spark, d):
    runs = t(spark, d, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("total_domains")).agg(F.count(F.lit(1)).alias("successful"))
    return etl.new_runs(runs, runs.filter("total_domains % 2 = 0"), ("total_domains", "successful"))


@query("select p_partkey, string_agg(w || ':' || k, '|' order by k, w) as tokens from (select distinct p_partkey, 'A' as k, unnest(string_split(lower(p_name), ' ')) as w from part union all select distinct p_partkey, 'C', unnest(regexp_extract_all(lower(p_brand), '[a-z0-9]+')) from part) where w <> '' group by 1")
def name_vector(spark, d):
    v = etl.name_vector(F.col("p_name"), F.lit(None).cast("string"), F.col("p_brand"), F.lit(None).cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.transform(v, lambda x: F.struct(x["weight"].alias("w"), x["token"].alias("t")))), lambda x: F.concat_ws(":", x["t"], x["w"])), "|")
    return t(spark, d, "part").select("p_partkey", text.alias("tokens"))


@query(f"with {_SCRAPES} select domain, case when doc_id % 7 = 0 then 'x' || doc_id || '@new.org' else emails[1] end as email, case when doc_id % 3 > 0 then 'Name ' || doc_id when doc_id % 7 = 0 then 'Fresh' end as name, case when doc_id % 5 = 0 and not (doc_id % 7 = 0 and 1990 + doc_id % 60 >= 2025) then 1990 + doc_id % 60 end as year from s")
def overlay_merge(spark, d):
    """All scrapes; a seventh of them has a refined row."""
    base = scrapes(spark, d)
    refined = t(spark, d, "documents").filter("doc_id % 7 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".com")).alias("domain"), F.lit("Fresh").alias("company_name"), F.array(F.concat(F.lit("X"), F.col("doc_id").cast("string"), F.lit("@new.org"))).alias("emails"), F.array().cast("array<string>").alias("phone_numbers"), F.array().cast("array<string>").alias("addresses"), F.lit(None).cast("string").alias("short_description"), F.lit(None).cast("int").alias("year_founded"), F.lit(None).cast("string").alias("logo_url"), F.create_map().cast("map<string,string>").alias("social_links"))
    done = overlay(base, refined, YEAR, F.lit("2025-01-01"))
    return done.select("domain", F.try_element_at("emails", F.lit(1))["value"].alias("email"), F.col("company_name").alias("name"), big("year_founded").alias("year"))


# Quality and analytics


@query(f"with {_SCRAPES} select domain, greatest(0, 100 - case when doc_id % 3 = 0 then 15 else 0 end - case when len(emails) = 0 then 10 else 0 end - case when len(phones) = 0 then 10 else 0 end - 10 - case when n_chars > 1000 then 0 else 5 end - 15 * len(list_filter(emails, lambda e: string_split(e, '@')[2] in ('example.com', 'sentry.io', 'keen.io', 'wixpress.com', 'schema.org', 'json-ld.org', 'gravatar.com', 'wordpress.org', 'w3.org', 'googleapis.com', 'googletagmanager.com'))) - 20 * len(list_filter(emails, lambda e: regexp_matches(string_split(e, '@')[1], '[0-9]{{7,}}'))) - 10 * len(list_filter(emails, lambda e: contains(e, '%'))) - case when doc_id % 5 = 0 and 1990 + doc_id % 60 >= 2025 then 15 else 0 end - case when doc_id % 4 = 0 then 5 else 0 end - case when success and doc_id % 3 = 0 and len(emails) = 0 and len(phones) = 0 then 30 else 0 end - case when n_chars > 1000 and regexp_matches(text, '(?i)casino|gambling|betting|slot\\s?gacor|poker|happybet|togel|judi|sbobet') then 30 else 0 end)::bigint as score from s")
def quality_score(spark, d):
    s = scrapes(spark, d)
    plain = lambda c: F.transform(c, lambda p: p["value"])
    found = Q.penalties(F.col("domain"), F.col("company_name"), plain("emails"), plain("phone_numbers"), plain("addresses"), F.col("short_description.value"), F.col("logo_url"), F.col("year_founded"), F.col("success"), F.col("pages_crawled"), YEAR)
    return s.select("domain", big(Q.quality(found)["score"]).alias("score"))


@query(f"with {_SCRAPES} select count(*)::bigint as total, count_if(len(phones) > 0)::bigint as with_phone, count_if(doc_id % 2 = 0)::bigint as with_facebook, count_if(doc_id % 2 = 0)::bigint as with_social, 0::bigint as with_address, count_if(len(emails) > 0)::bigint as with_email, count_if(n_chars > 1000)::bigint as with_description, count(*)::bigint as with_technology, count_if(doc_id % 4 = 0)::bigint as with_logo, count_if(doc_id % 5 = 0)::bigint as with_year_founded from s where success")
def fill_counts(spark, d):
    return A.fill_counts(scrapes(spark, d).filter("success"), A.fill_tests())


_RATES = {"phone": "len(phones) > 0", "facebook": "doc_id % 2 = 0", "social": "doc_id % 2 = 0", "address": "false", "email": "len(emails) > 0", "description": "n_chars > 1000", "technology": "true"}


@query(f"with {_SCRAPES} select count(*)::bigint as total, {', '.join(f'round(count_if({test}) / count(*), 9) as {k}_rate' for k, test in _RATES.items())} from s")
def fill_rates(spark, d):
    rates = A.fill_rates(scrapes(spark, d), {k: v for k, v in A.fill_tests().items() if k in _RATES})
    return rates.select("total", *[F.round(f"{k}_rate", 9).alias(f"{k}_rate") for k in _RATES])


@query("select item, count(*)::bigint as n from (select unnest(case when lang = 'en' then [source, lang] else [lang] end) as item from documents where doc_id % 10 > 0) group by 1 order by n desc, item limit 12")
def top_technologies(spark, d):
    return A.ranking(scrapes(spark, d).filter("success"), "technologies", 12)


_ERRORS = f"(select {_ERROR} as error from events)"


@query(f"select case when e like '%timeout%' or e like '%deadline exceeded%' then 'timeout' when e like '%DNS resolution failed%' or e like '%ENOTFOUND%' then 'DNS failure' when e like '%ECONNREFUSED%' then 'Connection refused' when regexp_matches(e, 'SSL|TLS|certificate') then 'SSL/TLS error' when e like '%HTTP%' then e else 'other' end as class, count(*)::bigint as n from (select coalesce(error, 'unknown') as e from {_ERRORS}) group by 1")
def error_classes(spark, d):
    return t(spark, d, "events").select(A.error_class(F.expr(_ERROR)).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"select *, failed - dns - http_4xx - http_5xx - timeout as other from (select count(*)::bigint as failed, count_if(error like '%DNS resolution failed%')::bigint as dns, count_if(regexp_matches(error, 'HTTP 4[0-9][0-9]'))::bigint as http_4xx, count_if(regexp_matches(error, 'HTTP 5[0-9][0-9]'))::bigint as http_5xx, count_if(error like '%deadline%' or error like '%timeout%')::bigint as timeout from {_ERRORS})")
def error_breakdown(spark, d):
    return A.error_counts(t(spark, d, "events").select(F.expr(_ERROR).alias("error")), "error")


@query(f"select *, failed - dns - http_4xx - http_5xx - timeout as other from (select count(*)::bigint as failed, count_if(error like '%DNS resolution failed%')::bigint as dns, count_if(regexp_matches(error, 'HTTP 4[0-9][0-9]'))::bigint as http_4xx, count_if(regexp_matches(error, 'HTTP 5[0-9][0-9]'))::bigint as http_5xx, count_if(error like '%deadline exceeded%' or error like '%timeout%' or error like '%Timeout%')::bigint as timeout from {_ERRORS})")
def error_breakdown_scrape(spark, d):
    return A.error_counts(t(spark, d, "events").select(F.expr(_ERROR).alias("error")), "error", ("deadline exceeded", "timeout", "Timeout"))


@query("select count(*)::bigint as total_domains, count_if(doc_id % 10 > 0)::bigint as successful, count_if(doc_id % 10 = 0)::bigint as failed, sum(n_chars)::bigint as total_time_ms, count(*)::bigint as total_pages_crawled, round(sum(n_chars) / count(*))::bigint as avg_crawl_time_ms, round(100.0 * count_if(doc_id % 10 > 0) / count(*), 1)::double as success_pct from documents")
def run_summary(spark, d):
    s = A.run_summary(scrapes(spark, d))
    s = s.select(*[big(c).alias(c) for c in s.columns])
    return s.withColumn("success_pct", A.percent(F.col("successful"), F.col("total_domains")).cast("double"))


@query("select o_orderkey, o_orderdate, 100.0::double * (o_orderkey % 50) / 50 as rate, case when round(o_totalprice) = 0 then '—' when round(o_totalprice / 1000) < 60 then round(o_totalprice / 1000)::bigint || 's' else (round(o_totalprice / 1000)::bigint // 60) || 'm ' || (round(o_totalprice / 1000)::bigint % 60) || 's' end as took from orders order by o_orderdate desc, o_orderkey limit 20")
def run_history(spark, d):
    top = t(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return top.select("o_orderkey", "o_orderdate", A.success_rate(F.col("o_orderkey") % 50, F.lit(50)).cast("double").alias("rate"), Q.duration_label(F.col("o_totalprice")).alias("took"))


@query("select c_custkey, c_name, c_acctbal from customer where contains(lower(c_name), '7') or contains(lower(c_mktsegment), '7') order by c_mktsegment, c_custkey desc limit 15 offset 15")
def company_page(spark, d):
    found = A.search_rows(t(spark, d, "customer"), "7", ("c_name", "c_mktsegment"))
    return A.page_of(found, 1, 15, "c_mktsegment", F.desc("c_custkey")).select("c_custkey", "c_name", "c_acctbal")


@query("select user_id, string_agg(event_type || '=' || n, ',' order by n desc, event_type) as counts from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def sorted_map(spark, d):
    each = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.array_join(F.transform(A.sorted_entries(F.col("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("select o_custkey as company_id, o_orderpriority as field_name, count(*)::bigint as n, max(o_totalprice) as best from orders group by 1, 2")
def provenance_by_field(spark, d):
    records = t(spark, d, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("field_name"), F.col("o_orderstatus").alias("field_value"), F.lit("u").alias("source_url"), F.lit("m").alias("extraction_method"), F.col("o_totalprice").alias("confidence"))
    return A.grouped_provenance(records).select("company_id", "field_name", big(F.size("points")).alias("n"), F.col("points")[0]["confidence"].alias("best"))


@query("select l_orderkey, l_linenumber, case when l_discount >= 0.09 then 'high' when l_discount >= 0.07 then 'medium' else 'low' end as band, round(l_tax * 100)::int || '%' as label from lineitem")
def confidence_labels(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Q.confidence_band(F.col("l_discount") * 10 + 1e-9).alias("band"), Q.confidence_label(F.col("l_tax")).alias("label"))


# Matching


def companies(spark, d) -> DataFrame:
    c = t(spark, d, "customer")
    number = F.concat(F.lit("+1207762"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 4, "0"))
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("commercial_name"),
        F.col("c_mktsegment").alias("legal_name"),
        F.array("c_name").alias("all_names"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(number)).otherwise(F.array().cast("array<string>")).alias("phone_numbers"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("fb"), (F.col("c_custkey") % 500).cast("string"))).alias("facebook_id"),
    )


def inputs(spark, d) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("input_id"), F.col("o_custkey").alias("c"))
    c = F.col("c").cast("string")
    return o.select(
        "input_id",
        F.when(F.col("input_id") % 4 == 0, F.concat(F.lit("https://www.c"), c, F.lit(".com/x"))).alias("website"),
        F.when(F.col("input_id") % 3 == 0, F.concat(F.lit("(207) 762-"), F.lpad((F.col("c") % 1000).cast("string"), 4, "0"))).alias("phone"),
        F.when(F.col("input_id") % 5 == 0, F.concat(F.lit("facebook.com/FB"), (F.col("c") % 500).cast("string"))).alias("facebook"),
        F.when(F.col("input_id") % 8 == 0, F.lit("Acme Inc")).alias("name"),
    )


_CASCADE = """with c as (select c_custkey as k, 'c' || c_custkey || '.com' as domain, case when c_custkey % 3 > 0 then c_name end as commercial_name, case when c_custkey % 2 = 0 then '+1207762' || lpad((c_custkey % 1000)::varchar, 4, '0') end as phone, case when c_custkey % 5 = 0 then 'fb' || (c_custkey % 500) end as fb from customer),
i as (select o_orderkey as input_id, case when o_orderkey % 4 = 0 then 'c' || o_custkey || '.com' end as domain, case when o_orderkey % 3 = 0 then '+1207762' || lpad((o_custkey % 1000)::varchar, 4, '0') end as phone, case when o_orderkey % 5 = 0 then 'fb' || (o_custkey % 500) end as fb, o_orderkey % 8 = 0 as named from orders),
p as (select phone, min(domain) as domain from c where phone is not null group by 1 having count(distinct domain) = 1),
f as (select fb, min(domain) as domain from c where fb is not null group by 1),
m as (select input_id, case when c.domain is not null then c.domain when p.domain is not null then p.domain else f.domain end as domain, case when c.domain is not null then 'website' when p.domain is not null then 'phone' when f.domain is not null then 'facebook' end as matched_on,
  case when c.domain is not null then case when named and coalesce(c.commercial_name, '') <> '' then 0.96 else 1.0 end when p.domain is not null then 0.95 when f.domain is not null then 0.9 else 0.0 end::double as confidence
  from i left join c on i.domain = c.domain left join p on i.phone = p.phone left join f on i.fb = f.fb)"""


@query(_CASCADE + " select input_id, domain, matched_on, confidence, case when domain is null then 'NO_MATCH' else 'HIGH' end as match_quality from m")
def match_exact_cascade(spark, d):
    done = match.match_companies(inputs(spark, d), companies(spark, d), fuzzy=False)
    return done.select("input_id", "domain", F.try_element_at("matched_on", F.lit(1)).alias("matched_on"), "confidence", "match_quality")


@query(_CASCADE + " select b.bucket, count(m.input_id)::bigint as n from (select unnest(['high', 'medium', 'low', 'none']) as bucket) b left join m on b.bucket = case when confidence > 0.7 then 'high' when confidence > 0.4 then 'medium' when confidence > 0.2 then 'low' else 'none' end group by 1")
def match_report_buckets(spark, d):
    return A.confidence_histogram(match.match_companies(inputs(spark, d), companies(spark, d), fuzzy=False), "confidence")


@query(_CASCADE + " select count(*)::bigint as total, count_if(confidence > 0.2)::bigint as matched, round(count_if(confidence > 0.2) / count(*), 9) as match_rate, round(avg(confidence) filter (where confidence > 0.2), 6) as avg_confidence from m")
def match_report(spark, d):
    s = A.match_summary(match.match_companies(inputs(spark, d), companies(spark, d), fuzzy=False))
    return s.select("total", "matched", F.round("match_rate", 9).alias("match_rate"), F.round("avg_confidence", 6).alias("avg_confidence"))


@query(_CASCADE + " select matched_on as item, count(*)::bigint as n from m where matched_on is not null group by 1 order by n desc, item limit 10")
def match_types(spark, d):
    return A.ranking(match.match_companies(inputs(spark, d), companies(spark, d), fuzzy=False), "matched_on", 10)


_BM25 = """with docs as (select distinct p_name as k from part), tok as (select k, unnest(string_split(lower(k), ' ')) as token from docs), tf as (select token, k, count(*) as tf from tok group by 1, 2), dl as (select k, count(*) as dl from tok group by 1), st as (select count(*) as n, avg(dl) as avgdl from dl), idf as (select token, ln(1 + ((select n from st) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf group by 1), q as (select distinct p_brand as qid, split_part(p_name, ' ', 1) as token from part)"""


@query(_BM25 + " select qid, k as name, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (select avgdl from st)))), 6) as score from q join idf using (token) join tf using (token) join dl using (k) group by 1, 2")
def match_bm25_name(spark, d):
    part = t(spark, d, "part")
    index = TextIndex.build(part.select("p_name").distinct(), "p_name", {"name": name_tokens(F.col("p_name"))})
    asked = part.select(F.col("p_brand").alias("qid"), F.lit("name").alias("field"), F.split("p_name", " ")[0].alias("token"), F.lit(1.0).alias("weight")).distinct()
    return index.scores(asked).select("qid", F.col("key").alias("name"), F.round("score", 6).alias("score"))


@query("with v as (select distinct unnest(string_split(lower(p_name), ' ')) as token from part), q as (select distinct replace(token, 'a', 'e') as asked from v) select asked, token, damerau_levenshtein(asked, token)::bigint as edits from q, v where damerau_levenshtein(asked, token) <= case when length(asked) <= 2 then 0 when length(asked) <= 5 then 1 else 2 end")
def fuzzy_terms(spark, d):
    words = t(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()
    asked = words.select(F.translate("token", "a", "e").alias("token")).distinct().select(F.col("token").alias("qid"), F.lit("n").alias("field"), "token", F.lit(1.0).alias("weight"))
    near = expand_fuzzy(asked, words.withColumn("field", F.lit("n")))
    less = F.least(F.length("qid"), F.length("token"))
    return near.select(F.col("qid").alias("asked"), "token", big(F.round((1 - F.col("weight")) * less)).alias("edits"))


@query("select gram, count(*)::bigint as n from (select unnest(list_transform(range(1, length(w) - k + 2), lambda i: substring(w, i, k))) as gram from (select unnest(string_split(lower(p_name), ' ')) as w, p_partkey from part), (select unnest([3, 4, 5]) as k) where length(w) >= k) group by 1")
def name_grams(spark, d):
    return t(spark, d, "part").select(F.explode(grams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, round((0.4 * w + 0.3 * p + 0.05 * x) / 0.75, 4) as confidence from (select o_orderkey, (o_orderkey % 10) / 10 as w, (o_orderkey % 7) / 7 as p, 0.5 as x from orders)")
def weighted_confidence(spark, d):
    k = F.col("o_orderkey")
    m = F.create_map(F.lit("website"), (k % 10) / 10, F.lit("phone"), (k % 7) / 7, F.lit("other"), F.lit(0.5))
    return t(spark, d, "orders").select("o_orderkey", Q.weighted_confidence(m).alias("confidence"))


# Streaming


@query("select event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1")
def stream_refresh(spark, d):
    """A file stream over the events table refreshes an aggregate; its result is read back."""
    import uuid

    from quarrylode.operators.stored import shared_dir
    from quarrylode.streaming.refresh import refresh_on_change

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = t(spark, d, "events").schema
    total = lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    refresh_on_change(spark, d, schema, total, f"{at}/out", f"{at}/log", once=True, pattern="events.parquet").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n from events group by 1, 2")
def hourly_counts(spark, d):
    from quarrylode.streaming.refresh import running_counts

    return running_counts(t(spark, d, "events"), "ts", "event_type")
