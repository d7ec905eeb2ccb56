"""Queries of page extraction, projections, joins and the scored match; each with SQL that reads the
same injected pages or the tables themselves, none of it taken from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylode.functions import extract as X
from quarrylode.functions import quality as Q
from quarrylode.operators import analytics as A
from quarrylode.operators import crawl, etl, match
from quarrylode.operators.overlay import overlay
from quarrylode.operators.textindex import name_tokens
from quarrylode.plans import sql as S
from quarrylode.plans.queries import _SCRAPES, YEAR, big, query, scrapes, spread, t

#: A page for each customer, in SQL that both engines read.
_K, _FOUR = "cast(c_custkey as varchar(9))", "lpad(cast(c_custkey % 10000 as varchar(9)), 4, '0')"
_PAGE = f"""'<html><head><title>' || c_name || ' | Home</title>'
|| case c_custkey % 3 when 0 then '<meta name="description" content="About ' || c_name || '">' when 1 then '<meta property="og:description" content="Og ' || c_name || '">' else '' end
|| case c_custkey % 4 when 0 then '<link rel="icon" href="/i' || {_K} || '.png">' when 1 then '<link rel="shortcut icon" href="/s' || {_K} || '.ico">' when 2 then '<meta property="og:image" content="https://x.example.org/' || {_K} || '.jpg">' else '' end
|| case when c_custkey % 5 = 0 then '<script type="application/ld+json">{{"@type":"Organization","location":{{"address":{{"streetAddress":"' || {_K} || ' Elm St","addressLocality":"Bath","addressRegion":"ME","postalCode":"04530","addressCountry":"US"}}}}}}</script>' else '' end
|| '<meta property="og:see_also" content="https://www.instagram.com/g' || {_K} || '">'
|| '</head><body><a href="tel:+1-207-762-' || {_FOUR} || '">call</a><p>Or (703) 684-' || {_FOUR} || ' now</p>'
|| '<a href="mailto:Info' || {_K} || '@acme.org?subject=hi">m</a> '
|| case when c_custkey % 2 = 0 then '<address>' || cast(c_custkey % 900 + 1 as varchar(9)) || ' Long  Road, <b>Bath</b></address>' else '' end
|| '<a href="https://twitter.com/b' || {_K} || '">t</a>'
|| '<footer>Tel (877) 449-' || {_FOUR} || ' or (703) 684-' || {_FOUR} || case when c_custkey % 3 = 0 then ' <a href="https://x.com/f' || {_K} || '">x</a>' else '' end || ' to Foot' || {_K} || '@acme.net</footer></body></html>'"""
_P = f"p as (select c_custkey, {_PAGE} as html from customer), b as (select *, regexp_extract(html, '(?s)<body>(.*)</body>', 1) as body, regexp_extract(html, '(?s)<footer>(.*)</footer>', 1) as foot from p)"
_TEXT = "regexp_replace({0}, '<[^>]*>', '', 'g')"
_NUMBER = "'\\(?[0-9]{3}\\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}'"


def sites(spark, d):
    return spread(t(spark, d, "customer"), "c_custkey").select("c_custkey", F.expr(_PAGE.replace("varchar(9)", "string")).alias("html"))


_PHONES = f"""ph as (select * from (select c_custkey, o, method, '+1' || right(regexp_replace(raw, '[^0-9]', '', 'g'), 10) as value from (
select c_custkey, 1 as o, 'tel_link' as method, unnest(regexp_extract_all(body, 'href="tel:([^"]*)"', 1)) as raw from b
union all select c_custkey, 2, 'footer_regex', unnest(regexp_extract_all({_TEXT.format('foot')}, {_NUMBER})) from b
union all select c_custkey, 3, 'regex', unnest(regexp_extract_all({_TEXT.format('body')}, {_NUMBER})) from b)) qualify row_number() over (partition by c_custkey, value order by o) = 1)"""


@query(f"with {_P}, {_PHONES} select c_custkey, method, value from ph")
def page_phone_points(spark, d):
    """Phones of links, the footer and the text, each once, from the first of these."""
    pages, page = X.Page.cut(sites(spark, d))
    found = pages.select("c_custkey", F.explode(X.page_phones(page)).alias("p"))
    return found.select("c_custkey", F.col("p.extraction_method").alias("method"), "p.value")


_MAILS = f"em as (select distinct c_custkey, lower(x) as value from (select c_custkey, unnest(list_concat(regexp_extract_all(body, 'mailto:([^?\"]*)', 1), regexp_extract_all({_TEXT.format('body')}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+'))) as x from b))"


@query(f"with {_P}, {_MAILS} select c_custkey, value from em")
def page_email_points(spark, d):
    pages, page = X.Page.cut(sites(spark, d))
    return pages.select("c_custkey", F.explode(X.page_emails(page)).alias("value"))


@query(f"""with {_P}, a as (select c_custkey, 'json_ld' as method, concat_ws(', ', j->>'$.streetAddress', j->>'$.addressLocality', j->>'$.addressRegion', j->>'$.postalCode', j->>'$.addressCountry') as value
from (select c_custkey, (regexp_extract(html, '<script[^>]*>(.*)</script>', 1)::json)->'$.location.address' as j from p where contains(html, '<script'))
union all select c_custkey, 'html_address_tag', trim(regexp_replace({_TEXT.format("regexp_extract(body, '<address>(.*)</address>', 1)")}, '\\s+', ' ', 'g')) from b where contains(body, '<address>')) select * from a where length(value) > 10""")
def page_address_points(spark, d):
    pages, page = X.Page.cut(sites(spark, d))
    found = pages.select("c_custkey", F.explode(X.page_addresses(page)).alias("p"))
    return found.select("c_custkey", F.col("p.extraction_method").alias("method"), "p.value")


@query(f"""with {_P}, s as (select c_custkey, 1 as o, 'footer_anchor' as method, unnest(regexp_extract_all(foot, 'href="(https:[^"]*)"', 1)) as value from b union all select c_custkey, 2, 'anchor_tag', unnest(regexp_extract_all(body, 'href="(https:[^"]*)"', 1)) from b
union all select c_custkey, 3, 'meta_og', unnest(regexp_extract_all(html, 'og:[a-z_]*" content="([^"]*)"', 1)) from p), n as (select *, case when regexp_matches(value, '//(www.)?(x|twitter)[.]com/') then 'twitter' when regexp_matches(value, '//(www.)?instagram[.]com/') then 'instagram' end as platform from s)
select c_custkey, platform, method, value from n where platform is not null qualify row_number() over (partition by c_custkey, platform order by o) = 1""")
def page_social_points(spark, d):
    """The first of footer links, links and og contents, for each platform."""
    pages, page = X.Page.cut(sites(spark, d))
    found = pages.select("c_custkey", F.explode(X.page_socials(page)).alias("platform", "p"))
    return found.select("c_custkey", "platform", F.col("p.extraction_method").alias("method"), "p.value")


@query(f"""with {_P}, {_PHONES}, {_MAILS} select c_custkey, trim(split_part(regexp_extract(html, '<title>(.*)</title>', 1), '|', 1)) as company_name,
coalesce(nullif(regexp_extract(html, 'name="description" content="([^"]*)"', 1), ''), nullif(regexp_extract(html, 'og:description" content="([^"]*)"', 1), '')) as description,
coalesce(nullif(regexp_extract(html, 'rel="icon" href="([^"]*)"', 1), ''), nullif(regexp_extract(html, 'rel="shortcut icon" href="([^"]*)"', 1), ''), nullif(regexp_extract(html, 'og:image" content="([^"]*)"', 1), '')) as logo_url,
(select string_agg(value, ',' order by value) from ph where ph.c_custkey = b.c_custkey) as phones, (select string_agg(value, ',' order by value) from em where em.c_custkey = b.c_custkey) as emails from b""")
def page_assembly(spark, d):
    """All that a page says about its company, in one projection."""
    pages, page = X.Page.cut(sites(spark, d))
    fields = X.page_fields(page, YEAR)
    read = pages.select("c_custkey", *[fields[c].alias(c) for c in ("company_name", "short_description", "logo_url", "phone_numbers", "emails")])
    return read.select("c_custkey", "company_name", F.col("short_description").alias("description"), "logo_url", F.array_join(F.array_sort(F.transform("phone_numbers", lambda p: p["value"])), ",").alias("phones"), F.array_join(F.array_sort("emails"), ",").alias("emails"))


# Crawl and ETL


@query("select row_number() over (order by n_chars % 101, doc_id) as place, doc_id, (n_chars % 101)::bigint as score from documents where n_chars % 101 < 70 and doc_id in (select doc_id from labels)")
def tier_candidates(spark, d):
    """Scored rows under the threshold whose pages were kept, worst first."""
    from pyspark.sql import Window

    found = crawl.worst_first(t(spark, d, "documents").select("doc_id", (F.col("n_chars") % 101).alias("score")), t(spark, d, "labels"), 70, "doc_id")
    # the place is the feature that shows the order; one task numbers what a person reads
    return found.select(big(F.row_number().over(Window.orderBy("score", "doc_id"))).alias("place"), "doc_id", big("score").alias("score"))


@query("select conv_id, role as platform, arg_min(text, turn) as value from conversations group by 1, 2")
def first_platforms(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.create_map("role", "text").alias("social_links"))
    return crawl.first_socials(rows, "conv_id", "turn").select("conv_id", F.explode("social_links").alias("platform", "value"))


@query("select conv_id, array_to_string(list_distinct(list(text order by turn)), '|') is not null as any_mail, count(distinct text)::bigint as n from conversations group by 1")
def merged_emails(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.array("text").alias("emails"))
    return crawl.merged_emails(rows, "conv_id", "turn").select("conv_id", F.col("emails").isNotNull().alias("any_mail"), big(F.size("emails")).alias("n"))


def _profiles(spark, d):
    names = t(spark, d, "documents").filter("doc_id % 4 > 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".com")).alias("domain"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Acme "), F.col("doc_id").cast("string"))).otherwise("").alias("company_commercial_name"), F.when(F.col("doc_id") % 9 > 0, "Legal").otherwise("").alias("company_legal_name"), F.lit("a|b| c ").alias("company_all_available_names"), F.lit(1).alias("o"))
    return etl.normalize_profiles(etl.merge_names(scrapes(spark, d), names, "o", F.lit("2025-01-01")))


@query(f"with {_SCRAPES} select domain, case when doc_id % 4 = 0 then null when doc_id % 3 > 0 then 'Acme ' || doc_id when doc_id % 9 > 0 then 'Legal' else 'a' end as company_name, 'https://' || domain as website, phones[1] as phone, emails[1] as primary_email, case when doc_id % 2 = 0 then 'https://facebook.com/p' || doc_id end as facebook_url from s")
def response_projection(spark, d):
    return etl.response(_profiles(spark, d)).select("domain", "company_name", "website", "phone", "primary_email", "facebook_url")


@query(f"with {_SCRAPES} select domain, case when doc_id % 4 > 0 then 'a b c' else '' end as all_names, len(phones)::bigint as n_phones from s")
def search_documents(spark, d):
    return etl.search_documents(_profiles(spark, d)).select("domain", "all_names", big(F.size("phone_numbers")).alias("n_phones"))


@query(f"with {_SCRAPES}, x as (select domain, doc_id, 'phone' as field_name, unnest(phones) as field_value from s where success union all select domain, doc_id, 'email', unnest(emails) from s where success union all select domain, doc_id, 'social_facebook', 'https://facebook.com/p' || doc_id from s where success and doc_id % 2 = 0 union all select domain, doc_id, 'description', text from s where success and n_chars > 1000) select doc_id * 10 as company_id, field_name, md5(field_value) as digest from x where doc_id % 2 = 1")
def provenance_attached(spark, d):
    """Data points with the id of their company; those of unknown companies are dropped."""
    known = t(spark, d, "documents").filter("doc_id % 2 = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".com")).alias("domain"), (F.col("doc_id") * 10).alias("id"))
    return etl.attach_ids(etl.provenance(scrapes(spark, d)), known).select("company_id", "field_name", F.md5("field_value").alias("digest"))


@query(f"""with {_SCRAPES} select domain, case when doc_id % 7 > 0 then array_to_string(list_sort(phones), ',') else '+12077620' || lpad((doc_id % 1000)::varchar, 3, '0') || ',+4930123456' end as phones,
case when doc_id % 7 = 0 then doc_id || ' Elm St' end as address, case when doc_id % 14 = 0 then 'New text' when n_chars > 1000 then text end as description_text,
case when doc_id % 7 = 0 and doc_id % 21 > 0 then 'https://cdn.org/l.png' when doc_id % 4 = 0 then '/logo.png' end as logo_url,
concat_ws(',', case when doc_id % 2 = 0 then 'facebook=https://facebook.com/p' || doc_id when doc_id % 7 = 0 then 'facebook=https://facebook.com/new' end, case when doc_id % 7 = 0 then 'github=https://github.com/g' end) as socials from s""")
def overlay_contacts(spark, d):
    """Phones, addresses, text, logo and socials of refined rows over all scrapes."""
    n = F.col("doc_id")
    none = F.array().cast("array<string>")
    refined = t(spark, d, "documents").filter("doc_id % 7 = 0").select(
        F.concat(F.lit("d"), n.cast("string"), F.lit(".com")).alias("domain"), F.lit(None).cast("string").alias("company_name"), none.alias("emails"),
        F.array(F.concat(F.lit("(207) 762-0"), F.lpad((n % 1000).cast("string"), 3, "0")), F.lit("+49 30 123456"), F.lit("+49 30123456"), F.lit("12")).alias("phone_numbers"), F.array(F.concat(n.cast("string"), F.lit(" Elm St"))).alias("addresses"),
        F.when(n % 2 == 0, "New text").alias("short_description"), F.lit(None).cast("int").alias("year_founded"), F.when(n % 3 > 0, "https://cdn.org/l.png").otherwise("l.png").alias("logo_url"),
        F.create_map(F.lit("facebook"), F.lit("https://facebook.com/new"), F.lit("github"), F.lit("https://github.com/g"), F.lit("x"), F.lit("no link")).alias("social_links"),
    )
    done = overlay(scrapes(spark, d), refined, YEAR, F.lit("2025-01-01"))
    values = lambda c: F.transform(c, lambda p: p["value"])
    links = F.array_sort(F.transform(F.map_entries("social_links"), lambda e: F.concat_ws("=", e["key"], e["value"]["value"])))
    return done.select("domain", F.array_join(F.array_sort(values("phone_numbers")), ",").alias("phones"), F.try_element_at("addresses", F.lit(1))["value"].alias("address"), F.col("short_description.value").alias("description_text"), "logo_url", F.array_join(links, ",").alias("socials"))


# Quality and display


_LONG = "case c_custkey % 4 when 0 then repeat('Elm Street ', 20) when 1 then 'Click here, Bath' when 2 then '1 Elm St' else 'Call us: ' || repeat('x', 160) end"


@query(f"select c_custkey, (100 - 10 * (length(a) > 150)::int - 15 * regexp_matches(a, '(?i)click|call us')::int)::bigint as score, concat_ws('|', case when length(a) > 150 then 'address_too_long' end, case when regexp_matches(a, '(?i)click|call us') then 'garbage_address:' || left(a, 50) end) as reasons from (select c_custkey, {_LONG} as a from customer)")
def quality_addresses(spark, d):
    """Penalties of addresses, with their reasons."""
    a, some = F.array(F.expr(_LONG)), F.array(F.lit("a@acme.org"))
    found = Q.penalties(F.lit("acme.org"), F.col("c_name"), some, some, a, F.lit("text"), F.lit("https://acme.org/l.png"), F.lit(1990), F.lit(True), some, YEAR)
    q = t(spark, d, "customer").select("c_custkey", Q.quality(found).alias("q"))
    return q.select("c_custkey", big("q.score").alias("score"), F.array_join("q.reasons", "|").alias("reasons"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then s_name else s_name || ', ' || s_nationkey end as address, case when s_suppkey % 3 = 0 then 'https://cdn.org/' || s_suppkey else 'https://' || s_name || '/' || s_suppkey end as logo from supplier")
def display_labels(spark, d):
    key = F.col("s_suppkey").cast("string")
    address = Q.display_address(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(""), F.col("s_name"), F.col("s_nationkey").cast("string"))
    logo = Q.absolute_logo(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://cdn.org/"), key)).otherwise(key), F.col("s_name"))
    return t(spark, d, "supplier").select("s_suppkey", address.alias("address"), logo.alias("logo"))


@query("select o_orderkey, o_orderdate, round(o_totalprice / 1000, 6) as rate from orders order by o_orderdate desc, o_orderkey limit 1")
def latest_run(spark, d):
    """Coverage of the latest run."""
    runs = t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") / 1000, 6).alias("rate"), F.struct("o_orderdate", -F.col("o_orderkey")).alias("o"))
    return A.latest(runs, 1, "o").drop("o")


@query("select o_custkey as company_id, count(*)::bigint as n, string_agg(o_orderpriority || ':' || o_orderkey, '|' order by o_orderpriority, o_orderkey) as listed from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' group by 1")
def provenance_of_company(spark, d):
    """The provenance records of every company of one kind, by field."""
    companies = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("domain"), F.col("c_custkey").alias("id"))
    records = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("domain"), F.col("o_orderpriority").alias("field_name"), "o_orderkey")
    known = etl.attach_ids(records, companies)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("field_name", "o_orderkey"))), lambda r: F.concat_ws(":", r["field_name"], r["o_orderkey"]))
    return known.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, "|").alias("listed"))


@query("select l_returnflag as part, bool_and(l_quantity > 0) as healthy from lineitem group by 1")
def health(spark, d):
    parts = t(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") > 0).alias("ok"))
    return A.all_healthy(parts.withColumnRenamed("l_returnflag", "part"), by=("part",))


@query("select p_partkey, array_to_string(list_filter(string_split(lower(p_name || ' Services of Caf' || 'e ltd'), ' '), lambda w: w not in ('inc', 'llc', 'ltd', 'corp', 'co', 'pty', 'limited', 'holding', 'holdings', 'company', 'services', 'service')), ' ') as tokens from part")
def name_stop_words(spark, d):
    tokens = name_tokens(F.concat("p_name", F.lit(" Services of Café Ltd")))
    return t(spark, d, "part").select("p_partkey", F.array_join(tokens, " ").alias("tokens"))


@query("select p_partkey, p_name, p_brand from part order by lower(p_brand), length(p_name) desc, p_partkey limit 25 offset 25")
def sortable_table(spark, d):
    """A table sorted without regard to case and by an array's length."""
    rows = t(spark, d, "part").withColumn("letters", F.split("p_name", ""))
    return A.page_of(rows, 1, 25, F.lower("p_brand"), F.desc(F.size("letters")), "p_partkey").select("p_partkey", "p_name", "p_brand")


# The scored match


_SUFFIX = "lpad(cast((length(p_name) * 37 + ascii(p_name) * 11 + ascii(substring(p_name, 5, 1))) % 50 as varchar(9)), 4, '0')"
_ASKED = f"select p_partkey as input_id, case when p_partkey % 3 = 0 then '(207) 762-' || {_SUFFIX} end as raw_phone, case when p_partkey % 4 > 0 then replace(p_name, 'e', 'a') else p_name || ' Ltd.' end as raw_name from part"
_FULL = f"""with recursive firms as (select distinct replace(p_name, ' ', '-') || '.com' as key, p_name as name, '+1207762' || {_SUFFIX} as phone from part),
asked as (select input_id, {S.phone('raw_phone')} as phone, {S.company('raw_name')} as name from ({_ASKED})),
one as (select phone, min(key) as key from firms group by 1 having count(distinct key) = 1),
exact as (select input_id, key from asked join one using (phone)),
rest as (select * from asked where input_id not in (select input_id from exact)),
w as (select key, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) as token from firms),
post as (select unnest(['commercial_name', 'all_names']) as field, token, key, count(*) as tf from w group by token, key
  union all select 'grams', gram, key, count(*) from (select key, unnest(list_transform(range(1, length(token) - k + 2), lambda i: substring(token, i, k))) as gram from w, (select unnest([3, 4, 5]) as k) where length(token) >= k) group by 2, 3),
len as (select field, key, sum(tf) as dl from post group by 1, 2),
avgs as (select field, count(*) as n, avg(dl) as avgdl from len group by 1),
idf as (select field, token, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from post join avgs using (field) group by field, token, n),
bm as (select field, token, key, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as part from post join idf using (field, token) join len using (field, key) join avgs using (field)),
q as (select distinct input_id, phone is not null as several, unnest(regexp_extract_all(name, '[a-z0-9]+')) as asked from rest where name is not null),
near as (select a.asked, v.token, damerau_levenshtein(a.asked, v.token) as e from (select distinct asked from q) a, (select distinct token from w) v where abs(length(a.asked) - length(v.token)) <= 2 and damerau_levenshtein(a.asked, v.token) <= case when length(a.asked) <= 2 then 0 when length(a.asked) <= 5 then 1 else 2 end),
terms as (select input_id, several, token, 1 - e / least(length(asked), length(token)) as less from q join near using (asked) where several or asked[1] = token[1]),
fields as (select input_id, key, field, sum(less * part * case field when 'commercial_name' then 3 else 1 end * case when several then 5 else 1 end) as s from terms join bm using (token) where field <> 'grams' group by 1, 2, 3),
grams as (select distinct input_id, unnest(list_transform(range(1, length(asked) - k + 2), lambda i: substring(asked, i, k))) as token from q, (select unnest([3, 4, 5]) as k) where length(asked) >= k),
clauses as (select input_id, key, max(s) as s from fields group by 1, 2 union all select input_id, key, sum(2 * part) from grams join bm using (token) where field = 'grams' group by 1, 2
  union all select input_id, key, 5 from rest r join firms f on r.phone is null and r.name = lower(f.name)
  union all select input_id, f.key, 8 * ln(1 + ((select count(*) from firms) - df + 0.5) / (df + 0.5)) from rest r join (select key, phone, count(*) over (partition by phone) as df from firms) f using (phone) where r.name is not null),
best as (select input_id, key, sum(s) as s from clauses group by 1, 2 qualify row_number() over (partition by input_id order by round(sum(s), 6) desc, key) = 1),
done as (select r.input_id, b.key, r.phone is not null as several, r.phone = f.phone as same, least(b.s / (b.s + 5), 0.95) as c from rest r join best b using (input_id) join firms f using (key)),
conf as (select input_id, key, matched_on, round(c, 4) as c from (select input_id, key, several, case when several and same then 'phone,name' else 'name' end as matched_on, case when several and same then least(c + 0.1, 0.97) else c end as c from done) where c > case when several then 0.3 else 0.2 end)
select a.input_id, coalesce(e.key, c.key) as domain, case when e.key is not null then 'phone' else c.matched_on end as matched_on, (case when e.key is not null then 0.95 else coalesce(c.c, 0) end)::double as confidence,
case when e.key is not null then 'HIGH' when c.key is null then 'NO_MATCH' when c.c > 0.7 and c.matched_on = 'phone,name' then 'HIGH' when c.c > 0.5 then 'MEDIUM' when c.c > 0.3 then 'LOW' else 'UNCERTAIN' end as match_quality
from asked a left join exact e using (input_id) left join conf c using (input_id)"""


@query(_FULL)
def match_full_cascade(spark, d):
    """All five strategies; part names with typing errors meet the names they come from."""
    suffix = F.expr(_SUFFIX.replace("varchar(9)", "string"))
    part = t(spark, d, "part").select("p_name").distinct()
    firms = part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".com")).alias("domain"), F.col("p_name").alias("commercial_name"), F.lit(None).cast("string").alias("legal_name"), F.array("p_name").alias("all_names"), F.array(F.concat(F.lit("+1207762"), suffix)).alias("phone_numbers"), F.lit(None).cast("string").alias("facebook_id"))
    asked = t(spark, d, "part").select(F.col("p_partkey").alias("input_id"), F.lit(None).cast("string").alias("website"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("(207) 762-"), suffix)).alias("phone"), F.lit(None).cast("string").alias("facebook"), F.when(F.col("p_partkey") % 4 > 0, F.replace("p_name", F.lit("e"), F.lit("a"))).otherwise(F.concat("p_name", F.lit(" Ltd."))).alias("name"))
    done = match.match_companies(asked, firms)
    return done.select("input_id", "domain", F.nullif(F.array_join("matched_on", ","), F.lit("")).alias("matched_on"), "confidence", "match_quality")
