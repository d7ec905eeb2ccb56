"""Page extraction, robots rules, overlay, scoring, sources and streaming on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quarrylode import schemas
from quarrylode.functions import extract as X
from quarrylode.functions import quality as Q
from quarrylode.operators import analytics as A
from quarrylode.operators import crawl, etl, match
from quarrylode.plans import site_queries  # noqa: F401
from quarrylode.plans.queries import QUERIES
from quarrylode.sources import files, pages
from quarrylode.streaming.refresh import refresh_on_change

LD = '{"@graph":[{"@type":["Organization"],"name":"Acme Inc","telephone":["+1 207 762 9321 "],"foundingDate":"1999-01-01","email":"mailto:hq@acme.org","address":{"streetAddress":"1 Main St","addressLocality":"Bath","addressRegion":"ME","postalCode":"04530","addressCountry":"US"},"sameAs":["https://x.com/acme","ftp://z"]}]}'
CODED = "42" + "".join(f"{b ^ 0x42:02x}" for b in b"joe@acme.org")
PAGE = f"""<html><head><title>Acme Co | Home</title><meta name="description" content="We make things"><meta content="WordPress 6" name="generator"><meta name="keywords" content="a, tools, Hard Ware"><link rel="icon" href="/f.ico">
<script type="application/ld+json">{LD}</script></head><body><a href="tel:+1 (207) 762-9322">call</a> <a href="mailto:Info@Acme.org?x=1">m</a><a href="https://www.facebook.com/">fb</a><a href="https://facebook.com/acme">fb</a> sales [at] acme [dot] org foo@example.com (509) 276-6996. Visit 12 Elm Street, Springfield, IL 62701 since 1985<span data-cfemail="{CODED}"></span><footer>Call 715.978.0027 <a href="https://x.com/a">x</a></footer></body></html>"""


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "html string").select(*columns).first()


def test_a_page_with_everything(spark):
    r = one(spark, PAGE, *[c.alias(k) for k, c in X.page_fields(F.col("html"), 2025).items()])
    assert r["company_name"] == "Acme Inc" and r["jsonld_phones"] == ["+1 207 762 9321"] and r["year_founded"] == 1999
    assert [(p["value"], p["extraction_method"]) for p in r["phone_numbers"]] == [("+12077629322", "tel_link"), ("+17159780027", "footer_regex"), ("+15092766996", "regex")]
    assert r["emails"] == ["info@acme.org", "joe@acme.org", "sales@acme.org", "hq@acme.org"]
    assert [a["value"] for a in r["addresses"]] == ["1 Main St, Bath, ME, 04530, US", "12 Elm Street, Springfield, IL 62701", "12 Elm Street, Springfield, IL"]
    assert {k: (v["value"], v["confidence"]) for k, v in r["social_links"].items()} == {"twitter": ("https://x.com/a", 0.95), "facebook": ("https://facebook.com/acme", 0.9)}
    assert r["technologies"] == ["WordPress"] and r["industry_keywords"] == ["tools", "hard ware"] and r["logo_url"] == "/f.ico" and r["same_as"] == ["https://x.com/acme"]


@pytest.mark.parametrize("page", ["", "no html", "<p>", None])
def test_pages_with_nothing(spark, page):
    r = one(spark, page, *[c.alias(k) for k, c in X.page_fields(F.col("html"), 2025).items()])
    assert not r["phone_numbers"] and not r["emails"] and r["year_founded"] is None and not r["social_links"]


@pytest.mark.parametrize(("page", "footer"), [("<footer>a</footer><div id='footer'>b</div>", "a"), ('<div role="contentinfo">c</div>', "c"), ('<div id="footer">d</div>', "d"), ('<div class="x footer">e</div>', "e"), ('<p class="site-footer y">f</p>', "f"), ("<div>g</div>", None)])
def test_footers(spark, page, footer):
    assert one(spark, page, X.footer_of(F.col("html")))[0] == footer


@pytest.mark.parametrize(("text", "year"), [("best 2019", 2019), ("founded in 1700, © 2001", 2001), ("copyright 2030", None), ("Est. 1850", 1850)])
def test_years(spark, text, year):
    assert one(spark, text, X.year_founded(F.col("html"), 2025))[0] == year


ROBOTS = "User-agent: *\nDisallow: /all\n# no\nUser-agent: other\nDisallow: /\nUser-agent: OurBot/1\nDisallow: /own\nDisallow:\nCrawl-delay: 1.5\nUser-agent: last\nDisallow: /late"


def test_robots(spark):
    rules = crawl.robots_rules(F.col("html"), "ourbot")
    assert one(spark, ROBOTS, rules)[0].asDict() == {"disallowed": ["/all", "/own"], "crawl_delay": 1.5}
    assert one(spark, None, rules)[0].asDict() == {"disallowed": [], "crawl_delay": None}
    assert one(spark, ROBOTS, crawl.path_allowed(F.lit("/own/x"), rules), crawl.path_allowed(F.lit("/x"), rules))[:] == (False, True)


def test_each_penalty(spark):
    base = {"domain": "a.com", "name": "A", "emails": ["a@b.co"], "phones": ["1"], "addresses": ["x"], "description": "d", "logo": "http://l", "year": 2000, "success": True, "pages": ["p"]}
    cases = [({}, 100), ({"name": None}, 85), ({"emails": []}, 90), ({"phones": []}, 90), ({"addresses": []}, 90), ({"description": None}, 95), ({"emails": ["test@test.com"]}, 80), ({"emails": ["x@sentry.io"]}, 85), ({"emails": ["1234567@b.co"]}, 80), ({"emails": ["%20a@b.co"]}, 90), ({"year": 2025}, 85), ({"name": "https://x"}, 85), ({"name": "n" * 81}, 90), ({"addresses": ["a" * 151]}, 90), ({"addresses": ["Click here"]}, 85), ({"logo": "/l"}, 95), ({"description": "best casino"}, 70), ({"description": "casino", "domain": "casino.com"}, 100), ({"name": "", "emails": [], "phones": [], "addresses": []}, 25)]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], "domain string, name string, emails array<string>, phones array<string>, addresses array<string>, description string, logo string, year int, success boolean, pages array<string>")
    got = df.select(Q.quality(Q.penalties(*[F.col(k) for k in base], 2025)).alias("q")).collect()
    assert [r["q"]["score"] for r in got] == [e for _, e in cases]
    assert [r["q"]["needs_refinement"] for r in got] == [e < 70 for _, e in cases]


def test_confidence(spark):
    assert one(spark, "", Q.weighted_confidence(F.create_map(F.lit("website"), F.lit(1.0), F.lit("company_name"), F.lit(0.8))))[0] == 0.96
    q = [Q.match_quality(F.lit(c), F.array(*map(F.lit, f))) for c, f in ((0.96, ["website"]), (0.95, ["name"]), (0.95, ["phone", "facebook"]), (0.31, ["name"]), (0.3, ["name"]))]
    assert list(one(spark, "", *q)) == ["HIGH", "MEDIUM", "VERIFIED", "LOW", "UNCERTAIN"]
    assert list(one(spark, "", Q.duration_label(F.lit(0)), Q.duration_label(F.lit(59_400)), Q.duration_label(F.lit(125_000)))) == ["—", "59s", "2m 5s"]


def test_a_shared_phone_matches_nobody(spark):
    firms = spark.createDataFrame([("a.com", "Acme", None, ["Acme"], ["+12077629321"], None), ("b.com", "Bolt", None, [], ["+12077629321", "+12077629322"], "bolt")], "domain string, commercial_name string, legal_name string, all_names array<string>, phone_numbers array<string>, facebook_id string")
    asked = spark.createDataFrame([(1, None, "207-762-9321", None, None), (2, None, "207-762-9322", None, None), (3, "www.a.com", "207-762-9322", None, "Acme"), (4, None, None, "facebook.com/Bolt", None), (5, None, None, None, "acme inc"), (6, None, None, None, None), (7, None, "207-762-9321", None, "Bolt")], "input_id int, website string, phone string, facebook string, name string")
    got = {r["input_id"]: (r["domain"], r["match_quality"], r["match_source"]) for r in match.match_companies(asked, firms).collect()}
    assert got[1] == (None, "NO_MATCH", None) and got[2] == ("b.com", "HIGH", "exact_phone") and got[3] == ("a.com", "HIGH", "exact_domain") and got[4] == ("b.com", "HIGH", "exact_facebook")
    assert got[5][0] == "a.com" and got[5][2] == "fuzzy_name" and got[6] == (None, "NO_MATCH", None) and got[7][0] == "b.com" and got[7][2] == "composite_multi_field"


def test_last_names_win_and_unmatched_names_go(spark):
    scrape = spark.createDataFrame([(" A.com ", True)], "domain string, success boolean")
    full = scrape.select(*[F.col(f.name) if f.name in scrape.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.SCRAPE])
    names = spark.createDataFrame([("a.com", "Old", "", "x", 1), ("A.COM", " New ", "", " p | |q", 2), ("z.com", "Z", "", "", 3)], "domain string, company_commercial_name string, company_legal_name string, company_all_available_names string, o int")
    r = etl.normalize_profiles(etl.merge_names(full, names, "o", F.lit("2025-01-01"))).collect()
    assert len(r) == 1 and (r[0]["domain"], r[0]["commercial_name"], r[0]["legal_name"], r[0]["all_names"]) == ("a.com", "New", None, ["p", "q"])


def test_fetching_retries_only_what_may_mend(spark):
    def fetch(url):
        if "gone" in url:
            return 404, "x"
        if "down" in url:
            return 503, None
        if "dead" in url:
            raise OSError("refused")
        return 200, "<body>" + "word " * 20 + "</body>"

    urls = spark.createDataFrame([("http://ok",), ("http://gone",), ("http://down",), ("http://dead",), (None,)], "url string")
    rows = {r["url"]: r for r in pages.fetch_pages(urls, fetch, pause_s=0.0).collect()}
    assert {u: r["attempts"] for u, r in rows.items()} == {"http://ok": 1, "http://gone": 1, "http://down": 2, "http://dead": 2}
    assert rows["http://dead"]["error"] == "refused" and rows["http://gone"]["html"] is None
    assert pages.rendered_only(pages.fetch_pages(urls, fetch, pause_s=0.0)).count() == 1


def test_files_come_back(spark, tmp_path):
    (tmp_path / "d.csv").write_text("domain\n a.com \n\nb.com\n")
    assert [r[0] for r in files.read_domains(spark, str(tmp_path / "d.csv")).collect()] == ["a.com", "b.com"]
    (tmp_path / "m.csv").write_text("input name,input phone,input website,input_facebook\nA, 1,,x\n")
    assert files.read_match_inputs(spark, str(tmp_path / "m.csv")).first()[:] == ("A", " 1", None, "x")
    (tmp_path / "s.json").write_text('[{"domain": "a.com", "success": true, "phone_numbers": [{"value": "1", "confidence": 0.9}]}]')
    assert files.read_scrapes(spark, str(tmp_path / "s.json")).first()["phone_numbers"][0]["value"] == "1"
    assert files.read_optional(spark, str(tmp_path / "none.json"), schemas.RUN).count() == 0
    files.write_table(spark.range(3), str(tmp_path / "t"))
    files.clear_tables(spark, {str(tmp_path / "t"): spark.range(1).schema})
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0


def test_new_files_refresh_the_result(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "log")}
    schema = spark.range(1).schema
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(at["in"])
        refresh_on_change(spark, at["in"], schema, lambda t: t.agg(F.count(F.lit(1)).alias("n")), at["out"], at["log"], once=True).awaitTermination()
    assert spark.read.parquet(at["out"]).first()["n"] == 7


def test_small_aggregates(spark):
    empty = spark.createDataFrame([], "confidence double, ok boolean")
    assert {r["bucket"]: r["n"] for r in A.confidence_histogram(empty, "confidence").collect()} == {"high": 0, "medium": 0, "low": 0, "none": 0}
    assert A.all_healthy(empty).first()[0] is False and A.match_summary(empty).first()[:] == (0, 0, 0.0, 0.0)
    b = [A.bucket(F.lit(c)) for c in (0.71, 0.7, 0.41, 0.2, None)]
    assert list(one(spark, "", *b)) == ["high", "medium", "medium", "none", "none"]


def test_a_coded_address_reads_its_code_once(spark):
    rows = spark.createDataFrame([(CODED.upper(),), (None,), ("42",), (CODED[:-1],), ("42" + CODED[4:6] * 4,), ("6b" * 3,)], "code string")
    found = rows.select(X.decode_cf_email(F.trim("code")).alias("x"))
    assert [r["x"] for r in found.collect()] == ["joe@acme.org", None, None, None, None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("trim(code") == 1  # not once for each letter, and again for each letter of those


@pytest.mark.parametrize("name", ["page_assembly", "page_address_points", "page_email_points", "json_ld_org", "cf_email_decode"])
def test_pages_of_one_small_file_are_made_in_many_tasks(spark, tmp_path, name):
    ids = spark.range(12_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), F.lit("AUTO").alias("c_mktsegment"))
    ids.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3
