"""Explicit schemas of the company tables; nothing is inferred on read."""

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def fields(text: str) -> T.StructType:
    """A flat schema from "name kind, ..."; unlike DDL this needs no session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split() for f in text.split(","))])


S, A, M = T.StringType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())
DATA_POINT = fields("value string, source_url string, source_element string, extraction_method string, confidence double, extracted_at timestamp")
POINTS = T.ArrayType(DATA_POINT)
SCRAPE = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("domain", S), ("company_name", S), ("success", T.BooleanType()), ("phone_numbers", POINTS), ("social_links", T.MapType(S, DATA_POINT)), ("addresses", POINTS), ("emails", POINTS), ("short_description", DATA_POINT),
        ("technologies", A), ("logo_url", S), ("industry_keywords", A), ("year_founded", T.IntegerType()), ("crawl_time_ms", T.LongType()), ("pages_crawled", A), ("error", S),
    )]
)
ADDRESS = fields("street string, city string, state string, zip string, country string, raw string")
PROFILE = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("domain", S), ("commercial_name", S), ("legal_name", S), ("all_names", A), ("phone_numbers", A), ("phone_numbers_raw", A), ("primary_email", S), ("emails", A), ("facebook_url", S), ("facebook_id", S), ("social_links", M),
        ("addresses", T.ArrayType(ADDRESS)), ("short_description", S), ("technologies", A), ("logo_url", S), ("industry_keywords", A), ("year_founded", T.IntegerType()), ("crawl_status", S), ("crawl_timestamp", T.TimestampType()),
    )]
)
DOMAINS = fields("domain string")
NAMES = fields("domain string, company_commercial_name string, company_legal_name string, company_all_available_names string")
MATCH_INPUT = fields("name string, phone string, website string, facebook string")
RUN = fields("id string, started_at timestamp, completed_at timestamp, total_domains int, successful int, failed int, total_time_ms long").add(
    "metadata",
    T.StructType([T.StructField("fill_rates", T.MapType(S, T.DoubleType())), T.StructField("error_breakdown", T.MapType(S, T.IntegerType())), T.StructField("total_pages_crawled", T.IntegerType()), T.StructField("avg_crawl_time_ms", T.IntegerType())]),
)
REFINEMENT = T.StructType([T.StructField(n, t) for n, t in (("company_name", S), ("emails", A), ("phone_numbers", A), ("addresses", A), ("short_description", S), ("year_founded", T.IntegerType()), ("logo_url", S), ("social_links", M), ("confidence_notes", S))])
PAGE = fields("domain string, url string, rank int, status int, html string, error string, time_ms long")
