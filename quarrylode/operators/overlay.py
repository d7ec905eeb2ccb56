"""Refined fields laid over scraped ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.functions.normalize import overlay_phone

METHOD, ELEMENT = "model_refinement", "model_answer"


def point(value: Column, url: Column, confidence: float, time: Column) -> Column:
    return F.struct(value.alias("value"), url.alias("source_url"), F.lit(ELEMENT).alias("source_element"), F.lit(METHOD).alias("extraction_method"), F.lit(confidence).alias("confidence"), time.cast("timestamp").alias("extracted_at"))


def overlay(scrapes: DataFrame, refined: DataFrame, current_year: int, run_time: Column) -> DataFrame:
    """Scrapes with the refined row of their domain laid over, if there is one.

    Lists are replaced where the refined one is not empty; a name only where the old one is
    missing, very long or a url; a year of this year or later is cleared; a logo only where the new
    one is absolute and the old one not; socials only add platforms.
    """
    cols = [c for c in refined.columns if c != "domain"]
    joined = scrapes.join(refined.select("domain", F.struct(*cols).alias("r")), "domain", "left")
    url = F.coalesce(F.try_element_at("pages_crawled", F.lit(1)), F.concat(F.lit("https://"), F.col("domain")))
    points = lambda values, c: F.transform(values, lambda v: point(v, url, c, run_time))
    given = lambda name: F.coalesce(F.size(f"r.{name}"), F.lit(0)) > 0
    text = lambda name: F.coalesce(F.col(f"r.{name}"), F.lit("")) != ""
    bad_name = F.col("company_name").isNull() | (F.col("company_name") == "") | (F.length("company_name") > 80) | F.rlike("company_name", F.lit("^https?://"))
    phones = F.array_distinct(F.array_compact(F.transform("r.phone_numbers", overlay_phone)))
    links = F.map_filter("r.social_links", lambda k, v: F.startswith(v, F.lit("http")) & ~F.coalesce(F.map_contains_key("social_links", k), F.lit(False)))
    more = F.transform_values(links, lambda k, v: point(v, url, 0.90, run_time))
    absolute = lambda c: F.coalesce(F.startswith(c, F.lit("http")), F.lit(False))
    has = F.col("r").isNotNull()
    return joined.withColumns({
        "company_name": F.when(text("company_name") & bad_name, F.col("r.company_name")).otherwise(F.col("company_name")),
        "emails": F.when(given("emails"), points(F.transform("r.emails", F.lower), 0.92)).otherwise(F.col("emails")),
        "phone_numbers": F.when(given("phone_numbers"), points(phones, 0.92)).otherwise(F.col("phone_numbers")),
        "addresses": F.when(given("addresses"), points(F.col("r.addresses"), 0.90)).otherwise(F.col("addresses")),
        "year_founded": F.when(F.col("r.year_founded").isNotNull(), F.col("r.year_founded")).when(has & (F.col("year_founded") >= current_year), F.lit(None)).otherwise(F.col("year_founded")),
        "short_description": F.when(text("short_description"), point(F.col("r.short_description"), url, 0.90, run_time)).otherwise(F.col("short_description")),
        "logo_url": F.when(absolute(F.col("r.logo_url")) & ~absolute(F.col("logo_url")), F.col("r.logo_url")).otherwise(F.col("logo_url")),
        "social_links": F.when(more.isNotNull(), F.map_concat(F.coalesce("social_links", F.map_filter(more, lambda k, v: F.lit(False))), more)).otherwise(F.col("social_links")),
    }).drop("r")
