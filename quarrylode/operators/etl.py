"""From scrapes to company profiles: joins, provenance, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.functions.normalize import blank_to_null, normalize_facebook, normalize_phone, normalize_url, split_names, strip


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the largest order value."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_names(scrapes: DataFrame, names: DataFrame, order: str, run_time: Column) -> DataFrame:
    """Profiles: every scrape with the last names row of its domain, if it has one."""
    key = F.lower(strip(F.col("domain")))
    one = last_by_key(names.withColumn("domain", key), "domain", order).drop(order)
    values = lambda c: F.coalesce(F.transform(c, lambda p: p["value"]), F.array().cast("array<string>"))
    joined = scrapes.withColumn("domain", key).join(one, "domain", "left")
    return joined.select(
        "domain",
        blank_to_null(F.col("company_commercial_name")).alias("commercial_name"),
        blank_to_null(F.col("company_legal_name")).alias("legal_name"),
        split_names(F.col("company_all_available_names")).alias("all_names"),
        values("phone_numbers").alias("phone_numbers"),
        values("phone_numbers").alias("phone_numbers_raw"),
        F.try_element_at(values("emails"), F.lit(1)).alias("primary_email"),
        values("emails").alias("emails"),
        F.try_element_at("social_links", F.lit("facebook"))["value"].alias("facebook_url"),
        F.lit(None).cast("string").alias("facebook_id"),
        F.coalesce(F.transform_values("social_links", lambda k, v: v["value"]), F.create_map().cast("map<string,string>")).alias("social_links"),
        F.transform("addresses", lambda a: F.struct(*[F.lit(None).cast("string").alias(n) for n in ("street", "city", "state", "zip", "country")], a["value"].alias("raw"))).alias("addresses"),
        F.col("short_description.value").alias("short_description"),
        "technologies",
        "logo_url",
        "industry_keywords",
        "year_founded",
        F.when(F.col("success"), "success").otherwise("failed").alias("crawl_status"),
        run_time.cast("timestamp").alias("crawl_timestamp"),
    )


def normalize_profiles(profiles: DataFrame) -> DataFrame:
    emails = F.array_distinct(F.transform("emails", F.lower))
    return profiles.withColumns({
        "phone_numbers_raw": F.col("phone_numbers"),
        "phone_numbers": F.array_distinct(F.array_compact(F.transform("phone_numbers", normalize_phone))),
        "facebook_id": normalize_facebook(F.col("facebook_url")),
        "domain": F.coalesce(normalize_url(F.col("domain")), "domain"),
        "emails": emails,
        "primary_email": F.try_element_at(emails, F.lit(1)),
    })


def provenance(scrapes: DataFrame) -> DataFrame:
    """domain, field_name, field_value, source_url, source_element, extraction_method, confidence,
    extracted_at: a row for every data point of a successful scrape."""
    kind = "array<struct<field_name:string,field_value:string,source_url:string,source_element:string,extraction_method:string,confidence:double,extracted_at:timestamp>>"

    def row(name: Column, p: Column) -> Column:
        return F.struct(name.alias("field_name"), p["value"].alias("field_value"), *[p[c].alias(c) for c in ("source_url", "source_element", "extraction_method", "confidence", "extracted_at")])

    listed = []
    for c, n in (("phone_numbers", "phone"), ("emails", "email"), ("addresses", "address")):
        listed.append(F.coalesce(F.transform(c, _named(row, n)), F.array().cast(kind)))
    listed.append(F.coalesce(F.transform(F.map_entries("social_links"), lambda e: row(F.concat(F.lit("social_"), e["key"]), e["value"])), F.array().cast(kind)))
    listed.append(F.when(F.col("short_description").isNotNull(), F.array(row(F.lit("description"), F.col("short_description")))).otherwise(F.array().cast(kind)))
    return scrapes.filter("success").select(F.lower(strip(F.col("domain"))).alias("domain"), F.inline(F.concat(*listed)))


def _named(row, name: str):
    return lambda p: row(F.lit(name), p)


def attach_ids(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Records with the company_id of their domain; those of unknown domains are dropped."""
    return records.join(companies.select("domain", F.col("id").alias("company_id")), "domain")


def upsert(old: DataFrame, new: DataFrame, key: str, run_time: Column | None = None) -> DataFrame:
    """The table after new rows replaced or joined the old ones; updated_at only where replaced."""
    if run_time is not None:
        stamp = F.when(F.col("_known"), run_time.cast("timestamp"))
        known = old.select(key).distinct().withColumn("_known", F.lit(True))
        new = new.join(known, key, "left").withColumn("updated_at", stamp).drop("_known")
        if "updated_at" not in old.columns:
            old = old.withColumn("updated_at", F.lit(None).cast("timestamp"))
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def new_runs(runs: DataFrame, recorded: DataFrame, keys: tuple[str, ...] = ("total_domains", "successful", "failed", "total_time_ms")) -> DataFrame:
    """Runs of which no identical one is recorded."""
    return runs.join(recorded.select(*keys), list(keys), "left_anti")


def search_documents(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("all_names", F.array_join("all_names", " ")).drop("crawl_timestamp", "phone_numbers_raw")


def name_vector(commercial: Column, legal: Column, domain: Column, description: Column) -> Column:
    """array<struct<token, weight>>: words of the names, domain and description, weighed A to D."""
    parts = (("A", commercial), ("B", legal), ("C", domain), ("D", description))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.concat(*[F.transform(F.array_distinct(words(c)), _weighed(w)) for w, c in parts])


def _weighed(weight: str):
    return lambda t: F.struct(t.alias("token"), F.lit(weight).alias("weight"))


def response(profiles: DataFrame) -> DataFrame:
    """What a match returns of a profile."""
    name = F.coalesce(F.nullif("commercial_name", F.lit("")), F.nullif("legal_name", F.lit("")), F.try_element_at("all_names", F.lit(1)))
    return profiles.select("domain", name.alias("company_name"), "commercial_name", "legal_name", "all_names", F.concat(F.lit("https://"), F.col("domain")).alias("website"), F.try_element_at("phone_numbers", F.lit(1)).alias("phone"), "phone_numbers", "primary_email", "emails", "facebook_url", "social_links", F.try_element_at("addresses", F.lit(1)).alias("address"), "short_description", "technologies", "logo_url", "industry_keywords", "year_founded")
