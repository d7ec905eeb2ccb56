"""Quality score of a scraped company, match confidence, and display labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Addresses that templates leave behind, domains of services, words of hijacked sites.
PLACEHOLDERS = ("your@email.com", "email@domain.com", "info@example.com", "name@company.com", "user@example.com", "test@test.com", "email@example.com", "yourname@email.com")
SERVICE_DOMAINS = ("sentry.io", "keen.io", "wixpress.com", "schema.org", "json-ld.org", "example.com", "gravatar.com", "wordpress.org", "w3.org", "googleapis.com", "googletagmanager.com")
SPAM = r"(?i)casino|gambling|betting|slot\s?gacor|poker|happybet|togel|judi|sbobet"
ACTION_TEXT = r"(?i)contact\s*us|click|call\s*us|email\s*us"
#: Weight of a matched field in the overall confidence; other fields weigh 0.05.
WEIGHTS = {"website": 0.40, "phone": 0.30, "facebook": 0.20, "name": 0.10, "company_name": 0.10}
OTHER_WEIGHT = 0.05


def _sized(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def penalties(domain: Column, name: Column, emails: Column, phones: Column, addresses: Column, description: Column, logo: Column, year: Column, success: Column, pages: Column, current_year: int) -> Column:
    """array<struct<points, reason>> in the order of the checks. Arrays hold plain strings."""
    none = F.array().cast("array<struct<points:int,reason:string>>")

    def hit(test: Column, points: int, reason: Column | str) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(F.lit(points).alias("points"), text.alias("reason")))).otherwise(none)

    def email_hits(e: Column) -> Column:
        v = F.lower(e)
        host, local, short = F.get(F.split(v, "@"), F.lit(1)), F.get(F.split(v, "@"), F.lit(0)), F.left(v, F.lit(50))
        return F.concat(
            hit(v.isin(*PLACEHOLDERS), 20, F.concat(F.lit("placeholder_email:"), v)),
            hit(host.isin(*SERVICE_DOMAINS), 15, F.concat(F.lit("junk_email_domain:"), host)),
            hit(F.rlike(local, F.lit("[0-9]{7,}")), 20, F.concat(F.lit("garbled_email:"), short)),
            hit(F.contains(v, F.lit("%")), 10, F.concat(F.lit("urlencoded_email:"), short)),
        )

    def address_hits(a: Column) -> Column:
        return F.concat(hit(F.length(a) > 150, 10, "address_too_long"), hit(F.rlike(a, F.lit(ACTION_TEXT)), 15, F.concat(F.lit("garbage_address:"), F.left(a, F.lit(50)))))

    def each(items: Column, f) -> Column:
        return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), f))

    nameless, no_text = F.coalesce(name, F.lit("")) == "", F.coalesce(description, F.lit("")) == ""
    bare = (_sized(emails) == 0) & (_sized(phones) == 0) & (_sized(addresses) == 0)
    return F.concat(
        hit(nameless, 15, "missing_company_name"),
        hit(_sized(emails) == 0, 10, "no_emails"),
        hit(_sized(phones) == 0, 10, "no_phones"),
        hit(_sized(addresses) == 0, 10, "no_addresses"),
        hit(no_text, 5, "no_description"),
        each(emails, email_hits),
        hit(year >= current_year, 15, F.concat(F.lit("future_year_founded:"), year.cast("string"))),
        hit(F.rlike(name, F.lit("^https?://")), 15, "company_name_is_url"),
        hit(F.length(name) > 80, 10, "company_name_too_long"),
        each(addresses, address_hits),
        hit((logo != "") & ~F.startswith(logo, F.lit("http")) & ~F.startswith(logo, F.lit("data:")), 5, "relative_logo_url"),
        hit(success & (_sized(pages) > 0) & bare & nameless, 30, "empty_success"),
        hit(F.rlike(description, F.lit(SPAM)) & ~F.rlike(domain, F.lit(SPAM)), 30, "hijacked_spam_domain"),
    )


def quality(found: Column, threshold: int = 70) -> Column:
    """struct(score, needs_refinement, reasons) from penalties()."""
    score = F.greatest(F.lit(0), F.lit(100) - F.aggregate(found, F.lit(0), lambda a, p: a + p["points"]))
    return F.struct(score.alias("score"), (score < threshold).alias("needs_refinement"), F.transform(found, lambda p: p["reason"]).alias("reasons"))


def squash(relevance: Column) -> Column:
    return F.least(relevance / (relevance + 5), F.lit(0.95))


def agreement(confidence: Column, fields: Column) -> Column:
    """More confidence where several fields agree."""
    return F.when(fields >= 3, F.least(confidence + 0.15, F.lit(0.99))).when(fields >= 2, F.least(confidence + 0.10, F.lit(0.97))).otherwise(confidence)


def match_quality(confidence: Column, fields: Column) -> Column:
    exact = F.size(F.filter(fields, lambda f: f != "name"))
    return F.when((confidence > 0.9) & (exact >= 2), "VERIFIED").when((confidence > 0.7) & (exact >= 1), "HIGH").when(confidence > 0.5, "MEDIUM").when(confidence > 0.3, "LOW").otherwise("UNCERTAIN")


def weighted_confidence(scores: Column) -> Column:
    """Weighted mean of a map field -> confidence, to four decimals; 0 for an empty map."""
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    weigh = lambda k: F.coalesce(F.try_element_at(weights, k), F.lit(OTHER_WEIGHT))
    both = F.aggregate(
        F.map_entries(scores),
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
        lambda a, e: F.struct((a["s"] + weigh(e["key"]) * e["value"]).alias("s"), (a["w"] + weigh(e["key"])).alias("w")),
    )
    return F.when(F.size(scores) > 0, F.round(both["s"] / both["w"], 4)).otherwise(F.lit(0.0))


def confidence_label(c: Column) -> Column:
    return F.coalesce(F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%")), F.lit("—"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c.isNotNull(), "low").otherwise("none")


def duration_label(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "—").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def display_address(raw: Column, *parts: Column) -> Column:
    return F.coalesce(F.nullif(raw, F.lit("")), F.concat_ws(", ", *parts))


def absolute_logo(logo: Column, domain: Column) -> Column:
    return F.when(F.startswith(logo, F.lit("http")), logo).otherwise(F.concat(F.lit("https://"), domain, F.lit("/"), logo))
