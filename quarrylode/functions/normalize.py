"""Normalisers as Column expressions: phones, web domains, Facebook pages, company names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that say nothing about a company.
GENERIC_DOMAINS = ("google.com", "www.google.com", "bing.com", "www.bing.com", "facebook.com", "www.facebook.com", "youtube.com", "www.youtube.com", "twitter.com", "www.twitter.com", "instagram.com", "www.instagram.com")
#: Legal forms cut from names, in this order; Java patterns with ASCII word bounds.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
LEGAL_FORMS = ("Holdings?", "Limited", "Company", r"Pty\.?", r"Ltd\.?", r"LLC\.?", r"Inc\.?", r"Corp\.?", r"Co\.(?=\s*\z)", "LTD")
#: North American numbers: area code and exchange start with 2 to 9.
NANP = r"[2-9][0-9]{2}[2-9][0-9]{6}"
_SPACE = r"[\s\x{FEFF}\x{A0}]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def nanp_e164(digits: Column) -> Column:
    """+1 and ten digits, from ten digits or eleven with a leading 1; else null."""
    return F.when(F.rlike(digits, F.lit(rf"^1?{NANP}$")), F.concat(F.lit("+1"), F.right(digits, F.lit(10))))


def normalize_phone(raw: Column) -> Column:
    """E.164 or null. North American numbers are checked by their plan; other numbers with a plus
    sign pass with 8 to 15 digits, which is an approximation of national numbering plans."""
    cleaned = F.regexp_replace(F.regexp_replace(strip(raw), r"\(\+", "+"), r"[()]", "")
    kept = F.regexp_replace(cleaned, r"[^0-9+]", "")
    digits = F.regexp_replace(kept, r"\+", "")
    abroad = F.when(F.startswith(cleaned, F.lit("+")) & F.rlike(digits, F.lit(r"^[2-9][0-9]{7,14}$")), F.concat(F.lit("+"), digits))
    return F.when(F.length(kept) >= 7, F.coalesce(nanp_e164(digits), abroad))


def overlay_phone(raw: Column) -> Column:
    """The refinement stage's rule: North American, else a plus sign and 10 to 15 digits as is."""
    kept = F.regexp_replace(raw, r"[^0-9+]", "")
    return F.coalesce(nanp_e164(F.regexp_replace(kept, r"\+", "")), F.when(F.rlike(kept, F.lit(r"^\+[0-9]{10,15}$")), kept))


def normalize_url(raw: Column) -> Column:
    """The bare lower-case host of a url or domain; null if generic or not a domain."""
    c = F.regexp_replace(strip(raw), r"(?i)^(?:https?://)+", "")
    c = F.regexp_replace(c, r"(?i)^https?//", "")
    c = F.regexp_replace(c, r"(?i)^www\.", "")
    c = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?s)[/?#].*\z", "")), r"\.+\z", "")
    return F.when((F.length(c) >= 4) & F.contains(c, F.lit(".")) & ~c.isin(*GENERIC_DOMAINS), c)


def normalize_facebook(raw: Column) -> Column:
    """The lower-case page name of a Facebook url, or null."""
    c = F.regexp_replace(F.regexp_replace(strip(raw), r"(?i)^https?://", ""), r"(?i)^www\.", "")
    page = F.regexp_replace(F.regexp_replace(c, r"(?i)^facebook\.com/?", ""), r"/+\z", "")
    page = F.lower(F.regexp_extract(page, r"^[^?#/]*", 0))
    fine = F.startswith(F.lower(c), F.lit("facebook.com")) & ~page.isin("", "pages", "profile.php") & (F.length(page) >= 2)
    return F.when(fine, page)


def normalize_company_name(raw: Column) -> Column:
    """A name without legal forms and stray signs, in lower case; null if under two characters."""
    c = F.regexp_replace(strip(raw), "&", " ")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\*", ""), "//", ""), r"\.\.", "")
    for _ in range(2):
        for form in LEGAL_FORMS:
            # a form that ends in an optional point needs a word bound after what it took
            end = "" if form.startswith("Co") and "(?=" in form else r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
            c = F.regexp_replace(c, rf"(?i){_B}{form}{end}", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"^[\s\-.,;:!?'\"]+", ""), r"[\s\-.,;:!?'\"]+\z", "")
    c = F.lower(strip(F.regexp_replace(c, r"\s+", " ")))
    c = F.regexp_replace(F.regexp_replace(c, r"^[-.\s]+", ""), r"[-.\s]+\z", "")
    return F.when(F.length(c) >= 2, c)


def split_names(c: Column) -> Column:
    """Names separated by bars, trimmed, empty ones dropped; never null."""
    return F.coalesce(F.filter(F.transform(F.split(c, r"\|"), strip), lambda n: n != ""), F.array().cast("array<string>"))


def usable_fields(domain: Column, phone: Column, facebook: Column, name: Column) -> Column:
    """Which keys a match input has, in this order."""
    named = (("website", domain), ("phone", phone), ("facebook", facebook), ("name", name))
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in named]))
