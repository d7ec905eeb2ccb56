"""Contact data, technologies and structured data of web pages, as Column expressions.

Fragments of a page are found by patterns, so everything stays in the JVM: no parser per row.
Text is what remains when tags are cut; like a browser's text content it includes script text and
joins neighbouring elements without a space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.functions.normalize import blank_to_null, nanp_e164, strip

STRINGS = "array<string>"
#: Social hosts, each also with www. in front.
SOCIAL_HOSTS = {"facebook.com": "facebook", "twitter.com": "twitter", "x.com": "twitter", "linkedin.com": "linkedin", "instagram.com": "instagram", "youtube.com": "youtube", "tiktok.com": "tiktok", "pinterest.com": "pinterest", "github.com": "github", "yelp.com": "yelp", "threads.net": "threads"}
#: Signs of technologies in a page's source.
TECHNOLOGIES = {
    "WordPress": "wp-content|wordpress",
    "Shopify": r"cdn\.shopify\.com|shopify",
    "React": r"react(?:\.production|dom)",
    "jQuery": r"jquery[.\-/]",
    "Angular": r"angular[.\-/]",
    "Vue": r"vue[.\-/]",
    "Next.js": r"next\.js|__next",
    "Gatsby": "gatsby",
    "Svelte": "svelte",
    "Bootstrap": r"bootstrap[.\-/]",
    "Tailwind CSS": "tailwindcss|tailwind",
    "Wix": r"wix\.com|parastorage",
    "Squarespace": "squarespace",
    "Google Analytics": "google-analytics|googletagmanager|gtag",
    "Google Tag Manager": r"googletagmanager\.com/gtm",
    "HubSpot": "hubspot",
    "Drupal": "drupal",
    "Joomla": "joomla",
    "Webflow": "webflow",
    "Cloudflare": r"cloudflare|cdnjs\.cloudflare",
    "Font Awesome": "font-awesome|fontawesome",
}
#: Domains of addresses that are never a company's.
JUNK_DOMAINS = ("example.com", "sentry.io", "wixpress.com", "schema.org", "json-ld.org")
#: Types of structured data that describe a company.
ORGANISATIONS = ("Organization", "LocalBusiness", "Corporation", "Store", "Restaurant", "MedicalBusiness", "LegalService", "FinancialService", "RealEstateAgent", "AutoDealer", "HealthAndBeautyBusiness", "HomeAndConstructionBusiness", "ProfessionalService", "FoodEstablishment")
#: Parts of United States addresses.
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY"
STREETS = "Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct|Place|Pl|Circle|Cir|Terrace|Ter|Trail|Trl|Parkway|Pkwy|Highway|Hwy|Suite|Ste"
#: Forms of phones, e-mails, hidden e-mails, years and addresses in text.
PHONES = (r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\+1\d{10}")
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
HIDDEN_EMAIL = r"(?i)[a-zA-Z0-9._%+-]+\s*[\[({]\s*at\s*[\])}]\s*[a-zA-Z0-9.-]+\s*[\[({]\s*dot\s*[\])}]\s*[a-zA-Z]{2,}"
YEARS = (r"(?i)(?:founded|established|since|est\.?)\s*(?:in\s+)?(\d{4})", r"(?i)©\s*(\d{4})", r"(?i)copyright\s*(\d{4})")
ADDRESS_FULL = rf"(?i)\d{{1,5}}\s+[A-Za-z0-9.\s]+(?:{STREETS})\b[.,]?\s*[A-Za-z\s]+,?\s*(?:{STATES})\b\s*\d{{5}}(?:-\d{{4}})?"
ADDRESS_NO_ZIP = rf"(?i)\d{{1,5}}\s+[A-Za-z0-9.\s]+(?:{STREETS})\b[.,]?\s*[A-Za-z\s]{{2,30}},\s*(?:{STATES})\b"
ADDRESS_BOX = rf"(?i)P\.?\s*O\.?\s*Box\s+\d+[,.]?\s*[A-Za-z\s]+,?\s*(?:{STATES})\b\s*(?:\d{{5}}(?:-\d{{4}})?)?"
#: The footer is the first of these that a page has.
FOOTERS = (
    r"(?is)<footer\b[^>]*>(.*?)</footer>",
    r"(?is)<(\w+)\b[^>]*\brole\s*=\s*[\"']contentinfo[\"'][^>]*>(.*?)</\1>",
    r"(?is)<(\w+)\b[^>]*\bid\s*=\s*[\"']footer[\"'][^>]*>(.*?)</\1>",
    r"(?is)<(\w+)\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?footer(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1>",
    r"(?is)<(\w+)\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?site-footer(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1>",
)
_LD = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def nothing() -> Column:
    return F.array().cast(STRINGS)


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), nothing())


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match or if empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def decode_entities(c: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0*39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.regexp_replace(c, name, sign)
    return c


def text_of(html: Column) -> Column:
    return decode_entities(F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", ""))


def body_of(html: Column) -> Column:
    return F.coalesce(first_group(html, r"(?is)<body\b[^>]*>(.*?)(?:</body>|\z)"), html)


def footer_of(html: Column) -> Column:
    return F.coalesce(*[first_group(html, p, 2 if "\\1" in p else 1) for p in FOOTERS])


def title_of(html: Column) -> Column:
    return strip(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def meta_of(html: Column, key: str, value: str) -> Column:
    """Content of the first meta element whose attribute key is value, in either order."""
    at, content = rf"\b{key}\s*=\s*[\"']{value}[\"']", r"\bcontent\s*=\s*[\"']([^\"']*)[\"']"
    return F.coalesce(first_group(html, rf"(?is)<meta\b[^>]*{at}[^>]*{content}"), first_group(html, rf"(?is)<meta\b[^>]*{content}[^>]*{at}"))


def link_of(html: Column, rel: str) -> Column:
    at, href = rf"\brel\s*=\s*[\"']{rel}[\"']", r"\bhref\s*=\s*[\"']([^\"']*)[\"']"
    return F.coalesce(first_group(html, rf"(?is)<link\b[^>]*{at}[^>]*{href}"), first_group(html, rf"(?is)<link\b[^>]*{href}[^>]*{at}"))


def anchors_of(html: Column) -> Column:
    return all_of(html, r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)


def strip_scripts(html: Column) -> Column:
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return html


def phones_in(text: Column) -> Column:
    """Valid North American numbers of a text in E.164, each once."""
    found = F.concat(*[all_of(text, p) for p in PHONES])
    return F.array_distinct(F.array_compact(F.transform(found, lambda p: nanp_e164(F.regexp_replace(p, "[^0-9]", "")))))


def tel_links(html: Column) -> Column:
    hrefs = F.filter(anchors_of(html), lambda h: F.startswith(h, F.lit("tel:")))
    return F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: nanp_e164(F.regexp_replace(h, "[^0-9]", "")))))


def _points(values: Column, element: str, method: str, confidence: float) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(element).alias("source_element"), F.lit(method).alias("extraction_method"), F.lit(confidence).alias("confidence")))


def first_each(points: Column, key=lambda p: p["value"]) -> Column:
    """Data points without those whose key came before; n of them are sorted, not compared in pairs."""
    placed = F.array_sort(F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))
    firsts = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"])))[0]
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"])


@dataclass
class Page:
    """A page and the parts of it that several fields read."""

    html: Column
    body: Column
    text: Column
    footer: Column
    footer_text: Column
    items: Column
    companies: Column

    @staticmethod
    def of(html: Column | Page) -> Page:
        if isinstance(html, Page):
            return html
        body, footer, items = body_of(html), footer_of(html), json_ld_items(html)
        return Page(html, body, text_of(body), footer, text_of(footer), items, companies_of(items))

    @staticmethod
    def cut(pages: DataFrame, html: str = "html") -> tuple[DataFrame, Page]:
        """pages with the parts as columns, which are cut once however many fields read them."""
        c = lambda n: f"_page_{n}"
        first = pages.withColumns({c("body"): body_of(F.col(html)), c("footer"): footer_of(F.col(html)), c("items"): json_ld_items(F.col(html))})
        then = first.withColumns({c("text"): text_of(F.col(c("body"))), c("footer_text"): text_of(F.col(c("footer"))), c("companies"): companies_of(F.col(c("items")))})
        return then, Page(F.col(html), *[F.col(c(n)) for n in ("body", "text", "footer", "footer_text", "items", "companies")])


def page_phones(html: Column | Page) -> Column:
    """Data points of phones: links first, then the footer's text, then all text; each once."""
    p = Page.of(html)
    return first_each(F.concat(_points(tel_links(p.html), "a[href^=tel:]", "tel_link", 0.95), _points(F.coalesce(phones_in(p.footer_text), nothing()), "footer_text", "footer_regex", 0.88), _points(phones_in(p.text), "body_text", "regex", 0.80)))


def social_platform(url: Column) -> Column:
    """The platform of a url by its host, or null."""
    hosts = F.create_map(*[F.lit(x) for h, p in SOCIAL_HOSTS.items() for x in (h, p, f"www.{h}", p)])
    return F.try_element_at(hosts, F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))))


def page_socials(html: Column | Page) -> Column:
    """map platform -> data point: footer links, then all links, then og: contents; first wins."""
    page = Page.of(html)
    html = page.html
    anchors = lambda part, e, m, c: F.filter(_points(part, e, m, c), lambda p: _own_page(p["value"]))
    og = all_of(html, r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\"']og:[^\"']*[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']+)[\"']", 1)
    points = F.concat(anchors(F.coalesce(anchors_of(page.footer), nothing()), "footer a[href]", "footer_anchor", 0.95), anchors(anchors_of(html), "a[href]", "anchor_tag", 0.90), _points(og, "meta[property^=og:]", "meta_og", 0.85))
    named = F.filter(F.transform(points, lambda p: F.struct(social_platform(p["value"]).alias("platform"), p.alias("p"))), lambda x: x["platform"].isNotNull())
    return F.map_from_entries(first_each(named, lambda x: x["platform"]))


def _own_page(url: Column) -> Column:
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+\z", "")
    return (F.coalesce(social_platform(url), F.lit("")) != "facebook") | (path != "")


def addresses_in(text: Column) -> Column:
    """Data points of United States addresses in a text: full, without zip, post boxes."""
    kinds = ((ADDRESS_FULL, 3, "regex_us_full", 0.75), (ADDRESS_NO_ZIP, 3, "regex_us_no_zip", 0.60), (ADDRESS_BOX, 2, "regex_po_box", 0.65))
    return F.concat(*[_points(F.slice(all_of(text, p), 1, n), "body_text", m, c) for p, n, m, c in kinds])


def tidy(points: Column) -> Column:
    """Addresses with single spaces, longer than five characters, each once whatever its case."""
    clean = F.transform(points, lambda p: p.withField("value", strip(F.regexp_replace(p["value"], r"\s+", " "))))
    return first_each(F.filter(clean, lambda p: F.length(p["value"]) > 5), lambda p: F.lower(p["value"]))


def page_addresses(html: Column | Page) -> Column:
    """Data points of addresses: structured data, <address> elements, then text."""
    page = Page.of(html)
    tagged = F.filter(F.transform(all_of(page.html, r"(?is)<address\b[^>]*>(.*?)</address>", 1), lambda a: strip(F.regexp_replace(text_of(a), r"\s+", " "))), lambda a: (F.length(a) > 10) & (F.length(a) < 300))
    structured = F.flatten(F.transform(page.items, lambda i: _json_addresses(i, 5)))
    return tidy(F.concat(_points(structured, "script[type=application/ld+json]", "json_ld", 0.95), _points(tagged, "address", "html_address_tag", 0.85), addresses_in(page.text)))


def _variants(v: Column, path: str) -> Column:
    """What is at a path, as an array: of an array its items, of one value that value."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array_compact(F.array(F.try_variant_get(v, path, "variant"))), F.array().cast("array<variant>"))


def _string(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def json_ld_items(html: Column) -> Column:
    """Items of all structured data of a page: of an array, a graph, or one object."""
    parsed = F.array_compact(F.transform(all_of(html, _LD, 1), lambda s: F.try_parse_json(s)))
    graph = lambda v: F.try_variant_get(v, '$["@graph"]', "array<variant>")
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), graph(v), F.array(v))))


def _json_addresses(item: Column, parts: int) -> Column:
    names = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")[:parts]
    found = F.concat(_variants(item, "$.address"), _variants(item, "$.location.address") if parts == 5 else F.array().cast("array<variant>"))
    joined = lambda a: F.nullif(F.concat_ws(", ", *[_string(a, f"$.{n}") for n in names]), F.lit(""))
    return F.array_compact(F.transform(found, lambda a: F.when(F.startswith(F.schema_of_variant(a), F.lit("OBJECT")), joined(a)).otherwise(F.try_variant_get(a, "$", "string"))))


def companies_of(items: Column) -> Column:
    """The items of structured data whose type is a company's."""
    kinds = lambda i: F.transform(_variants(i, '$["@type"]'), lambda t: F.try_variant_get(t, "$", "string"))
    return F.filter(items, lambda i: F.arrays_overlap(kinds(i), F.array(*[F.lit(o) for o in ORGANISATIONS])))


def json_ld_organisation(html: Column | Page, current_year: int) -> Column:
    """struct(name, description, phones, founded, addresses, emails, same_as) of a page's companies."""
    orgs = Page.of(html).companies
    first = lambda path: F.try_element_at(F.array_compact(F.transform(orgs, lambda i: _string(i, path))), F.lit(1))
    strings = lambda path: F.flatten(F.transform(orgs, lambda i: F.array_compact(F.transform(_variants(i, path), lambda v: F.try_variant_get(v, "$", "string")))))
    year = F.transform(orgs, lambda i: F.try_to_number(F.left(_string(i, "$.foundingDate"), F.lit(4)), F.lit("9999")).cast("int"))
    return F.struct(
        first("$.name").alias("name"),
        first("$.description").alias("description"),
        F.transform(strings("$.telephone"), strip).alias("phones"),
        F.try_element_at(F.filter(year, lambda y: y.between(1800, current_year)), F.lit(-1)).alias("founded"),
        F.flatten(F.transform(orgs, lambda i: _json_addresses(i, 4))).alias("addresses"),
        F.transform(strings("$.email"), lambda e: F.regexp_replace(e, "(?i)^mailto:", "")).alias("emails"),
        F.filter(strings("$.sameAs"), lambda u: F.startswith(u, F.lit("http"))).alias("same_as"),
    )


def technologies_in(html: Column) -> Column:
    """Technologies by the generator named first, then by the whole source; each once."""

    def has(text: Column, pattern: str) -> Column:
        """The patterns are in lower case; how their parts begin is looked for first, at less cost."""
        may = F.lit(False)
        for start in re.findall(r"(?:^|\|)([a-z_-]+)", pattern):
            may = may | F.contains(text, F.lit(start))
        return may & F.rlike(text, F.lit(pattern))

    names = lambda text: F.array_compact(F.array(*[F.when(has(text, p), F.lit(t)) for t, p in TECHNOLOGIES.items()]))
    texts = F.array(F.lower(F.coalesce(meta_of(html, "name", "generator"), F.lit(""))), F.lower(html))  # made once, then read by every pattern
    return F.array_distinct(F.flatten(F.transform(texts, names)))


def _let(value: Column, then) -> Column:
    """then(value), where value is made once however often then reads it."""
    return F.transform(F.array(value), then)[0]


def decode_cf_email(code: Column) -> Column:
    """An address whose bytes were XORed with the first one, from hex; null if it is none."""
    byte = lambda h: F.conv(h, 16, 10).cast("int")
    plain = lambda b: F.lower(F.array_join(F.transform(F.slice(b, 2, F.size(b)), lambda x: F.char(x.bitwiseXOR(F.get(b, F.lit(0))))), ""))
    address = lambda a: F.when(F.contains(a, F.lit("@")) & F.contains(a, F.lit(".")), a)
    decoded = lambda c: _let(_let(F.transform(all_of(c, "[0-9A-Fa-f]{2}"), byte), plain), address)
    return _let(code, lambda c: F.when(F.rlike(c, F.lit(r"^(?:[0-9A-Fa-f]{2}){2,}$")), decoded(c)))


def hidden_emails(text: Column) -> Column:
    """Addresses written with [at] and [dot]."""
    at = lambda m: F.regexp_replace(m, r"(?i)\s*[\[({]\s*at\s*[\])}\s]*", "@")
    return F.transform(all_of(text, HIDDEN_EMAIL), lambda m: F.lower(strip(F.regexp_replace(at(m), r"(?i)\s*[\[({]\s*dot\s*[\])}\s]*", "."))))


def is_junk_email(email: Column) -> Column:
    test = F.lit(False)
    for d in JUNK_DOMAINS:
        test = test | F.contains(email, F.lit(d))
    return test


def accepted_emails(found: Column) -> Column:
    clean = F.transform(found, lambda e: F.lower(strip(e)))
    return F.array_distinct(F.filter(clean, lambda e: F.contains(e, F.lit("@")) & ~is_junk_email(e)))


def raw_emails(html: Column, limit: int | None = None, shown: Column | None = None) -> Column:
    """All e-mail strings of a fragment: links, encoded ones, text (the first so many), hidden. Its
    text is made here if it is not at hand."""
    shown = text_of(html) if shown is None else shown
    links = F.filter(anchors_of(html), lambda h: F.startswith(h, F.lit("mailto:")))
    links = F.transform(links, lambda h: F.regexp_replace(F.regexp_replace(h, r"(?i)^mailto:\s*", ""), r"(?s)\?.*\z", ""))
    coded = F.array_compact(F.transform(all_of(html, r"(?is)\bdata-cfemail\s*=\s*[\"']([^\"']*)[\"']", 1), decode_cf_email))
    text = all_of(shown, EMAIL)
    return F.concat(links, coded, F.slice(text, 1, limit) if limit else text, hidden_emails(shown))


def page_emails(html: Column | Page) -> Column:
    p = Page.of(html)
    return accepted_emails(F.concat(raw_emails(p.body, 5, p.text), json_ld_organisation(p, 9999)["emails"], F.coalesce(raw_emails(p.footer, shown=p.footer_text), nothing())))


def year_founded(text: Column, current_year: int) -> Column:
    """The first plausible year by the first form that has one."""
    years = [F.regexp_extract(text, p, 1) for p in YEARS]
    return F.coalesce(*[F.when((y != "") & F.nullif(y, F.lit("")).cast("int").between(1800, current_year), F.nullif(y, F.lit("")).cast("int")) for y in years])


def keywords(content: Column) -> Column:
    words = F.transform(F.split(content, ","), lambda k: F.lower(strip(k)))
    return F.coalesce(F.slice(F.filter(words, lambda k: F.length(k).between(3, 49)), 1, 10), nothing())


def company_name_of(title: Column) -> Column:
    return blank_to_null(F.regexp_replace(title, r"(?i)\s*[|–—-]\s*(home|welcome|official|main).*$", ""))


def page_fields(html: Column | Page, current_year: int) -> dict[str, Column]:
    """All that a page says about its company, by field; over a table, see Page.cut."""
    page = Page.of(html)
    org, html = json_ld_organisation(page, current_year), page.html
    described = F.coalesce(blank_to_null(meta_of(html, "name", "description")), blank_to_null(meta_of(html, "property", "og:description")), org["description"])
    return {
        "company_name": F.coalesce(org["name"], blank_to_null(meta_of(html, "property", "og:site_name")), company_name_of(title_of(html))),
        "phone_numbers": page_phones(page),
        "jsonld_phones": org["phones"],
        "emails": page_emails(page),
        "addresses": page_addresses(page),
        "social_links": page_socials(page),
        "same_as": org["same_as"],
        "short_description": F.substring(described, 1, 500),
        "technologies": technologies_in(html),
        "logo_url": F.coalesce(link_of(html, "icon"), link_of(html, "shortcut icon"), meta_of(html, "property", "og:image")),
        "industry_keywords": keywords(meta_of(html, "name", "keywords")),
        "year_founded": F.coalesce(org["founded"], year_founded(page.text, current_year)),
    }
