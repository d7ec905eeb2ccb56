"""SQL texts of the normalisers, for checking queries in another engine."""

from __future__ import annotations

#: Fixed values that results must have, stated here again so that the check does not lean on the code.
GENERIC_DOMAINS = ("google.com", "www.google.com", "bing.com", "www.bing.com", "facebook.com", "www.facebook.com", "youtube.com", "www.youtube.com", "twitter.com", "www.twitter.com", "instagram.com", "www.instagram.com")
LEGAL_FORMS = (r"\bHoldings?\b", r"\bLimited\b", r"\bCompany\b", r"\bPty\.?\b", r"\bLtd\.?\b", r"\bLLC\.?\b", r"\bInc\.?\b", r"\bCorp\.?\b", r"\bCo\.\s*$", r"\bLTD\b")
NANP = "[2-9][0-9]{2}[2-9][0-9]{6}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cut(c: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, '{flags}')"


def url(c: str) -> str:
    host = cut(cut(cut(f"trim({c})", "(?i)^(?:https?://)+"), "(?i)^https?//"), r"(?i)^www\.")
    host = cut(f"lower({cut(host, '(?s)[/?#].*$')})", r"\.+$")
    generic = ", ".join(lit(g) for g in GENERIC_DOMAINS)
    return f"case when length({host}) >= 4 and contains({host}, '.') and {host} not in ({generic}) then {host} end"


def ordered_distinct(items: str) -> str:
    """Each item of a list once, in the order of their first places (list_distinct keeps no order)."""
    return f"(select list_filter(m, lambda x, i: list_position(m, x) = i) from (select {items} as m))"


def phone(c: str) -> str:
    cleaned = cut(cut(f"trim({c})", r"\(\+", "+"), "[()]")
    kept = cut(cleaned, "[^0-9+]")
    digits = cut(kept, r"\+")
    return f"case when length({kept}) < 7 then null when regexp_matches({digits}, '^1?{NANP}$') then '+1' || right({digits}, 10) when starts_with({cleaned}, '+') and regexp_matches({digits}, '^[2-9][0-9]{{7,14}}$') then '+' || {digits} end"


def phone_list(c: str) -> str:
    raw = f"list_concat(regexp_extract_all({c}, '(?:\\+?1[-.\\s]?)?\\(?\\d{{3}}\\)?[-.\\s]?\\d{{3}}[-.\\s]?\\d{{4}}'), regexp_extract_all({c}, '\\+1\\d{{10}}'))"
    digits = f"list_transform({raw}, lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
    return ordered_distinct(f"list_transform(list_filter({digits}, lambda x: regexp_matches(x, '^1?{NANP}$')), lambda x: '+1' || right(x, 10))")


def facebook(c: str) -> str:
    bare = cut(cut(f"trim({c})", "(?i)^https?://"), r"(?i)^www\.")
    rest = cut(cut(bare, r"(?i)^facebook\.com/?"), "/+$")
    page = f"lower(regexp_extract({rest}, '^[^?#/]*'))"
    return f"case when starts_with(lower({bare}), 'facebook.com') and {page} not in ('', 'pages', 'profile.php') and length({page}) >= 2 then {page} end"


def company(c: str) -> str:
    name = cut(cut(cut(cut(f"trim({c})", "&", " "), r"\*"), "//"), r"\.\.")
    for _ in range(2):
        for form in LEGAL_FORMS:
            name = cut(name, f"(?i){form}", " ")
    name = cut(cut(name, r"""^[\s\-.,;:!?'"]+"""), r"""[\s\-.,;:!?'"]+$""")
    name = f"lower(trim({cut(name, chr(92) + 's+', ' ')}))"
    name = cut(cut(name, r"^[-.\s]+"), r"[-.\s]+$")
    return f"(select case when length(x) >= 2 then x end from (select {name} as x))"
