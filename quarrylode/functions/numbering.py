"""Telephone numbers of many countries by their codes and the lengths of their national numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylode.functions.normalize import nanp_e164

#: Country codes with the least and most digits of the numbers after them.
NATIONAL_DIGITS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (4, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (4, 13),
    "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (8, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 11), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "94": (9, 9),
    "212": (9, 9), "213": (8, 9), "216": (8, 8), "234": (8, 10), "254": (9, 9), "351": (9, 9), "352": (4, 11), "353": (7, 9), "354": (7, 9), "358": (5, 12), "359": (7, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
#: Countries whose national numbers keep their leading zero abroad.
KEEPS_ZERO = ("39",)


def country_code(digits: Column) -> Column:
    """The code that digits begin with, or null. A code never begins another, so it is looked up by
    three, two and one digits, like the levels of a tree of prefixes."""
    levels = [F.array(*[F.lit(c) for c in NATIONAL_DIGITS if len(c) == n]) for n in (3, 2, 1)]
    return F.coalesce(*[F.when(F.array_contains(level, F.left(digits, F.lit(n))), F.left(digits, F.lit(n))) for n, level in zip((3, 2, 1), levels, strict=True)])


def _fits(code: Column, rest: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for c, (least, most) in NATIONAL_DIGITS.items() for x in (c, least * 100 + most)])
    both = F.try_element_at(lengths, code)
    return F.length(rest).between(F.floor(both / 100), both % 100)


def international(phone: Column, default: str | None = None) -> Column:
    """A number in E.164, or null if its country is not known or has no numbers of that length.

    It begins with + or 00, a (0) after the code is dropped; without either it is a number of the
    country of the default code, a leading zero is that country's trunk prefix. Numbers of code 1 must
    fit the North American plan."""
    text = F.trim(F.coalesce(phone, F.lit("")))
    abroad = F.rlike(text, F.lit(r"^\(?(\+|00)"))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\(0\)", ""), r"^\(?(\+|00)", ""), "[^0-9]", "")
    if default is not None:
        trunk = digits if default in KEEPS_ZERO else F.regexp_replace(digits, "^0", "")
        whole = F.when(abroad, digits).when(F.lit(default) == "1", F.regexp_replace(nanp_e164(digits), r"^\+", "")).otherwise(F.concat(F.lit(default), trunk))
    else:
        whole = F.when(abroad, digits)

    def checked(d: Column) -> Column:
        code = country_code(d)
        rest = F.substr(d, F.length(code) + 1)
        return F.when(code == "1", nanp_e164(d)).when(_fits(code, rest), F.concat(F.lit("+"), d))

    return F.transform(F.array(whole), checked)[0]
