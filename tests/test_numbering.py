"""Numbers of ten countries and more, as their numbering plans have them."""

from pyspark.sql import functions as F

from quarrylode.functions.numbering import NATIONAL_DIGITS, country_code, international

ABROAD = {
    "+44 20 7946 0958": "+442079460958", "+44 (0)20 7946 0958": "+442079460958", "0044 20 7946 0958": "+442079460958", "(+49) 30 901820": "+4930901820", "+33 1 23 45 67 89": "+33123456789", "+61 2 9374 4000": "+61293744000", "+81 3-1234-5678": "+81312345678",
    "+91 22 2778 2183": "+912227782183", "+55 11 91234-5678": "+5511912345678", "+39 06 698 82353": "+390669882353", "+353 1 234 5678": "+35312345678", "+971 4 123 4567": "+97141234567", "+1 (207) 762-9321": "+12077629321",
    "+33 1 23 45 67": None, "+33 1 23 45 67 89 0": None, "+61 2 9374 400": None, "+999 12345678": None, "+1 107 762 9321": None, "020 7946 0958": None, "+": None, "": None, None: None, "words": None,
}


def test_numbers_with_a_country(spark):
    df = spark.createDataFrame([(k, v) for k, v in ABROAD.items()], "phone string, wanted string")
    assert [r for r in df.select("phone", "wanted", international(F.col("phone")).alias("got")).collect() if r.wanted != r.got] == []


def test_numbers_of_a_default_country(spark):
    cases = [("44", "020 7946 0958", "+442079460958"), ("39", "06 698 82353", "+390669882353"), ("1", "(207) 762-9321", "+12077629321"), ("1", "107 762 9321", None), ("33", "01 23 45 67 89", "+33123456789"), ("33", "+44 20 7946 0958", "+442079460958"), ("33", "12", None)]
    one = spark.range(1)
    for code, phone, wanted in cases:
        assert one.select(international(F.lit(phone), code)).first()[0] == wanted


def test_no_code_begins_another_and_codes_are_found(spark):
    assert not [(a, b) for a in NATIONAL_DIGITS for b in NATIONAL_DIGITS if a != b and b.startswith(a)]
    df = spark.createDataFrame([(c + "5" * 9, c) for c in NATIONAL_DIGITS], "digits string, code string")
    assert df.filter(country_code(F.col("digits")) != F.col("code")).isEmpty()
