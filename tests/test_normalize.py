"""Table-driven checks of the normalisers, evaluated as Columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylode.functions import normalize as N

#: The vectors that results must equal, in four tables.
COMPANY = [
    ("SafetyChain Software Services Pty. Ltd.", "safetychain software services"), ("SBS*", "sbs"), ("&AWL", "awl"), ("Hueboost Services //", "hueboost services"), ("Inc. Mercury", "mercury"),
    ("Forge Marketing & Management Pty.", "forge marketing management"), ("Cadott Family Restaurant Limited", "cadott family restaurant"), ("Blue Ridge Chair - Limited", "blue ridge chair"), ("A W Brueggemann Co.", "a w brueggemann"),
    ("Cedar Work Inc.", "cedar work"), ("JETT Business Technology LTD", "jett business technology"), ("Total Seal Inc.", "total seal"), ("True Audio Services", "true audio services"), ("RyanLBatesDDS", "ryanlbatesdds"),
    ("Acorn Law P.C.", "acorn law p.c"), ("Advance Net Support", "advance net support"), ("Aroostook", "aroostook"), ("Denham's Florist Inc", "denham's florist"), ("Garrett-Wietholter-State-Farm-Agent", "garrett-wietholter-state-farm-agent"),
    ("GSS", "gss"), ("American Inns of Court Company", "american inns of court"), ("NY AL Elevator", "ny al elevator"), ("NY Staffing LLC.", "ny staffing"), ("Puppet Heap USA", "puppet heap usa"), ("SteppIR Tree Services", "steppir tree services"),
    ("Templo Ebenezer Weslaco Holding", "templo ebenezer weslaco"), ("The Greenwich Cincinnati", "the greenwich cincinnati"), ("ViruStar LLC.", "virustar"), ("Inc.", None), ("..", None), ("", None), (None, None), ("   ", None),
]
FACEBOOK = [
    ("https://www.facebook.com/acornfurnitureworkshops", "acornfurnitureworkshops"), ("https://facebook.com/bluemercury", "bluemercury"), ("https://www.facebook.com/GSSstrings/", "gssstrings"),
    ("https://www.facebook.com/SBS-Transport-LLC-101932885163238", "sbs-transport-llc-101932885163238"), ("https://www.facebook.com/SteppIR/", "steppir"), ("https://www.facebook.com/totalseal.pistonrings/", "totalseal.pistonrings"),
    ("https://www.facebook.com/workitstudio/", "workitstudio"), ("https://www.facebook.com/musselrockcloggers/", "musselrockcloggers"), ("https://facebook.com/puppetheap", "puppetheap"), ("https://www.facebook.com/somepage?ref=123", "somepage"),
    ("", None), (None, None), ("https://twitter.com/someuser", None), ("https://www.facebook.com/", None),
]
PHONE = [
    ("(786) 426-3492", "+17864263492"), ("207.762.9321", "+12077629321"), ("(509) 276-6996", "+15092766996"), ("715.978.0027", "+17159780027"), ("(706) 685.0182", "+17066850182"), ("(317) 873-3230", "+13178733230"),
    ("(+877) 449-5079", "+18774495079"), ("+1703-684-3590", "+17036843590"), ("(678) 387-5715", "+16783875715"), ("(956) 968-8142", "+19569688142"), ("+1513-221-1151", "+15132211151"), ("865-494-3388", "+18654943388"),
    ("", None), (None, None), ("not a phone", None), ("123", None), ("   ", None),
]
URL = [
    ("https://https//acornlawpc.com/", "acornlawpc.com"), ("http://sbstransportllc.com/index.html?lang=en", "sbstransportllc.com"), ("https://safetychain.com/about-us", "safetychain.com"), ("https://www.blueridgechair.com", "blueridgechair.com"),
    ("awlsnap.com", "awlsnap.com"), ("steppir.com", "steppir.com"), ("trueaudio.com", "trueaudio.com"), ("innsc.com", "innsc.com"), ("elevator.io", "elevator.io"), ("nyexecstaffing.com", "nyexecstaffing.com"), ("puppet.io", "puppet.io"),
    ("viru.com", "viru.com"), ("wworks.net", "wworks.net"), ("awbrueggemann.com", "awbrueggemann.com"), ("cedarwork.org", "cedarwork.org"), ("http://dreamservicesoftware.com", "dreamservicesoftware.com"),
    ("https://www.google.com/", None), ("google.com", None), ("www.google.com", None), ("facebook.com", None), ("https://www.google.com", None), ("", None), (None, None), ("   ", None), ("abc", None), ("https//https://x.com", None),
]


#: Cases of our own.
OWN = {
    "company": (N.normalize_company_name, [("Müller & Söhne Holdings", "müller söhne"), ("Co. Op Limited Co.", "co. op"), ("\u00a0Acme\u00a0Ltd. ", "acme"), ("Limited", None), ("A/B Corp.", "a/b"), ("x" * 3000 + " Inc", "x" * 3000), ("  -  ", None), ("Incline Labs", "incline labs")]),
    "facebook": (N.normalize_facebook, [("HTTP://Facebook.com/ACME?x=1#y", "acme"), ("facebook.com/a", None), ("m.facebook.com/acme", None), ("https://facebook.com/profile.php?id=3", None), (" www.facebook.com/über ", "über")]),
    "phone": (N.normalize_phone, [("+44 20 7946 0018", "+442079460018"), ("1-800-555-0199", "+18005550199"), ("(107) 555-0199", None), ("+1 555 010 9999 9", None), ("207.555.0199 x12", None), ("\t+49 (30) 1234567", "+49301234567")]),
    "url": (N.normalize_url, [("HTTPS://WWW.Example.ORG:8080/x", "example.org:8080"), ("http://http://a.io", "a.io"), ("b.co?x", "b.co"), ("localhost", None), ("ü.de...", "ü.de"), ("https://www.bing.com/search", None)]),
}


@pytest.mark.parametrize("name", sorted(OWN))
def test_own_cases(spark, name):
    f, cases = OWN[name]
    assert run(spark, f, [v for v, _ in cases]) == [e for _, e in cases]


def run(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


@pytest.mark.parametrize(("f", "cases"), [(N.normalize_company_name, COMPANY), (N.normalize_facebook, FACEBOOK), (N.normalize_phone, PHONE), (N.normalize_url, URL)], ids=["company", "facebook", "phone", "url"])
def test_vectors(spark, f, cases):
    assert run(spark, f, [v for v, _ in cases]) == [e for _, e in cases]


def test_usable_fields_keep_their_order(spark):
    df = spark.createDataFrame([("d.com", None, "fb", "n"), (None, None, None, None)], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(N.usable_fields(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [["website", "facebook", "name"], []]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 ()+-.x", max_size=20), min_size=40, max_size=40))
def test_phones_are_idempotent_and_in_form(spark, values):
    once = [v for v in run(spark, N.normalize_phone, values) if v is not None]
    assert all(v[0] == "+" and v[1:].isdigit() and 8 <= len(v) - 1 <= 15 for v in once)
    assert not once or run(spark, N.normalize_phone, once) == once
