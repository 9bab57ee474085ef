"""Values and texts: tables of cases, one row each."""

import pytest
from pyspark.sql import functions as F

from evidencia.functions import contacts, names, profiles, urls


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_host(spark):
    cases = {"https://WWW.Example.test:443/a": "example.test", "http://user@evil.test/": "evil.test", "https://[broken": "", "mailto:a@b.test": "", "": "", None: None, "https://de.shop.example.test?x": "de.shop.example.test"}
    assert column(spark, urls.host, cases) == list(cases.values())


def test_site_key(spark):
    cases = {"https://a.b.example.org/": "example.org", "https://shop.example.co.uk": "example.co.uk", "https://example.co.uk": "example.co.uk", "https://localhost/": "localhost", "https://x.ab.de": "ab.de"}
    assert column(spark, urls.site_key, cases) == list(cases.values())


def test_two_url_keys(spark):
    assert column(spark, urls.page_key, ["https://a.test/x/#top", None, ""]) == ["https://a.test/x", None, ""]
    assert column(spark, urls.source_key, ["https://a.test/x/#top", "https://a.test/x//"]) == ["https://a.test/x/#top", "https://a.test/x"]


def test_profile_key(spark):
    cases = {
        "https://de.linkedin.com/in/Pat-Sample/details?trk=1": "https://www.linkedin.com/in/pat-sample",
        "https://linkedin.com.evil.test/in/x": "",
        "https://linkedin.com@evil.test/in/x": "",
        "https://www.linkedin.com/pub/dir/Pat": "https://www.linkedin.com/pub/dir/pat",
        "x": "",
        None: None,
    }
    assert column(spark, urls.profile_key, cases) == list(cases.values())


def test_link_priority(spark):
    rows = [("https://a.test/contact", None), ("https://a.test/thank-you", "contact"), ("https://a.test/news", ""), ("https://a.test/x", "About us"), ("https://a.test/x", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, t string")
    assert [r[0] for r in df.orderBy("i").select(urls.link_priority(F.col("u"), F.col("t"))).collect()] == [0, 3, 1, 1, 2]


def test_in_scope(spark):
    rows = [("https://www.a.test", "https://a.test/x", True), ("https://a.test", "https://b.a.test/", False), ("https://g.test/companies/one", "https://g.test/companies/two", False), ("https://g.test/companies/one", "https://g.test/companies/one/team", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, w string, u string, want boolean")
    assert all(r[0] == r[1] for r in df.select(urls.in_scope(F.col("w"), F.col("u")), "want").collect())


def test_names(spark):
    assert column(spark, names.normalised_name, ["Straße GmbH & Co_KG", "Łódź Été", None, ""]) == ["strasse gmbh co kg", "łodz ete", None, ""]
    cases = {
        "Example Minerals (Southern Works) Ltd": ["example minerals southern works ltd", "southern works", "example minerals"],
        "X Co Ltd": ["x co ltd", "x co"],  # "co" alone is no legal form
        "Sté Exemple S.p.A. Limited": ["ste exemple s p a limited", "ste exemple"],
        "": [],
        None: None,
    }
    assert column(spark, names.name_aliases, cases) == list(cases.values())


def test_title_names_engines_and_websites(spark):
    assert column(spark, names.name_from_title, ["pat SAMPLE - Buyer | x", "Example", "Pat Sample 2", None]) == ["Pat Sample", "", "", ""]
    assert column(spark, profiles.engines_of, [" ru ", "DE", None]) == [["google cse", "yandex"], [], []]
    assert column(spark, profiles.listed, ["a, b ,,c", ""]) == [["a", "b", "c"], []]
    assert column(spark, urls.website, [" a.test/x ", "ftp://a.test", "http://", None, "HTTP://b.test"]) == ["https://a.test/x", "", "", "", "HTTP://b.test"]
    with pytest.raises(Exception, match="no web address"):
        column(spark, lambda c: urls.website(c, strict=True), ["ftp://a.test"])
    assert column(spark, urls.mirrored, ["https://www.linkedin.com/company/x?trk=1", "https://linkedin.com/in/x"]) == [["https://www.linkedin.com/company/x?trk=1", "https://tt.linkedin.com/company/x"], []]
    assert column(spark, urls.profile_kind, ["https://de.linkedin.com/in/x", "https://linkedin.com/company/y", "https://a.test/b.PDF?x=1", "https://linkedin.com.evil.test/in/x", None]) == ["person", "company", "pdf", "", ""]


def test_person_names(spark):
    assert column(spark, names.without_honorifics, ['Dr. Prof. Pat "Sample"', "Herr von Sample", "Mrs. X", None]) == ["Pat  Sample", "von Sample", "X", None]
    assert column(spark, names.without_initials, ["J. R. Sample", "J.", "Pat Sample", "J.R.Sample von X"]) == ["Sample", "J.", "Pat Sample", "Sample von X"]


def test_slug(spark):
    got = column(spark, names.slug, ["Example  Minerals, Ltd!", "公司", "a" * 80])
    assert got[0] == "example-minerals-ltd" and got[1].startswith("company-") and len(got[1]) == 18 and got[2] == "a" * 60


def test_emails(spark):
    cases = {
        "Write to Pat@Example.test or pat@example.test": ["pat@example.test"],
        "mailtox@example.test and x@example.test": ["x@example.test"],
        "a[at]example.test, b (at) example.test": ["a@example.test", "b@example.test"],
        "meet at example.test": [],
        "": [],
        None: [],
    }
    assert column(spark, contacts.emails, cases) == list(cases.values())


def test_phones(spark):
    cases = {"Tel. +1 202 555 0123": ["+12025550123"], "Fax: +1 202 555 0198": [], "0049 (0)30 23125 100": ["+493023125100"], "030 23125": [], None: []}
    assert column(spark, contacts.phones, cases) == list(cases.values())
    assert column(spark, contacts.e164, ["+44 20 7946 0000", "020 7946 0000", "+0 12345678", None]) == ["+442079460000", None, None, None]


def test_flattened(spark):
    cases = {"a@b.test": ["a@b.test"], '["x", "y"]': ["x", "y"], '{"value": "z"}': ["z"], '[{"url": "u"}, {"url": "v"}]': ["u", "v"], "": [], "[]": [], None: []}
    assert column(spark, contacts.flattened, cases) == list(cases.values())


@pytest.mark.parametrize("channel,value,want", [("email", " A@B.test ", "a@b.test"), ("phone", "00 44 20", "4420"), ("linkedin", "https://linkedin.com/in/X/", "https://www.linkedin.com/in/x"), ("linkedin", "other", "other"), ("whatsapp", " +1 ", "+1")])
def test_canonical(spark, channel, value, want):
    assert spark.range(1).select(contacts.canonical(F.lit(channel), F.lit(value))).first()[0] == want


def test_profile_words(spark):
    cases = {
        "https://www.linkedin.com/in/pat-van-sample-1a2b": ("Pat van Sample", "1a2b"),
        "https://linkedin.com/in/sales-manager": ("", ""),
        "https://linkedin.com/in/kim_other/": ("Kim Other", ""),
        "https://linkedin.com/in/patsample": ("", ""),
        "https://linkedin.com/company/pat-sample": ("", ""),
        "": ("", ""),
    }
    assert column(spark, profiles.name_from_profile, cases) == [v[0] for v in cases.values()]
    assert column(spark, profiles.stable_id, cases) == [v[1] for v in cases.values()]


def test_regions_and_patterns(spark):
    assert column(spark, profiles.region, [" de ", "South  Korea", "西班牙", "Atlantis", None]) == ["DE", "KR", "ES", None, None]
    for pattern in profiles.PATTERNS:
        made = profiles.rendered(F.lit(pattern), F.lit("pat"), F.lit("sample"))
        assert spark.range(1).select(profiles.pattern_of(made, F.lit("pat"), F.lit("sample"))).first()[0] == pattern
