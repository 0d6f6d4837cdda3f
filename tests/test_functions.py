from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.functions import cron, jsonld, text, urls


def column(spark, make, *rows, schema="a string, b string"):
    rows = [r if isinstance(r, tuple) else (r, None) for r in rows]
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(make).collect()]


def test_comparable(spark):
    cases = {
        "https://WWW.Ex.com:443/a/#t": "https://ex.com/a", "http://ex.com:80": "http://ex.com/", "https://ex.com/a//": "https://ex.com/a/",
        "https://ex.com/a/?q=1#f": "https://ex.com/a?q=1", "https://ex.com./a": "https://ex.com/a", "HTTPS://EX.com/A": "https://ex.com/A",
        "https://ex.com:8080/x/": "https://ex.com:8080/x", "not a url": None, "": None,
    }
    assert column(spark, urls.comparable("a"), *cases) == list(cases.values())


def test_references(spark):
    base = "https://ex.com/x/y"
    cases = {"/rel": "https://ex.com/rel", "b": "https://ex.com/x/b", "?q": "https://ex.com/x/y?q", "#f": "https://ex.com/x/y", "//z.io/p/": "https://z.io/p", "mailto:a@b": None, "https://q.io": "https://q.io/"}
    assert column(spark, urls.comparable_ref("a", "b"), *[(c, base) for c in cases]) == list(cases.values())
    assert urls.resolve_text("../für", "https://ex.com/x/y") == "https://ex.com/f%C3%BCr"
    assert urls.resolve_text("javascript:x", base) is None and urls.resolve_text(None, base) is None
    assert column(spark, urls.resolved_any("a", "b"), ("../z", base), (None, base)) == ["https://ex.com/z", None]


def test_same_site(spark):
    pairs = {("blog.ex.com", "ex.com"): True, ("www.ex.com", "ex.com"): True, ("ex.com", "notex.com"): False, ("", "ex.com"): False, (None, "ex.com"): False}
    assert column(spark, urls.same_site("a", "b"), *pairs) == list(pairs.values())


def test_sites_and_pages(spark):
    assert column(spark, urls.site_url("a"), "http://www.Ex.com/", "ex.com//", "https://ex.com/a/#x") == ["https://ex.com", "https://ex.com", "https://ex.com/a"]
    assert column(spark, urls.is_page("a"), "https://e.io/a.PDF", "https://e.io/a.html", "https://e.io/v1.2/", "x", None) == [False, True, True, False, False]
    assert column(spark, F.concat_ws("|", urls.query_names("a")), "https://e.io/?a=1&b&a=2", "https://e.io/") == ["a|b|a", ""]
    assert column(spark, F.concat_ws(" ", urls.token_words("a")), "https://e.io/Blue-shoes/r%C3%A9d_x", "https://e.io/a/%zz") == ["blue shoes r d x", ""]
    assert column(spark, urls.equivalent("a", "b", F.lit("https://e.io/")), ("/a/", "https://www.e.io/a"), ("/a", "/b")) == [True, False]
    assert column(spark, urls.group("a"), "https://e.io/", "https://e.io/s/t") == ["root", "s"]


def test_text(spark):
    assert column(spark, text.trimmed("a"), "  x\t\n", "　") == ["x", ""]
    assert column(spark, text.blank("a"), None, "", "  ", "x") == [True, True, True, False]
    assert column(spark, text.utf16_length("a"), "a😀b") == [4]
    assert column(spark, text.rounded(F.col("a").cast("double"), 0), "-2.5", "2.5") == [-2.0, 3.0]
    assert column(spark, text.normal_category("a"), "structured-data", "On Page", "weird") == ["STRUCTURED_DATA", "ON_PAGE", "ON_PAGE"]
    assert column(spark, text.normal_severity("a"), " high", "odd") == ["HIGH", "MEDIUM"]
    assert column(spark, text.contains_ci("a", "A%"), "xa%b", "xab") == [True, False]


@pytest.mark.parametrize(
    ("blocks", "broken"),
    [
        ([{"@context": "https://schema.org", "@type": "Organization", "name": "x"}], []),
        ([{"@context": "https://schema.org", "@type": ["Organization"]}], []),  # a list of types is no type by name
        ([None], ["SD-002", "SD-003", "SD-008"]),
        ([[]], ["SD-002", "SD-003", "SD-008", "SD-009"]),
        ([5], ["SD-002", "SD-003"]),
        ([{"@context": 0, "@type": None}], ["SD-003", "SD-009"]),
        ([{"@context": "https://schema.org", "@type": "Product", "offers": []}], ["SD-012"]),
        ([{"@context": "https://schema.org", "@type": "BreadcrumbList", "itemListElement": [{"@type": "ListItem", "position": True, "name": "a", "item": "/"}]}], ["SD-011"]),
        ([{"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q"}]}], ["SD-010"]),
    ],
)
def test_structured_data(blocks, broken):
    assert jsonld.block_rules(blocks) == broken


def test_cron():
    at = datetime(2024, 3, 1, 12, 30)
    assert cron.slot("0 12 * * *", at, forward=False) == datetime(2024, 3, 1, 12, 0)
    assert cron.slot("30 12 * * *", at, forward=False) == datetime(2024, 2, 29, 12, 30)
    assert cron.slot("*/20 8-10 * * mon", at, forward=True) == datetime(2024, 3, 4, 8, 0)
    assert cron.slot("0 0 29 2 *", at, forward=True) == datetime(2028, 2, 29)
    assert cron.slot("0 0 13 * fri", at, forward=True) == datetime(2024, 3, 8)  # either day field is enough
    assert cron.slot("0 0 * * 7", at, forward=True) == datetime(2024, 3, 3)
    for bad in ("manual", "", None, "61 * * * *", "* * *", "a * * * *", "0 0 31 2 *"):
        assert cron.slot(bad, at, forward=True) is None
