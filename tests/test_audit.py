"""The twelve-page site of the fixtures, boundaries of single rules, and the lifecycle of issues."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import graph, lifecycle
from pagewright.operators.audit import audit
from pagewright.operators.rules import CATEGORY_OF, catalogue
from pagewright.operators.shared import derived, link_rows

HOST = "https://ex.test"


def page(spark_rows, page_id, url, links=(), **fields):
    row = {
        "page_id": page_id, "project_id": "site", "url": url, "status_code": 200, "response_time": 100.0, "title": "A title of fair size", "meta_description": "Words about it.",
        "h1": ["one"], "og_tags": {}, "json_ld": [], "images": [], "word_count": 400, "hreflang_tags": [], "page_size": 10_000, "external_links": [],
        "internal_links": [{"href": HOST + h if h.startswith("/") else h, "text": t, "rel": None, "nofollow": False} for h, t in links],
    } | fields
    spark_rows.append(row)
    return row


def table(spark, rows):
    schema = spark.createDataFrame([], schemas.PAGE).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture(scope="module")
def site(spark):
    rows = []
    to = lambda *paths: [(p, f"text {i}") for i, p in enumerate(paths)]
    page(rows, "P01", f"{HOST}/", to("/docs", "/docs/a", "/pricing"), canonical_url=f"{HOST}/", title="Example home page")
    page(rows, "P02", "https://www.ex.test/docs/", to("/docs/a", "/docs/a", "/"), canonical_url=f"{HOST}/docs", title="Docs overview")
    page(rows, "P03", f"{HOST}/docs/a", to("/gone", "/r1", "/docs/a", "/docs/a", "/docs/a"), title="Docs overview")
    page(rows, "P04", f"{HOST}/pricing", to("/"), canonical_url=f"{HOST}/", title="Plans and pricing", meta_robots="NoIndex, follow")
    page(rows, "P05", f"{HOST}/gone", status_code=404, title="Gone for good")
    page(rows, "P06", f"{HOST}/r1", status_code=301, canonical_url=f"{HOST}/r2", title="Moved one away")
    page(rows, "P07", f"{HOST}/r2", status_code=302, canonical_url=f"{HOST}/r3", title="Moved two away")
    page(rows, "P08", f"{HOST}/r3", status_code=301, canonical_url=f"{HOST}/", title="Moved three away")
    page(rows, "P09", f"{HOST}/loop1", status_code=301, canonical_url=f"{HOST}/loop2", title="Loop number one")
    page(rows, "P10", f"{HOST}/loop2", status_code=301, canonical_url=f"{HOST}/loop1", title="Loop number two")
    page(rows, "P11", "http://ex.test/insecure?token=x&a=1&b=2&c=3", title="Insecure example")
    page(rows, "P12", f"{HOST}/fr", canonical_url=f"{HOST}/fr", title="Page en français", hreflang_tags=[{"lang": "fr", "href": f"{HOST}/fr"}, {"lang": "en", "href": f"{HOST}/"}])
    return table(spark, rows).persist()


@pytest.fixture(scope="module")
def broken(site):
    found = {}
    for r in audit(site).collect():
        found.setdefault(r["rule_id"], set()).add(int(r["page_id"][1:]))
    return found


@pytest.mark.parametrize(
    ("rule", "pages"),
    {
        "IDX-001": {4}, "IDX-002": {4}, "IDX-003": {7, 8, 9, 10, 11, 12}, "IDX-005": {3}, "OPG-002": {2, 3}, "CRW-001": {9, 10}, "CRW-002": {5}, "CRW-009": {5}, "CRW-004": {6},
        "CRW-006": {11}, "SEC-001": {11}, "SEC-008": {11}, "CRW-010": {6, 7, 8, 9, 10}, "LNK-006": {3}, "LNK-007": {3}, "LNK-008": {3}, "I18N-001": set(), "I18N-002": {12},
        "I18N-003": {12}, "I18N-008": set(), "CAN-003": {6, 7, 9, 10}, "CAN-007": {4},
    }.items(),
)
def test_site_rules(broken, rule, pages):
    assert broken.get(rule, set()) == pages


def test_site_graph(spark, site):
    counts = {r["page_id"]: r["n"] for r in link_rows(derived(site)).join(derived(site).select(F.col("norm_url").alias("target"), F.col("page_id").alias("to")), "target").groupBy(F.col("to").alias("page_id")).agg(F.count("*").alias("n")).collect()}
    assert counts == {"P01": 2, "P02": 1, "P03": 6, "P04": 1, "P05": 1, "P06": 1}
    edge = graph.edges(site)
    assert {(r["source"], r["target"]) for r in edge.collect()} == {("P01", "P02"), ("P01", "P03"), ("P01", "P04"), ("P02", "P03"), ("P02", "P01"), ("P03", "P05"), ("P03", "P06"), ("P04", "P01")}
    assert {r["page_id"]: r["inbound_links"] for r in graph.inbound_links(edge).collect()} == {"P01": 2, "P02": 1, "P03": 2, "P04": 1, "P05": 1, "P06": 1}


def test_rule_boundaries(spark):
    image = lambda alt="a", width=10, height=10: {"src": "https://ex.test/i", "alt": alt, "width": width, "height": height}
    link = lambda scheme="https": {"href": f"{scheme}://o.test/", "text": "t", "rel": None, "nofollow": False, "status_code": None, "is_broken": None, "redirect_chain": None, "error": None}
    many = lambda n: [{"href": f"{HOST}/t{i}", "text": "t", "rel": None, "nofollow": False} for i in range(n)]
    cases = [
        ("OPG-003", {"title": "t" * 61}, {"title": "t" * 60}), ("MOB-002", {"title": "t" * 51}, {"title": "t" * 50}), ("OPG-009", {"title": "t" * 9}, {"title": "t" * 10}),
        ("OPG-007", {"meta_description": "d" * 161}, {"meta_description": "d" * 160}), ("OPG-008", {"word_count": 299}, {"word_count": 300}), ("IDX-008", {"word_count": 49}, {"word_count": 50}),
        ("CRW-008", {"response_time": 3001.0}, {"response_time": 3000.0}), ("PRF-003", {"response_time": 1001.0}, {"response_time": 1000.0}), ("PRF-003", {"response_time": 3000.0}, {"response_time": 3001.0}),
        ("PRF-002", {"page_size": 3145729}, {"page_size": 3145728}), ("MOB-003", {"page_size": 512001}, {"page_size": 512000}), ("CRW-006", {"url": f"{HOST}/q?a&b&c&d"}, {"url": f"{HOST}/q?a&b&c"}),
        ("IDX-007", {"url": f"{HOST}/1/2/3/4/5/6"}, {"url": f"{HOST}/1/2/3/4/5"}), ("MOB-006", {"url": f"{HOST}/1/2/3/4/5"}, {"url": f"{HOST}/1/2/3/4"}),
        ("IMG-007", {"images": [image()] * 31}, {"images": [image()] * 30}), ("PRF-005", {"images": [image()] * 51}, {"images": [image()] * 50}), ("IMG-002", {"images": [image("a" * 126)]}, {"images": [image("a" * 125)]}),
        ("LNK-002", {"internal_links": many(2)}, {"internal_links": many(3)}), ("PRF-006", {"internal_links": many(201)}, {"internal_links": many(200)}),
        ("LNK-003", {"external_links": [link()] * 101}, {"external_links": [link()] * 100}), ("SEC-006", {"external_links": [link()] * 11}, {"external_links": [link()] * 10}),
        ("SEC-004", {"external_links": [link("http")] * 6}, {"external_links": [link("http")] * 5}), ("MOB-005", {"internal_links": many(201)}, {"internal_links": many(200)}),
        ("IMG-008", {"images": [image("")] * 3}, {"images": [image("")] * 2}), ("MOB-008", {"images": [image(width=None)] * 6}, {"images": [image(width=None)] * 5}),
        ("SOC-002", {"og_tags": {"og:title": " "}}, {"og_tags": {"og:title": "x"}}), ("IMG-005", {"images": [image("DSC_12")]}, {"images": [image("dsc 12")]}),
    ]
    rows = []
    for i, (_, fires, not_) in enumerate(cases):
        page(rows, f"{i}y", **({"url": f"{HOST}/y{i}"} | fires))
        page(rows, f"{i}n", **({"url": f"{HOST}/n{i}"} | not_))
    # urls that two cases share would be one finding: make them different
    seen = {}
    for r in rows:
        seen[r["url"]] = seen.get(r["url"], 0) + 1
        r["url"] += "" if seen[r["url"]] == 1 else f"{'&' if '?' in r['url'] else ''}" + ("x" * seen[r["url"]] if "?" not in r["url"] else "")
    found = {(r["rule_id"], r["page_id"]) for r in audit(table(spark, rows)).collect()}
    wrong = [(rule, i) for i, (rule, *_) in enumerate(cases) if (rule, f"{i}y") not in found or (rule, f"{i}n") in found]
    assert not wrong


def test_catalogue_is_complete(spark):
    rules = catalogue()
    assert len(rules) == len({r.id for r in rules}) == 106
    assert {r.category for r in rules} == set(CATEGORY_OF.values())


def issue_rows(spark, rows):
    base = spark.createDataFrame(rows, "issue_id string, rule_id string, affected_url string, status string, last string")
    out = base.selectExpr("*", "cast(last as timestamp) last_detected_at", "status = 'WHITELISTED' is_whitelisted")
    for f in spark.createDataFrame([], schemas.ISSUE).schema:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.select(*spark.createDataFrame([], schemas.ISSUE).columns)


def test_lifecycle(spark):
    old = issue_rows(spark, [("1", "R1", "u1", "ACTIVE", "2024-01-01"), ("2", "R1", "u2", "WHITELISTED", "2024-01-01"), ("3", "R2", "u1", "ACTIVE", "2024-01-01"), ("4", "R2", "u1", "ACTIVE", "2024-01-02"), ("5", "R3", "u3", "ACTIVE", "2024-01-01"), ("6", "R1", "u9", "RESOLVED", "2024-01-01")])
    new = spark.createDataFrame([("R1", "u1"), ("R1", "u2"), ("R2", "u1"), ("R1", "u9"), ("R4", "u4")], "rule_id string, affected_url string")
    now = F.lit("2024-02-01").cast("timestamp")
    synced = lifecycle.sync_issues(new, old, now).persist()
    by = {}
    for r in synced.collect():
        by.setdefault(r["action"], []).append((r["rule_id"], r["affected_url"], r["status"], r["issue_id"]))
    assert sorted(x[:3] for x in by["create"]) == [("R1", "u9", "ACTIVE"), ("R4", "u4", "ACTIVE")]
    assert sorted(x[:4] for x in by["refresh"]) == [("R1", "u1", "ACTIVE", "1"), ("R1", "u2", "WHITELISTED", "2"), ("R2", "u1", "ACTIVE", "4")]
    assert sorted(x[3] for x in by["resolve"]) == ["3", "5"] and [x[3] for x in by["keep"]] == ["6"]
    again = lifecycle.sync_issues(new, synced.drop("action"), now)
    assert {r["action"] for r in again.collect()} == {"refresh", "keep"}
    scoped = lifecycle.sync_issues(new.limit(0), old, now, evaluated=["R1"])
    assert {(r["rule_id"], r["action"]) for r in scoped.where("status <> 'RESOLVED'").collect()} == {("R2", "keep"), ("R3", "keep")}
    assert lifecycle.totals(synced).first().asDict() == {"active_issues": 4, "new_issues": 2}
    entries = spark.createDataFrame([("SINGLE", "5", None, "known"), ("RULE", None, "R1", "fine")], "scope string, issue_id string, rule_id string, reason string")
    listed = {r["issue_id"]: (r["status"], r["whitelist_reason"]) for r in lifecycle.whitelist(old, entries).collect()}
    assert listed["5"] == ("WHITELISTED", "known") and listed["1"] == ("WHITELISTED", "fine") and listed["6"] == ("RESOLVED", None)


def test_health(spark):
    def score(pages, *rules):
        rows = [(f"{r}{i}", r, severity, f"u{i}", "WHITELISTED" if listed else "ACTIVE", listed) for r, severity, n, listed in rules for i in range(n)]
        issues = spark.createDataFrame(rows, "issue_id string, rule_id string, severity string, affected_url string, status string, is_whitelisted boolean")
        return lifecycle.health_score(issues, spark.range(pages)).first()["score"]

    assert score(10, ("A", "HIGH", 3, False), ("B", "CRITICAL", 1, False), ("C", "LOW", 10, False), ("D", "MEDIUM", 5, True)) == 94.9
    assert score(10_000, ("A", "INFO", 1, False)) == 99.9
    assert score(0, ("A", "HIGH", 1, False)) == 100.0 and score(5) == 100.0


def test_scores_and_counts_make_no_evidence(spark):
    rows = []
    page(rows, "1", f"{HOST}/a", [("/b", "t")], title="Same")
    page(rows, "2", f"{HOST}/b", title="Same", word_count=10)
    pages = table(spark, rows)
    bare, full = audit(pages, evidence=False), audit(pages)
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, full.drop("evidence").collect()))
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "structstojson" not in plan.lower()
    assert plan.count("Join ") <= 14 < full._jdf.queryExecution().optimizedPlan().toString().count("Join ")
