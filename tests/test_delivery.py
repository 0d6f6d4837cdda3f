"""Webhooks, notifications, listings, exports and crawl helpers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import graph, lifecycle, reads
from pagewright.operators.audit import audit
from pagewright.operators.ranking import first_of
from pagewright.plans import post_crawl
from pagewright.sources import frontier, robots, sinks
from pagewright.streaming import events
from tests.test_audit import page as audit_page
from tests.test_audit import table



def page(page_id, url, **fields):
    return audit_page([], page_id, url, **fields)


HOOK = "project_id string, webhook_url string, webhook_events array<string>, webhook_secret string, webhook_retries int"
EVENT = "event_id long, project_id string, event string, ts timestamp, payload string"


def happened(spark, n=4):
    rows = [(i, "p" if i < 3 else "q", "crawl.completed" if i % 2 else "crawl.failed", None, '{"n":%d}' % i) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))


def hooks(spark):
    return spark.createDataFrame([("p", "https://p.test", None, "s", 0), ("q", "https://q.test", ["crawl.completed"], None, 2), ("r", "", None, None, 1)], HOOK)


def flaky(url, body, headers):
    """Accepts the second try of odd events; the endpoint of project q raises."""
    data = json.loads(body)
    if "q.test" in url:
        raise OSError("no route")
    seen = flaky.__dict__.setdefault("seen", {})
    seen[data["data"]["n"]] = seen.get(data["data"]["n"], 0) + 1
    assert headers["X-Event-Id"] == str(data["data"]["n"]) and len(headers["X-Signature"]) == 64
    return (204, "ok") if data["data"]["n"] == 1 and seen[1] == 2 else (500, "busy" * 1000)


def test_webhooks_are_posted_until_one_attempt_succeeds(spark):
    made = events.requests(happened(spark), hooks(spark))
    rows = {r["event_id"]: r for r in made.collect()}
    assert set(rows) == {1, 2, 3}  # event 4 is not in the list of project q
    assert json.loads(rows[1]["body"]) == {"event": "crawl.completed", "timestamp": "2024-01-02T03:04:05.000Z", "projectId": "p", "data": {"n": 1}}
    assert [rows[i]["max_attempts"] for i in (1, 2, 3)] == [3, 3, 2]
    tried = events.post_all(made.coalesce(1), flaky, lambda seconds: None).persist()
    got = {r["event_id"]: r for r in events.deliveries(made, tried).collect()}
    assert {i: (r["attempt"], r["success"], r["waited"]) for i, r in got.items()} == {1: (2, True, 1.0), 2: (3, False, 5.0), 3: (2, False, 1.0)}
    assert got[2]["error_message"].startswith("HTTP 500: busy") and len(got[2]["error_message"]) == 510 and "no route" in got[3]["error_message"]
    assert got[1]["error_message"] is None and got[1]["status_code"] == 204


def test_a_batch_that_runs_again_replaces_its_deliveries(spark, tmp_path):
    happened(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    accept = lambda url, body, headers: (200, "ok")
    for _ in range(2):  # the second query has its own log and handles batch 0 once more
        events.post_events(stream, hooks(spark), accept, lambda s: None, str(tmp_path / "out"), str(tmp_path / f"log{_}")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_waits_follow_the_attempt_they_come_after(spark):
    got = spark.range(0, 6).select("id", *[events.backoff(k, F.col("id")).alias(k) for k in events.ATTEMPTS], events.backoff("webhook", F.col("id"), F.lit(5)).alias("own")).collect()
    assert [r["webhook"] for r in got] == [None, 1.0, 4.0, None, None, None] and [r["job"] for r in got] == [None, 5.0, 10.0, None, None, None]
    assert [r["database"] for r in got] == [None, 1.0, 2.0, 3.0, 4.0, None] and [r["own"] for r in got] == [None, 1.0, 4.0, 16.0, 64.0, None]


def test_post_crawl_isolates_what_fails_in_a_task(spark):
    pages = table(spark, [page("1", "https://a.test/"), page("2", "https://a.test/x")])
    broken = pages.withColumn("word_count", F.raise_error(F.lit("torn file")).cast("int"))
    issues = spark.createDataFrame([], "issue_id string, project_id string, rule_id string, category string, severity string, affected_url string, page_id string, evidence string, title string, description string, is_whitelisted boolean, whitelist_reason string, status string, first_detected_at timestamp, last_detected_at timestamp, resolved_at timestamp")
    now = F.lit("2024-01-01").cast("timestamp")
    out = post_crawl.run(broken, issues, now)
    assert "torn file" in out.failures["issues"] and "score" not in out.tables and {"keywords", "edges"} <= set(out.tables)
    hook = spark.createDataFrame([("site", "https://h.test", None, None, 1)], HOOK)
    done = post_crawl.run(pages, issues, now, hooks=hook, post=lambda url, body, headers: (200, body))
    assert not done.failures and done.tables["webhooks"].first()["success"]
    assert done.tables["issues"].where("description is null or description = title").count() == 0


def test_audit_reads_the_pages_at_most_three_times(spark):
    pages = table(spark, [page("1", "https://a.test/"), page("2", "https://a.test/x")])
    for categories, most in ((None, 1), (("IMAGES",), 1), (("PERFORMANCE",), 1)):
        plan = audit(pages, categories)._jdf.queryExecution().optimizedPlan().toString()
        # the two narrow tables are made beforehand; the plan itself has one reading of the wide rows
        assert sum("images#" in line and ("LogicalRDD" in line or "LocalRelation" in line) for line in plan.splitlines()) <= most
    plan = audit(pages, ("IMAGES",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert audit(pages, ("PERFORMANCE",))._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the site's means


def test_lists_of_a_key_are_cut_but_counted(spark):
    rows = spark.range(500).select(F.lit("hub").alias("source"), F.format_string("t%03d", "id").alias("target")).union(spark.createDataFrame([("a", "b")], "source string, target string"))
    got = {r["page_id"]: r for r in graph.adjacency(rows).collect()}
    assert got["hub"]["incident"] == 500 and got["hub"]["neighbours"] == [f"t{i:03}" for i in range(50)] and got["b"]["neighbours"] == ["a"]
    assert graph.adjacency_rows(rows).count() == 1002
    assert first_of(rows.limit(0), "source", "target", 3, "x").count() == 0
    issues = rows.select(F.lit("R").alias("rule_id"), F.lit("T").alias("title"), F.col("target").alias("affected_url"), F.lit("LOW").alias("severity"), F.col("target").alias("issue_id"))
    (group,) = lifecycle.grouped_for_report(issues).collect()
    assert group["instances"] == 501 and group["urls"][0] == "b" and len(group["urls"]) == 50


def test_whitelist_toggle_and_list(spark):
    issues = spark.createDataFrame([("1", "ACTIVE", False, None), ("2", "WHITELISTED", True, "old")], "issue_id string, status string, is_whitelisted boolean, whitelist_reason string")
    on = {r["issue_id"]: tuple(r)[1:] for r in lifecycle.toggle_whitelist(issues, "1", True, "known").collect()}
    assert on == {"1": ("WHITELISTED", True, "known"), "2": ("WHITELISTED", True, "old")}
    off = {r["issue_id"]: tuple(r)[1:] for r in lifecycle.toggle_whitelist(issues, "2", False, "ignored").collect()}
    assert off["2"] == ("ACTIVE", False, None)
    entries = spark.createDataFrame([("p", 1), ("q", 2), ("p", 3)], "project_id string, created_at int")
    assert [r["created_at"] for r in lifecycle.whitelist_entries(entries, "p").collect()] == [3, 1]


def test_reads(spark):
    window = spark.createDataFrame([('{"new":["a","b","c"]}',), (None,)], "diff string")
    assert [(r["pos"], r["url"]) for r in reads.window_urls(window, "new", 1, 1).collect()] == [(1, "b")]
    one = spark.range(1)
    (r,) = one.select(reads.evidence_summary(F.lit('{"a":1,"b":"x","c":[1,2],"d":null,"e":true,"f":6}')).alias("s")).collect()
    assert r["s"]["keys"] == list("abcdef") and len(r["s"]["values"]) == 5 and r["s"]["values"][:2] == ["1", "x"]
    assert one.select(reads.fits(F.array(F.lit("abc")), 7).alias("a"), reads.fits(F.array(F.lit("abc")), 6).alias("b")).first() == (True, False)
    agents = spark.createDataFrame([("a",), ("b",)], "agent_id string")
    runs = spark.createDataFrame([(1, "a", 10, "SUCCESS"), (2, "a", 20, "FAILED")], "run_id long, agent_id string, created_at int, status string")
    found = spark.createDataFrame([(1, i, "LOW", f"t{i}", i) for i in range(60)], "run_id long, finding_id long, severity string, title string, created_at int")
    got = {r["agent_id"]: r["runs"] for r in reads.agent_with_runs(agents, runs, found).collect()}
    assert got["b"] is None and [r["run_id"] for r in got["a"]] == [2, 1] and got["a"][1]["n_findings"] == 60 and [f["finding_id"] for f in got["a"][1]["findings"]] == list(range(50))


def test_last_rows_win_in_a_stated_order(spark):
    fresh = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "x", 1), (2, "y", 1)], "k int, v string, n int")
    last = lambda order=None: {r["k"]: r["v"] for r in sinks.last_of(fresh.repartition(3), ["k"], order).collect()}
    assert last([F.desc("n")]) == {1: "a", 2: "y"} and last() == {1: "b", 2: "y"}
    assert sinks.insert_new(fresh.limit(0), fresh, ["k"]).count() == 2
    status = spark.createDataFrame([("u", 200, False, None, None), ("u", 404, True, None, "gone")], "href string, status_code int, is_broken boolean, redirect_chain array<string>, error string")
    link = {"href": "u", "text": "t", "rel": None, "nofollow": False, "status_code": None, "is_broken": None, "redirect_chain": None, "error": None}
    pages = table(spark, [page("1", "https://a.test/", external_links=[link])])
    assert {frontier.with_link_status(pages, status.repartition(n)).first()["external_links"][0]["status_code"] for n in (1, 2, 3)} == {404}


def test_exports(spark, tmp_path):
    issues = spark.createDataFrame([("R", "C", "LOW", "ACTIVE", 'say "T"', "https://b.test"), ("R", "C", "LOW", "ACTIVE", "T", "https://a.test"), ("Q", "C", "LOW", "ACTIVE", "T", "https://a.test")], "rule_id string, category string, severity string, status string, title string, affected_url string")
    lines = sinks.group_lines(issues, "R")
    assert [r["line"].split(",")[6] for r in lines.collect()] == ['"https://a.test"', '"https://b.test"'] and '"say ""T"""' in lines.collect()[1]["line"]
    assert sinks.group_lines(issues, "R", "T").count() == 1
    sinks.write_lines(lines.coalesce(1), str(tmp_path / "csv"), sinks.GROUP_COLUMNS)
    text = next((tmp_path / "csv").glob("*.txt")).read_text().splitlines()
    assert text[0] == ",".join(sinks.GROUP_COLUMNS) and text[1] == lines.collect()[0]["line"]
    report = sinks.json_report(issues.withColumn("issue_id", F.lit("i")), issues.agg(F.count(F.lit(1)).alias("n"))).collect()
    assert [r["part"] for r in report].count("row") == 3 and json.loads(next(r["json"] for r in report if r["part"] == "row"))["evidence"] is None


def test_sitemap_references_join_in_their_normal_form(spark):
    cases = {"/sitemap.xml": "https://ex.test/sitemap.xml", "https://WWW.ex.test/a?b=1#c": "https://ex.test/a?b=1", " sub.xml ": "https://ex.test/sub.xml", "": None, "ftp://ex.test/x": None, "http://ex.test:8080/s": "http://ex.test:8080/s"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, expected string").withColumn("got", urls.sitemap_url("raw", F.lit("https://www.ex.test/"))).collect()
    assert all(r["got"] == r["expected"] for r in rows), rows
    nest = [(f"https://ex.test/{i}.xml", f"<sitemapindex><sitemap><loc>https://www.ex.test/{i + 1}.xml</loc></sitemap></sitemapindex>") for i in range(14)]
    docs = spark.createDataFrame([*nest, ("/14.xml", "<urlset><url><loc>https://ex.test/deep</loc></url></urlset>")], "sitemap_url string, body string").withColumn("body", F.col("body").cast("binary"))
    found = robots.sitemap_pages(spark.createDataFrame([("/0.xml",)], "sitemap_url string"), docs, "ex.test").collect()
    assert [r["url"] for r in found] == ["https://ex.test/deep"]


def test_frontier_cut_and_fallback(spark):
    link = lambda href: {"href": href, "text": "t", "rel": None, "nofollow": False}
    pages = table(spark, [page("0", "https://a.test/", internal_links=[link(f"https://a.test/p{i}") for i in range(9)]), *[page(str(i + 1), f"https://a.test/p{i}", internal_links=[link(f"https://a.test/p{i + 9}"), link("/x.pdf"), link("https://b.test/")]) for i in range(9)]])
    seed = spark.createDataFrame([("https://a.test/",)], "url string")
    reach = lambda most: sorted(r["key"] for r in frontier.crawl(seed, pages, "a.test", max_pages=most).collect())
    assert reach(4) == ["https://a.test/", "https://a.test/p0", "https://a.test/p1", "https://a.test/p2"] and len(reach(None)) == 10
    got = frontier.fallback_links(pages, spark.createDataFrame([("0",), ("1",)], "page_id string"), "a.test")
    assert {(r["page_id"], r["key"]) for r in got.collect()} == {(str(i + 1), f"https://a.test/p{i + 9}") for i in range(1, 9)}


@pytest.mark.parametrize(("a", "b", "same"), [("https://a.test/x/", "http://www.a.test/x", True), ("https://a.test/x", "https://a.test/y", False)])
def test_equivalent_sites(spark, a, b, same):
    assert spark.range(1).select(urls.equivalent_sites(F.lit(a), F.lit(b)).alias("s")).first()["s"] is same
