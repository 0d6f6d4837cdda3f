from __future__ import annotations

import gzip
import hmac
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import diff, keywords, metrics, reads, semantic
from pagewright.operators.components import connected_components
from pagewright.operators.ranking import range_index, salted_index
from pagewright.sources import html, robots, sinks
from pagewright.streaming import events
from tests.test_audit import page, table


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_indexes(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7 + 1))
    rows = salted_index(df, "g", [F.col("id")], "n").collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    ranked = {r["id"]: r["n"] for r in range_index(df, [F.desc("id")], "n").collect()}
    assert all(ranked[i] == 999 - i for i in range(1000))


def test_robots(spark):
    lines = ["User-agent: *", "Disallow: /a", "Allow: /a/b", "Disallow: /*.pdf$", "Crawl-delay: 3", "Sitemap: s1", "Sitemap: s1"]
    rules = robots.parse_robots(spark.createDataFrame([("ex.test", i, line) for i, line in enumerate(lines)], "site string, line_no int, line string"))
    paths = ["/a/b/c", "/a/x", "/x.pdf", "/x.pdf?q=1", "/"]
    pages = spark.createDataFrame([(p, f"https://www.ex.test{p}") for p in paths] + [("other", "https://free.test/a")], "p string, url string")
    got = {r["p"]: r["allowed"] for r in robots.allowed(pages, rules).collect()}
    assert got == {"/a/b/c": True, "/a/x": False, "/x.pdf": False, "/x.pdf?q=1": True, "/": True, "other": True}
    assert robots.crawl_delay(rules).first()["delay"] == 3.0 and robots.robots_sitemaps(rules).first()["sitemaps"] == ["s1"]


def test_sitemaps(spark):
    index = b"<sitemapindex><sitemap><loc> https://ex.test/b.xml </loc></sitemap><sitemap><loc>https://ex.test/a.xml</loc></sitemap></sitemapindex>"
    urls = "".join(f"<url><loc>{u}</loc></url>" for u in ("https://ex.test/x?a=1&amp;b=2", "https://else.where/", "https://ex.test/f.pdf"))
    docs = spark.createDataFrame([("https://ex.test/a.xml", index), ("https://ex.test/b.xml", gzip.compress(f"<urlset>{urls}</urlset>".encode())), ("https://ex.test/c.xml", b"<urlset><url><loc>https://ex.test/unseen</loc></url></urlset>")], "sitemap_url string, body binary")
    start = spark.createDataFrame([("https://ex.test/a.xml",)], "sitemap_url string")
    assert [r["url"] for r in robots.sitemap_pages(start, docs, "ex.test").collect()] == ["https://ex.test/x?a=1&b=2"]


def test_html():
    source = """<html><head><title> A &amp; B </title><title>no</title><meta name="description" content=" d "><meta name="robots" content="">
    <link rel="canonical" href="/c"><link rel="alternate" hreflang="de" href="/de"><meta property="og:title" content="x"><meta property="og:title" content="y"><meta property="og:image" content="">
    <script type="application/ld+json">{"@type": "X"}</script><script type="application/ld+json">{bad</script><style>p{}</style></head>
    <body><h1>One <b>two</b></h1><h1> </h1><p>Hello, world-wide <a href="/p#f" rel="NoFollow x">Link <i>text</i></a><a href="/p">Link text</a><a href="mailto:x">m</a><a href="https://other.io">o</a>
    <img src="i.png" alt="z" width="12px" height="0"><p>un<br>closed"""
    row = html.page_row("https://www.ex.test/dir/", source)
    assert (row["title"], row["meta_description"], row["meta_robots"], row["canonical_url"]) == ("A & B", "d", None, "/c")
    assert row["h1"] == ["One two"] and row["og_tags"] == [("og:title", "y")] and row["json_ld"] == ['{"@type": "X"}']
    assert [(x["href"], x["text"], x["nofollow"]) for x in row["internal_links"]] == [("https://www.ex.test/p", "Link text", True)]
    assert [x["href"] for x in row["external_links"]] == ["https://other.io/"]
    assert row["images"] == [{"src": "i.png", "alt": "z", "width": 12, "height": None}] and row["hreflang_tags"] == [{"lang": "de", "href": "/de"}]
    assert html.page_row(None, None)["word_count"] == 0


def test_references_without_a_semicolon_stay_where_asked():
    source = '<title>A &amp;&amp;&amp</title><h1>B &copy; &#38;&#x26; &copy c</h1><script type="application/ld+json">{"a": "&amp &"}</script><body><a href="/x?a=1&b=2">t &lt</a>'
    row, plain = html.page_row("https://ex.test/", source, closed=True), html.page_row("https://ex.test/", source)
    assert (row["title"], row["h1"]) == ("A &&&amp", ["B \u00a9 && &copy c"])
    assert (plain["title"], plain["h1"]) == ("A &&&", ["B \u00a9 && \u00a9 c"])
    assert row["internal_links"][0]["text"] == "t &lt" and row["page_size"] == plain["page_size"]
    assert row["json_ld"] == plain["json_ld"] == ['{"a": "&amp &"}'] and row["internal_links"][0]["href"] == plain["internal_links"][0]["href"]


def test_html_table(spark):
    raw = spark.createDataFrame([(1, "https://a.io/", "<h1>x</h1>"), (2, None, None)], "page_id long, url string, html string")
    assert [(r["page_id"], r["h1"], r["page_size"]) for r in html.extract(raw).orderBy("page_id").collect()] == [(1, ["x"], 10), (2, [], 0)]


def test_diff(spark):
    def snapshot(**pages):
        rows = []
        for name, fields in pages.items():
            page(rows, name, f"https://ex.test/{name}", **fields)
        return table(spark, rows)

    before = snapshot(a={"title": "T1"}, b={}, c={}, e={"h1": ["x, y"]})
    after = snapshot(a={"title": "T2"}, b={"word_count": 1}, d={}, e={"h1": ["x", "y"]})
    got = {r["key"][-1]: (r["change"], r["fields"], r["hash_changed"]) for r in diff.compare(after, before).collect()}
    assert got == {"a": ("changed", ["title"], True), "b": ("changed", [], True), "c": ("removed", [], False), "d": ("new", [], False), "e": ("changed", [], True)}
    assert diff.compare(after, after).count() == 0
    nothing = spark.createDataFrame([], "url string")
    assert diff.coverage(after, nothing).count() == 0
    covered = diff.coverage(after, before)
    rules = {r["rule_id"]: r["evidence"] for r in diff.coverage_issues(covered, "https://ex.test").collect()}
    assert set(rules) == {"CRW-SITEMAP-002", "CRW-SITEMAP-003"} and "ex.test/d" in rules["CRW-SITEMAP-002"]
    assert diff.coverage_issues(covered, "s", has_sitemap=False).first()["rule_id"] == "CRW-SITEMAP-001"
    row = diff.diagnostics(diff.compare(after, before), covered, most=1).first()
    assert row["changed"] == 3 and len(row["changed_urls"]) == 1 and row["new_urls"] == ["https://ex.test/d"]


def test_keywords(spark):
    rows = []
    page(rows, "1", "https://ex.test/blue-shoes", title="Blue running shoes", h1=None, meta_description=None)
    found = {r["keyword"]: (r["score"], r["frequency"], r["sources"]) for r in keywords.page_keywords(table(spark, rows)).collect()}
    assert found["blue"] == found["shoes"] == (13.0, 2, ["title", "url"]) and found["blue shoes"] == (3.0, 1, ["url"])
    assert {k: v[0] for k, v in found.items() if v[0] == 10} == dict.fromkeys(["running", "blue running", "running shoes", "blue running shoes"], 10.0)
    total = spark.createDataFrame([(4,)], "n int")
    rows = spark.createDataFrame([("1", "blue", 13.0, 0), ("2", "blue", 1.0, 0)] + [(str(i), "all", 5.0, 1) for i in range(4)], "page_id string, keyword string, score double, first int")
    scored = {(r["page_id"], r["keyword"]): r["score"] for r in keywords.tf_idf(rows, total).collect()}
    assert scored["1", "blue"] == 9.01 and scored["1", "all"] == 0.0


def topic(spark, near, members):
    node = spark.createDataFrame([(i,) for i in range(12)], "ix long")
    lists = spark.createDataFrame(near, "ix long, nb long, sim double, place int")
    return {r["ix"]: r["segment"] for r in semantic.attached(node, lists, spark.createDataFrame(members, "node long, component long")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_leftovers_join_in_order(spark, seed):
    rng = random.Random(seed)
    n, members = 40, {i: i // 4 * 4 for i in range(8)}
    lists = {i: rng.sample([j for j in range(n) if j != i], 3) for i in range(8, n)}
    near = [(i, j, 0.25, p) for i, js in lists.items() for p, j in enumerate(js, 1)]
    expected = dict(members)
    for i in range(8, n):
        hit = next((j for j in lists[i] if j in expected), None)
        if hit is not None:
            expected[i] = expected[hit]
    assert topic(spark, near, list(members.items())) == expected


def test_cosine(spark):
    v = spark.createDataFrame([(1, "x", 1.0, 1, 2**0.5), (1, "y", 1.0, 2, 2**0.5), (2, "x", 1.0, 1, 1.0), (3, "z", 1.0, 1, 1.0)], "ix long, term string, weight double, place int, norm double")
    got = {(r["a"], r["b"]): r["sim"] for r in semantic.similarities(v).collect()}
    assert set(got) == {(1, 2), (2, 1)} and got[1, 2] == pytest.approx(np.sqrt(0.5))


def test_metrics(spark):
    crawls = spark.createDataFrame([("COMPLETED", "2024-01-05", '{"postProcessing":{"healthScore":90}}'), ("COMPLETED", "2024-01-05", '{"postProcessing":{"healthScore":91}}'), ("COMPLETED", "2024-01-06", '{"postProcessing":{}}'), ("FAILED", "2024-01-06", None), ("COMPLETED", "2024-01-06", "oops")], "status string, day string, diff string").withColumn("completed_at", F.col("day").cast("timestamp"))
    trend = {str(r["day"]): r["score"] for r in metrics.health_trend(crawls, F.lit("2024-01-07").cast("date")).collect()}
    assert len(trend) == 7 and trend["2024-01-05"] == 90.5 and trend["2024-01-06"] is None
    none = spark.createDataFrame([], "status string, last_detected_at timestamp, severity string")
    assert metrics.issues_by_day(none, F.lit("2024-01-07").cast("date")).count() == 0
    evidence = spark.createDataFrame([('{"a": {"b": ["https://x.io", 1]}, "c": "http://y.io"}', "https://ex.test/"), ("bad", None)], "e string, u string")
    rows = evidence.select(metrics.evidence_lines("e").alias("lines"), metrics.evidence_urls("e", "u").alias("urls")).collect()
    assert rows[0]["lines"] == ["a.b[0]: https://x.io", "a.b[1]: 1", "c: http://y.io"] and rows[0]["urls"] == ["https://ex.test/", "https://x.io", "http://y.io"]
    assert rows[1]["lines"] == rows[1]["urls"] == []


def test_findings(spark):
    answers = [
        'Sure: ```json\n[{"title": " T ", "description": "D", "type": "Issue", "severity": "high", "confidence": 0.5, "affectedUrls": ["u", " "]}]\n```',
        'text {"title": "A", "description": "B", "affectedUrls": "v", "confidence": 7} more',
        '[{"title": "", "description": "x"}, {"title": "k", "description": "d", "type": "odd"}]',
        "nothing",
        None,
    ]
    got = reads.findings(spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, text string")).orderBy("i").collect()
    assert [(r["i"], r["type"], r["severity"], r["title"], r["affected_urls"], r["confidence"]) for r in got] == [(0, "issue", "HIGH", "T", ["u"], 0.5), (1, "observation", "MEDIUM", "A", ["v"], None)]


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "b"), (3, "b")], "k int, v string")
    assert sorted(map(tuple, sinks.insert_new(old, new, ["k"]).collect())) == [(3, "b")]
    assert sorted(map(tuple, sinks.replace_by_key(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "b"), (3, "b")]
    rows = spark.createDataFrame([('x"y', 1, None, ["a"])], "a string, b int, c string, d array<string>")
    assert sinks.csv_lines(rows, ["a", "b", "c", "d"]).first()["line"] == '"x""y","1","","[""a""]"'
    for batch in (old, new.dropDuplicates()):
        sinks.overwrite_partitions(batch, str(tmp_path / "t"), "k")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect()} == {(1, "a"), (2, "b"), (3, "b")}


def test_events(spark):
    now = F.lit("2024-03-01 12:30:00").cast("timestamp")
    projects = spark.createDataFrame([(p, s, "2024-01-01") for p, s in (("due", "0 12 * * *"), ("done", "0 12 * * *"), ("busy", "0 12 * * *"), ("manual", "manual"))] + [("young", "0 12 * * *", "2024-03-01 12:10:00")], "project_id string, crawl_schedule string, c string").withColumn("created_at", F.col("c").cast("timestamp"))
    crawls = spark.createDataFrame([("due", "2024-03-01 11:00:00", "COMPLETED"), ("done", "2024-03-01 12:01:00", "COMPLETED"), ("busy", "2024-02-01", "RUNNING")], "project_id string, c string, status string").withColumn("created_at", F.col("c").cast("timestamp"))
    assert [(r["project_id"], r["job_id"]) for r in events.due_projects(projects, crawls, now).collect()] == [("due", "scheduled-crawl-due-202403011200")]
    hooks = spark.createDataFrame([("p", "u", ["a"]), ("p", "w", []), ("p", "", ["a"]), ("p", None, None)], "project_id string, webhook_url string, webhook_events array<string>")
    happened = spark.createDataFrame([("p", "a"), ("p", "b")], "project_id string, event string")
    assert sorted((r["event"], r["webhook_url"]) for r in events.routed(happened, hooks).collect()) == [("a", "u"), ("a", "w"), ("b", "w")]
    assert [(r["event"], r["webhook_url"]) for r in events.routed(happened, hooks, strict=True).collect()] == [("a", "u")]
    waits = spark.range(1, 6).select(events.backoff("webhook", F.col("id")).alias("w"), events.backoff("job", F.col("id")).alias("j"), events.backoff("database", F.col("id")).alias("d")).collect()
    assert [tuple(r) for r in waits] == [(1.0, 5.0, 1.0), (4.0, 10.0, 2.0), (None, None, 3.0), (None, None, 4.0), (None, None, None)]  # waits after an attempt
    signed = spark.createDataFrame([("body", "key")], "b string, s string").select(events.signature("b", "s")).first()[0]
    assert signed == hmac.new(b"key", b"body", "sha256").hexdigest()
    told = events.notifications(spark.createDataFrame([("u", "p", "CRAWL_FAILED", "Site", None, "x"), ("u", "p", "ODD", "Site", None, None)], "user_id string, project_id string, type string, project_name string, severity string, subject string")).collect()
    assert [(r["severity"], r["title"]) for r in told] == [("HIGH", "Crawl failed for Site")]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("j1", "2024-01-01 00:00:00", "HIGH", "COMPLETED"), ("j1", "2024-01-01 00:10:00", "HIGH", "COMPLETED"), ("j2", "2024-01-02 00:00:00", "LOW", "FAILED")]
    df = spark.createDataFrame(rows, "job_id string, t string, severity string, status string").withColumn("ts", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(df.schema).parquet(source)

    def run(frame, name, mode="append"):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["job_id"] for r in run(events.once_per_job(stream()), "jobs")) == ["j1", "j2"]
    assert {(r["severity"], r["n"]) for r in run(events.issue_windows(stream()), "windows", "complete")} == {("HIGH", 2), ("LOW", 1)}
    seen = []
    events.on_crawls(stream(), lambda batch, _: seen.extend(r["job_id"] for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["j1", "j1"]


def test_post_crawl_plan(spark):
    from pagewright.plans import post_crawl

    rows = []
    page(rows, "1", "https://ex.test/a", [("/b", "t")])
    page(rows, "2", "https://ex.test/b", title=None)
    agents = spark.createDataFrame([("a1", "site", "ON_NEW_ISSUES", '{"minIssues": 1}', True), ("a2", "site", "ON_NEW_PAGES", None, True)], "agent_id string, project_id string, trigger_type string, trigger_config string, is_active boolean")
    out = post_crawl.run(table(spark, rows), spark.createDataFrame([], schemas.ISSUE), F.lit("2024-01-01").cast("timestamp"), agents)
    assert not out.failures
    assert out.tables["score"].first()["total_pages"] == 2 and out.tables["edges"].count() == 1
    assert [r["agent_id"] for r in out.tables["triggered"].collect()] == ["a1"]
    assert {r["page_id"]: r["inbound_links"] for r in out.tables["nodes"].collect()} == {"1": 0, "2": 1}
