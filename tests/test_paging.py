"""Deep pages by key ranges, newest rows of a project, and schedules that wait for work in progress."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import diff, lifecycle, paging, reads
from pagewright.streaming import events


def long_list(spark, n=3000):
    k = F.col("id")
    return spark.range(n).select(k, F.when(k % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (k * 7919 % 1009).cast("string"))).alias("url"), F.when(k % 11 == 0, None).otherwise(k % 13).alias("rank"))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_pages_equal_the_offset_form(spark, parts):
    rows, order = long_list(spark), [F.desc("rank"), F.asc("url"), F.asc("id")]
    every = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[2] is None, -(r[2] or 0), r[1], r[0]))
    found = paging.ranges(rows, order, parts)
    for number, size in ((1, 50), (2, 17), (60, 50), (61, 50), (3, 999), (4, 999), (1, 5000), (500, 6)):
        expected = [(*r, 3000, number, size, 3000 > number * size) for r in every[(number - 1) * size : number * size]]
        assert [tuple(r) for r in found.page(number, size).collect()] == expected, (number, size)
        offset = lifecycle.page_of(rows, order, number, size).collect()
        assert sorted(map(repr, offset)) == sorted(repr(r) for r in found.page(number, size).collect())


def test_a_deep_page_reads_one_range(spark):
    found = paging.ranges(long_list(spark), [F.asc("id")], 20)
    deep = found.page(50, 50)
    files = set(found.rows.where(F.col("_range") == 16).select(F.input_file_name().alias("f")).distinct().toPandas()["f"])
    assert len(files) == 1 and [r["id"] for r in deep.collect()] == list(range(2450, 2500))
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_lists(spark):
    found = paging.ranges(long_list(spark).limit(0), [F.asc("id")])
    assert found.total == 0 and found.page(1).count() == 0


def test_newest_rows_of_a_project(spark):
    rows = spark.range(200).select(F.col("id").alias("delivery_id"), F.col("id").alias("run_id"), (F.col("id") % 2).cast("string").alias("project_id"), (F.col("id") % 10).alias("created_at"))
    expected = sorted((i for i in range(200) if i % 2), key=lambda i: (-(i % 10), -i))
    assert [r["delivery_id"] for r in reads.delivery_list(rows, "1").collect()] == expected[:50]
    assert [r["run_id"] for r in reads.qualification_runs(rows, "1").collect()] == expected[:20]


@pytest.mark.parametrize("jobs, due", [([], 1), ([("crawl", "WAITING"), ("agent", "ACTIVE")], 1), ([("post-crawl", "ACTIVE")], 0), ([("crawl", "ACTIVE"), ("agent", "DONE")], 0)])
def test_nothing_is_due_while_a_crawl_is_active_anywhere(spark, jobs, due):
    now = F.lit("2024-03-01 12:30:00").cast("timestamp")
    projects = spark.createDataFrame([("p", "0 12 * * *")], "project_id string, crawl_schedule string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    crawls = spark.createDataFrame([], "project_id string, created_at timestamp, status string")
    assert events.due_projects(projects, crawls, now, spark.createDataFrame(jobs, "kind string, status string")).count() == due


def test_the_latest_crawl_is_told_in_short_lists(spark):
    diff = {"crawlDiff": {"newPages": ["n1", 5, "n2", None, "n3"], "removedPages": ["r1"], "changedPages": [{"url": "c1", "changes": [{"field": "title", "oldValue": "a", "newValue": {"x": 1}}, {"newValue": 2}]}, {"url": ""}, {"changes": []}, {"url": "c2"}]}, "postProcessing": {"newIssueCount": 40, "activeIssueCount": 7, "completedAt": "2024-01-03T00:00:00.000Z"}}
    crawls = spark.createDataFrame([("k0", "COMPLETED", "2024-01-01", None, None), ("k1", "COMPLETED", "2024-01-02", "2024-01-02 01:00:00", json.dumps(diff)), ("k2", "FAILED", "2024-01-09", None, None)], "crawl_id string, status string, created_at string, completed_at string, diff string")
    crawls = crawls.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "completed_at")})
    window = reads.crawl_window(crawls, F.lit("2024-02-01").cast("timestamp"))
    when = lambda d: F.to_timestamp(F.lit(f"2024-01-{d}"))
    k = F.col("id")
    issues = spark.range(30).select(
        k.cast("string").alias("issue_id"), F.lit("R").alias("rule_id"), F.element_at(F.array(*map(F.lit, ("LOW", "HIGH", "INFO"))), (k % 3 + 1).cast("int")).alias("severity"), F.lit("t").alias("title"), F.lit("u").alias("affected_url"),
        F.when(k % 2 == 0, when("02 12:00:00")).otherwise(when("01")).alias("first_detected_at"), when("02 13:00:00").alias("last_detected_at"), F.when(k % 5 == 0, when("02 14:00:00")).alias("resolved_at"), F.when(k % 5 == 0, "RESOLVED").otherwise("ACTIVE").alias("status"),
    )
    listed = reads.capped_issues(issues, window, 4)
    got = {}
    for r in listed.orderBy("delta", "place").collect():
        got.setdefault(r["delta"], []).append((r["severity"], r["issue_id"]))
    assert got["new"] == [("HIGH", i) for i in sorted(str(i) for i in range(30) if i % 2 == 0 and i % 3 == 1)[:4]]
    assert got["resolved"] == [("HIGH", "10"), ("HIGH", "25"), ("LOW", "0"), ("LOW", "15")] and len(got["persisted"]) == 4
    row = reads.capped_delta(window, listed, new=2, removed=2, changed=2).first()
    assert (row["crawl_id"], row["is_initial"], row["new_pages"], row["removed_pages"], row["trimmed"]) == ("k1", False, ["n1", "n2"], ["r1"], True)
    assert [(p["url"], [tuple(c) for c in p["changes"]]) for p in row["changed_pages"]] == [("c1", [("title", '"a"', '{"x":1}'), ("unknown", "null", "2")]), ("c2", [])]
    assert (row["new_issues"], row["resolved_issues"], row["persisted_issues"], row["active_issues"]) == (40, 4, 4, 7)
    assert not reads.capped_delta(window, listed, 3, 1, 2).first()["trimmed"]
    bare = reads.crawl_window(crawls.where("crawl_id = 'k0'"), F.lit("2024-02-01").cast("timestamp"))
    row = reads.capped_delta(bare, listed, 1, 1, 1).first()
    assert row["is_initial"] and row["new_pages"] == [] and row["changed_pages"] == [] and row["new_issues"] == 4 and row["active_issues"] is None


def test_what_a_crawl_found_at_the_start(spark):
    files = spark.createDataFrame([("a", "https", 200, None), ("b", "https", 404, None), ("c", "http", None, "timed out")], "site string, scheme string, status_code int, error string")
    rules = spark.createDataFrame([("a", "sitemap", "s1"), ("a", "sitemap", "s1"), ("a", "sitemap", "s2"), ("a", "allow", "/")], "site string, kind string, pattern string")
    configured = spark.createDataFrame([("b",)], "site string")
    got = {r["site"]: tuple(r)[1:] for r in diff.robots_diagnostics(files, rules, configured).collect()}
    assert got == {"a": ("https://a/robots.txt", True, None, 2, False), "b": ("https://b/robots.txt", False, "robots.txt returned HTTP 404", 0, False), "c": ("http://c/robots.txt", False, "timed out", 0, True)}
    seeds = spark.createDataFrame([("a", "/", False), ("a", "/1", True), ("a", "/1", True), ("a", "/", True), ("b", "/", False)], "site string, url string, from_sitemap boolean")
    linked = spark.createDataFrame([("a", "/1"), ("a", "/2"), ("a", "/2"), ("c", "/x")], "site string, url string")
    got = {r["site"]: tuple(r)[1:] for r in diff.discovery_diagnostics(seeds, linked).collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 0, 0), "c": (0, 0, 1)}
