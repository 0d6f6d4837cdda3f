"""Events of crawls: many projects in a batch, scores kept between batches and in a stream, posts with a project's settings."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.plans import post_crawl
from pagewright.streaming import crawl_events, events
from tests.test_audit import page, table

#: crawl, project, minute it ended, score of its audit (or none), new issues
CRAWLS = [("a1", "a", 1, 90.0, 3), ("b1", "b", 2, None, None), ("a2", "a", 3, None, None), ("a3", "a", 4, 90.0, 0), ("b2", "b", 5, 80.0, 1), ("a4", "a", 6, 95.5, 0), ("c1", "c", 7, 100.0, 0)]


def rows_of(spark, crawls=CRAWLS):
    made = [(i, p, f"2024-01-01 00:{m:02}:00", 10, 1, 2, 3, 0, s, 7 if s is not None else None, n) for i, p, m, s, n in crawls]
    text = crawl_events.AUDITED.replace("timestamp", "string")
    return spark.createDataFrame(made, text).withColumn("completed_at", F.col("completed_at").cast("timestamp"))


def in_turn(crawls, before):
    """Event names and scores before, one crawl after another."""
    score, out = dict(before), set()
    for crawl, project, _, own, new in sorted(crawls, key=lambda c: c[2]):
        old = score.get(project)
        out.add((crawl, "crawl.completed", None))
        if own is not None:
            out.add((crawl, "audit.completed", old))
            out |= {(crawl, "issues.new", None)} if new else set()
            out |= {(crawl, "health.changed", old)} if old is not None and old != own else set()
            score[project] = own
    return out, score


def told(df):
    return {(r["crawl_id"], r["event"], json.loads(r["payload"]).get("previousHealthScore")) for r in df.collect()}


def test_many_projects_in_one_batch(spark):
    before = spark.createDataFrame([("b", 70.0), ("z", 1.0)], "project_id string, health_score double")
    rows = crawl_events.with_previous(rows_of(spark), before)
    made = crawl_events.crawl_events(rows).persist()
    expected, scores = in_turn(CRAWLS, {"b": 70.0, "z": 1.0})
    assert told(made) == expected
    ids = [r["event_id"] for r in made.collect()]
    assert len(set(ids)) == len(ids) and {r["event_id"] for r in crawl_events.crawl_events(rows.repartition(5)).collect()} == set(ids)
    assert {r["project_id"]: r["health_score"] for r in crawl_events.latest_scores(rows, before).collect()} == scores
    by = {(r["crawl_id"], r["event"]): json.loads(r["payload"]) for r in made.collect()}
    assert by["b1", "crawl.completed"] == {"crawlId": "b1", "totalPages": 10, "newPages": 1, "removedPages": 2, "changedPages": 3, "errorCount": 0, "healthScore": None, "newIssueCount": None}
    assert by["a4", "health.changed"] == {"crawlId": "a4", "previousHealthScore": 90.0, "healthScore": 95.5, "delta": 5.5}
    assert by["a1", "issues.new"] == {"crawlId": "a1", "newIssueCount": 3, "activeIssueCount": 7, "healthScore": 90.0}


def test_batches_with_kept_scores_equal_one_batch(spark):
    scores, seen = spark.createDataFrame([], "project_id string, health_score double"), set()
    for part in (CRAWLS[:2], CRAWLS[2:5], CRAWLS[5:]):
        rows = crawl_events.with_previous(rows_of(spark, part), scores)
        seen |= told(crawl_events.crawl_events(rows))
        scores = spark.createDataFrame(crawl_events.latest_scores(rows, scores).collect(), scores.schema)
    assert seen == in_turn(CRAWLS, {})[0]


def test_a_stream_remembers_scores_and_drops_repeated_crawls(spark, tmp_path):
    for n, part in enumerate((CRAWLS[:2], CRAWLS[1:5], [*CRAWLS[5:], CRAWLS[3]])):
        rows_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{n}"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows_of(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for n in range(3):  # the query is stopped and started again between the parts
        for file in (tmp_path / f"part{n}").glob("*.parquet"):
            file.rename(tmp_path / "in" / f"{n}-{file.name}")
        made = crawl_events.crawl_events(crawl_events.remembered(stream))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert told(got) == in_turn(CRAWLS, {})[0] and got.count() == len(told(got))


def test_crawls_that_ended_and_were_not_handled(spark):
    crawls = rows_of(spark).drop("health_score", "active_issues", "new_issues").withColumn("status", F.when(F.col("crawl_id") == "c1", "FAILED").otherwise("COMPLETED"))
    audits = rows_of(spark).where("health_score is not null")
    found = crawl_events.audited(crawls, audits, crawls.where("crawl_id = 'a1'"))
    assert sorted((r["crawl_id"], r["health_score"]) for r in found.collect()) == [("a2", None), ("a3", 90.0), ("a4", 95.5), ("b1", None), ("b2", 80.0)]


@pytest.fixture
def endpoint():
    """A loopback server that keeps what is posted to it."""
    kept = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            kept.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"ok")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", kept
    server.shutdown()


def send(url, body, headers, timeout):
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, body.encode(), headers | {"X-Timeout": str(timeout)}), timeout=timeout) as answer:
        return answer.status, answer.read().decode()


def test_a_crawl_is_told_to_its_own_project(spark, endpoint):
    url, kept = endpoint
    rows = []
    page(rows, "1", "https://ex.test/a", [("/b", "t")])
    page(rows, "2", "https://ex.test/b", title=None)
    hook = "project_id string, webhook_url string, webhook_events array<string>, webhook_secret string, webhook_retries int, webhook_headers map<string, string>, webhook_timeout int"
    hooks = spark.createDataFrame([("p7", url, None, "s", 1, {"X-Team": "blue", "X-Event-Id": "mine"}, 5), ("site", url, None, None, 1, None, None)], hook)
    agent = "agent_id string, project_id string, trigger_type string, trigger_config string, is_active boolean"
    agents = spark.createDataFrame([("new", "p7", "ON_NEW_PAGES", '{"minPages": 2}', True), ("few", "p7", "ON_NEW_PAGES", '{"minPages": 3}', True), ("other", "site", "POST_CRAWL", None, True)], agent)
    crawl = spark.createDataFrame([("k1", "p7", 2, 2, 0, 1, 0)], "crawl_id string, project_id string, total_pages int, new_pages int, removed_pages int, changed_pages int, error_count int").withColumn("completed_at", F.lit("2024-01-01").cast("timestamp"))
    before = spark.createDataFrame([("p7", 12.5)], "project_id string, health_score double")
    out = post_crawl.run(table(spark, rows), spark.createDataFrame([], schemas.ISSUE), F.lit("2024-01-01").cast("timestamp"), agents, hooks, send, crawl=crawl, before=before)
    assert not out.failures
    assert [(r["agent_id"], r["crawl_id"]) for r in out.tables["triggered"].collect()] == [("new", "k1")]
    assert sorted(body["event"] for _, body in kept) == sorted(crawl_events.EVENTS) and {body["projectId"] for _, body in kept} == {"p7"}
    ids = [headers["X-Event-Id"] for headers, _ in kept]
    assert len(set(ids)) == 4 and "mine" not in ids and all(h["X-Team"] == "blue" and h["X-Timeout"] == "5" for h, _ in kept)
    assert out.tables["webhooks"].where("success").count() == 4
    score = out.tables["score"].first()["score"]
    assert [(r["project_id"], r["health_score"]) for r in out.tables["scores"].collect()] == [("p7", score)]
    assert next(body["data"] for _, body in kept if body["event"] == "health.changed")["previousHealthScore"] == 12.5


def test_a_failed_audit_leaves_the_end_of_the_crawl(spark):
    rows = []
    page(rows, "1", "https://ex.test/a")
    broken = table(spark, rows).withColumn("word_count", F.raise_error(F.lit("torn file")).cast("int"))
    hooks = spark.createDataFrame([("site", "https://h.test", None, None, 1)], "project_id string, webhook_url string, webhook_events array<string>, webhook_secret string, webhook_retries int")
    out = post_crawl.run(broken, spark.createDataFrame([], schemas.ISSUE), F.lit("2024-01-01").cast("timestamp"), hooks=hooks, post=lambda url, body, headers: (200, body))
    assert "torn file" in out.failures["issues"] and [r["event"] for r in out.tables["webhooks"].collect()] == ["crawl.completed"]
