"""Schedules, triggers, notifications and webhook routing as joins over event tables, with streaming wrappers."""

from __future__ import annotations

import hashlib
import hmac
import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.cron import previous_slot
from pagewright.functions.text import severity_rank
from pagewright.session import checkpointed

#: Seconds after a failed attempt n: 4 ** (n - 1) for a webhook, 5 * 2 ** (n - 1) for a job, n for the database.
WEBHOOK_BASE, JOB_BASE, DATABASE_STEP = 4, 5, 1
TIMEOUT = 30
ATTEMPTS = {"webhook": 3, "job": 3, "database": 5}


def due_projects(projects: DataFrame, crawls: DataFrame, now: Column, jobs: DataFrame | None = None) -> DataFrame:
    """``project_id, slot, job_id`` of projects whose last schedule slot has not been crawled.

    The slot must not lie before the project's creation, must be later than the last crawl, and no crawl may be queued
    or running. With ``jobs`` (``kind, status``), nothing is due while a crawl or what follows one is active for any project.
    """
    last = crawls.groupBy("project_id").agg(F.max("created_at").alias("last_run"), F.bool_or(F.col("status").isin("QUEUED", "RUNNING")).alias("busy"))
    slotted = projects.withColumn("slot", previous_slot("crawl_schedule", now)).join(last, "project_id", "left")
    fresh = F.col("slot").isNotNull() & (F.col("slot") >= F.col("created_at")) & (F.col("last_run").isNull() | (F.col("slot") > F.col("last_run")))
    due = slotted.where(fresh & ~F.coalesce("busy", F.lit(False)))
    if jobs is not None:
        active = jobs.agg(F.coalesce(F.bool_or((F.col("status") == "ACTIVE") & F.col("kind").isin("crawl", "post-crawl")), F.lit(False)).alias("_active"))
        due = due.join(F.broadcast(active)).where("not _active")  # one row
    return due.select("project_id", "slot", F.concat(F.lit("scheduled-crawl-"), "project_id", F.lit("-"), F.date_format("slot", "yyyyMMddHHmm")).alias("job_id"))


def triggered(agents: DataFrame, crawls: DataFrame) -> DataFrame:
    """``agent_id, crawl_id, reason``: agents to run after crawls (``project_id, crawl_id, new_issues, new_pages``).

    After every crawl; when new issues reach ``minIssues``; when new pages reach ``minPages`` (1 if not configured).
    """
    live = agents.where("is_active").join(crawls, "project_id")
    least = lambda name: F.coalesce(F.expr(f"try_cast(get_json_object(trigger_config, '$.{name}') as int)"), F.lit(1))
    kind = F.col("trigger_type")
    hit = (
        (kind == "POST_CRAWL")
        | ((kind == "ON_NEW_ISSUES") & (F.col("new_issues") > 0) & (F.col("new_issues") >= least("minIssues")))
        | ((kind == "ON_NEW_PAGES") & (F.col("new_pages") > 0) & (F.col("new_pages") >= least("minPages")))
    )
    return live.where(hit).select("agent_id", "crawl_id", kind.alias("reason"))


# Default severity per notification type.
NOTIFICATION_SEVERITY = {
    "NEW_PAGE": "INFO", "PAGE_REMOVED": "MEDIUM", "NEW_ISSUE": "MEDIUM", "ISSUE_RESOLVED": "INFO",
    "AGENT_FINDING": "INFO", "CRAWL_COMPLETED": "INFO", "CRAWL_FAILED": "HIGH", "WEBHOOK_FAILED": "MEDIUM",
}


def notifications(events: DataFrame) -> DataFrame:
    """One row per event of a known type: ``user_id, project_id, type, severity, title, body``; other types are dropped.

    ``events`` holds those ids, ``type``, ``project_name``, and ``severity`` and ``subject`` where they are known. Only a new
    issue and the findings of an agent run (those of ``worst_finding``) have a severity of their own; any other type has a
    fixed one.
    """
    default = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in NOTIFICATION_SEVERITY.items()])
    phrase = {
        "NEW_PAGE": "New page on ", "PAGE_REMOVED": "Page gone from ", "NEW_ISSUE": "New issue on ", "ISSUE_RESOLVED": "Issue resolved on ",
        "AGENT_FINDING": "Agent findings on ", "CRAWL_COMPLETED": "Crawl finished for ", "CRAWL_FAILED": "Crawl failed for ", "WEBHOOK_FAILED": "Webhook failed for ",
    }
    title = F.coalesce(*[F.when(F.col("type") == k, F.concat(F.lit(v), "project_name")) for k, v in phrase.items()])
    known = events.where(F.col("type").isin(*NOTIFICATION_SEVERITY))
    own = F.when(F.col("type").isin("NEW_ISSUE", "AGENT_FINDING"), F.col("severity"))
    return known.select("user_id", "project_id", "type", F.coalesce(own, default).alias("severity"), title.alias("title"), F.coalesce("subject", F.lit("")).alias("body"))


def worst_finding(findings: DataFrame) -> DataFrame:
    """``run_id, severity``: the highest severity among a run's findings."""
    return findings.groupBy("run_id").agg(F.max_by("severity", severity_rank("severity")).alias("severity"))


def routed(events: DataFrame, hooks: DataFrame, strict: bool = False) -> DataFrame:
    """Events joined to the webhooks that want them: a url is set, and the event list names the event or is empty.

    ``strict`` is the dispatcher's own reading, in which an empty list wants nothing.
    """
    empty = F.coalesce(F.size("webhook_events"), F.lit(0)) <= 0
    wants = F.coalesce(F.array_contains("webhook_events", F.col("event")), F.lit(False))
    return events.join(hooks, "project_id").where(F.coalesce(F.col("webhook_url") != "", F.lit(False)) & (wants | (F.lit(not strict) & empty)))


def backoff(kind: str, attempt: Column, attempts: Column | int | None = None) -> Column:
    """Seconds to wait after failed attempt ``attempt`` (from 1); null when no attempt follows. ``attempts`` may be given per
    row, as projects do."""
    most = F.coalesce(attempts if isinstance(attempts, Column) else F.lit(attempts), F.lit(ATTEMPTS[kind]))
    wait = {
        "webhook": F.pow(F.lit(float(WEBHOOK_BASE)), attempt - 1),
        "job": F.lit(float(JOB_BASE)) * F.pow(F.lit(2.0), attempt - 1),
        "database": F.lit(float(DATABASE_STEP)) * attempt,
    }[kind]
    return F.when((attempt >= 1) & (attempt < most), wait)


def requests(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """What to post, per routed event: ``event_id, project_id, event, url, body, signature, max_attempts, headers, timeout``.

    ``events`` holds ``event_id, project_id, event, ts, payload`` (JSON); ``hooks`` holds ``project_id, webhook_url,
    webhook_events, webhook_secret, webhook_retries`` and, where projects set them, ``webhook_headers`` (a map) and
    ``webhook_timeout`` (seconds). No retries, or none set, means three attempts; no timeout means 30 seconds.

    These are the events that the emitter lets through and the dispatcher sends: the dispatcher refuses everything where a project's
    list is empty, the emitter alone (``routed``) does not.
    """
    known = events.join(hooks, "project_id").where((F.col("webhook_url") != "") & (F.col("webhook_events").isNull() | F.array_contains("webhook_events", F.col("event"))))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    # the payload is JSON already and goes in as it is
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c).cast("string"))), r"^\[|\]$", "")
    body = F.concat(F.lit('{"event":'), quoted("event"), F.lit(',"timestamp":"'), stamp, F.lit('","projectId":'), quoted("project_id"), F.lit(',"data":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    made = known.withColumn("body", body)
    attempts = F.when(F.col("webhook_retries") > 0, F.col("webhook_retries")).otherwise(ATTEMPTS["webhook"]).cast("int")
    headers = F.col("webhook_headers") if "webhook_headers" in hooks.columns else F.lit(None).cast("map<string, string>")
    set_ = F.col("webhook_timeout") if "webhook_timeout" in hooks.columns else F.lit(None).cast("int")
    timeout = F.when(set_ > 0, set_).otherwise(TIMEOUT).cast("int")
    return made.select(
        "event_id", "project_id", "event", F.col("webhook_url").alias("url"), "body", signature("body", "webhook_secret").alias("signature"), attempts.alias("max_attempts"), headers.alias("headers"), timeout.alias("timeout")
    )


def post_all(made: DataFrame, post: Callable[[str, str, dict], tuple[int, str]], wait: Callable[[float], None]) -> DataFrame:
    """``event_id, attempt, status_code, response, error`` per attempt, until one succeeds or none is left.

    ``post(url, body, headers)``, or ``post(url, body, headers, timeout)`` if it takes one, gives a status code and a text, or
    raises; ``wait(seconds)`` passes the time between two attempts. Both run in the tasks. A project's own headers go
    before the event's id and signature, which they cannot replace. A lost task posts again: receivers know an event by its id.
    """
    timed = len(inspect.signature(post).parameters) > 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                own = {k: v for k, v in dict(r.headers or {}).items() if v is not None}
                headers = {"Content-Type": "application/json"} | own | {"X-Event-Id": str(r.event_id)} | ({"X-Signature": r.signature} if r.signature else {})
                send = (r.url, r.body, headers, r.timeout) if timed else (r.url, r.body, headers)
                for attempt in range(1, r.max_attempts + 1):
                    try:
                        code, text, error = *post(*send), None
                    except Exception as problem:  # an endpoint may fail in any way; that is an outcome
                        code, text, error = None, None, str(problem)
                    out.append((r.event_id, attempt, code, None if text is None else text[:5000], error))
                    if code is not None and 200 <= code < 300:
                        break
                    if attempt < r.max_attempts:
                        wait(float(WEBHOOK_BASE ** (attempt - 1)))
            yield pd.DataFrame(out, columns=["event_id", "attempt", "status_code", "response", "error"]).astype({"status_code": "Int32", "attempt": "int32"})

    return made.mapInPandas(run, "event_id long, attempt int, status_code int, response string, error string")


def deliveries(made: DataFrame, attempts: DataFrame) -> DataFrame:
    """One delivery row per request: ``event_id, project_id, event, url, attempt, max_attempts, status_code, success,
    error_message, waited``; ``attempt`` is the first that succeeded, or the last one made."""
    good = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    within = attempts.join(made.select("event_id", "max_attempts"), "event_id").where(F.col("attempt").between(1, F.col("max_attempts")))
    told = F.struct("attempt", "status_code", "response", "error", good.alias("success"))
    last = within.groupBy("event_id").agg(F.coalesce(F.min_by(F.when(good, told), F.when(good, F.col("attempt"))), F.max_by(told, "attempt")).alias("_a"))
    message = F.when(~F.col("_a.success"), F.coalesce("_a.error", F.concat(F.lit("HTTP "), "_a.status_code", F.lit(": "), F.substring(F.coalesce("_a.response", F.lit("")), 1, 500))))
    waited = F.aggregate(F.sequence(F.lit(0), F.col("_a.attempt")), F.lit(0.0), lambda sum_, n: sum_ + F.when((n > 0) & (n < F.col("_a.attempt")), F.pow(F.lit(float(WEBHOOK_BASE)), n - 1)).otherwise(0.0))
    return made.join(last, "event_id").select(
        "event_id", "project_id", "event", "url", "_a.attempt", "max_attempts", "_a.status_code", "_a.success", message.alias("error_message"), waited.alias("waited")
    )


def post_events(stream: DataFrame, hooks: DataFrame, post: Callable, wait: Callable[[float], None], path: str, checkpoint: str):
    """Start a query that posts events and keeps the delivery rows under ``path``, a folder per batch, so that a batch that
    runs again replaces what it wrote."""

    def handle(batch: DataFrame, number: int) -> None:
        made = checkpointed(requests(batch, hooks))
        attempts = checkpointed(post_all(made, post, wait))
        deliveries(made, attempts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@F.pandas_udf(T.StringType())
def signature(body: pd.Series, secret: pd.Series) -> pd.Series:
    """Hexadecimal HMAC-SHA256 of a webhook body."""
    return pd.Series([None if b is None or s is None else hmac.new(s.encode(), b.encode(), hashlib.sha256).hexdigest() for b, s in zip(body, secret)], dtype=object)


def unprocessed(crawls: DataFrame, processed: DataFrame) -> DataFrame:
    """Completed crawls that have not been post-processed."""
    return crawls.where("status = 'COMPLETED'").join(processed.select("crawl_id"), "crawl_id", "left_anti")


def stale_jobs(jobs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Jobs active for longer than ``minutes``: to be queued again."""
    return jobs.where((F.col("status") == "ACTIVE") & (F.col("started_at") < now - F.expr(f"interval {minutes} minutes")))


def once_per_job(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of jobs (``job_id, ts``) with each job id let through once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id"])


def issue_windows(stream: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and severity; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "severity").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "severity", "n")


def on_crawls(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that post-processes completed crawls batch by batch; a batch id is handled once."""
    done = stream.where("status = 'COMPLETED'")
    return done.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
