"""What a project is told about its crawls: four webhook events, and the score each project had before.

A row is a completed crawl with the outcome of its audit, if that ran. The score before is the one of the project's last
audited crawl: in a batch by a window over the project's crawls, with the scores that were kept before the batch; in a
stream by state per project. Any number of projects, and several crawls of one project, may be in a batch. An event's id is
made of its crawl and its name, so an event that is sent again has the id it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The names of the events and of their fields.
COUNTS = {"totalPages": "total_pages", "newPages": "new_pages", "removedPages": "removed_pages", "changedPages": "changed_pages", "errorCount": "error_count"}
EVENTS = ("crawl.completed", "audit.completed", "issues.new", "health.changed")

AUDITED = """crawl_id string, project_id string, completed_at timestamp, total_pages int, new_pages int, removed_pages int,
changed_pages int, error_count int, health_score double, active_issues bigint, new_issues bigint"""
COLUMNS = tuple(f.split()[0] for f in AUDITED.split(","))


def audited(crawls: DataFrame, audits: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Completed crawls with ``health_score, active_issues, new_issues`` of their audit, null where it failed; crawls in
    ``processed`` are left out."""
    done = crawls.where("status = 'COMPLETED'")
    if processed is not None:
        done = done.join(processed.select("crawl_id"), "crawl_id", "left_anti")
    return done.join(audits.select("crawl_id", "health_score", "active_issues", "new_issues"), "crawl_id", "left").select(*COLUMNS)


def with_previous(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``rows`` and ``previous_score``: the score of the project's last audited crawl, in this batch or in ``before``
    (``project_id, health_score``); null for a project's first."""
    earlier = Window.partitionBy("project_id").orderBy("completed_at", "crawl_id").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("previous_score", F.last("health_score", ignorenulls=True).over(earlier))
    if before is None:
        return found
    kept = before.select("project_id", F.col("health_score").alias("_kept"))
    return found.join(kept, "project_id", "left").withColumn("previous_score", F.coalesce("previous_score", "_kept")).drop("_kept").select(*rows.columns, "previous_score")


def latest_scores(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``project_id, health_score`` to keep for the next batch: one row a project that has ever been audited."""
    new = rows.where("health_score is not null").groupBy("project_id").agg(F.max_by("health_score", F.struct("completed_at", "crawl_id")).alias("health_score"))
    return new if before is None else new.unionByName(before.select("project_id", "health_score").join(new, "project_id", "left_anti"))


def remembered(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The stream of audited crawls with ``previous_score``, kept per project in the state store.

    A crawl that comes again within ``late`` is dropped. Crawls of a project that come in one batch are taken in order;
    one that comes after a later crawl was handled is compared with the score that the project has by then.
    """
    once = stream.withWatermark("completed_at", late).dropDuplicatesWithinWatermark(["crawl_id"])
    schema = T.StructType([*once.schema.fields, T.StructField("previous_score", T.DoubleType())])

    def carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["completed_at", "crawl_id"])
        previous = []
        for own in rows["health_score"]:
            previous.append(score)
            score = score if pd.isna(own) else float(own)
        if score is not None:
            state.update((score,))
        yield rows.assign(previous_score=pd.Series(previous, rows.index, "float64"))

    return once.groupBy("project_id").applyInPandasWithState(carry, schema, "score double", "append", GroupStateTimeout.NoTimeout)


def crawl_events(rows: DataFrame) -> DataFrame:
    """``event_id, project_id, event, ts, payload, crawl_id`` for every event of a crawl (``AUDITED`` and ``previous_score``).

    ``crawl.completed`` is sent for each crawl, ``audit.completed`` where an audit ran, ``issues.new`` where it found new ones,
    and ``health.changed`` where the project had a score before that is not the one it has now.
    """
    audit = F.col("health_score").isNotNull()
    score, before = F.col("health_score").alias("healthScore"), F.col("previous_score").alias("previousHealthScore")
    new, active, crawl = F.col("new_issues").alias("newIssueCount"), F.col("active_issues").alias("activeIssueCount"), F.col("crawl_id").alias("crawlId")
    fields = {
        "crawl.completed": (F.lit(True), [crawl, *[F.col(c).alias(name) for name, c in COUNTS.items()], score, new]),
        "audit.completed": (audit, [crawl, score, before, active, new]),
        "issues.new": (audit & (F.col("new_issues") > 0), [crawl, new, active, score]),
        "health.changed": (audit & (F.col("previous_score") != F.col("health_score")), [crawl, before, score, (F.col("health_score") - F.col("previous_score")).alias("delta")]),
    }
    said = [F.when(F.coalesce(sent, F.lit(False)), F.struct(F.lit(name).alias("event"), F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("payload"))) for name, (sent, parts) in fields.items()]
    told = rows.select("crawl_id", "project_id", F.col("completed_at").alias("ts"), F.explode(F.array_compact(F.array(*said))).alias("e"))
    return told.select(F.xxhash64("crawl_id", "e.event").alias("event_id"), "project_id", "e.event", "ts", "e.payload", "crawl_id")
