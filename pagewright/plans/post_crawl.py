"""What follows a crawl: audit, issues, score, keywords, link graph, triggers, events, webhooks; failures are noted, not spread."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators import graph, keywords, lifecycle
from pagewright.operators.audit import audit
from pagewright.session import checkpointed
from pagewright.streaming import crawl_events, events


@dataclass
class Outcome:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)


def of_pages(pages: DataFrame, now: Column) -> DataFrame:
    """The crawl that ``pages`` are, where no crawl row is kept: all that is known of it is its project, time and size."""
    known = pages.agg(F.min("project_id").alias("project_id"), F.count(F.lit(1)).cast("int").alias("total_pages"))
    counts = {c: F.lit(0) for c in crawl_events.COUNTS.values() if c != "total_pages"}
    return known.withColumns({"crawl_id": F.concat_ws("-", "project_id", F.date_format(now, "yyyyMMddHHmmss")), "completed_at": now, "status": F.lit("COMPLETED"), **counts})


def run(
    pages: DataFrame,
    issues: DataFrame,
    now: Column,
    agents: DataFrame | None = None,
    hooks: DataFrame | None = None,
    post: Callable | None = None,
    wait: Callable[[float], None] = lambda seconds: None,
    crawl: DataFrame | None = None,
    before: DataFrame | None = None,
) -> Outcome:
    """Tables ``issues, score, keywords, edges, nodes, crawl, scores, triggered, events, webhooks``, each computed and kept
    before the next step.

    A step that fails, be it in planning or in a task, is reported in ``failures``; steps that do not need it go on, and
    those that do are skipped. ``crawl`` is the row of the crawl that just ended, and ``before`` the scores that projects had
    until now; ``scores`` are those to keep. Agents and webhooks are the project's own. With ``hooks`` and ``post``, the
    crawl's events are posted; a failed audit leaves the end of the crawl to be told.
    """
    out = Outcome()

    def step(name: str, make: Callable[[], DataFrame], *needs: str):
        if any(n not in out.tables for n in needs):
            return
        try:
            out.tables[name] = checkpointed(make())  # runs here: what fails in a task fails in this step
        except Exception as error:  # a step's failure must not stop the others
            out.failures[name] = str(error)

    step("issues", lambda: lifecycle.sync_issues(audit(pages), issues, now))
    step("keywords", lambda: keywords.keyword_table(pages))
    step("edges", lambda: graph.edges(pages))
    step("score", lambda: lifecycle.health_score(out.tables["issues"], pages), "issues")
    step("nodes", lambda: graph.nodes(pages, out.tables["edges"], out.tables["issues"]), "issues", "edges")
    def ended() -> DataFrame:
        row = of_pages(pages, now) if crawl is None else crawl
        found = {"health_score": F.lit(None).cast("double"), "active_issues": F.lit(None).cast("bigint"), "new_issues": F.lit(None).cast("bigint")}
        if "score" not in out.tables:
            return crawl_events.with_previous(row.withColumns(found).select(*crawl_events.COLUMNS), before)
        audit_row = out.tables["score"].select(F.col("score").alias("health_score")).join(lifecycle.totals(out.tables["issues"]))  # one row each
        return crawl_events.with_previous(row.join(audit_row).select(*crawl_events.COLUMNS), before)

    step("crawl", ended)
    step("scores", lambda: crawl_events.latest_scores(out.tables["crawl"], before), "crawl", "score")
    if agents is not None:
        step("triggered", lambda: events.triggered(agents, out.tables["crawl"].fillna(0, ["new_issues", "new_pages"])), "crawl")
    if hooks is not None and post is not None:
        step("events", lambda: crawl_events.crawl_events(out.tables["crawl"]), "crawl")
        step("requests", lambda: events.requests(out.tables["events"], hooks), "events")
        step("webhooks", lambda: events.deliveries(out.tables["requests"], events.post_all(out.tables["requests"], post, wait)), "requests")
    return out
