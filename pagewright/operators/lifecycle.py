"""Issue lifecycle, whitelisting and the site's health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import contains_ci, rounded, severity_rank
from pagewright.operators.ranking import first_of
from pagewright.session import checkpointed

DESCRIBED = ("category", "severity", "title", "description", "page_id", "evidence")
# Points a rule costs if it is broken everywhere.
WEIGHTS = {"CRITICAL": 12.0, "HIGH": 8.0, "MEDIUM": 4.0, "LOW": 1.5, "INFO": 0.4}
UNKNOWN_WEIGHT = 4.0


def audit_input(pages: DataFrame, crawl_pages: DataFrame, crawl_id: str) -> DataFrame:
    """Pages of one crawl by the bridge table; all pages if the crawl has none."""
    wanted = crawl_pages.where(F.col("crawl_id") == crawl_id).select("page_id").distinct()
    if wanted.isEmpty():
        return pages
    return pages.join(wanted, "page_id", "left_semi")


def first_detected(found: DataFrame, page_order: str = "page_order", rule_order: str = "rule_order") -> DataFrame:
    """One finding per (rule, url): the first in page order, then rule order."""
    others = [c for c in found.columns if c not in ("rule_id", "affected_url")]
    picked = found.groupBy("rule_id", "affected_url").agg(F.min_by(F.struct(*others), F.struct(page_order, rule_order)).alias("_f"))
    return picked.select("rule_id", "affected_url", *[F.col(f"_f.{c}").alias(c) for c in others])


def open_issues(issues: DataFrame) -> DataFrame:
    """Unresolved issues with ``duplicate``: all but the one detected last per (rule, url)."""
    latest = Window.partitionBy("rule_id", "affected_url").orderBy(F.desc("last_detected_at"), F.desc("issue_id"))
    kept = issues.where(F.col("status").isin("ACTIVE", "WHITELISTED"))
    return kept.withColumn("duplicate", F.row_number().over(latest) > 1)


def sync_issues(detected: DataFrame, issues: DataFrame, now: Column, evaluated: list[str] | None = None, strict: bool = False) -> DataFrame:
    """The issue table after an audit, with ``action``: create, refresh, resolve or keep.

    One full outer join on (rule, url). Issues of rules that were not evaluated are left alone, unless ``strict``, which
    resolves whatever was not detected. Resolved rows stay as they are; an issue that comes back is a new row.
    """
    new = detected.select("rule_id", "affected_url", F.struct(*[F.col(c) if c in detected.columns else F.lit(None).cast("string").alias(c) for c in DESCRIBED]).alias("new")).withColumn("seen", F.lit(True))
    marked = open_issues(issues)
    current = marked.where(~F.col("duplicate")).drop("duplicate")
    old = current.select("rule_id", "affected_url", F.struct(*current.columns).alias("old"))
    both = old.join(new, ["rule_id", "affected_url"], "full_outer")
    known = F.lit(True) if strict or evaluated is None else F.col("rule_id").isin(evaluated)
    action = F.when(F.col("old").isNull(), "create").when(F.col("seen"), "refresh").when(known, "resolve").otherwise("keep")
    refreshed, created = action == "refresh", action == "create"
    value = {c: F.when(refreshed | created, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in DESCRIBED}
    value |= {
        "issue_id": F.coalesce("old.issue_id", F.sha2(F.concat_ws("\u0001", "rule_id", "affected_url", now.cast("string")), 256)),
        "project_id": F.col("old.project_id"),
        "rule_id": F.col("rule_id"),
        "affected_url": F.col("affected_url"),
        "is_whitelisted": F.coalesce("old.is_whitelisted", F.lit(False)),
        "whitelist_reason": F.col("old.whitelist_reason"),
        "status": F.when(created, "ACTIVE").when(refreshed, F.when(F.col("old.is_whitelisted"), "WHITELISTED").otherwise("ACTIVE")).when(action == "resolve", "RESOLVED").otherwise(F.col("old.status")),
        "first_detected_at": F.when(created, now).otherwise(F.col("old.first_detected_at")),
        "last_detected_at": F.when(created | refreshed, now).otherwise(F.col("old.last_detected_at")),
        "resolved_at": F.when(action == "resolve", now).when(created | refreshed, None).otherwise(F.col("old.resolved_at")),
    }
    columns = issues.columns
    kinds = dict(zip(columns, (f.dataType for f in issues.schema)))
    made = both.select(*[value[c].cast(kinds[c]).alias(c) for c in columns], action.alias("action"))
    copies = marked.where("duplicate").drop("duplicate").withColumns({"status": F.lit("RESOLVED"), "resolved_at": now, "action": F.lit("resolve")})
    done = issues.where(~F.coalesce(F.col("status").isin("ACTIVE", "WHITELISTED"), F.lit(False))).withColumn("action", F.lit("keep"))
    return made.unionByName(copies).unionByName(done)


def totals(synced: DataFrame) -> DataFrame:
    """One row: active issues that are not whitelisted, and issues created now."""
    active = (F.col("status") == "ACTIVE") & ~F.coalesce("is_whitelisted", F.lit(False))
    return synced.agg(F.count_if(active).alias("active_issues"), F.count_if(F.col("action") == "create").alias("new_issues"))


def whitelist(issues: DataFrame, entries: DataFrame) -> DataFrame:
    """Apply SINGLE entries (one issue) and RULE entries (every active issue of a rule); the newest reason wins."""
    single = entries.where("scope = 'SINGLE' and issue_id is not null").groupBy("issue_id").agg(F.max("reason").alias("_single"))
    rule = entries.where("scope = 'RULE' and rule_id is not null").groupBy("rule_id").agg(F.max("reason").alias("_rule"))
    joined = issues.join(single.withColumn("_s", F.lit(True)), "issue_id", "left").join(rule.withColumn("_r", F.lit(True)), "rule_id", "left")
    hit = F.coalesce("_s", F.lit(False)) | (F.coalesce("_r", F.lit(False)) & (F.col("status") == "ACTIVE"))
    changed = joined.withColumns(
        {
            "is_whitelisted": F.when(hit, True).otherwise(F.col("is_whitelisted")),
            "whitelist_reason": F.when(hit, F.coalesce("_single", "_rule")).otherwise(F.col("whitelist_reason")),
            "status": F.when(hit, "WHITELISTED").otherwise(F.col("status")),
        }
    )
    return changed.select(*issues.columns)


def toggle_whitelist(issues: DataFrame, issue_id: str, on: bool, reason: str | None = None) -> DataFrame:
    hit = F.col("issue_id") == issue_id
    return issues.withColumns(
        {
            "is_whitelisted": F.when(hit, on).otherwise(F.col("is_whitelisted")),
            "whitelist_reason": F.when(hit, F.lit(reason if on else None)).otherwise(F.col("whitelist_reason")),
            "status": F.when(hit, "WHITELISTED" if on else "ACTIVE").otherwise(F.col("status")),
        }
    )


def whitelist_entries(entries: DataFrame, project_id: str) -> DataFrame:
    return entries.where(F.col("project_id") == project_id).orderBy(F.desc("created_at"))


def health_score(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """One row ``total_pages, active_issues, score``: 100 less what every broken rule costs for its share of pages.

    A rule weighs as the severity of its issue with the smallest id; rules share one severity in practice. A blank url is
    a url of its own. Scores that would round to 100 or more in spite of issues are 99.9.
    """
    total = pages.agg(F.count(F.lit(1)).alias("total_pages"))
    live = issues.where((F.col("status") == "ACTIVE") & ~F.coalesce("is_whitelisted", F.lit(False)))
    per_rule = live.groupBy("rule_id").agg(
        F.min_by("severity", "issue_id").alias("severity"), F.count_distinct(F.coalesce("affected_url", F.lit(""))).alias("urls"), F.count(F.lit(1)).alias("issues")
    )
    weight = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in WEIGHTS.items()], F.lit(UNKNOWN_WEIGHT))
    cost = weight * F.least(F.lit(1.0), F.try_divide("urls", "total_pages"))
    summed = per_rule.join(F.broadcast(total)).agg(F.sum(cost).alias("cost"), F.sum("issues").alias("active_issues"))
    raw = rounded(100 - F.col("cost"), 1)
    score = F.when((F.col("total_pages") == 0) | (F.coalesce("active_issues", F.lit(0)) == 0), 100.0).when(raw >= 100, 99.9).otherwise(F.greatest(F.lit(0.0), raw))
    return total.join(F.broadcast(summed)).select("total_pages", F.coalesce("active_issues", F.lit(0)).alias("active_issues"), score.alias("score"))


# --- filtering and reporting ---------------------------------------------------------------------------------------


def select_issues(issues: DataFrame, severities: str | None = None, category: str | None = None, status: str = "ACTIVE", page_id: str | None = None, url: str | None = None, search: str | None = None) -> DataFrame:
    """Issues that pass all given filters. Unknown severities are dropped; if none is left, the filter is off."""
    from pagewright.functions.text import SEVERITIES

    out = issues
    named = [s for s in (severities or "").upper().replace(" ", "").split(",") if s in SEVERITIES]
    if named:
        out = out.where(F.col("severity").isin(named))
    if category:
        out = out.where(F.col("category") == category)
    if status != "ALL":
        out = out.where(F.col("status") == status)
    if page_id:
        out = out.where(F.col("page_id") == page_id)
    if url:
        out = out.where(contains_ci("affected_url", url))
    if search:
        out = out.where(contains_ci("title", search) | contains_ci("affected_url", search))
    return out


def page_of(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 50, most: int = 50_000) -> DataFrame:
    """One page of rows with the envelope columns ``total, page, page_size, has_more``."""
    size = max(1, min(page_size, most))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return shown.join(F.broadcast(total)).withColumns({"page": F.lit(page), "page_size": F.lit(size), "has_more": F.col("total") > page * size})


def by_severity() -> list[Column]:
    return [F.desc(severity_rank("severity")), F.desc("last_detected_at"), F.asc("issue_id")]


def linking_rows(issues: DataFrame, pages: DataFrame, internal_only: bool = False) -> DataFrame:
    """``affected_url, source``: every page that links to an issue's url, a row each."""
    from pagewright.functions import urls
    from pagewright.operators.shared import derived, link_rows

    named = issues.select("affected_url").distinct().withColumn("target", urls.lenient("affected_url"))
    links = link_rows(derived(pages), internal_only).select("target", F.col("url").alias("source"))
    return links.join(named, "target").select("affected_url", "source").distinct()


def linked_from(issues: DataFrame, pages: DataFrame, internal_only: bool = False, shown: int = 50) -> DataFrame:
    """Issues with ``linked_from``, the first urls of the pages that link to the affected url, and ``linking_pages``, how
    many there are. ``linking_rows`` has them all."""
    rows = checkpointed(linking_rows(issues, pages, internal_only))
    counted = rows.groupBy("affected_url").agg(F.count(F.lit(1)).alias("linking_pages")).join(first_of(rows, "affected_url", "source", shown, "linked_from"), "affected_url")
    joined = issues.join(counted, "affected_url", "left")
    return joined.withColumns({"linked_from": F.coalesce("linked_from", F.array().cast("array<string>")), "linking_pages": F.coalesce("linking_pages", F.lit(0))})


def grouped_for_report(issues: DataFrame, shown: int = 50) -> DataFrame:
    """By (rule, title): count, the first urls in order, severity of the first issue by id. The rows have all urls."""
    keyed = issues.withColumn("_key", F.concat_ws("\u0001", "rule_id", F.coalesce("title", F.lit(""))))
    counted = keyed.groupBy("_key", "rule_id", "title").agg(F.min_by("severity", "issue_id").alias("severity"), F.count(F.lit(1)).alias("instances"))
    return counted.join(first_of(keyed, "_key", "affected_url", shown, "urls"), "_key").drop("_key").select("rule_id", "title", "severity", "instances", "urls")


def grouped_for_view(issues: DataFrame) -> DataFrame:
    """By (rule, title): count and highest severity, worst and largest first."""
    found = issues.groupBy("rule_id", "title").agg(F.max(severity_rank("severity")).alias("rank"), F.count(F.lit(1)).alias("instances"))
    return found.orderBy(F.desc("rank"), F.desc("instances"), "rule_id", "title")


def counts(issues: DataFrame, linked: bool = False) -> DataFrame:
    """Counts by severity and by category in one pass (grouping sets)."""
    sets = [[F.col("severity")], [F.col("category")]]
    return issues.groupingSets(sets, "severity", "category").agg(F.count(F.lit(1)).alias("n"))


def category_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy(F.concat_ws(":", "category", "severity").alias("key")).agg(F.count(F.lit(1)).alias("n"))
