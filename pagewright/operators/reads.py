"""Read queries: crawl windows, listings, context selection, findings out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import blank, contains_ci, severity_rank, trimmed

# Kinds of findings.
FINDING_TYPES = ("issue", "recommendation", "observation")
LEVELS = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def crawl_window(crawls: DataFrame, now: Column) -> DataFrame:
    """One row ``crawl_id, start, end, is_initial`` for the latest completed crawl; none if there is none."""
    done = crawls.where("status = 'COMPLETED'")
    noted = F.try_to_timestamp(F.get_json_object("diff", "$.postProcessing.completedAt"))
    latest = done.agg(F.max_by(F.struct("crawl_id", "created_at", "completed_at", noted.alias("noted"), "diff"), "created_at").alias("c"), F.count(F.lit(1)).alias("n"))
    return latest.where("c is not null").select(
        "c.crawl_id", F.col("c.created_at").alias("start"), F.coalesce("c.noted", "c.completed_at", now).alias("end"), (F.col("n") == 1).alias("is_initial"), "c.diff"
    )


def window_issues(issues: DataFrame, window: DataFrame) -> DataFrame:
    """Issues with ``delta``: new, resolved or persisted in the window; an issue can be new and resolved at once."""
    joined = issues.join(F.broadcast(window.select("start", "end")))
    new = F.col("first_detected_at").between(F.col("start"), F.col("end"))
    resolved = F.col("resolved_at").between(F.col("start"), F.col("end"))
    persisted = (F.col("first_detected_at") < F.col("start")) & F.col("last_detected_at").between(F.col("start"), F.col("end")) & (F.col("status") != "RESOLVED")
    kinds = F.filter(F.array(F.when(new, F.lit("new")), F.when(resolved, F.lit("resolved")), F.when(persisted, F.lit("persisted"))), lambda k: k.isNotNull())
    return joined.withColumn("delta", F.explode(kinds)).drop("start", "end")


def window_summary(issues: DataFrame, window: DataFrame) -> DataFrame:
    found = window_issues(issues, window)
    return found.agg(*[F.count_if(F.col("delta") == k).alias(k) for k in ("new", "resolved", "persisted")])


def window_urls(window: DataFrame, kind: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """``pos, url``: a page of the new, removed or changed urls that the crawl noted."""
    listed = F.from_json(F.get_json_object("diff", f"$.{kind}"), "array<string>")
    return window.select(F.posexplode(listed).alias("pos", "url")).where(F.col("pos").between(offset, offset + limit - 1))


#: When an issue of a bucket was new, resolved or seen again.
MOMENT = {"new": "first_detected_at", "resolved": "resolved_at", "persisted": "last_detected_at"}


def capped_issues(issues: DataFrame, window: DataFrame, most: int) -> DataFrame:
    """Issues with ``delta, moment, place``: the first ``most`` new, resolved and persisted ones, the severest and latest first."""
    moment = F.coalesce(*[F.when(F.col("delta") == k, F.col(c)) for k, c in MOMENT.items()])
    place = F.row_number().over(Window.partitionBy("delta").orderBy(F.desc(severity_rank("severity")), F.desc("moment"), "issue_id"))
    found = window_issues(issues, window).withColumn("moment", moment)
    return found.withColumn("place", place).where(F.col("place") <= most)


def capped_delta(window: DataFrame, listed: DataFrame, new: int, removed: int, changed: int) -> DataFrame:
    """One row for the latest crawl: ``crawl_id, is_initial, new_pages, removed_pages, changed_pages, trimmed, new_issues,
    resolved_issues, persisted_issues, active_issues``.

    ``window`` is ``crawl_window``'s row and ``listed`` the rows of ``capped_issues``. Urls that the crawl noted are cut at the
    given lengths, and ``trimmed`` says whether any list was longer. Entries that are not texts, and changed pages without a
    url, do not count. What post-processing noted of new and active issues stands before what is listed.
    """
    noted = lambda path: F.get_json_object("diff", f"$.{path}")

    def texts(path: str) -> Column:
        items = F.from_json(noted(path), "array<variant>")
        kept = F.filter(items, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
        return F.coalesce(F.transform(kept, lambda v: v.cast("string")), F.array().cast("array<string>"))

    entries = F.from_json(noted("crawlDiff.changedPages"), "array<struct<url: string, changes: array<struct<field: string, oldValue: variant, newValue: variant>>>>")
    value = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    changes = lambda e: F.transform(F.filter(e["changes"], lambda c: c.isNotNull()), lambda c: F.struct(F.coalesce(c["field"], F.lit("unknown")).alias("field"), value(c["oldValue"]).alias("old"), value(c["newValue"]).alias("new")))
    pages = F.transform(F.filter(entries, lambda e: F.coalesce(e["url"] != "", F.lit(False))), lambda e: F.struct(e["url"].alias("url"), F.coalesce(changes(e), F.array()).alias("changes")))
    full = window.select("crawl_id", "is_initial", "diff", texts("crawlDiff.newPages").alias("_new"), texts("crawlDiff.removedPages").alias("_removed"), F.coalesce(pages, F.array()).alias("_changed"))
    counted = listed.agg(*[F.count_if(F.col("delta") == k).alias(f"_{k}_issues") for k in MOMENT])
    number = lambda path: F.try_variant_get(F.try_parse_json(noted(path)), "$", "bigint")
    trimmed = (F.size("_new") > new) | (F.size("_removed") > removed) | (F.size("_changed") > changed)
    return full.join(F.broadcast(counted)).select(
        "crawl_id", "is_initial", F.slice("_new", 1, new).alias("new_pages"), F.slice("_removed", 1, removed).alias("removed_pages"), F.slice("_changed", 1, changed).alias("changed_pages"), trimmed.alias("trimmed"),
        F.coalesce(number("postProcessing.newIssueCount"), "_new_issues").alias("new_issues"), F.col("_resolved_issues").alias("resolved_issues"), F.col("_persisted_issues").alias("persisted_issues"), number("postProcessing.activeIssueCount").alias("active_issues"),
    )


def list_pages(pages: DataFrame, url: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Pages by url with link and image counts."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    kept = pages.where(contains_ci("url", url)) if url else pages
    missing = F.coalesce(F.size(F.filter("images", lambda i: blank(i["alt"]))), F.lit(0))
    return (
        kept.orderBy("url", "page_id").offset(offset).limit(limit)
        .select("page_id", "url", "title", "status_code", size("internal_links").alias("internal_links"), size("external_links").alias("external_links"), size("images").alias("images"), missing.alias("images_without_alt"))
    )


def search_pages(pages: DataFrame, text: str, limit: int = 50) -> DataFrame:
    hit = contains_ci("url", text) | F.coalesce(contains_ci("title", text), F.lit(False))
    return pages.where(hit).orderBy("url", "page_id").limit(limit).select("page_id", "url", "title", "status_code")


def pages_by_url(pages: DataFrame, wanted: list[str], cap: int = 50) -> DataFrame:
    """Pages of the first ``cap`` distinct trimmed urls asked for."""
    names = list(dict.fromkeys(u.strip() for u in wanted if u and u.strip()))[:cap]
    return pages.where(F.col("url").isin(names))


def list_issues(issues: DataFrame, severity: str | None = None, rule: str | None = None, url: str | None = None, limit: int = 50) -> DataFrame:
    out = issues.where("status = 'ACTIVE'")
    out = out.where(F.col("severity") == severity.upper()) if severity else out
    out = out.where(contains_ci("rule_id", rule)) if rule else out
    out = out.where(contains_ci("affected_url", url)) if url else out
    return out.orderBy(F.desc(severity_rank("severity")), "affected_url", "issue_id").limit(limit)


def context_pages(pages: DataFrame, new: DataFrame, removed: DataFrame, changed: DataFrame, cap: int) -> DataFrame:
    """Up to ``cap`` pages: new, removed and changed urls first, then by url."""
    first = lambda df, n: df.select("url", F.lit(n).alias("_p"))
    named = first(new, 0).union(first(removed, 1)).union(first(changed, 2)).groupBy("url").agg(F.min("_p").alias("_p"))
    return pages.join(named, "url", "left").orderBy(F.coalesce("_p", F.lit(3)), "url", "page_id").limit(cap).drop("_p")


def latest_per(rows: DataFrame, key: str, when: str, n: int = 1) -> DataFrame:
    """The newest ``n`` rows per key."""
    newest = Window.partitionBy(key).orderBy(F.desc(when), *[F.desc(c) for c in rows.columns if c.endswith("_id") and c != key])
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def previous_findings(runs: DataFrame, findings: DataFrame, agent_id: str, cap: int = 50) -> DataFrame:
    """Findings of the agent's latest successful run."""
    last = runs.where((F.col("agent_id") == agent_id) & (F.col("status") == "SUCCESS")).agg(F.max_by("run_id", "created_at").alias("run_id"))
    return findings.join(F.broadcast(last), "run_id", "left_semi").orderBy("created_at", "finding_id").limit(cap)


def project_list(projects: DataFrame, user_id: str) -> DataFrame:
    """A user's projects, the one changed last first."""
    return projects.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "project_id")


def notification_list(notifications: DataFrame, projects: DataFrame, user_id: str, project_id: str | None = None, limit: int = 50) -> DataFrame:
    """A user's newest notifications with the name of their project."""
    mine = notifications.where(F.col("user_id") == user_id)
    if project_id is not None:
        mine = mine.where(F.col("project_id") == project_id)
    newest = mine.orderBy(F.desc("created_at"), F.desc("notification_id")).limit(limit)
    return newest.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left").orderBy(F.desc("created_at"), F.desc("notification_id"))


def newest(rows: DataFrame, project_id: str, tie: str, limit: int) -> DataFrame:
    """A project's newest rows, newest first; ``tie`` decides between rows of one time."""
    return rows.where(F.col("project_id") == project_id).orderBy(F.desc("created_at"), F.desc(tie)).limit(limit)


def delivery_list(deliveries: DataFrame, project_id: str, limit: int = 50) -> DataFrame:
    """The newest webhook deliveries of a project."""
    return newest(deliveries, project_id, "delivery_id", limit)


def qualification_runs(runs: DataFrame, project_id: str, limit: int = 20) -> DataFrame:
    """The newest qualification runs of a project."""
    return newest(runs, project_id, "run_id", limit)


def agent_with_runs(agents: DataFrame, runs: DataFrame, findings: DataFrame, most: int = 20, shown: int = 50) -> DataFrame:
    """Agents with ``runs``, the newest first, each with its first ``findings`` and how many there are."""
    kept = latest_per(runs, "agent_id", "created_at", most)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "finding_id"))
    first = findings.withColumn("_n", place).where(F.col("_n") <= shown)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_n", "finding_id", "severity", "title"))), lambda f: F.struct(f["finding_id"], f["severity"], f["title"]))
    per_run = first.groupBy("run_id").agg(items.alias("findings")).join(findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_findings")), "run_id")
    told = kept.join(per_run, "run_id", "left").withColumns({"findings": F.coalesce("findings", F.array().cast("array<struct<finding_id: long, severity: string, title: string>>")), "n_findings": F.coalesce("n_findings", F.lit(0))})
    newest = F.sort_array(F.collect_list(F.struct("created_at", "run_id", "status", "n_findings", "findings")), asc=False)
    return agents.join(told.groupBy("agent_id").agg(newest.alias("runs")), "agent_id", "left")


def project_summary(projects: DataFrame, pages: DataFrame, issues: DataFrame, project_id: str) -> DataFrame:
    mine = F.col("project_id") == project_id
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (
        projects.where(mine)
        .join(F.broadcast(one(pages.where(mine), "stored_pages")))
        .join(F.broadcast(one(issues.where(mine & (F.col("status") == "ACTIVE")), "active_issues")))
    )


def evidence_summary(evidence: Column) -> Column:
    """Keys of a JSON object and its first five values as texts."""
    keys = F.json_object_keys(evidence)
    values = F.transform(F.slice(keys, 1, 5), lambda k: F.try_element_at(F.from_json(evidence, "map<string, string>"), k))
    return F.struct(keys.alias("keys"), values.alias("values"))


def json_in_text(text: Column) -> Column:
    """The JSON in an answer: the whole text, a fenced block, or what lies between the outermost brackets; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    array, object_ = F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    candidates = [F.trim(text), F.trim(fenced), array, object_]
    return F.coalesce(*[F.when(F.try_parse_json(c).isNotNull() & (c != ""), c) for c in candidates])


def findings(answers: DataFrame, text: str = "text") -> DataFrame:
    """Findings in free-text answers, normalised; rows without title or description, or of unknown kind, are dropped.

    A lone object counts as a list of one; confidence outside 0..1 and other fields of the wrong type become null.
    """
    found = json_in_text(F.col(text))
    listed = F.when(found.startswith("["), found).when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]")))
    items = answers.withColumn("_item", F.explode(F.from_json(listed, "array<string>")))
    v = F.try_parse_json("_item")
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    kind = F.lower(F.coalesce(get("type"), F.lit("observation")))
    level = F.upper(F.coalesce(get("severity"), F.lit("MEDIUM")))
    confidence = F.try_variant_get(v, "$.confidence", "double")
    urls = F.coalesce(F.from_json(F.get_json_object("_item", "$.affectedUrls"), "array<string>"), F.when(get("affectedUrls").isNotNull(), F.array(get("affectedUrls"))), F.array().cast("array<string>"))
    out = items.select(
        *answers.columns,
        kind.alias("type"),
        level.alias("severity"),
        trimmed(get("title")).alias("title"),
        trimmed(get("description")).alias("description"),
        F.filter(urls, lambda u: ~blank(u)).alias("affected_urls"),
        F.when(confidence.between(0, 1), confidence).alias("confidence"),
    )
    return out.where(F.col("type").isin(*FINDING_TYPES) & F.col("severity").isin(*LEVELS) & ~blank("title") & ~blank("description"))


def fits(value: Column, most: int) -> Column:
    """True if the value's JSON text has at most ``most`` characters."""
    return F.length(F.to_json(value)) <= most
