"""Dashboard aggregates, page checklists and evidence reports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.jsonld import valid_blocks
from pagewright.functions.text import CATEGORIES, blank, rounded, severity_rank, trimmed, utf16_length

DAYS = 7
BUCKETS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def calendar(spark, today: Column, days: int = DAYS) -> DataFrame:
    """``day``: the last ``days`` days, ``today`` included (UTC)."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))


def issues_by_day(issues: DataFrame, today: Column, days: int = DAYS) -> DataFrame:
    """``day, label, critical, high, medium, low``, zero-filled; no rows if no issue at all was seen in the window.

    INFO issues count for "any issue seen" but have no column.
    """
    live = issues.where(F.col("status").isin("ACTIVE", "WHITELISTED")).withColumn("day", F.to_date("last_detected_at"))
    live = live.where(F.col("day").between(F.date_sub(today, days - 1), today))
    counted = live.groupBy("day").agg(F.count(F.lit(1)).alias("any"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in BUCKETS])
    seen = counted.agg(F.sum("any").alias("seen"))
    joined = calendar(issues.sparkSession, today, days).join(counted, "day", "left").join(F.broadcast(seen)).where("seen > 0")
    return joined.select("day", F.date_format("day", "MMM d").alias("label"), *[F.coalesce(s.lower(), F.lit(0)).alias(s.lower()) for s in BUCKETS])


def crawl_score(diff: Column) -> Column:
    """Health score noted in a crawl's JSON; null unless it is a number."""
    return F.try_variant_get(F.try_parse_json(diff), "$.postProcessing.healthScore", "double")


def health_trend(crawls: DataFrame, today: Column, days: int = DAYS) -> DataFrame:
    """``day, score``: mean noted score of the crawls completed that day, one digit; null for gaps."""
    done = crawls.where("status = 'COMPLETED'").select(F.to_date("completed_at").alias("day"), crawl_score(F.col("diff")).alias("score")).where("score is not null")
    daily = done.groupBy("day").agg(rounded(F.avg("score"), 1).alias("score"))
    return calendar(crawls.sparkSession, today, days).join(daily, "day", "left")


def portfolio(projects: DataFrame) -> DataFrame:
    """One row: pages, issues and rounded mean score over projects."""
    return projects.agg(F.sum("total_pages").alias("pages"), F.sum("total_issues").alias("issues"), rounded(F.avg("health_score")).alias("score"))


def crawl_history(crawls: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` crawls, completed ones only, oldest first."""
    latest = crawls.orderBy(F.desc("created_at"), F.desc("crawl_id")).limit(n)
    return latest.where("status = 'COMPLETED'").orderBy("created_at", "crawl_id")


def relation_counts(pages: DataFrame, issues: DataFrame, agents: DataFrame) -> DataFrame:
    """One row: pages, active issues, agents."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(pages, "pages").join(F.broadcast(one(issues.where("status = 'ACTIVE'"), "issues"))).join(F.broadcast(one(agents, "agents")))


def qualification_delta(runs: DataFrame, score: Column, project_score: Column) -> Column:
    """``score`` less the last completed run's, or the project's; as a scalar over ``runs``."""
    last = runs.where("status = 'COMPLETED'").agg(F.max_by("health_score", "created_at")).scalar()
    return score - F.coalesce(last, project_score)


# Comfortable lengths of titles and descriptions.
TITLE_RANGE, DESCRIPTION_RANGE = (25, 65), (70, 170)


def checklist(enriched: DataFrame, issues: DataFrame) -> DataFrame:
    """``page_id`` and 13 statuses (ok, warn, error) per page; issues count while they are active."""
    live = issues.where("status = 'ACTIVE'")
    flags = live.groupBy(F.col("affected_url").alias("url")).agg(F.collect_set("rule_id").alias("rules"), F.collect_set("category").alias("cats"))
    page = enriched.join(flags, "url", "left")
    has = lambda column, *names: F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, names))), F.lit(False))
    pick = lambda error, warn: F.when(error, "error").when(warn, "warn").otherwise("ok")
    never = F.lit(False)
    title, description = utf16_length(trimmed("title")), utf16_length(trimmed("meta_description"))
    noindex = F.coalesce(F.lower("meta_robots").contains("noindex"), never)
    og_missing = lambda n: blank(F.try_element_at("og_tags", F.lit(f"og:{n}")))
    status = F.col("status_code")
    # blocks are judged in an Arrow function; a page without any passes null
    page = page.withColumn("blocks_valid", F.coalesce(valid_blocks("json_ld"), never))
    return page.select(
        "page_id",
        pick(blank("canonical_url"), F.col("canon_norm") != F.col("norm_url")).alias("canonical"),
        pick(blank("title") | blank("meta_description"), ~title.between(*TITLE_RANGE) | ~description.between(*DESCRIPTION_RANGE)).alias("meta"),
        pick(never, noindex).alias("robots"),
        pick(~F.col("blocks_valid"), never).alias("structured_data"),
        pick(has("rules", "LNK-007", "CRW-002"), has("rules", "LNK-006") | (F.col("n_il") == 0)).alias("links"),
        pick(status >= 400, status.isNull() | (status >= 300)).alias("http"),
        pick(never, F.coalesce(F.exists("images", lambda i: blank(i["alt"])), never)).alias("media"),
        pick(never, F.coalesce(F.size("hreflang_tags"), F.lit(0)) <= 0).alias("i18n"),
        F.when(F.coalesce(status != 200, F.lit(True)) | noindex, "error").when(has("cats", "INDEXABILITY"), "warn").otherwise("ok").alias("indexability"),
        pick(never, F.coalesce(F.col("response_time") > 3000, never) | has("cats", "PERFORMANCE")).alias("performance"),
        pick(never, ~F.col("url").startswith("https://") | has("rules", "CRW-007") | has("cats", "SECURITY")).alias("security"),
        pick(never, has("cats", "MOBILE")).alias("mobile"),
        pick(never, has("cats", "SOCIAL") | og_missing("title") | og_missing("description") | og_missing("url")).alias("social"),
    )


def category_coverage(issues: DataFrame) -> DataFrame:
    """``category, issues, state`` for all twelve categories: ok without issues, error from HIGH up, else warn."""
    found = issues.where("status = 'ACTIVE'").groupBy("category").agg(F.count(F.lit(1)).alias("issues"), F.max(severity_rank("severity")).alias("worst"))
    every = issues.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    state = F.when(F.col("issues").isNull(), "ok").when(F.col("worst") >= 4, "error").otherwise("warn")
    return every.join(found, "category", "left").select("category", F.coalesce("issues", F.lit(0)).alias("issues"), state.alias("state"))


def _flatten(value, path: str, depth: int, out: list[str], most: int) -> None:
    if len(out) >= most:
        return
    if isinstance(value, dict) and depth < 4 and value:
        for k, v in value.items():
            _flatten(v, f"{path}.{k}" if path else k, depth + 1, out, most)
    elif isinstance(value, list) and depth < 4 and value:
        for i, v in enumerate(value):
            _flatten(v, f"{path}[{i}]", depth + 1, out, most)
    else:
        out.append(f"{path}: {value if isinstance(value, str) else json.dumps(value)}")


@F.pandas_udf(T.ArrayType(T.StringType()))
def evidence_lines(evidence: pd.Series) -> pd.Series:
    """``path: value`` lines of a JSON text, four levels deep, the first 250."""

    def lines(text):
        out: list[str] = []
        try:
            _flatten(json.loads(text), "", 0, out, 250)
        except (TypeError, ValueError):
            return []
        return out[:250]

    return pd.Series([lines(t) for t in evidence])


_URL = re.compile(r"^https?://", re.IGNORECASE)


def _texts(value):
    if isinstance(value, str):
        yield value
    for item in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from _texts(item)


@F.pandas_udf(T.ArrayType(T.StringType()))
def evidence_urls(evidence: pd.Series, affected_url: pd.Series) -> pd.Series:
    """The affected url and every http(s) text anywhere in the evidence, each once, in order."""

    def found(text, url):
        try:
            inside = [t for t in _texts(json.loads(text)) if _URL.match(t)]
        except (TypeError, ValueError):
            inside = []
        return list(dict.fromkeys([*([url] if url else []), *inside]))

    return pd.Series([found(t, u) for t, u in zip(evidence, affected_url)])


def unread(notifications: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Unread notifications, of given types if any are given."""
    out = notifications.where(~F.coalesce("is_read", F.lit(False)))
    return out.where(F.col("type").isin(kinds)) if kinds else out
