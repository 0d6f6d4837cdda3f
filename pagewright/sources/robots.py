"""robots.txt and sitemaps: parsing, matching, expansion."""

from __future__ import annotations

import gzip
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import urls
from pagewright.session import checkpointed


def parse_robots(lines: DataFrame) -> DataFrame:
    """``site, group_ix, user_agent, kind, pattern`` from ``(site, line_no, line)``.

    Every user-agent line opens a group; allow, disallow and crawl-delay lines before the first belong to none and are
    dropped; sitemap lines count anywhere (group 0 before the first).
    """
    text = F.trim(F.regexp_replace("line", r"[\r\t]", " "))
    split = lines.select("site", "line_no", text.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#") & F.col("t").contains(":"))
    parts = split.select(
        "site", "line_no", F.lower(F.trim(F.substring_index("t", ":", 1))).alias("kind"), F.trim(F.expr("substring(t, instr(t, ':') + 1)")).alias("pattern")
    )
    so_far = Window.partitionBy("site").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.col("kind") == "user-agent"
    grouped = parts.withColumn("group_ix", F.sum(agent.cast("int")).over(so_far)).withColumn("user_agent", F.last(F.when(agent, F.lower("pattern")), ignorenulls=True).over(so_far))
    wanted = F.col("kind").isin("allow", "disallow", "crawl-delay") & (F.col("group_ix") > 0) | (F.col("kind") == "sitemap")
    return grouped.where(wanted).select("site", "group_ix", "user_agent", "kind", "pattern", "line_no")


def js_pattern(pattern):
    """The regular expression a pattern with ``*`` stands for: other characters keep their meaning, the end is open."""
    return F.concat(F.lit("^"), F.regexp_replace(pattern, r"\*", ".*"), F.lit(".*"))


def matches(path, pattern):
    """Prefix match; ``/`` matches all, an empty pattern nothing; ``*`` is a wildcard; a final ``$`` alone means equal."""
    return (
        F.when(pattern == "", False)
        .when(pattern == "/", True)
        .when(pattern.contains("*"), F.regexp_like(path, js_pattern(pattern)))
        .when(pattern.endswith("$"), path == F.expr("substring(pattern, 1, length(pattern) - 1)"))
        .otherwise(F.startswith(path, pattern))
    )


def literal_prefix(pattern):
    """What every path that a pattern matches begins with, as far as it can be read off the pattern.

    In patterns with ``*`` all other characters keep their meaning in a regular expression: the prefix ends before the
    first that has one, and before the character that a quantifier refers to; an alternative leaves none.
    """
    plain = F.regexp_extract(pattern, r"^[^.?+()\[\]{}|^$\\*]*", 0)
    quantified = F.regexp_like(F.substr(pattern, F.length(plain) + 1, F.lit(1)), F.lit(r"[?+{]"))
    wild = F.when(pattern.contains("|"), "").when(quantified, F.substr(plain, F.lit(1), F.greatest(F.length(plain) - 1, F.lit(0)))).otherwise(plain)
    return (
        F.when(pattern == "/", "")
        .when(pattern.contains("*"), wild)
        .when(pattern.endswith("$"), F.substr(pattern, F.lit(1), F.length(pattern) - 1))
        .otherwise(pattern)
    )


def rules_met(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``site, _path`` and the rules that may match it: those whose literal prefix begins the path.

    Each path is cut at the lengths that its site's prefixes have, and the cuts meet the rules by (site, prefix): a path
    makes as many rows as the site has different lengths, however many rules there are.
    """
    keyed = rules.where("pattern <> ''").withColumn("_prefix", literal_prefix(F.col("pattern")))
    lengths = keyed.groupBy("site").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    fits = F.filter("_lengths", lambda n: n <= F.length("_path"))
    cuts = paths.join(lengths, "site").select("site", "_path", F.explode(fits).alias("_n"))
    return cuts.withColumn("_prefix", F.substr("_path", F.lit(1), F.col("_n"))).join(keyed, ["site", "_prefix"]).drop("_n", "_prefix")


def allowed(pages: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Pages with ``allowed``: blocked if in any group for the agent the longest disallow beats the longest allow.

    Rules meet paths by site and literal prefix; only patterns with ``*`` are regular expressions then. Sites without
    rules allow everything.
    """
    mine = rules.where(F.col("kind").isin("allow", "disallow") & F.col("user_agent").isin("*", agent.lower()))
    target = pages.withColumn("site", urls.normal_host(urls.host(url))).withColumn("_path", F.concat(urls.path(url), F.regexp_extract(F.col(url), r"(\?[^#]*)", 1)))
    met = rules_met(target.select("site", "_path").distinct(), mine).where(matches(F.col("_path"), F.col("pattern")))
    longest = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.length("pattern"))), F.lit(-1))
    per_group = met.groupBy("site", "_path", "group_ix").agg((longest("disallow") > longest("allow")).alias("_no"))
    blocked = per_group.groupBy("site", "_path").agg(F.bool_or("_no").alias("_blocked"))
    return target.join(blocked, ["site", "_path"], "left").withColumn("allowed", ~F.coalesce("_blocked", F.lit(False))).drop("site", "_path", "_blocked")


def crawl_delay(rules: DataFrame, agent: str = "*") -> DataFrame:
    """``site, delay`` of the first group for the agent."""
    mine = rules.where((F.col("kind") == "crawl-delay") & F.col("user_agent").isin("*", agent.lower()))
    return mine.groupBy("site").agg(F.min_by(F.expr("try_cast(pattern as double)"), "line_no").alias("delay"))


def robots_sitemaps(rules: DataFrame) -> DataFrame:
    """``site, sitemaps``: distinct, in order of first mention."""
    named = rules.where("kind = 'sitemap'")
    return named.groupBy("site").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pattern"))), lambda x: x["pattern"])).alias("sitemaps"))


@F.pandas_udf(T.StringType())
def sitemap_text(body: pd.Series) -> pd.Series:
    """Text of a sitemap file, unpacked if it starts like gzip; null if it cannot be read."""

    def text(raw):
        if raw is None:
            return None
        try:
            data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            return data.decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    return pd.Series([text(b) for b in body], dtype=object)


# The entities that XML defines.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def sitemap_locations(docs: DataFrame) -> DataFrame:
    """``sitemap_url, is_index, loc`` per location of ``(sitemap_url, body)``."""
    read = docs.select("sitemap_url", sitemap_text("body").alias("xml")).where("xml is not null")
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<loc[^>]*>(.*?)</loc>"), F.lit(1))
    found = read.select("sitemap_url", F.regexp_like("xml", F.lit(r"(?i)<sitemapindex[\s>]")).alias("is_index"), F.explode(locs).alias("loc"))
    plain = F.regexp_replace(F.trim("loc"), r"^<!\[CDATA\[|\]\]>$", "")
    for entity, sign in ENTITIES:
        plain = F.regexp_replace(plain, re.escape(entity), sign)
    return found.withColumn("loc", F.trim(plain)).where("loc <> ''")


def sitemap_pages(start: DataFrame, docs: DataFrame, site_host: str) -> DataFrame:
    """``url``: page locations reached from the sitemaps in ``start`` through sitemap indexes, same site and pages only.

    ``docs`` holds the fetched files. References are compared in their normal form, so relative ones and ones with ``www.``
    meet their files. Each round reads the files of a level and keeps those not seen before; rounds go on until nothing is
    new, however deep indexes are nested.
    """
    root = F.lit(f"https://{site_host}")
    normal = lambda c: F.coalesce(urls.sitemap_url(c, root), F.col(c))
    locations = sitemap_locations(docs)
    locations = checkpointed(locations.withColumns({"sitemap_url": normal("sitemap_url"), "loc": F.when(F.col("is_index"), normal("loc")).otherwise(F.col("loc"))}))
    seen = checkpointed(start.select(normal("sitemap_url").alias("sitemap_url")).distinct())
    frontier = seen
    while True:
        nested = locations.where("is_index").join(frontier, "sitemap_url", "left_semi").select(F.col("loc").alias("sitemap_url")).distinct()
        frontier = checkpointed(nested.join(seen, "sitemap_url", "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.union(frontier))
    pages = locations.where("not is_index").join(seen, "sitemap_url", "left_semi").select(F.col("loc").alias("url")).distinct()
    return pages.where(urls.same_site(urls.host("url"), F.lit(site_host)) & urls.is_page("url"))
