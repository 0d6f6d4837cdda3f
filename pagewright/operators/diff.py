"""Snapshot comparison, sitemap coverage and graph change flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls

FIELDS = ("title", "meta_description", "status_code")


def content_hash() -> Column:
    """SHA-256 over the content fields as JSON, nulls spelled out."""
    content = F.struct("title", "meta_description", "status_code", "h1", "word_count")
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def keyed(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """One page per comparable url, the last in ``order`` winning, with its content hash."""
    key = urls.lenient("url")
    columns = [*FIELDS, "h1", "url"]
    rows = pages.select(key.alias("key"), F.struct(*columns, content_hash().alias("hash"), F.col(order).alias("_order")).alias("row"))
    return rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by("row", F.struct(F.length(F.col("row._order").cast("string")), "row._order")).alias("row"))


def compare(current: DataFrame, previous: DataFrame, order: str = "page_id") -> DataFrame:
    """``key, url, change, fields, hash_changed`` for pages that are new, removed or changed; one full outer join.

    ``fields`` lists title, meta description and status where they differ (null-safe) and headings where their joined
    text does; ``change`` is 'changed' if a field or the content hash differs.
    """
    cur, prev = keyed(current, order).withColumnRenamed("row", "c"), keyed(previous, order).withColumnRenamed("row", "p")
    both = cur.join(prev, "key", "full_outer")
    differs = [F.when(~F.col(f"c.{f}").eqNullSafe(F.col(f"p.{f}")), F.lit(f)) for f in FIELDS]
    heading = lambda side: F.array_join(F.coalesce(f"{side}.h1", F.array().cast("array<string>")), ", ")
    fields = F.filter(F.array(*differs, F.when(heading("c") != heading("p"), F.lit("h1"))), lambda f: f.isNotNull())
    kept = F.col("c").isNotNull() & F.col("p").isNotNull()
    out = both.select(
        "key",
        F.coalesce("c.url", "p.url").alias("url"),
        F.when(kept, fields).otherwise(F.array().cast("array<string>")).alias("fields"),
        (kept & (F.col("c.hash") != F.col("p.hash"))).alias("hash_changed"),
        F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "removed").otherwise("kept").alias("change"),
    )
    changed = (F.col("change") == "kept") & ((F.size("fields") > 0) | F.col("hash_changed"))
    return out.withColumn("change", F.when(changed, "changed").otherwise(F.col("change"))).where("change <> 'kept'")


def summary(changes: DataFrame) -> DataFrame:
    """One row: pages new, removed, changed by field, changed by hash, and changed at all."""
    field = (F.col("change") == "changed") & (F.size("fields") > 0)
    return changes.agg(
        F.count_if(F.col("change") == "new").alias("new_pages"),
        F.count_if(F.col("change") == "removed").alias("removed_pages"),
        F.count_if(field).alias("field_changed"),
        F.count_if(F.col("hash_changed")).alias("hash_changed"),
        F.count_if(F.col("change") == "changed").alias("changed_pages"),
    )


def coverage(crawled: DataFrame, sitemap: DataFrame, url: str = "url") -> DataFrame:
    """``url, coverage``: 'missing_from_sitemap' and 'sitemap_only'; nothing if the sitemap is empty."""
    a = crawled.select(urls.lenient(url).alias("url")).distinct()
    b = sitemap.select(urls.lenient(url).alias("url")).where("url is not null").distinct()
    if b.isEmpty():
        return a.limit(0).withColumn("coverage", F.lit(""))
    left = a.join(b, "url", "left_anti").withColumn("coverage", F.lit("missing_from_sitemap"))
    return left.union(b.join(a, "url", "left_anti").withColumn("coverage", F.lit("sitemap_only")))


# Site-wide rules of sitemap coverage.
COVERAGE_RULES = {"no_sitemap": ("CRW-SITEMAP-001", "HIGH"), "missing_from_sitemap": ("CRW-SITEMAP-002", "MEDIUM"), "sitemap_only": ("CRW-SITEMAP-003", "MEDIUM")}
EXAMPLES = 25


def coverage_issues(covered: DataFrame, site_url: str, has_sitemap: bool = True) -> DataFrame:
    """At most three site-wide findings, with up to 25 example urls each (the smallest)."""
    if not has_sitemap:
        rule, severity = COVERAGE_RULES["no_sitemap"]
        return covered.sparkSession.createDataFrame([(rule, "CRAWLABILITY", severity, site_url, None, None)], "rule_id string, category string, severity string, affected_url string, page_id string, evidence string")
    numbered = covered.withColumn("_n", F.expr("row_number() over (partition by coverage order by url)"))
    found = numbered.groupBy("coverage").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("_n") <= EXAMPLES, F.col("url")))).alias("examples"))
    pick = lambda i: F.coalesce(*[F.when(F.col("coverage") == k, F.lit(v[i])) for k, v in COVERAGE_RULES.items()])
    return found.select(
        pick(0).alias("rule_id"), F.lit("CRAWLABILITY").alias("category"), pick(1).alias("severity"), F.lit(site_url).alias("affected_url"), F.lit(None).cast("string").alias("page_id"), F.to_json(F.struct("n", "examples")).alias("evidence")
    )


def diagnostics(changes: DataFrame, covered: DataFrame, most: int = 500) -> DataFrame:
    """One row of nested crawl diagnostics; lists hold the first ``most`` urls in order."""

    def first(rows: DataFrame, name: str) -> DataFrame:
        top = rows.orderBy("url").limit(most).agg(F.sort_array(F.collect_list("url")).alias(f"{name}_urls"))
        return rows.agg(F.count(F.lit(1)).alias(name)).join(F.broadcast(top))

    parts = [first(changes.where(F.col("change") == c), c) for c in ("new", "removed", "changed")]
    parts += [first(covered.where(F.col("coverage") == c), c) for c in ("missing_from_sitemap", "sitemap_only")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # one row each
    return out


def robots_diagnostics(files: DataFrame, rules: DataFrame, configured: DataFrame) -> DataFrame:
    """``site, robots_url, found, fetch_error, sitemaps, sitemap_missing`` per site.

    ``files`` has the fetched robots files (``site, scheme, status_code, error``), ``rules`` their parsed lines and ``configured``
    the sites whose owner named a sitemap. A file is found if its status is a success; another status is an error of its own.
    A sitemap is missing where neither the file nor the owner names one.
    """
    named = rules.where("kind = 'sitemap'").groupBy("site").agg(F.count_distinct("pattern").alias("sitemaps"))
    own = configured.select("site").distinct().withColumn("_own", F.lit(True))
    found = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    error = F.when(~found, F.coalesce("error", F.concat(F.lit("robots.txt returned HTTP "), "status_code")))
    joined = files.join(named, "site", "left").join(own, "site", "left")
    sitemaps = F.coalesce("sitemaps", F.lit(0)).cast("long")
    return joined.select(
        "site", F.concat("scheme", F.lit("://"), "site", F.lit("/robots.txt")).alias("robots_url"), found.alias("found"), error.alias("fetch_error"), sitemaps.alias("sitemaps"), ((sitemaps == 0) & F.col("_own").isNull()).alias("sitemap_missing")
    )


def discovery_diagnostics(seeds: DataFrame, linked: DataFrame) -> DataFrame:
    """``site, seed_urls, sitemap_seeds, via_links`` per site: different urls that the crawl began with, those of them that a
    sitemap named, and those that only links led to.

    ``seeds`` holds ``site, url, from_sitemap``; ``linked`` holds ``site, url`` of the links that were followed.
    """
    began = seeds.groupBy("site", "url").agg(F.bool_and("from_sitemap").alias("from_sitemap"))
    led = linked.select("site", "url").distinct().join(began, ["site", "url"], "left_anti").groupBy("site").agg(F.count(F.lit(1)).alias("via_links"))
    counted = began.groupBy("site").agg(F.count(F.lit(1)).alias("seed_urls"), F.count_if("from_sitemap").alias("sitemap_seeds"))
    return counted.join(led, "site", "full_outer").select("site", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seed_urls", "sitemap_seeds", "via_links")])


def graph_flags(nodes: DataFrame, new_urls: DataFrame, removed_urls: DataFrame) -> DataFrame:
    """Nodes with ``is_new`` and ``is_removed`` set from the two url lists and reset elsewhere."""
    new = new_urls.select(F.col("url"), F.lit(True).alias("_new")).distinct()
    gone = removed_urls.select(F.col("url"), F.lit(True).alias("_gone")).distinct()
    joined = nodes.drop("is_new", "is_removed").join(new, "url", "left").join(gone, "url", "left")
    return joined.withColumns({"is_new": F.coalesce("_new", F.lit(False)), "is_removed": F.coalesce("_gone", F.lit(False))}).drop("_new", "_gone")
