"""Offline crawl: a bounded breadth-first walk over fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators.ranking import range_index
from pagewright.operators.shared import derived, link_rows
from pagewright.session import checkpointed


def seeds(root: str, sitemap: DataFrame, site_host: str, max_pages: int) -> DataFrame:
    """Root and crawlable sitemap urls, the root first, at most ``max_pages``."""
    spark = sitemap.sparkSession
    first = spark.createDataFrame([(root,)], "url string").select(urls.crawl_url("url").alias("url"), F.lit(0).alias("_o"))
    rest = sitemap.where(urls.same_site(urls.host("url"), F.lit(site_host)) & urls.is_page("url")).select(urls.crawl_url("url").alias("url"), F.lit(1).alias("_o"))
    every = first.union(rest).where("url is not null").groupBy("url").agg(F.min("_o").alias("_o"))
    return every.orderBy("_o", "url").limit(max_pages).select("url")


def _cut(rows: DataFrame, most: int | None) -> tuple[DataFrame, int | None]:
    """The first ``most`` keys in order, and how many more may follow. Only a level that goes over is numbered."""
    rows = checkpointed(rows)
    if most is None:
        return rows, None
    n = rows.count()
    if n > most:
        rows, n = checkpointed(range_index(rows, [F.col("key")], "_at").where(F.col("_at") < most).select("key")), most
    return rows, most - n


def crawl(seed: DataFrame, pages: DataFrame, site_host: str, max_depth: int = 10, max_pages: int | None = 10_000, allowed: DataFrame | None = None) -> DataFrame:
    """``key, depth`` of the pages reached; ``pages`` is the table of all fetched pages with their links.

    A level is the links of the level before, less what was seen: one equi join and one anti join. ``allowed`` holds the
    keys that robots rules permit. The walk stops at ``max_depth``, at ``max_pages`` (by url within a level; None is no
    limit) or when nothing is new.
    """
    page = derived(pages)
    links = checkpointed(link_rows(page).where(urls.same_site(urls.host("target"), F.lit(site_host)) & urls.is_page("target")).select(F.col("norm_url").alias("from"), "target").distinct())
    known = checkpointed(page.select(F.col("norm_url").alias("key")).distinct())
    if allowed is not None:
        known = checkpointed(known.join(allowed, "key", "left_semi"))
    level, left = _cut(seed.select(urls.lenient("url").alias("key")).distinct().join(known, "key", "left_semi"), max_pages)
    reached = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        if left == 0 or level.isEmpty():
            break
        onward = links.join(level, F.col("from") == F.col("key"), "left_semi").select(F.col("target").alias("key")).distinct()
        level, left = _cut(onward.join(known, "key", "left_semi").join(reached.select("key"), "key", "left_anti"), left)
        reached = checkpointed(reached.union(level.withColumn("depth", F.lit(depth))))
    return reached


def fallback_links(pages: DataFrame, harvested: DataFrame, site_host: str) -> DataFrame:
    """``page_id, key``: links of the same site taken from a page's own anchors, for pages that ``harvested`` (page_id) found
    no link on; files of other kinds are left out."""
    bare = derived(pages).join(harvested.select("page_id").distinct(), "page_id", "left_anti")
    every = link_rows(bare, internal_only=False).select("page_id", urls.crawl_url(urls.resolved("href", "url")).alias("key"))
    return every.where(F.col("key").isNotNull() & urls.same_site(urls.host("key"), F.lit(site_host)) & urls.is_page("key")).distinct()


def outgoing(pages: DataFrame, most: int = 1200) -> DataFrame:
    """Distinct http(s) targets of external links to probe, at most ``most`` by url."""
    hrefs = pages.select(F.explode("external_links").alias("l")).select("l.href").where(F.col("href").rlike("(?i)^https?://")).distinct()
    return hrefs.orderBy("href").limit(most)


def with_link_status(pages: DataFrame, status: DataFrame) -> DataFrame:
    """External links with the outcome of their probe, joined from a table of probes."""
    flat = pages.select("page_id", F.posexplode("external_links").alias("pos", "l")).select("page_id", "pos", "l.href", "l.text", "l.rel", "l.nofollow")
    # of several probes of a target the newest counts, by probe time if there is one, then the largest status code
    newest = F.struct(*([F.col("probed_at")] if "probed_at" in status.columns else []), F.coalesce("status_code", F.lit(-1)), F.to_json(F.struct("is_broken", "redirect_chain", "error")))
    last = F.max_by(F.struct("status_code", "is_broken", "redirect_chain", "error"), newest).alias("_s")
    probed = status.groupBy("href").agg(last).select("href", "_s.*")
    joined = flat.join(probed, "href", "left")
    link = F.struct("href", "text", "rel", "nofollow", "status_code", "is_broken", "redirect_chain", "error")
    lists = joined.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", link.alias("l")))), lambda x: x["l"]).alias("_links"))
    return pages.join(lists, "page_id", "left").withColumn("external_links", F.coalesce("_links", "external_links")).drop("_links")
