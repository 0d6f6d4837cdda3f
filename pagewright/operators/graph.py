"""The link graph: edges between crawled pages, node attributes, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import blank, contains_ci, severity_rank
from pagewright.operators.ranking import first_of
from pagewright.operators.shared import derived, last_by, link_rows

ANCHOR = 200
COLOURS = 16


def stored_links(raw: DataFrame, column: str = "links") -> DataFrame:
    """Links from stored JSON, given as texts or as objects with href and text; blank targets are dropped."""
    either = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))

    def link(item):
        href = F.coalesce(F.get_json_object(item, "$.href"), F.when(~item.startswith("{"), item))
        return F.struct(href.alias("href"), F.coalesce(F.get_json_object(item, "$.text"), F.lit("")).alias("text"))

    return raw.withColumn(column, F.filter(F.transform(either, link), lambda x: ~blank(x["href"])))


def edges(pages: DataFrame) -> DataFrame:
    """``source, target, anchor_text`` (page ids): links to other crawled pages, the first text of each pair."""
    page = derived(pages)
    links = link_rows(page, internal_only=False).where(F.col("target") != F.col("norm_url"))
    known = last_by(page, "norm_url", "page_id").select(F.col("norm_url").alias("target"), F.col("page_id").alias("_to"))
    found = links.join(known, "target")
    first = F.min_by(F.substring(F.coalesce("text", F.lit("")), 1, ANCHOR), "pos").alias("anchor_text")
    return found.groupBy(F.col("page_id").alias("source"), F.col("_to").alias("target")).agg(first)


def inbound_links(edge: DataFrame) -> DataFrame:
    """Distinct linking pages per page, self links excluded."""
    return edge.groupBy(F.col("target").alias("page_id")).agg(F.count_distinct("source").cast("int").alias("inbound_links"))


def nodes(pages: DataFrame, edge: DataFrame, issues: DataFrame) -> DataFrame:
    """``page_id, url, label, grp, depth, issue_count, inbound_links, status`` per page."""
    live = issues.where(F.col("status") == "ACTIVE")
    per_page = live.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("issue_count"), F.max(severity_rank("severity")).alias("_worst"))
    last = F.try_element_at(urls.segments("url"), F.lit(-1))
    worst = F.coalesce("_worst", F.lit(0))
    status = F.when(F.col("status_code") >= 400, "unreachable").when(worst >= 4, "high").when(worst == 3, "medium").when(worst == 2, "low").otherwise("healthy")
    return (
        pages.join(inbound_links(edge), "page_id", "left")
        .join(per_page, "page_id", "left")
        .select(
            "page_id",
            "url",
            F.concat(F.lit("/"), F.coalesce(last, F.lit(""))).alias("label"),
            urls.group("url").alias("grp"),
            "depth",
            F.coalesce("issue_count", F.lit(0)).alias("issue_count"),
            F.coalesce("inbound_links", F.lit(0)).alias("inbound_links"),
            status.alias("status"),
        )
    )


def displayed(node: DataFrame, segment_of: DataFrame | None = None) -> DataFrame:
    """Nodes with display size and, from ``(page_id, segment)``, a colour number."""
    out = node.withColumn("size", F.greatest(F.lit(3), F.least(F.lit(20), F.col("inbound_links") + 3)))
    if segment_of is None:
        return out
    return out.join(segment_of, "page_id", "left").withColumn("colour", F.col("segment") % COLOURS)


def subgraph(node: DataFrame, edge: DataFrame, group: str | None = None, status: str | None = None, search: str | None = None, new_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass the filters and the edges between them."""
    kept = node
    if group:
        kept = kept.where(F.col("grp") == group)
    if status:
        kept = kept.where(F.col("status") == status)
    if search:
        kept = kept.where(contains_ci("url", search) | contains_ci("label", search))
    if new_only:
        kept = kept.where(F.col("is_new"))
    ids = kept.select("page_id")
    inner = edge.join(ids.withColumnRenamed("page_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("page_id", "target"), "target", "left_semi")
    return kept, inner


def adjacency_rows(edge: DataFrame) -> DataFrame:
    """``page_id, other``: both directions of every link."""
    return edge.select(F.col("source").alias("page_id"), F.col("target").alias("other")).union(edge.select(F.col("target"), F.col("source")))


def adjacency(edge: DataFrame, shown: int = 50) -> DataFrame:
    """``page_id, neighbours, incident``: the first neighbours in order, and how many links meet at the page.

    A hub has any number of neighbours: ``adjacency_rows`` has them all.
    """
    both = adjacency_rows(edge)
    return both.groupBy("page_id").agg(F.count(F.lit(1)).alias("incident")).join(first_of(both, "page_id", "other", shown, "neighbours"), "page_id").select("page_id", "neighbours", "incident")


def groups(node: DataFrame) -> DataFrame:
    return node.select("grp").distinct()


def orphans(node: DataFrame) -> DataFrame:
    """Pages nobody links to, the root excepted."""
    return node.where((F.col("inbound_links") == 0) & (F.size(urls.segments("url")) >= 1))


def depth_distribution(node: DataFrame) -> DataFrame:
    return node.groupBy("depth").agg(F.count(F.lit(1)).alias("pages"))


def group_distribution(node: DataFrame) -> DataFrame:
    from pagewright.functions.text import rounded

    return node.groupBy("grp").agg(
        F.count(F.lit(1)).alias("pages"), rounded(F.avg("issue_count"), 2).alias("avg_issues"), rounded(F.avg("inbound_links"), 2).alias("avg_inbound")
    )


def top_linked(node: DataFrame, n: int = 15) -> DataFrame:
    return node.orderBy(F.desc("inbound_links"), F.length("page_id"), "page_id").limit(n)


def link_starved(node: DataFrame, pages: DataFrame, n: int = 20) -> DataFrame:
    """Long pages with at most one inbound link."""
    long = pages.where("word_count > 500").select("page_id", "word_count")
    return node.where("inbound_links <= 1").join(long, "page_id").orderBy(F.desc("word_count"), F.length("page_id"), "page_id").limit(n)
