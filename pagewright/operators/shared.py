"""Cross-page inputs of the audit, joined to each page once.

``enriched`` adds the derived columns that rules share and the joined inputs that were asked for. Pages are read for them
at most twice: once for a narrow table of keys, once for the rows of links; both are materialised, and every aggregate is
made from those. Aggregates of one key are one join. All joins are equi joins on url keys, and per-key aggregates are
partial before they are shuffled; lists of a key are cut before they are gathered. Site-wide scalars are one-row frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import blank, trimmed
from pagewright.operators.evidence import LISTED
from pagewright.session import checkpointed

#: A redirect chain is followed this far.
MAX_HOPS = 10


def derived(pages: DataFrame) -> DataFrame:
    """Page-local columns that several rules read."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(size(c))
    return pages.withColumns(
        {
            "norm_url": urls.lenient("url"),
            "canon_norm": F.when(~blank("canonical_url"), F.coalesce(urls.comparable_ref("canonical_url", "url"), urls.bare_slash("canonical_url"))),
            "directives": F.transform(F.split(F.lower(F.coalesce("meta_robots", F.lit(""))), ","), trimmed),
            "segs": urls.segments("url"),
            "names": F.transform(urls.query_names("url"), lambda n: F.lower(n)),
            "n_il": count("internal_links"),
            "n_xl": count("external_links"),
            "n_img": count("images"),
            "n_h1": count("h1"),
        }
    )


def last_by(pages: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key, the last page in id order winning: ``key`` + ``columns``."""
    picked = F.max_by(F.struct(*columns), F.struct(F.length("page_id"), F.col("page_id"))).alias("_p")
    return pages.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, "_p.*")


def link_rows(pages: DataFrame, internal_only: bool = True) -> DataFrame:
    """``(page_id, url, norm_url, href, text, target)`` per stored link occurrence; target is its comparable key."""
    links = F.transform("internal_links", lambda s: F.struct(s["href"].alias("href"), s["text"].alias("text")))
    if not internal_only:
        outer = F.transform("external_links", lambda s: F.struct(s["href"].alias("href"), s["text"].alias("text")))
        none = F.array().cast("array<struct<href: string, text: string>>")
        links = F.concat(F.coalesce(links, none), F.coalesce(outer, none))
    rows = pages.select("page_id", "url", "norm_url", F.posexplode(links).alias("pos", "link"))
    return rows.select("page_id", "url", "norm_url", "pos", "link.href", "link.text", F.coalesce(urls.comparable_ref("link.href", "url"), urls.bare_slash("link.href")).alias("target"))


def site_scalars(pages: DataFrame) -> DataFrame:
    """One row: means over pages that have a value, with sample sizes, and the number of pages."""
    return pages.agg(
        F.avg("response_time").alias("avg_response"),
        F.count("response_time").alias("n_response"),
        F.avg("page_size").alias("avg_size"),
        F.count("page_size").alias("n_size"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def site_languages(pages: DataFrame) -> DataFrame:
    """One row: the set of languages the site's alternates name (bounded by the number of language tags)."""
    tags = pages.select(F.explode("hreflang_tags").alias("t")).select(F.lower("t.lang").alias("lang")).where("lang is not null").distinct()
    return tags.agg(F.array_sort(F.collect_list("lang")).alias("site_langs"))


def redirect_hops(pages: DataFrame) -> DataFrame:
    """``(page_id, hops, chain)`` for redirecting pages that name a target (their canonical, taken without a base).

    The walk counts one hop to the target and one more for every redirecting page with a target that it meets; it ends
    at any other page, at one seen before, and at ``MAX_HOPS``. ``chain`` holds the urls it met. Walks and the steps from
    every redirecting url are one table of paths, and each join puts behind a path the path from its last url, so paths
    double and ``MAX_HOPS`` urls take its logarithm of joins. Where a path repeats itself is seen when it is whole.
    """
    target = F.when(~blank("canonical_url"), urls.lenient("canonical_url"))
    moved = F.col("status_code").between(300, 399)
    known = last_by(pages.withColumn("_next", target), "norm_url", "status_code", "_next", "canonical_url")
    step = lambda url, named: F.array(F.struct(url.alias("url"), named.alias("named"))).alias("path")
    steps = known.where(moved & F.col("_next").isNotNull()).select(F.col("norm_url").alias("at"), step(F.col("_next"), F.col("canonical_url")))
    walks = pages.where(moved & target.isNotNull()).select("page_id", "url", "norm_url", step(target, F.col("canonical_url")))
    paths, length = checkpointed(walks.unionByName(steps, allowMissingColumns=True)), 1
    while length < MAX_HOPS:
        length *= 2
        onward = paths.where("at is not null").select(F.col("at").alias("_last"), F.col("path").alias("_path"))
        going = (paths if length < MAX_HOPS else paths.where("at is null")).withColumn("_last", F.element_at("path", -1)["url"])
        joined = going.join(onward, "_last", "left").withColumn("path", F.concat("path", F.coalesce("_path", F.filter("path", lambda _: F.lit(False)))))
        paths = joined.drop("_last", "_path")
        paths = checkpointed(paths) if length < MAX_HOPS else paths
    walks = paths
    nodes = F.concat(F.array("norm_url"), F.transform("path", lambda p: p["url"]))
    again = F.transform("_nodes", lambda url, i: F.coalesce(F.array_position("_nodes", url) <= i, F.lit(True)))
    cut = walks.withColumn("path", F.slice("path", 1, MAX_HOPS)).withColumn("_nodes", nodes).withColumn("_again", F.array_position(again, True))
    fresh = F.when(F.col("_again") > 0, F.greatest(F.col("_again") - 2, F.lit(0))).otherwise(F.size("path")).cast("int")
    met = cut.withColumn("_fresh", F.least(fresh, F.lit(MAX_HOPS - 1)))
    chain = F.concat(F.array("url"), F.transform(F.slice("path", F.lit(1), F.col("_fresh")), lambda p: p["named"]))
    return met.select("page_id", (F.least(F.col("_fresh"), F.size("path") - 1) + 1).alias("hops"), chain.alias("chain"))


#: Page columns that the joined inputs are made of.
KEYS = ("page_id", "url", "norm_url", "canon_norm", "canonical_url", "status_code", "title", "response_time", "page_size", "hreflang_tags")
ALL = frozenset(("inbound", "canonical", "incoming", "titles", "outcomes", "alternates", "languages", "scalars", "hops", "loops"))


def _order() -> Column:
    return F.struct(F.length("page_id").alias("n"), F.col("page_id").alias("id"))


def first_urls(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``key, name``: the first ``n`` different urls of a key by page order; rows beyond are dropped before they are sent."""
    once = rows.groupBy(key, "url").agg(F.min(_order()).alias("_o"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_o", "url"))
    kept = once.withColumn("_place", place).where(F.col("_place") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "url"))), lambda u: u["url"]).alias(name))


def _by_url(keys: DataFrame, links: DataFrame | None, needs: frozenset | set, lists: bool) -> DataFrame | None:
    """Aggregates per comparable url: links to it and canonicals that name it, with the first of them if ``lists``."""
    out = None
    if "inbound" in needs:
        per_source = links.groupBy(F.col("target").alias("norm_url"), "url").agg(F.count(F.lit(1)).alias("n"), F.min_by("page_id", _order()).alias("page_id"))
        out = per_source.groupBy("norm_url").agg(F.sum("n").alias("inbound"), F.count(F.lit(1)).alias("linking_pages"))
        if lists:
            missing = keys.where(F.col("status_code").between(400, 499)).select("norm_url").distinct()
            out = out.join(first_urls(per_source.join(missing, "norm_url", "left_semi"), "norm_url", LISTED, "linking_list"), "norm_url", "left")
    if "incoming" in needs:
        named = keys.where(F.col("canon_norm").isNotNull() & (F.col("canon_norm") != F.col("norm_url"))).select(F.col("canon_norm").alias("_n"), "url", "page_id").withColumnRenamed("_n", "norm_url")
        incoming = named.groupBy("norm_url").agg(F.count(F.lit(1)).alias("canon_incoming"))
        if lists:
            incoming = incoming.join(first_urls(named, "norm_url", 10, "canon_list"), "norm_url", "left")
        out = incoming if out is None else out.join(incoming, "norm_url", "full_outer")
    return out


def _outcomes(links: DataFrame, lookup: DataFrame) -> DataFrame:
    """Per page: where its links lead, as counts and lists in order. A page's own links bound its lists."""
    by_target = lookup.select(F.col("norm_url").alias("target"), F.col("status_code").alias("_status"))
    item = F.struct("pos", F.col("target").alias("href"), F.col("_status").alias("statusCode"))
    told = lambda c: F.transform(F.array_sort(c), lambda i: F.struct(i["href"].alias("href"), i["statusCode"].alias("statusCode")))
    moved, broken, own = F.col("_status").between(300, 399), F.col("_status") >= 400, F.col("target") == F.col("norm_url")
    found = links.join(by_target, "target", "left").where(moved | broken | own).groupBy("page_id").agg(
        F.count_if(moved).alias("links_moved"),
        F.count_if(broken).alias("links_broken"),
        F.count_if(own).alias("links_self"),
        told(F.collect_list(F.when(moved, item))).alias("moved_list"),
        told(F.collect_list(F.when(broken, item))).alias("broken_list"),
        F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("pos", "text")))), lambda i: i["text"]).alias("self_list"),
    )
    return found


def _alternates(keys: DataFrame) -> DataFrame:
    """Per page: alternates that do not refer back, and those that do not answer 200."""
    bare = urls.bare_slash
    asked = keys.select("page_id", bare("url").alias("own"), F.posexplode("hreflang_tags").alias("pos", "tag"))
    asked = asked.select("page_id", "own", "pos", F.col("tag.lang").alias("lang"), F.col("tag.href").alias("href"), bare("tag.href").alias("to"))
    none = F.array().cast("array<struct<lang: string, href: string>>")
    named = last_by(keys.withColumn("own", bare("url")), "own", "status_code", "hreflang_tags").select(
        F.col("own").alias("to"), F.col("status_code").alias("_status"), F.transform(F.coalesce("hreflang_tags", none), lambda t: bare(t["href"])).alias("_back")
    )
    one_way = (F.col("own") != F.col("to")) & ~F.coalesce(F.array_contains("_back", F.col("own")), F.lit(False))
    bad = F.col("_status") != 200
    tag, told = F.struct("pos", "lang", "href"), F.struct("pos", "lang", "href", F.col("_status").alias("statusCode"))
    bare_of = lambda c, *names: F.transform(F.array_sort(c), lambda i: F.struct(*[i[n].alias(n) for n in names]))
    return asked.join(named, "to").groupBy("page_id").agg(
        F.count_if(one_way).alias("alternates_one_way"),
        F.count_if(bad).alias("alternates_bad"),
        bare_of(F.collect_list(F.when(one_way, tag)), "lang", "href").alias("one_way_list"),
        bare_of(F.collect_list(F.when(bad, told)), "lang", "href", "statusCode").alias("bad_list"),
    )


def _loops(keys: DataFrame) -> DataFrame:
    """``(page_id, loops, loop_canonical)``: pages whose target, taken without a base, has a canonical, and whether that is
    the page itself."""
    raw = F.coalesce(urls.comparable("canonical_url"), urls.bare_slash("canonical_url"))
    back = last_by(keys.withColumn("_back", raw), "norm_url", "_back", "canonical_url").select(F.col("norm_url").alias("_to"), "_back", F.col("canonical_url").alias("loop_canonical"))
    moved = keys.where(F.col("status_code").between(300, 399))
    return moved.select("page_id", "norm_url", raw.alias("_to")).join(back, "_to").select("page_id", (F.col("_back") == F.col("norm_url")).alias("loops"), "loop_canonical")


def enriched(pages: DataFrame, needs: frozenset | set = ALL, lists: bool = True) -> DataFrame:
    """Pages with derived columns and the shared inputs named in ``needs``; lists of urls only with ``lists``."""
    page = derived(pages)
    if not needs & ALL:
        return page
    keys = checkpointed(page.select(*KEYS))
    links = checkpointed(link_rows(page)) if needs & {"inbound", "outcomes"} else None
    lookup = last_by(keys, "norm_url", "status_code", "canon_norm", "canonical_url") if needs & {"canonical", "outcomes"} else None
    zero = []
    by_url = _by_url(keys, links, needs, lists)
    if by_url is not None:
        page = page.join(by_url, "norm_url", "left")
        zero += ["inbound", "linking_pages"] * ("inbound" in needs) + ["canon_incoming"] * ("incoming" in needs)
    if "titles" in needs:
        title_key = F.when((F.col("status_code") == 200) & ~blank("title"), F.lower(trimmed("title")))
        titled = keys.select(title_key.alias("title_key"), "url", "page_id").where("title_key is not null")
        titles = titled.groupBy("title_key").agg(F.count_distinct("url").alias("title_urls")).where("title_urls > 1")
        if lists:
            titles = titles.join(first_urls(titled, "title_key", 11, "title_list"), "title_key")
        page = page.withColumn("title_key", title_key).join(titles, "title_key", "left")
        zero.append("title_urls")
    if "canonical" in needs:
        target = lookup.select(
            F.col("norm_url").alias("_t"), F.col("status_code").alias("canon_status"), F.col("canon_norm").alias("canon_of_target"), F.col("canonical_url").alias("target_canonical"), F.lit(True).alias("canon_known")
        )
        page = page.join(target, F.col("canon_norm") == F.col("_t"), "left")
    per_page = []
    if "outcomes" in needs:
        per_page.append(_outcomes(links, lookup))
        zero += ["links_moved", "links_broken", "links_self"]
    if "alternates" in needs:
        per_page.append(_alternates(keys))
        zero += ["alternates_one_way", "alternates_bad"]
    if "hops" in needs:
        per_page.append(redirect_hops(keys))
        zero.append("hops")
    if "loops" in needs:
        per_page.append(_loops(keys))
    if per_page:  # one row per page and input: one join with the wide rows
        merged = per_page[0]
        for more in per_page[1:]:
            merged = merged.join(more, "page_id", "full_outer")
        page = page.join(merged, "page_id", "left")
    if "loops" in needs:
        page = page.withColumn("loops", F.coalesce("loops", F.lit(False)))
    if "scalars" in needs:
        page = page.join(F.broadcast(site_scalars(keys)))  # one row
    if "languages" in needs:
        page = page.join(F.broadcast(site_languages(keys)))  # one row
    return page.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
