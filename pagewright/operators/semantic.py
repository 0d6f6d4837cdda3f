"""Topic analytics over page keywords: vectors, neighbours, segments and the reports built on them.

Pages are known by an integer ``ix`` that gives their order; all ties are broken by ``ix`` or by term, so results do not
depend on partitioning. Vectors stay in long form (ix, term, weight), at most ``TERMS`` terms a page; similarity is found
between classes of pages with one vector (``similar``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import rounded
from pagewright.operators import similar
from pagewright.operators.components import connected_components
from pagewright.operators.ranking import first_of
from pagewright.operators.similar import Classes
from pagewright.operators.skew import lookup
from pagewright.session import checkpointed, written

# Words that carry no topic.
STOP_WORDS = "a an and are as at be by for from has in is it of on or that the to was were with www com org net page pages".split()
TERMS, NEIGHBOURS, SHARED, TOP_TERMS = 24, 6, 4, 10
#: Choices of waiting pages that one task may take in turn.
IN_A_TASK = 200_000
COMMON, LEAST_WEIGHT, LEAST_SIMILARITY = 0.7, 0.08, 0.12


def normal_keywords(texts: Column) -> Column:
    """An array's texts in lower case, other characters than a-z, 0-9, space and ``-`` blanked, squeezed; null if unfit for a
    topic. In an array each text is rewritten once, however often the result is looked at."""
    words = F.transform(texts, lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9 -]", " "), r"\s+", " ")))
    return F.transform(words, lambda w: F.when((F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~w.isin(*STOP_WORDS), w))


def _fit(texts: Column) -> Column:
    """A row for each of an array's texts that is fit for a topic; a filter on a column would compute it again."""
    return F.explode(F.array_compact(normal_keywords(texts)))


def strongest(stored: DataFrame, most: int = 5000) -> DataFrame:
    """The best keyword rows by score, for a report; analytics reads all of them."""
    return stored.orderBy(F.desc("score"), "page_id", "keyword").limit(most)


def keyword_scores(node: DataFrame, stored: DataFrame) -> DataFrame:
    """``ix, keyword, score`` per keyword row that is fit for a topic; scores are at least 0.05."""
    rows = stored.select("page_id", _fit(F.array("keyword")).alias("keyword"), F.greatest(F.lit(0.05), "score").alias("score"))
    return rows.join(node.select("page_id", "ix"), "page_id").select("ix", "keyword", "score")


def term_scores(node: DataFrame, scores: DataFrame) -> DataFrame:
    """``ix, term, score``: keywords, 0.35 of the score for each word of a phrase, 0.25 for each word of the url."""
    words = scores.where(F.col("keyword").contains(" ")).select("ix", _fit(F.split("keyword", " ")).alias("term"), (F.col("score") * 0.35).alias("score"))
    from_url = node.select("ix", _fit(urls.token_words("url")).alias("term"), F.lit(0.25).alias("score"))
    every = scores.select("ix", F.col("keyword").alias("term"), "score").union(words).union(from_url)
    return every.groupBy("ix", "term").agg(F.sum("score").alias("score"))


def vectors(node: DataFrame, terms: DataFrame) -> DataFrame:
    """``ix, term, weight, place, norm``: at most ``TERMS`` terms a page, or the page's group where none is left."""
    n = node.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log1p("score") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    weighed = terms.join(df, "term").join(F.broadcast(n)).where(F.col("df") <= F.col("n") * COMMON).select("ix", "term", weight.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    place = F.row_number().over(Window.partitionBy("ix").orderBy(F.desc(F.round("weight", 9)), "term"))
    kept = weighed.withColumn("place", place).where(F.col("place") <= TERMS)
    every = node.select("ix", "grp").join(kept, "ix", "left")
    named = every.select("ix", *[F.coalesce(c, bare).alias(c) for c, bare in (("term", F.concat(F.lit("group:"), "grp")), ("weight", F.lit(1.0)), ("place", F.lit(1)))])
    return named.withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("ix"))))


def alike(vector: DataFrame) -> Classes:
    """Pages of one vector as classes, and the classes with a cosine of at least 0.12."""
    return similar.classes(vector, LEAST_SIMILARITY, (F.col("place") <= TOP_TERMS) & ~F.col("term").startswith("group:"))


def page_pairs(vector: DataFrame) -> DataFrame:
    """``a, b, sim`` for every pair of pages with a cosine of at least 0.12, ``a < b``."""
    return similar.page_pairs(alike(vector))


def similarities(vector: DataFrame) -> DataFrame:
    """``a, b, sim`` for both directions of every pair of pages with a cosine of at least 0.12."""
    return similar.expanded(alike(vector))


def neighbours(vector: DataFrame, found: Classes | None = None) -> DataFrame:
    """``ix, nb, sim, shared, place``: the six most similar pages of each page."""
    return similar.nearest(found or alike(vector), NEIGHBOURS, SHARED)


def strong_pairs(near: DataFrame) -> DataFrame:
    return near.where((F.col("sim") >= 0.30) | ((F.col("sim") >= 0.24) & (F.size("shared") >= 2))).select(F.col("ix").alias("a"), F.col("nb").alias("b"))


def _followed(heads: DataFrame, max_rounds: int | None) -> DataFrame:
    """Where the first choices lead: ``ix, to, segment, only, over``.

    ``heads`` has one choice a page: a page ``to`` that is waiting too, or a ``segment``. A round lets every page look where
    its choice was looking, so a chain of n pages is followed in log2(n) rounds. ``over`` marks chains that end at a page
    without a choice; ``only`` those along which no page had a second choice.
    """
    state = written(heads.withColumn("over", F.lit(False)))
    n, rounds = state.count(), 0
    waits = F.col("segment").isNull() & ~F.col("over")
    while not state.where(waits).isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"pages did not settle in {max_rounds} rounds")
        rounds += 1
        ahead = state.select(F.col("ix").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("to", "segment", "only", "over")])
        known = F.col("_over").isNotNull()
        state = written(
            lookup(state, "to", ahead, n).select(
                "ix",
                F.when(waits & known, F.col("_to")).otherwise(F.col("to")).alias("to"),
                F.when(waits, F.col("_segment")).otherwise(F.col("segment")).alias("segment"),
                F.when(waits & known, F.col("only") & F.col("_only")).otherwise(F.col("only")).alias("only"),
                F.when(waits, F.coalesce("_over", F.lit(True))).otherwise(F.col("over")).alias("over"),
            )
        )
    return state


def _in_reach(choices: DataFrame) -> DataFrame:
    """``choices`` of the pages that hang together with one that has a segment; the others can never join any."""
    groups = checkpointed(connected_components(choices.where("segment is null"), "ix", "nb"))
    has = choices.where("segment is not null").select("ix").distinct()
    alive = groups.join(has, groups["node"] == has["ix"], "left_semi").select("component").distinct()
    pages = has.unionByName(groups.join(alive, "component", "left_semi").select(F.col("node").alias("ix")))
    return choices.join(pages, "ix", "left_semi")


def _in_turn(choices: DataFrame) -> DataFrame:
    """``ix, segment`` of few waiting pages, one after another in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}
        for batch in batches:
            for ix, nb, segment in zip(*(batch.column(c).to_pylist() for c in ("ix", "nb", "segment"))):
                if ix not in joined and (found := joined.get(nb) if segment is None else segment) is not None:
                    joined[ix] = found
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(joined), list(joined.values()))], names=["ix", "segment"])

    ordered = choices.select(F.col("ix").cast("long"), F.col("nb").cast("long"), "place", F.col("segment").cast("long")).coalesce(1).sortWithinPartitions("ix", "place")
    return ordered.mapInArrow(run, "ix bigint, segment bigint")


def attached(node: DataFrame, near: DataFrame, members: DataFrame, max_rounds: int | None = None, in_a_task: int = IN_A_TASK) -> DataFrame:
    """``ix, segment``: component members, and pages that join one in order of ``ix``.

    A page outside all components joins the segment of its first neighbour (similarity 0.24 or more) that has one when
    its turn comes: members, and earlier pages that joined. So its choices are members and earlier waiting pages, in order.
    All first choices are followed at once (``_followed``). A chain that ends in a segment settles all its pages; a chain
    that ends at a page without a choice settles those that had no second one: they stay alone. The others drop the choices that
    stay alone and choose again, or take their turns in one task once they have no more than ``in_a_task`` choices left.
    ``max_rounds`` bounds the rounds of one chain; pages still waiting then are an error.
    """
    fixed = members.select(F.col("node").alias("ix"), F.col("component").alias("segment"))
    open_ = near.where("sim >= 0.24").select("ix", "nb", "place").join(fixed.select("ix"), "ix", "left_anti")
    named = open_.join(fixed.select(F.col("ix").alias("nb"), "segment"), "nb", "left")
    choices = checkpointed(named.where(F.col("segment").isNotNull() | (F.col("nb") < F.col("ix"))).select("ix", "nb", "place", "segment"))
    settled, first = fixed, True
    while not choices.isEmpty():
        head = choices.groupBy("ix").agg(F.min_by(F.struct("nb", "segment"), "place").alias("h"), (F.count(F.lit(1)) == 1).alias("only"))
        state = _followed(head.select("ix", F.col("h.nb").alias("to"), F.col("h.segment").alias("segment"), "only"), max_rounds)
        settled = settled.union(state.where("segment is not null").select("ix", "segment"))
        again = state.where("segment is null and not only").select("ix")
        now = state.where("segment is not null or not only").select(F.col("ix").alias("nb"), F.col("segment").alias("_segment"), F.lit(True).alias("_open"))
        left = choices.join(again, "ix", "left_semi").join(now, "nb", "left").where("segment is not null or _open")
        choices = written(left.select("ix", "nb", "place", F.coalesce("segment", "_segment").alias("segment")))
        if first and not choices.isEmpty():
            choices, first = written(_in_reach(choices)), False
        if choices.count() <= in_a_task:
            return settled.union(_in_turn(choices))
    return settled


def segments(node: DataFrame, near: DataFrame, most: int = 30) -> DataFrame:
    """``ix, segment, number``: the 30 largest segments numbered from 1, larger first, then by smallest page."""
    members = connected_components(strong_pairs(near))
    every = attached(node, near, members)
    sizes = every.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "segment").limit(most)
    numbered = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), "segment")))  # at most 30 rows
    return every.join(F.broadcast(numbered.select("segment", "number")), "segment").select("ix", "segment", "number")


def segment_summary(node: DataFrame, vector: DataFrame, near: DataFrame, found: DataFrame) -> DataFrame:
    """``number, id, label, size, avg_depth, total_issues, keywords, cohesion`` per segment."""
    weights = vector.where(~F.col("term").startswith("group:")).join(found, "ix").groupBy("number", "term").agg(F.sum("weight").alias("w"))
    best = Window.partitionBy("number").orderBy(F.desc(F.round("w", 9)), "term")
    words = weights.withColumn("n", F.row_number().over(best)).where("n <= 8").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("k"))
    words = words.select("number", F.transform("k", lambda k: k["term"]).alias("keywords"))
    joined = node.join(found, "ix")
    per_group = joined.groupBy("number", "grp").agg(F.count(F.lit(1)).alias("n"))
    dominant = per_group.groupBy("number").agg(F.min_by("grp", F.struct(-F.col("n"), "grp")).alias("dominant"))
    totals = joined.groupBy("number").agg(F.count(F.lit(1)).alias("size"), rounded(F.avg("depth"), 1).alias("avg_depth"), F.sum("issue_count").alias("total_issues"))
    other = found.select(F.col("ix").alias("nb"), F.col("number").alias("_other"))
    inner = near.where("nb > ix").join(found, "ix").join(other, "nb").where("number = _other")
    cohesion = inner.groupBy("number").agg(rounded(F.avg("sim"), 3).alias("cohesion"))
    label = F.when(F.size("keywords") >= 2, F.concat(F.col("keywords")[0], F.lit(" + "), F.col("keywords")[1])).otherwise(F.concat(F.lit("/"), "dominant"))
    none = F.array().cast("array<string>")
    return (
        totals.join(words, "number", "left")
        .join(dominant, "number")
        .join(cohesion, "number", "left")
        .withColumn("keywords", F.coalesce("keywords", none))
        .select("number", F.concat(F.lit("semantic-"), F.col("number")).alias("id"), label.alias("label"), "size", "avg_depth", "total_issues", "keywords", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"))
    )


def path_clusters(node: DataFrame, terms: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters by the first two path segments, for a site without segments; empty where there are some."""
    segs = urls.segments("url")
    key = F.when(F.size(segs) >= 2, F.concat(F.lit("/"), segs[0], F.lit("/"), segs[1])).otherwise(F.concat(F.lit("/"), F.coalesce(F.try_element_at(segs, F.lit(1)), F.lit("root"))))
    keyed = node.withColumn("id", key)
    if not found.isEmpty():
        keyed = keyed.limit(0)
    best = Window.partitionBy("ix").orderBy(F.desc("score"), "term")
    top = terms.withColumn("n", F.row_number().over(best)).where("n <= 5").join(keyed.select("ix", "id"), "ix").groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"))
    ranked = top.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "term"))).where("n <= 8")
    words = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("k")).select("id", F.transform("k", lambda k: k["term"]).alias("keywords"))
    shown = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("ix")))
    totals = shown.groupBy("id").agg(
        F.count(F.lit(1)).alias("size"), rounded(F.avg("depth"), 1).alias("avg_depth"), F.sum("issue_count").alias("total_issues"), F.sort_array(F.collect_list(F.when(F.col("_n") <= 50, F.struct("ix", "url")))).alias("_u")
    )
    return totals.where("size >= 2").join(words, "id", "left").select("id", "size", "avg_depth", "total_issues", F.transform("_u", lambda u: u["url"]).alias("urls"), "keywords")


def bridges(node: DataFrame, near: DataFrame, found: DataFrame, most: int = 20) -> DataFrame:
    """Pages whose neighbours (0.22 or more) lie in other segments too: ``url, segments, inbound_links, issue_count``."""
    own = found.select("ix", F.col("number").alias("own"))
    other = found.select(F.col("ix").alias("nb"), F.col("number").alias("other"))
    crossing = near.where("sim >= 0.22").join(own, "ix").join(other, "nb").where("own <> other")
    counted = crossing.groupBy("ix").agg((F.count_distinct("other") + 1).alias("segments"))
    return counted.join(node, "ix").orderBy(F.desc("segments"), "inbound_links", F.desc("issue_count"), "ix").limit(most).select("ix", "url", "segments", "inbound_links", "issue_count")


def link_opportunities(node: DataFrame, near: DataFrame, edge: DataFrame, most: int = 25) -> DataFrame:
    """Similar pages that do not link to each other, where the link would help the page: best first."""
    page = node.select("ix", F.col("page_id").alias("source"), F.col("url").alias("from_url"), F.col("inbound_links").alias("_in"), "issue_count")
    goal = node.select(F.col("ix").alias("nb"), F.col("page_id").alias("target"), F.col("url").alias("to_url"), F.col("inbound_links").alias("_to"))
    pairs = near.where("sim >= 0.34").join(page.where("_in <= 2 or issue_count > 0"), "ix").join(goal, "nb")
    pairs = pairs.where("not (_in > _to and sim < 0.45)")
    both = edge.select("source", "target").union(edge.select(F.col("target"), F.col("source")))
    free = pairs.join(both.distinct(), ["source", "target"], "left_anti")
    rank = F.col("sim") * (1 + 0.03 * F.greatest(F.lit(0), F.col("_to") - F.col("_in")))
    best = free.withColumn("rank", rank).groupBy("from_url", "to_url").agg(F.max_by(F.struct("sim", "shared", "rank"), "rank").alias("r"))
    return best.orderBy(F.desc("r.rank"), "from_url", "to_url").limit(most).select("from_url", "to_url", rounded(F.col("r.sim"), 3).alias("similarity"), F.slice("r.shared", 1, 3).alias("shared"))


def cannibalisation(scores: DataFrame, found: Classes, most: int = 20) -> DataFrame:
    """Keywords on 3 to 10 pages that are alike: ``keyword, pages, avg_similarity, avg_score``."""
    per_page = scores.groupBy("keyword", "ix").agg(F.sum("score").alias("score"))
    counted = per_page.groupBy("keyword").agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("total")).where("pages between 3 and 10")
    holders = per_page.join(counted.select("keyword"), "keyword").select("keyword", "ix")
    pairs = holders.withColumnRenamed("ix", "a").join(holders.withColumnRenamed("ix", "b"), "keyword").where("a < b")  # at most 45 per keyword
    means = similar.of_pages(found, pairs).groupBy("keyword").agg(F.avg(F.coalesce("sim", F.lit(0.0))).alias("avg"))
    ranked = means.where("avg >= 0.24").join(counted, "keyword").orderBy(F.desc(F.round(F.col("pages") * F.col("avg"), 9)), "keyword").limit(most)
    return ranked.select("keyword", "pages", rounded(F.col("avg"), 3).alias("avg_similarity"), rounded(F.col("total") / F.col("pages"), 3).alias("avg_score"))


def neighbour_report(node: DataFrame, near: DataFrame, pages: int = 120, shown: int = 5) -> DataFrame:
    """``ix, url, place, neighbour, similarity``: neighbours of the pages most in need."""
    chosen = node.join(near.select("ix").distinct(), "ix").orderBy(F.desc("issue_count"), "inbound_links", "ix").limit(pages)
    names = node.select(F.col("ix").alias("nb"), F.col("url").alias("neighbour"))
    return near.where(F.col("place") <= shown).join(chosen.select("ix", "url"), "ix").join(names, "nb").select("ix", "url", "place", "neighbour", rounded(F.col("sim"), 3).alias("similarity"))


def keyword_distribution(scores: DataFrame, node: DataFrame | None = None, most: int = 50, shown: int = 5) -> DataFrame:
    """``keyword, pages, avg_score`` of the keywords on most pages; with ``node``, ``examples`` too: the urls of the first
    pages that hold each."""
    counted = scores.groupBy("keyword").agg(F.count_distinct("ix").alias("pages"), F.sum("score").alias("total"))
    top = counted.orderBy(F.desc("pages"), "keyword").limit(most)
    found = top.select("keyword", "pages", rounded(F.col("total") / F.col("pages"), 3).alias("avg_score"))
    if node is None:
        return found
    first = first_of(scores.join(F.broadcast(found.select("keyword")), "keyword"), "keyword", "ix", shown, "firsts")  # at most ``most`` keywords
    named = first.select("keyword", F.posexplode("firsts").alias("place", "ix")).join(node.select("ix", "url"), "ix")
    urls_ = named.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("examples"))
    return found.join(urls_, "keyword")
