"""Audit: pages and rules in, one row per broken rule out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import rules as catalogue
from pagewright.operators.shared import enriched
from pagewright.session import configure


def evaluated(pages: DataFrame, found: list[catalogue.Rule], evidence: bool = True) -> DataFrame:
    """Pages with what these rules read, and nothing else joined; lists of urls are for their evidence only."""
    needs = catalogue.needs(found)
    page = enriched(pages, needs, evidence)
    return catalogue.structured_columns(page) if "structured" in needs else page


def audit(pages: DataFrame, categories: tuple[str, ...] | None = None, evidence: bool = True) -> DataFrame:
    """``rule_id, category, severity, title, description, affected_url, page_id, evidence`` per broken rule and url; without
    ``evidence`` for scores and counts, which do not read it: no JSON is made and no lists of urls are joined.

    All rules are one projection to arrays of findings and one explode, whatever the number of rules. A rule gives at most
    one row per page; of pages that share a url the first by id counts.
    """
    configure(pages.sparkSession)
    found = [r for r in catalogue.catalogue() if categories is None or r.category in categories]

    def finding(rule: catalogue.Rule):
        # constants are looked up by rule once the findings are few, not carried through the shuffle
        return F.when(rule.broken, F.struct(F.lit(rule.id).alias("rule_id"), *[rule.evidence.alias("evidence")] * evidence))

    groups = {}
    for rule in found:
        groups.setdefault(rule.category, []).append(finding(rule))
    per_category = [F.filter(F.array(*items), lambda f: f.isNotNull()) for items in groups.values()]
    rows = evaluated(pages, found, evidence).select("page_id", F.col("url").alias("affected_url"), F.explode(F.concat(*per_category)).alias("f"))
    first = F.min_by(F.struct("page_id", "f"), F.struct(F.length("page_id"), F.col("page_id"))).alias("_first")
    kept = rows.groupBy(F.col("f.rule_id").alias("rule_id"), "affected_url").agg(first)
    constant = lambda of: F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r.id, of(r))]), F.col("rule_id"))
    return kept.select(
        "rule_id", constant(lambda r: r.category).alias("category"), constant(lambda r: r.severity).alias("severity"), constant(lambda r: r.title).alias("title"),
        constant(lambda r: r.description).alias("description"), "affected_url", "_first.page_id", *["_first.f.evidence"] * evidence,
    )
