"""Registry of the site-audit queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.operators.audit import audit
from pagewright.plans import checks
from pagewright.plans.site import site


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit: every broken rule of every page."""
    return audit(site(spark, sf_dir)).select("rule_id", "category", "severity", "title", "affected_url", "page_id", "evidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(checks.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(checks.ORACLES)
