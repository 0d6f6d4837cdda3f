"""Text and number helpers whose results follow browser-script semantics where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a script's trim removes: Spark's trim knows the space character only.
SPACE = r"[\s\u000B   -     　﻿]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def blank(c: Column | str) -> Column:
    """True for null, empty and all-space text."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def falsy(c: Column | str) -> Column:
    """True for null and empty text."""
    return F.coalesce(col(c) == "", F.lit(True))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units; Spark's length counts code points."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def rounded(c: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def contains_ci(c: Column | str, needle: str) -> Column:
    """Case-insensitive literal containment; % and _ mean themselves."""
    return F.contains(F.lower(col(c)), F.lit(needle.lower()))


def is_in(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


# Severities from low to high.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_rank(c: Column | str) -> Column:
    """1 for INFO up to 5 for CRITICAL; 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), col(c)), F.lit(0)).cast("int")


def normal_category(c: Column | str) -> Column:
    """Upper-case category name; unknown names are ON_PAGE."""
    name = F.upper(F.regexp_replace(trimmed(c), r"[\s-]+", "_"))
    return F.when(name.isin(*CATEGORIES), name).otherwise("ON_PAGE")


def normal_severity(c: Column | str) -> Column:
    """Upper-case severity; unknown names are MEDIUM."""
    name = F.upper(trimmed(c))
    return F.when(name.isin(*SEVERITIES), name).otherwise("MEDIUM")


# The categories.
CATEGORIES = (
    "INDEXABILITY",
    "CRAWLABILITY",
    "ON_PAGE",
    "PERFORMANCE",
    "STRUCTURED_DATA",
    "IMAGES",
    "LINKS",
    "INTERNATIONALIZATION",
    "CANONICALIZATION",
    "SECURITY",
    "MOBILE",
    "SOCIAL",
)
