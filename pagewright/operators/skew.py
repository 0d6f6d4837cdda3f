"""Joins with a lookup table whose keys may be held by any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below this many rows a plain join does; above it, keys with more than a thousandth of the rows are hot.
PLAIN = 4096


def lookup(rows: DataFrame, key: str, table: DataFrame, n: int) -> DataFrame:
    """``rows`` left-joined with ``table``, which has at most one row a key; ``n`` is the number of ``rows``.

    A hot key holds more than ``n`` / 1000 rows, so there are fewer than 1000 of them: their lookups are sent to every task
    and their rows stay where they are. All other rows are shuffled as usual, at most a thousandth of them a key. ``rows``
    is read three times and should be materialised. Null keys find nothing.
    """
    if n < PLAIN:
        return rows.join(table, key, "left")
    hot = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > n // 1000) & F.col(key).isNotNull()).select(key))
    few = F.broadcast(table.join(hot, key, "left_semi"))
    stay = rows.join(hot, key, "left_semi").join(few, key, "left")
    return stay.unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))
