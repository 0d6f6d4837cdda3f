"""Pages of a long list by key ranges, so that a deep page does not sort what lies before it.

The list is range-partitioned by its order once and written as one folder per range. How many rows each range holds says in
which ranges a page lies; a page then reads those folders only, whatever its number, and sorts a range instead of the list.
Ranges come from Spark's own sample of the keys; what a page shows does not depend on them.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import written


@dataclass(frozen=True)
class Ranges:
    """A written list; range n begins after ``before[n]`` rows, and ``before[-1]`` is the number of all rows."""

    rows: DataFrame
    order: list[Column]
    before: list[int]

    @property
    def total(self) -> int:
        return self.before[-1]

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """Rows of a page, in order, with the envelope columns ``total, page, page_size, has_more``; none beyond the end."""
        start = (max(1, number) - 1) * size
        first = bisect_right(self.before, start) - 1
        last = max(first, bisect_right(self.before, min(start + size, self.total) - 1) - 1)
        wanted = list(range(first, last + 1)) if start < self.total else []
        shown = self.rows.where(F.col("_range").isin(wanted)).orderBy(*self.order).offset(start - self.before[first] if wanted else 0).limit(size)
        return shown.drop("_range").withColumns({"total": F.lit(self.total).cast("long"), "page": F.lit(number), "page_size": F.lit(size), "has_more": F.lit(self.total > number * size)})


def ranges(rows: DataFrame, order: list[Column], parts: int | None = None) -> Ranges:
    """``rows`` by ranges of ``order``, which should end with a unique column: rows equal in it may lie in either place.

    One count per range comes to the driver: as many numbers as there are ranges.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    kept = written(placed, by="_part")
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0]
    for _, n in counts:
        before.append(before[-1] + n)
    numbers = {part: n for n, (part, _) in enumerate(counts)}  # a range without rows has no folder
    numbered = F.col("_part") if list(numbers) == list(numbers.values()) else F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("_part"))
    return Ranges(kept.withColumn("_range", numbered).drop("_part"), order, before)
