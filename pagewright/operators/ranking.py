"""Dense numbering that never sends a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import checkpointed


def salted_index(df: DataFrame, group: str, order: list[Column], name: str, salts: int | None = None) -> DataFrame:
    """Number the rows of each ``group`` 0, 1, 2, ... in a pseudorandom but repeatable order.

    Rows are dealt to ``salts`` buckets by a hash of ``order``; each (group, bucket) is numbered on its own and shifted
    by the sizes of the buckets before it, so a group with a third of all rows is spread over all tasks. ``group`` must
    not be null. ``df`` is read twice; rows equal in ``order`` may swap numbers.
    """
    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(group, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(group, "_salt").orderBy(F.xxhash64(*order, F.lit(1)), *order)
    return (
        dealt.withColumn("_at", F.row_number().over(within) - 1)
        .join(offsets, [group, "_salt"])
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_salt", "_offset", "_at")
    )


def range_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order: range partitions, numbered apart and shifted by their sizes."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.withColumn("_at", F.row_number().over(within) - 1)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_part", "_offset", "_at")
    )


def first_of(rows: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
    """``key, name``: the ``n`` smallest different values of a key, in order. What is beyond is dropped before it is sent, so
    a key with any number of rows costs a task no more than ``n`` values from each of its map tasks."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    kept = rows.select(key, value).distinct().withColumn("_place", place).where(F.col("_place") <= n)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
