"""Writes: upserts, replacement by key, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Stored rows with fresh ones in place of those with the same key, and fresh ones added; the last fresh row wins."""
    fresh = last_of(fresh, keys, order)
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def _by_values(rows: DataFrame, keys: list[str]) -> list[Column]:
    """An order for rows that have none: their values as text."""
    return [F.desc(F.to_json(F.struct(*[c for c in rows.columns if c not in keys])))] if len(rows.columns) > len(keys) else []


def last_of(rows: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The last row of each key: last in ``order`` (last one first), by ``last_crawled_at`` if that is given, then by values."""
    given = order or ([F.desc("last_crawled_at")] if "last_crawled_at" in rows.columns else [])
    newest = [*given, *_by_values(rows, keys)]
    if not newest:
        return rows.dropDuplicates(keys)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where("_n = 1").drop("_n")


def insert_new(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Fresh rows whose key is not stored yet, one per key (the first in ``order``, else by values): what an insert that
    skips duplicates appends."""
    return last_of(fresh, keys, order).join(stored.select(*keys), keys, "left_anti")


def replace_by_key(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All stored rows of the fresh rows' keys are replaced."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that occur in ``rows``, leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def update_where(rows: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def quoted(value: Column) -> Column:
    """A CSV field: always in quotes, quotes doubled, null empty."""
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def csv_lines(rows: DataFrame, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """``line`` per row in CSV; nested values are JSON."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    fields = [quoted(F.to_json(c) if kinds[c] in ("struct", "array", "map") else F.col(c)) for c in columns]
    out = rows.orderBy(*order) if order else rows
    return out.select(F.concat_ws(",", *fields).alias("line"))


def csv_header(columns: list[str]) -> str:
    return ",".join(f'"{c}"' for c in columns)


# Columns of the issue export and of the export per group.
ISSUE_COLUMNS = ["issue_id", "rule_id", "category", "severity", "status", "title", "description", "affected_url", "page_id", "linked_from", "evidence", "first_detected_at", "last_detected_at", "resolved_at"]
GROUP_COLUMNS = ["rule_id", "category", "severity", "status", "title", "description", "affected_url", "evidence", "first_detected_at", "last_detected_at", "is_whitelisted"]


def keyword_lines(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """``url,title,keywords,score`` per page: keywords joined by ``; ``, best score with two digits, fields as they are."""
    lists = keywords.groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "keyword"))), lambda k: k["keyword"]).alias("k"), F.max("score").alias("top")
    )
    joined = pages.join(lists, "page_id", "left")
    line = F.concat_ws(",", F.col("url"), F.coalesce("title", F.lit("")), F.array_join(F.coalesce("k", F.array().cast("array<string>")), "; "), F.format_string("%.2f", F.coalesce("top", F.lit(0.0))))
    return joined.orderBy("url", "page_id").select(line.alias("line"))


def json_report(issues: DataFrame, summary: DataFrame) -> DataFrame:
    """``json, part``: the summary (one row), a row per group, and a row per issue; parts stay rows until they are written."""
    from pagewright.operators.lifecycle import grouped_for_report

    as_json = lambda df, part: df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"), F.lit(part).alias("part"))
    return as_json(summary, "summary").union(as_json(grouped_for_report(issues), "group")).union(as_json(report_rows(issues), "row"))


# Fields of an issue in the report.
REPORT_FIELDS = ["rule_id", "category", "severity", "status", "title", "description", "affected_url", "evidence"]


def report_rows(issues: DataFrame) -> DataFrame:
    return issues.select(*[F.col(c) if c in issues.columns else F.lit(None).cast("string").alias(c) for c in REPORT_FIELDS])


def group_lines(issues: DataFrame, rule_id: str, title: str | None = None) -> DataFrame:
    """CSV lines of one group of the issue view, by url."""
    rows = issues.where(F.col("rule_id") == rule_id)
    if title is not None:
        rows = rows.where(F.col("title") == title)
    kept = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in [*GROUP_COLUMNS, "page_id"]])
    return csv_lines(kept, GROUP_COLUMNS, [F.col("affected_url"), F.col("page_id")])


def write_lines(lines: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files under ``path``, each with the header, one per partition of ``lines``."""
    header = ",".join(columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=batch.schema)
            yield batch

    lines.select("line").mapInArrow(headed, "line string").write.mode("overwrite").text(path)
