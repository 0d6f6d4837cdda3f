"""Small fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHES = ("score", "size", "fp", "label", "words", "s", "at", "block", "component", "component_id", "spans", "length", "piece", "start", "rank", "key", "id", "rid", "use", "vec", "host", "rule", "taken", "target", "_key", "_text", "safe_text", "lang_pred")
LONG = " ".join(f"word{i % 97} other{i % 89}" for i in range(20_000))


def documents(spark, rows) -> DataFrame:
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOCS)


def awkward(spark) -> DataFrame:
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, None),
        (4, "one", "de", ""),
        (5, LONG, "en", "a"),
        (6, LONG + " tail", "en", "b"),
        (7, "password=hunter2hunter2 and the MIT License", "en", "b"),
        (7, "password=hunter2hunter2 and the MIT License", "en", "b"),
        (None, "no id here at all", "fr", None),
        (8, "!!! ??? 123", None, "ü"),
    ]
    return documents(spark, rows)


def with_clashes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in df.columns})


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
