"""How operators hand whole texts to Python: once, beside the columns that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_text(docs: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``keep`` and the text, and the text's position. A text that is kept anyway is not sent twice.

    In a batch of the result, the kept columns are the first ``len(keep)``.
    """
    if text in keep:
        return docs.select(*keep), keep.index(text)
    return docs.select(*keep, F.col(text).alias("_text")), len(keep)
