"""Vectors of a table as packed bytes, with a note of which of them can take part in a comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import nullable


def packed(rows: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, str]:
    """``(id_col, dim, vec)`` per row and the numpy type of ``vec``.

    ``vec`` is null for a vector that is null, empty, all zero, or holds a null or non-finite component.
    """
    element = rows.schema[vector].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    read = rows.select(F.col(id_col), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("_vector"))
    schema = nullable(read.select(id_col, F.lit(0).cast("int").alias("dim"), F.lit(b"").alias("vec")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # a null is NaN; -0.0 becomes 0.0
            sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            out = []
            for s, e in zip(ends - sizes, ends):
                v = values[s:e].astype(kind)
                out.append(v.tobytes() if e > s and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=schema.names)

    return read.mapInArrow(run, schema), kind


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors of one dimension as the rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.empty((0, 0), kind)
