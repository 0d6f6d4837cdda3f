"""Columns by any name, and the identity of rows without an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(column: str) -> str:
    """A name as Spark reads it: dots are part of it."""
    return "`" + column.replace("`", "``") + "`" if "." in column or "`" in column else column


def named(column: str) -> Column:
    """The column of exactly this name."""
    return F.col(quoted(column))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def row_key(docs: DataFrame) -> Column:
    """128 bits of all values of a row, as bytes: rows alike in every column have one key, and no others do.

    At 10^10 rows the chance that any two unlike rows share a key is below 10^-18. Maps are hashed as JSON.
    """
    values = [F.to_json(F.struct(named(f.name).alias("v"))) if _holds_map(f.dataType) else named(f.name) for f in docs.schema]
    # the seed comes first: a hash of several values goes on from the hash of those before
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *values)), 16, "0") for seed in (1, 2)]))
