"""Comparison and hashing of row values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that never count as changed.
NOT_COMPARED = frozenset(("OBJECTID", "SDE_STATE_ID", "GLOBALID", "SHAPE", "SHAPE_WKB", "SHAPE_SRID"))
#: Fixed value: relative and absolute tolerance of numbers.
TOLERANCE = 1e-10


def values_equal(a: Column, b: Column, kind: T.DataType) -> Column:
    """Equality of two values of a type: nulls are equal, floating numbers within the tolerance, NaN equals NaN."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        gap = F.abs(a - b)
        close = (gap < TOLERANCE) | (gap < F.greatest(F.abs(a), F.abs(b)) * TOLERANCE)
        return a.eqNullSafe(b) | F.coalesce(close, F.lit(False))
    return a.eqNullSafe(b)


def compared_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.upper() not in NOT_COMPARED]


def row_hash(rows: DataFrame, columns: list[str], types: dict[str, T.DataType] | None = None) -> Column:
    """SHA-256 of a row: each value as its length and text, so that neither nulls nor separators can be confused; as values of `types` if given."""
    kinds = dict(rows.dtypes)

    def part(name: str) -> Column:
        column = F.col(name).cast(types[name]) if types else F.col(name)
        value = F.hex(column) if kinds[name] == "binary" else column.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat_ws("|", *[part(c) for c in columns]), 256)
