"""Numeric expressions shared by scoring and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    """All double columns of a table rounded half to even."""
    return df.select(*[F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pinned(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the computed columns, which later filters cannot pull apart.

    A filter on a computed column is pushed below its projection by copying the whole expression into the filter, once
    per use. For deep expressions that costs far more than it saves, so they are passed through a one-element inline,
    which filters stay above.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))
