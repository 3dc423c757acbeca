"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words, as a regular expression class body: space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it.

    A plain column is copied by the optimizer into every place that reads it, inside lambdas even once per element.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of non-blank characters; none for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+")
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's text modulo a number, for folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def columns_but(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of a table without those that have one of the names (compared without case)."""
    dropped = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in dropped]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
