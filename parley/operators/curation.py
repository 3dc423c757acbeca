"""Edits of labelled tables: filters, rules, mappings, casts and appends. All are narrow."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.schemas import ENTAILMENT, LABEL_NAMES

# Nine categories that fold into four groups.
CATEGORY_GROUPS = {
    "business": "business and finance",
    "finance": "business and finance",
    "language": "language and writing",
    "writing": "language and writing",
    "popular culture": "culture and entertainment",
    "music": "culture and entertainment",
    "entertainment": "culture and entertainment",
    "technology": "technology and ai",
    "ai": "technology and ai",
}


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def matches(c: Column, pattern: str, regex: bool = False) -> Column:
    """Literal substring test, or a regular expression; false for NULL."""
    hit = F.rlike(c, F.lit(pattern)) if regex else F.contains(c, F.lit(pattern))
    return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Applies to rows whose text matches ``pattern`` and whose label is ``label``.

    ``category`` None deletes the row, otherwise it replaces the category.
    """

    pattern: str
    category: str | None = None
    label: int = ENTAILMENT
    regex: bool = False

    def applies(self) -> Column:
        return matches(F.col("text"), self.pattern, self.regex) & F.coalesce(F.col("label") == self.label, F.lit(False))


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All deletions and category updates of a rule list in one pass; a later update wins."""
    deletions = [r.applies() for r in rules if r.category is None]
    updates = [r for r in rules if r.category is not None]
    kept = df.where(~reduce(Column.__or__, deletions)) if deletions else df
    category = F.col("category")
    for rule in updates:
        category = F.when(rule.applies(), F.lit(rule.category)).otherwise(category)
    return kept.withColumn("category", category)


def entailments(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") == ENTAILMENT)


def without_tags(df: DataFrame, tags: Iterable[str], column: str = "conversation_tag") -> DataFrame:
    """Drop rows with one of the tags; untagged rows are kept."""
    return df.where(~F.coalesce(F.col(column).isin(list(tags)), F.lit(False)))


def lowercase(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lower(column))


def swap_value(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def map_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace mapped values; others stay."""
    return df.withColumn(column, F.coalesce(F.try_element_at(literal_map(mapping), F.col(column)), F.col(column)))


def group_categories(df: DataFrame, column: str = "category") -> DataFrame:
    return map_values(df, column, CATEGORY_GROUPS)


def select_accepted(df: DataFrame, accepted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep the columns a consumer accepts, in its order; also return the ignored ones."""
    kept = [c for c in accepted if c in df.columns]
    if not kept:
        raise ValueError(f"none of {list(accepted)} is in {df.columns}")
    return df.select(*kept), [c for c in df.columns if c not in kept]


def decode_class(df: DataFrame, names: Sequence[str], source: str = "label", target: str = "class") -> DataFrame:
    """Class name by position, replacing the id column."""
    name = F.element_at(F.array(*map(F.lit, names)), F.col(source) + 1)
    return df.withColumn(target, name).drop(source)


def cast_label(df: DataFrame, column: str = "label", names: Mapping[int, str] = LABEL_NAMES) -> DataFrame:
    """Check labels against the enum and add ``<column>_name``; an unknown id fails the job."""
    name = F.try_element_at(literal_map(names), F.col(column).cast("int"))
    checked = F.when(name.isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col(column).cast("string"))))
    # both results carry the check, so that it holds whichever of them is read
    return df.withColumns({
        f"{column}_name": F.coalesce(checked.cast("string"), name),
        column: F.coalesce(checked.cast("int"), F.col(column).cast("int")),
    })


def flip_label_convention(c: Column) -> Column:
    """Between 0 contradiction .. 2 entailment and 0 entailment .. 2 contradiction."""
    return F.element_at(literal_map({0: 2, 1: 1, 2: 0}), c)


def top_categories(df: DataFrame, k: int, column: str = "category", exclude: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent values with their counts; excluded values are removed before the cut."""
    kept = df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(exclude)))
    return kept.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def in_top_categories(df: DataFrame, k: int, column: str = "category", exclude: Sequence[str] = ()) -> DataFrame:
    """Rows in the top ``k`` categories; the side broadcast has ``k`` rows."""
    top = top_categories(df, k, column, exclude).select(column)
    return df.join(F.broadcast(top), column, "left_semi")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL skipped."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def append_to_split(dataset: DataFrame, new_rows: DataFrame, split: str, splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Append records to one split, duplicates kept; labels of the new records are checked."""
    if split not in splits:
        raise ValueError(f"unknown split {split!r}; have {list(splits)}")
    checked = cast_label(new_rows).select(*[c for c in new_rows.columns if c != "split"])
    return dataset.unionByName(checked.withColumn("split", F.lit(split)), allowMissingColumns=True)
