"""Batch labelling: the queue an annotator works through and the records that follow from the decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.classify import rank_labels
from parley.operators.ordering import number_rows
from parley.operators.scoring import Scorer
from parley.schemas import CONTRADICTION, ENTAILMENT, NEUTRAL

# The actions of an annotator.
CORRECT, WRONG, NEUTRAL_ACTION, SKIP = "correct", "wrong", "neutral", "skip"


def labeling_queue(
    prompts: DataFrame, scorer: Scorer, text: str = "text", key: str = "seq", seed: int = 42, name: str = "place"
) -> DataFrame:
    """Shuffled texts with the label and score of the best, the second and the last candidate."""
    numbered = number_rows(prompts, key, seed, name)
    ranked = rank_labels(numbered, scorer, text, key, keep_text=True)
    columns = []
    for who, at in (("top", 1), ("second", 2), ("bottom", -1)):
        columns.append(F.element_at("ranked", at).label.alias(f"{who}_category"))
        columns.append(F.element_at("ranked", at).score.alias(f"{who}_score"))
    return ranked.select(*numbered.columns, *columns)


def records_of(action: Column) -> Column:
    """The records of one decision as an ordered array of (category, label).

    Custom texts count when not blank; the custom neutral one only after the neutral action.
    """
    def record(when: Column, category: Column, label: int) -> Column:
        return F.when(
            when & category.isNotNull(), F.struct(category.alias("category"), F.lit(label).alias("label"))
        )

    custom = {n: X.stripped_or_null(F.col(f"custom_{n}")) for n in ("entailment", "contradiction", "neutral")}
    top, bottom = F.col("top_category"), F.col("bottom_category")
    decided = action.isin(CORRECT, WRONG, NEUTRAL_ACTION)
    records = F.array(
        record(action == CORRECT, top, ENTAILMENT),
        record(action == WRONG, top, CONTRADICTION),
        record(action == NEUTRAL_ACTION, top, NEUTRAL),
        record(action.isin(CORRECT, NEUTRAL_ACTION), bottom, CONTRADICTION),
        record(decided, custom["entailment"], ENTAILMENT),
        record(decided, custom["contradiction"], CONTRADICTION),
        record(action == NEUTRAL_ACTION, custom["neutral"], NEUTRAL),
    )
    return F.filter(records, lambda r: r.isNotNull())


def apply_decisions(queue: DataFrame, decisions: DataFrame, text: str = "text", key: str = "seq") -> DataFrame:
    """Labelled records (key, place, text, category, label) of all decisions, in the order they were recorded."""
    joined = queue.join(decisions, key)
    return joined.select(
        key, F.col(text).alias("text"), F.posexplode(records_of(F.col("action"))).alias("place", "r")
    ).select(key, "place", "text", "r.category", "r.label")
