"""Table schemas and edge checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

#: One row per conversation; ``turn`` is the number of turns in it.
CONVERSATION = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("conversation", T.ArrayType(MESSAGE)),
    ]
)

#: One row per message; ``pos`` is the position of the message, from 0.
MESSAGES = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)

#: Labelled rows of a natural-language-inference dataset.
NLI = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

#: Long training log.
TRAINING_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("epoch", T.DoubleType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# The label ids of the dataset and their names.
LABEL_NAMES = {0: "contradiction", 1: "neutral", 2: "entailment"}
CONTRADICTION, NEUTRAL, ENTAILMENT = 0, 1, 2


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, with the missing names, instead of deep inside a plan."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
