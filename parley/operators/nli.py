"""Training rows for natural-language inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.ordering import hash_order, positional_split
from parley.schemas import CONTRADICTION, ENTAILMENT

# Fixed value: sequence length of training rows; one place is left for the end mark.
MAX_LENGTH = 128


def encode(df: DataFrame, text: Column, max_length: int = MAX_LENGTH, vocab_size: int = 50_000) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``: hashed word ids cut and padded to ``max_length - 1``."""
    size = max_length - 1
    ids = F.slice(X.word_ids(F.slice(X.words(text), 1, size), vocab_size), 1, size)
    padding = F.array_repeat(F.lit(0), size - F.size("_ids"))
    return (
        df.withColumn("_ids", ids)
        .withColumn("input_ids", F.concat("_ids", padding))
        .withColumn("attention_mask", F.concat(F.transform("_ids", lambda _: F.lit(1)), padding))
        .drop("_ids")
    )


def input_sentences(df: DataFrame, template: str = X.PROMPT_TEMPLATE, marks: tuple[str, str] = X.PROMPT_MARKS,
                    category: str = "category") -> DataFrame:
    """Add ``input_sentence``: the marked text followed by the hypothesis of its category."""
    return df.withColumn(
        "input_sentence", X.marked(F.col("text"), marks, X.hypothesis(template, F.col(category)))
    )


def format_rows(
    df: DataFrame, key: str, template: str = X.PROMPT_TEMPLATE, max_length: int = MAX_LENGTH,
    eval_share: float = 0.4, seed: int = 42,
) -> DataFrame:
    """Labelled rows as encoded training rows with a seeded positional split."""
    split = positional_split(input_sentences(df, template), key, eval_share, seed)
    return encode(split, F.col("input_sentence"), max_length).withColumnRenamed("label", "labels")


def contradiction_labels(key: Column, own: Column, labels: Sequence[str], k: int, seed: int | str) -> Column:
    """``k`` labels other than the row's own, drawn without replacement in seeded md5 order.

    The draw sorts the short label list inside the row. Rows with too few other labels fail the job.
    """
    others = F.filter(F.array(*map(F.lit, labels)), lambda l: ~l.eqNullSafe(own))
    draw = F.transform(
        others,
        lambda l: F.struct(hash_order(F.concat(key.cast("string"), F.lit(":"), l), seed).alias("h"), l.alias("l")),
    )
    picked = F.transform(F.slice(F.array_sort(draw), 1, k), lambda s: s.l)
    enough = F.size(others) >= k
    return F.when(enough, picked).otherwise(
        F.raise_error(F.lit(f"fewer than {k} other labels to draw from")).cast("array<string>")
    )


def contradiction_rows(
    df: DataFrame, key: str, labels: Sequence[str], k: int = 2, template: str = X.PLAIN_TEMPLATE,
    marks: tuple[str, str] = X.PROMPT_MARKS, category: str = "category", seed: int = 42,
) -> DataFrame:
    """Per row one entailment with its own category and ``k`` contradictions with others: N * (1 + k) rows.

    Adds ``pos`` (0 for the entailment), ``hypothesis``, ``labels`` and ``input_sentence``. No shuffle.
    """
    drawn = contradiction_labels(F.col(key), F.col(category), labels, k, seed)
    all_labels = F.concat(F.array(F.col(category)), drawn)
    rows = df.select("*", F.posexplode(all_labels).alias("pos", "_label"))
    return (
        rows.withColumn("hypothesis", X.hypothesis(template, F.col("_label")))
        .withColumn("labels", F.when(F.col("pos") == 0, ENTAILMENT).otherwise(CONTRADICTION))
        .withColumn("input_sentence", X.marked(F.col("text"), marks, F.col("hypothesis")))
        .withColumnRenamed("_label", "hypothesis_category")
    )


def contradiction_dataset(
    df: DataFrame, key: str, labels: Sequence[str], k: int = 2, template: str = X.PLAIN_TEMPLATE,
    max_length: int = MAX_LENGTH, eval_share: float = 0.2, seed: int = 42, group_by_text: bool = False,
) -> DataFrame:
    """Entailment and contradiction rows, split and encoded.

    The split is per generated row, so rows of one text may fall on both sides; ``group_by_text`` keeps them together.
    """
    if group_by_text:
        rows = contradiction_rows(positional_split(df, key, eval_share, seed), key, labels, k, template, seed=seed)
    else:
        made = contradiction_rows(df, key, labels, k, template, seed=seed)
        made = made.withColumn("row_key", F.concat(F.col(key).cast("string"), F.lit("-"), F.col("pos").cast("string")))
        rows = positional_split(made, "row_key", eval_share, seed)
    return encode(rows, F.col("input_sentence"), max_length)


def paired_encoding(df: DataFrame, key: str, labels: Sequence[str], template: str = X.PLAIN_TEMPLATE,
                    category: str = "category", seed: int = 42) -> DataFrame:
    """Two rows per text, one entailment and one contradiction, as separate premise and hypothesis."""
    rows = contradiction_rows(df, key, labels, 1, template, category=category, seed=seed)
    return rows.select(key, F.col("text").alias("premise"), "hypothesis", "labels", "pos")
