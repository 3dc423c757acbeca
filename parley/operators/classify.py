"""Classification of text columns from scorer logits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import arrays as A
from parley.functions import text as X
from parley.operators.curation import literal_map
from parley.operators.scoring import NaiveBayesScorer, Scorer, score_together

SCORE_DIGITS = 3


def _with_scores(scored: DataFrame, labels: int, multi_label: bool) -> DataFrame:
    """Add ``_p0..``, the score per label, and ``_o0..``, the value that ranks them.

    Single label: softmax of entailment over the labels. Multi label: entailment against contradiction per label.
    Labels are plain columns here: a computed array that is read inside a lambda would be computed again for each of
    its elements.
    """
    ks = range(labels)
    logits = scored.select(
        "*",
        *[F.col("entailment")[i].alias(f"_e{i}") for i in ks],
        *[F.col("contradiction")[i].alias(f"_c{i}") for i in ks if multi_label],
    )
    if multi_label:
        return logits.select(
            "*",
            *[(F.col(f"_e{i}") - F.col(f"_c{i}")).alias(f"_o{i}") for i in ks],
            *[(1 / (1 + F.exp(F.col(f"_c{i}") - F.col(f"_e{i}")))).alias(f"_p{i}") for i in ks],
        )
    top = F.greatest(*[F.col(f"_e{i}") for i in ks]) if labels > 1 else F.col("_e0")
    shifted = logits.withColumn("_m", top).select("*", *[F.exp(F.col(f"_e{i}") - F.col("_m")).alias(f"_x{i}") for i in ks])
    total = reduce(Column.__add__, [F.col(f"_x{i}") for i in ks])
    return shifted.withColumn("_sum", total).select(
        "*",
        *[F.col(f"_e{i}").alias(f"_o{i}") for i in ks],
        *[(F.col(f"_x{i}") / F.col("_sum")).alias(f"_p{i}") for i in ks],
    )


def rank_labels(
    df: DataFrame, scorer: Scorer, text: str, key: str, multi_label: bool = False, keep_text: bool = False
) -> DataFrame:
    """Add ``scores`` in label order and ``ranked``: array of (label, score), best first, ties in candidate order.

    Ranked before any rounding. ``keep_text`` joins the text back on its unique key where the scorer does not
    carry it.
    """
    scored = scorer.score(df, text, key)
    kept = [c for c in scored.columns if c not in ("entailment", "contradiction")]
    places = F.array(
        *[
            F.struct(
                (-F.col(f"_o{i}")).alias("descending"), F.lit(i).alias("pos"), F.lit(label).alias("label"),
                F.col(f"_p{i}").alias("score"),
            )
            for i, label in enumerate(scorer.labels)
        ]
    )
    ranked = F.transform(F.array_sort(places), lambda s: F.struct(s.label.alias("label"), s.score.alias("score")))
    out = A.pinned(
        _with_scores(scored, len(scorer.labels), multi_label),
        kept,
        scores=F.array(*[F.col(f"_p{i}") for i in range(len(scorer.labels))]),
        ranked=ranked,
    )
    if keep_text and text not in out.columns:
        return out.join(df.select(key, text), key)
    return out


def _rounded(ranked: Column) -> Column:
    return F.transform(
        ranked, lambda s: F.struct(s.label.alias("label"), A.round_half_even(s.score, SCORE_DIGITS).alias("score"))
    )


def classify_text(
    df: DataFrame, scorer: Scorer, text: str, key: str, top_n: int | None = None, multi_label: bool = False
) -> DataFrame:
    """Per text the ranked ``labels`` and ``scores`` (three digits), at most ``top_n`` of them."""
    out = _rounded(F.col("ranked"))
    if top_n is not None:
        out = F.slice(out, 1, top_n)
    return (
        rank_labels(df, scorer, text, key, multi_label, keep_text=True)
        .withColumn("_r", out)
        .withColumn("labels", F.col("_r.label"))
        .withColumn("scores", F.col("_r.score"))
        .drop("_r", "ranked")
        .withColumnRenamed(text, "sequence")
    )


def classify_column(
    df: DataFrame, scorer: Scorer, text: str, key: str, suffix: str, multi_label: bool = False
) -> DataFrame:
    """Add ``top_class_``, ``top_score_`` and ``full_results_`` with the suffix."""
    return (
        rank_labels(df, scorer, text, key, multi_label, keep_text=True)
        .withColumn(f"full_results_{suffix}", _rounded(F.col("ranked")))
        .withColumn(f"top_class_{suffix}", F.col(f"full_results_{suffix}")[0].label)
        .withColumn(f"top_score_{suffix}", F.col(f"full_results_{suffix}")[0].score)
        .drop("ranked", "scores")
    )


def wide_scores(df: DataFrame, scorer: Scorer, text: str, key: str) -> DataFrame:
    """Add one score column per candidate label and ``highest_score_label``. No pivot, no shuffle."""
    ranked = rank_labels(df, scorer, text, key)
    columns = [F.col("scores")[i].alias(label) for i, label in enumerate(scorer.labels)]
    kept = [c for c in ranked.columns if c not in ("scores", "ranked")]
    return ranked.select(*kept, *columns, F.col("ranked")[0].label.alias("highest_score_label"))


def predict(df: DataFrame, scorer: Scorer, text: str, key: str) -> DataFrame:
    """Add ``predicted_class`` and ``predicted_scores`` (best first, unrounded)."""
    return (
        rank_labels(df, scorer, text, key)
        .withColumn("predicted_class", F.col("ranked")[0].label)
        .withColumn("predicted_scores", F.col("ranked.score"))
        .drop("ranked", "scores")
    )


def binary_probabilities(df: DataFrame, scorer: Scorer, text: str, key: str) -> DataFrame:
    """Add ``predicted_prob_0``, ``predicted_prob_1`` and ``predicted`` (0 on a tie) of a two-class scorer."""
    scored = scorer.score(df, text, key)
    kept = [c for c in scored.columns if c not in ("entailment", "contradiction")]
    return A.pinned(
        _with_scores(scored, 2, False),
        kept,
        predicted_prob_0=F.col("_p0"),
        predicted_prob_1=F.col("_p1"),
        predicted=F.when(F.col("_p1") > F.col("_p0"), 1).otherwise(0),
    )


def classify_binary_column(
    df: DataFrame, scorer: Scorer, text: str, key: str, suffix: str, label_map: Mapping[int, str],
    max_tokens: int | None = None,
) -> DataFrame:
    """Add ``pred_label_`` and ``prob_`` with the suffix. ``max_tokens`` is the window of the model, if it has one."""
    source = df if max_tokens is None else df.withColumn(text, X.first_words(F.col(text), max_tokens))
    return (
        binary_probabilities(source, scorer, text, key)
        .withColumn(f"pred_label_{suffix}", F.element_at(literal_map(label_map), F.col("predicted")))
        .withColumn(f"prob_{suffix}", F.greatest("predicted_prob_0", "predicted_prob_1"))
        .drop("predicted", "predicted_prob_0", "predicted_prob_1")
    )


def classify_binary_columns(
    df: DataFrame, models: Mapping[str, tuple[NaiveBayesScorer, Mapping[int, str]]], text: str, key: str
) -> DataFrame:
    """``classify_binary_column`` by several models, each a scorer and its label map under a suffix; the texts are read once."""
    out = score_together(df, {f"_{suffix}": scorer for suffix, (scorer, _) in models.items()}, text, key)
    for suffix, (_, label_map) in models.items():
        logits = {name: f"{name}_{suffix}" for name in ("entailment", "contradiction")}
        kept = [c for c in out.columns if c not in logits.values()]
        p0, p1 = F.col("_p0"), F.col("_p1")
        out = A.pinned(
            _with_scores(out.withColumnsRenamed({own: name for name, own in logits.items()}), 2, False),
            kept,
            **{f"pred_label_{suffix}": F.element_at(literal_map(label_map), F.when(p1 > p0, 1).otherwise(0)),
               f"prob_{suffix}": F.greatest(p0, p1)},
        )
    return out


def correctness(true: Column, predicted: Column) -> Column:
    """1 where both are equal, else 0."""
    return F.coalesce((true == predicted).cast("int"), F.lit(0))


def labels_param(labels: Sequence[str]) -> list[str]:
    """Candidate labels with duplicates and blanks removed, order kept."""
    return list(dict.fromkeys(l for l in (x.strip() for x in labels) if l))
