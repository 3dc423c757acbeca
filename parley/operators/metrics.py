"""Evaluation: every metric comes from one table of counts per (true, predicted) pair, so a corpus is read once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: probabilities are kept this far from 0 and 1 in the log loss.
LOG_LOSS_CLIP = 2.220446049250313e-16


def prediction_counts(df: DataFrame, true: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (true_class, predicted_class); combined before the shuffle."""
    return df.groupBy(*by, F.col(true).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(
        F.count("*").alias("n")
    )


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class tp, fp, fn, support and f1 (0 when undefined), over the classes of either side."""
    hit = F.col("true_class").eqNullSafe(F.col("predicted_class"))
    sides = F.array(
        F.struct(
            F.col("true_class").alias("class"),
            F.when(hit, F.col("n")).otherwise(0).alias("tp"),
            F.lit(0).cast("bigint").alias("fp"),
            F.when(hit, 0).otherwise(F.col("n")).alias("fn"),
        ),
        F.struct(
            F.col("predicted_class").alias("class"),
            F.lit(0).cast("bigint").alias("tp"),
            F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
            F.lit(0).cast("bigint").alias("fn"),
        ),
    )
    summed = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )
    below = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(below > 0, 2 * F.col("tp") / F.nullif(below, F.lit(0))).otherwise(0.0)
    return summed.withColumn("support", F.col("tp") + F.col("fn")).withColumn("f1", f1)


def metrics_bundle(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: n, accuracy, macro F1 and support-weighted F1."""
    support = F.sum("support")
    return class_scores(counts, by).groupBy(*by).agg(
        support.alias("n"),
        (F.sum("tp") / support).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / support).alias("f1_weighted"),
    )


def cross_entropy(p_true: Column) -> Column:
    """Loss of one row from the probability given to its true class."""
    return -F.log(F.least(F.greatest(p_true, F.lit(LOG_LOSS_CLIP)), F.lit(1 - LOG_LOSS_CLIP)))


def mean_loss(df: DataFrame, loss: Column, prefix: str = "eval_") -> DataFrame:
    """Mean loss over examples and their number, named with a prefix."""
    return df.agg(F.avg(loss).alias(f"{prefix}loss"), F.count("*").alias(f"{prefix}examples"))


def prefix_metrics(bundle: DataFrame, prefix: str = "eval_") -> DataFrame:
    return bundle.select(*[F.col(c).alias(c if c.startswith(prefix) else prefix + c) for c in bundle.columns])


def confusion_matrix(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long matrix over the label grid, one per group: missing cells are 0, pairs outside the labels are dropped."""
    grid = counts.sparkSession.createDataFrame(
        [(i, j, t, p) for (i, t), (j, p) in product(enumerate(labels), enumerate(labels))],
        "true_pos int, predicted_pos int, true_class string, predicted_class string",
    )
    keys = [*by, "true_class", "predicted_class"]
    cells = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    if by:  # the grid repeats for each group, of which there are as many as models
        cells_of = counts.select(*by).distinct()
        labelled = F.explode(F.array(*[F.struct(F.lit(i).alias("true_pos"), F.lit(j).alias("predicted_pos"),
                                                F.lit(t).alias("true_class"), F.lit(p).alias("predicted_class"))
                                       for (i, t), (j, p) in product(enumerate(labels), enumerate(labels))]))
        grid = cells_of.select(*by, labelled.alias("_cell")).select(*by, "_cell.*")
    return grid.join(cells, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def count_matrix(df: DataFrame, rows: str, columns: str, labels: Sequence[str]) -> DataFrame:
    """One row per value of ``rows``, one count column per label, 0 where missing."""
    return df.groupBy(rows).pivot(columns, list(labels)).count().na.fill(0, list(labels))


def accuracy_by(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Share of right predictions per true class."""
    right = F.coalesce((F.col(true) == F.col(predicted)).cast("int"), F.lit(0))
    return df.groupBy(true).agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))


def accuracy_percent(df: DataFrame, true: str, predicted: str) -> DataFrame:
    right = F.coalesce((F.col(true) == F.col(predicted)).cast("int"), F.lit(0))
    return df.agg((F.avg(right) * 100).alias("accuracy_percent"))


def compare_matrices(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Counts of two models side by side with their difference."""
    keys = ["true_class", "predicted_class"]
    left = base.select(*keys, F.col("n").alias("base_n"))
    right = tuned.select(*keys, F.col("n").alias("tuned_n"))
    both = left.join(right, keys, "full_outer").na.fill(0, ["base_n", "tuned_n"])
    return both.withColumn("delta", F.col("tuned_n") - F.col("base_n"))


def compare_metrics(bundles: DataFrame, base: str, tuned: str, model: str = "model") -> DataFrame:
    """One row with the accuracy and macro F1 of two models and their differences."""
    def of(name: str, metric: str) -> Column:
        return F.max(F.when(F.col(model) == name, F.col(metric)))

    return bundles.agg(
        *[of(name, m).alias(f"{side}_{m}") for side, name in (("base", base), ("tuned", tuned))
          for m in ("accuracy", "f1_macro")]
    ).selectExpr(
        "*", "tuned_accuracy - base_accuracy as accuracy_gain", "tuned_f1_macro - base_f1_macro as f1_macro_gain"
    )


def dataset_size(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Examples and padded tokens."""
    return df.agg(F.count("*").alias("num_examples"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("num_tokens"))


def planned_tokens(df: DataFrame, seq: str, batch_size: int, max_steps: int, ids: str = "input_ids") -> DataFrame:
    """Tokens of the first batch times the number of steps."""
    first = df.select(seq, F.size(ids).alias("_size")).orderBy(seq).limit(batch_size)
    return first.agg((F.sum("_size") * max_steps).alias("num_tokens"))


def best_run(log: DataFrame, metric: str, greater_is_better: bool = True) -> DataFrame:
    """The log row with the best value of a metric; the earliest step wins a tie, then the run name.

    NULL and NaN are never best.
    """
    sign = 1 if greater_is_better else -1
    rows = log.where((F.col("metric") == metric) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    best = F.max(F.struct((F.col("value") * sign).alias("v"), (-F.col("step")).alias("s")))
    key = rows.agg(best.alias("b")).select("b.v", "b.s")
    tied = rows.join(
        F.broadcast(key), (F.col("value") * sign == F.col("v")) & (-F.col("step") == F.col("s")), "left_semi"
    )
    return tied.orderBy("run_id").limit(1)


# ---- metrics of a user -------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class UserMetric:
    """A metric as a mergeable state of a few numbers.

    ``update(rows)`` gives the state of some rows (a pandas table of ``columns``), ``merge(states)`` adds up a two-dimensional
    array of states along its rows, and ``finish(state)`` gives the value. States of tasks are combined per group before the
    shuffle, so a group of any size sends one state from each task.
    """

    name: str
    columns: Sequence[str]
    update: Callable[[pd.DataFrame], np.ndarray]
    finish: Callable[[np.ndarray], float]
    merge: Callable[[np.ndarray], np.ndarray] = staticmethod(lambda states: states.sum(0))


def user_metric(df: DataFrame, metric: UserMetric, by: Sequence[str]) -> DataFrame:
    """Rows (by.., metric, value) of a user's metric per group. Groups without rows do not appear; a null is a group."""
    by, columns = list(by), list(metric.columns)
    groups = T.StructType([df.schema[c] for c in by])
    partial_schema = T.StructType([*groups.fields, T.StructField("_state", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([*groups.fields, T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(by, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                state = np.asarray(metric.update(rows[columns]), float)
                states[key] = metric.merge(np.stack([states[key], state])) if key in states else state
        if states:
            yield pd.DataFrame([[*k, s.tolist()] for k, s in states.items()], columns=[*by, "_state"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        value = metric.finish(metric.merge(np.stack([np.asarray(s, float) for s in rows["_state"]])))
        return pd.DataFrame([[*key, metric.name, float(value)]], columns=schema.names)

    states = df.select(*by, *[c for c in columns if c not in by]).mapInPandas(partial, partial_schema)
    return states.groupBy(*by).applyInPandas(merged, schema)
