"""Fitting, searching and logging of classifiers on training rows."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.pairs import with_pair_items
from parley.schemas import TRAINING_LOG
from parley.session import materialize


#: A fit ends when an iteration changes its loss by less than this share; the iterations allowed are far beyond that.
TOLERANCE = 1e-3
#: Trials of a search that are fitted at once.
PARALLEL_TRIALS = 2


def pair_features(df: DataFrame, premise: str, hypothesis: str, size: int = 1 << 12) -> DataFrame:
    """Hashed counts of premise words, hypothesis words and words found in both, as ``features``."""
    rows = with_pair_items(df, premise, hypothesis, "_words")
    return HashingTF(numFeatures=size, inputCol="_words", outputCol="features").transform(rows).drop("_words")


def fit_logistic(
    train: DataFrame, label: str = "labels", max_iter: int = 1000, reg: float = 0.01
) -> LogisticRegressionModel:
    return LogisticRegression(labelCol=label, maxIter=max_iter, regParam=reg, tol=TOLERANCE).fit(train)


def training_history(model: LogisticRegressionModel, run_id: str, metric: str = "loss") -> DataFrame:
    """One log row per iteration of the fit."""
    values = model.summary.objectiveHistory
    return model.summary.predictions.sparkSession.createDataFrame(
        [(run_id, i, float(i), metric, float(v)) for i, v in enumerate(values)], TRAINING_LOG
    )


def search_settings(
    train: DataFrame, grid: Sequence[dict[str, float]], label: str = "labels", max_iter: int = 1000,
    train_share: float = 0.8, seed: int = 42, metric: str = "accuracy",
) -> DataFrame:
    """Fit every setting on the same random split; one row per trial with its objective, as a training log.

    The split is written once, so each fit holds its own blocks in memory and nothing else; no model is fitted on all rows, since
    only the objectives are returned.
    """
    lr = LogisticRegression(labelCol=label, maxIter=max_iter, tol=TOLERANCE)
    maps = [{lr.getParam(name): value for name, value in setting.items()} for setting in grid] or [{}]
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    drawn = materialize(train.select(label, "features", F.rand(seed).alias("_draw")), "settings")
    fitted, held_out = drawn.where(F.col("_draw") < train_share), drawn.where(F.col("_draw") >= train_share)

    def trial(params: dict) -> float:
        return evaluator.evaluate(lr.fit(fitted, params).transform(held_out))

    pool = ThreadPool(min(PARALLEL_TRIALS, len(maps)))
    try:
        scores = pool.map(inheritable_thread_target(train.sparkSession)(trial), maps, 1)
    finally:
        pool.close()
    rows = [(f"trial-{i}", 0, 0.0, f"eval_{metric}", float(v)) for i, v in enumerate(scores)]
    return train.sparkSession.createDataFrame(rows, TRAINING_LOG)
