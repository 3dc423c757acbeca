"""Classifiers of premise and hypothesis pairs, scored for all candidate labels inside the row of their premise.

A pair model weighs the words of the premise, those of the hypothesis and those found in both. The premise's part is the same
for every label, the hypothesis' part the same for every text, so both are summed once; what is left for each label of a text
is the few words that they share. No pair is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import arrays as A
from parley.functions import text as X
from parley.operators.lookup import with_weight_sums
from parley.operators.scoring import rounded
from parley.schemas import CONTRADICTION, ENTAILMENT
from parley.session import materialize

#: Marks in front of words of the hypothesis and of words found in both texts; words hold no blank.
OF_HYPOTHESIS, OF_BOTH = "h ", "b "
CLASSES = (ENTAILMENT, CONTRADICTION)
#: Column of the words of a premise.
PREMISE_WORDS = "_premise_words"


def pair_items(left: Column, hypothesis: Column) -> Column:
    """Words of the premise as given, marked words of the hypothesis, and each word found in both once, marked."""
    right = X.words(hypothesis)
    return F.concat(
        left,
        F.transform(right, lambda w: F.concat(F.lit(OF_HYPOTHESIS), w)),
        F.transform(F.array_intersect(left, right), lambda w: F.concat(F.lit(OF_BOTH), w)),
    )


def with_premise_words(df: DataFrame, premise: str) -> DataFrame:
    """Add the words of the premise. Called before rows are repeated for several hypotheses, a text is cut into words once."""
    return df.withColumn(PREMISE_WORDS, X.words(F.col(premise)))


def with_pair_items(rows: DataFrame, premise: str, hypothesis: str, target: str) -> DataFrame:
    """Add the items of the pair; the words of the premise are taken from ``with_premise_words`` where it was called."""
    known = rows if PREMISE_WORDS in rows.columns else with_premise_words(rows, premise)
    return known.withColumn(target, pair_items(F.col(PREMISE_WORDS), F.col(hypothesis))).drop(PREMISE_WORDS)


class PairModel(Protocol):
    def premise_logits(self, df: DataFrame, text: str, key: str) -> DataFrame:
        """``df`` with ``_premise``: logits of entailment and contradiction without a hypothesis."""

    def weights_of(self, items: Sequence[str]) -> dict[str, tuple[float, float]]:
        """Weights of entailment and contradiction of the items the model knows."""


@dataclass(frozen=True)
class PairScorer:
    """Scores the hypothesis of every label against a text, as the pair model does for each pair."""

    labels: Sequence[str]
    model: PairModel
    template: str = X.PLAIN_TEMPLATE

    def _hypotheses(self, df: DataFrame) -> list[list[str]]:
        """Words of the hypothesis of each label."""
        rows = df.sparkSession.createDataFrame([(i, label) for i, label in enumerate(self.labels)], "i int, label string")
        words = rows.select("i", X.words(X.hypothesis(self.template, F.col("label"))).alias("w")).collect()
        return [r["w"] for r in sorted(words, key=lambda r: r["i"])]

    def score(self, df: DataFrame, text: str, key: str) -> DataFrame:
        hypotheses = self._hypotheses(df)
        words = sorted({w for h in hypotheses for w in h})
        weights = self.model.weights_of([mark + w for mark in (OF_HYPOTHESIS, OF_BOTH) for w in words])
        wanted = F.array(*map(F.lit, words)).cast("array<string>")
        found = A.pinned(df, df.columns, _shared=F.array_intersect(X.words(F.coalesce(F.col(text), F.lit(""))), wanted))
        scored = self.model.premise_logits(found, text, key)

        def logit(k: int, hypothesis: list[str]) -> Column:
            total = F.col("_premise")[k] + sum(weights.get(OF_HYPOTHESIS + w, (0.0, 0.0))[k] for w in hypothesis)
            for w in dict.fromkeys(hypothesis):
                weight = weights.get(OF_BOTH + w, (0.0, 0.0))[k]
                if weight:
                    total = total + F.when(F.array_contains("_shared", w), weight).otherwise(0.0)
            return rounded(total)

        return scored.select(*df.columns, *[F.array(*[logit(k, h) for h in hypotheses]).alias(name)
                                            for k, name in enumerate(("entailment", "contradiction"))])


@dataclass(frozen=True)
class CountedPairModel:
    """Naive Bayes over the items of pairs; ``weights`` has columns item, n and w (entailment, contradiction)."""

    weights: DataFrame
    log_prior: tuple[float, float]

    def premise_logits(self, df: DataFrame, text: str, key: str) -> DataFrame:
        plain = self.weights.where(~F.contains("item", F.lit(" ")))
        summed = with_weight_sums(df, text, X.words, plain, key, len(CLASSES))
        logits = F.array(*[F.col("_sums")[k] + F.lit(self.log_prior[k]) for k in range(len(CLASSES))])
        return summed.select(*df.columns, logits.alias("_premise"))

    def weights_of(self, items: Sequence[str]) -> dict[str, tuple[float, float]]:
        rows = self.weights.where(F.col("item").isin(list(items))).select("item", "w").collect()
        return {r["item"]: tuple(r["w"]) for r in rows}


def pair_counts(rows: DataFrame, premise: str, hypothesis: str, label: str = "labels") -> DataFrame:
    """Per item of the pairs its count in entailments (n0), in contradictions (n1) and in both (n)."""
    known = rows.where(F.col(label).isin(list(CLASSES)))
    paired = with_pair_items(known, premise, hypothesis, "_items")
    items = paired.select(F.col(label).alias("label"), F.explode("_items").alias("item"))
    return items.groupBy("item").agg(F.count("*").alias("n"), *[
        F.count_if(F.col("label") == c).alias(f"n{k}") for k, c in enumerate(CLASSES)])


def fit_pair_bayes(rows: DataFrame, premise: str, hypothesis: str, label: str = "labels") -> CountedPairModel:
    """Fitted by one grouped count. The driver gets one total per class."""
    sizes = dict(rows.where(F.col(label).isin(list(CLASSES))).groupBy(label).agg(F.count("*")).collect())
    share = [(sizes.get(c, 0) + 1) / (sum(sizes.values()) + len(CLASSES)) for c in CLASSES]
    counts = materialize(pair_counts(rows, premise, hypothesis, label), "pair-counts")
    totals = counts.agg(F.count("*").alias("size"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    weights = [F.log((F.col(f"n{k}") + 1) / F.lit(float(max(1, (totals[f"n{k}"] or 0) + totals["size"]))))
               for k in range(len(CLASSES))]
    table = counts.select("item", "n", F.array(*weights).alias("w"))
    return CountedPairModel(materialize(table, "pair-weights"), tuple(math.log(p) for p in share))


@dataclass(frozen=True)
class HashedPairModel:
    """A logistic regression on hashed items of pairs, as ``training.fit_logistic`` gives it."""

    model: LogisticRegressionModel

    def _hashing(self) -> HashingTF:
        return HashingTF(numFeatures=self.model.numFeatures, inputCol="_words", outputCol="_features")

    def premise_logits(self, df: DataFrame, text: str, key: str) -> DataFrame:
        rows = self._hashing().transform(df.withColumn("_words", X.words(F.coalesce(F.col(text), F.lit("")))))
        model = self.model.copy({self.model.featuresCol: "_features", self.model.rawPredictionCol: "_raw",
                                 self.model.probabilityCol: "", self.model.predictionCol: ""})
        raw = vector_to_array("_raw")
        return model.transform(rows).select(*df.columns, F.array(*[raw[c] for c in CLASSES]).alias("_premise"))

    def weights_of(self, items: Sequence[str]) -> dict[str, tuple[float, float]]:
        matrix, hashing = self.model.coefficientMatrix.toArray(), self._hashing()
        places = {item: hashing.indexOf(item) for item in items}
        return {item: tuple(float(matrix[c, place]) for c in CLASSES) for item, place in places.items()}
