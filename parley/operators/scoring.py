"""Scorers: give each text an entailment and a contradiction logit per candidate label.

A scorer adds two ``array<double>`` columns, ``entailment`` and ``contradiction``, aligned with its label list. Scores
of all labels stay in the row of their text, so scoring needs no pairs of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import arrays as A
from parley.functions import text as X
from parley.operators.lookup import with_weight_sums
from parley.session import materialize

#: Logits are rounded before ranking, so that sums in another order rank alike.
LOGIT_DIGITS = 6
#: Texts that a user's model gets at once.
MODEL_ROWS = 512


class Scorer(Protocol):
    labels: Sequence[str]

    def score(self, df: DataFrame, text: str, key: str) -> DataFrame:
        """``df`` with ``entailment`` and ``contradiction``; ``key`` is unique per row."""


def rounded(c: Column) -> Column:
    return A.round_half_even(c, LOGIT_DIGITS)


def python_trigrams(s: str) -> list[str]:
    """Distinct character trigrams of a short literal such as a hypothesis, in order."""
    return list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))


@dataclass(frozen=True)
class HypothesisOverlapScorer:
    """Untrained scorer: cosine between the character trigram sets of text and hypothesis, times a scale.

    Each text is cut into trigrams once and intersected once with the trigrams of all hypotheses; the per-label
    overlaps are then taken on that short rest.
    """

    labels: Sequence[str]
    template: str = X.PLAIN_TEMPLATE
    scale: float = 10.0

    def score(self, df: DataFrame, text: str, key: str | None = None) -> DataFrame:
        grams = [python_trigrams(self.template.replace("{}", label).lower()) for label in self.labels]
        all_grams = list(dict.fromkeys(g for gs in grams for g in gs))

        def literal(values: list[str]) -> Column:
            return F.array(*map(F.lit, values)).cast("array<string>")

        found = df.withColumn("_grams", F.array_distinct(X.char_trigrams(F.lower(F.coalesce(F.col(text), F.lit(""))))))
        # pinned, because the lambda below would otherwise repeat the intersection for each label
        found = A.pinned(
            found, df.columns, _n=F.size("_grams").cast("double"), _shared=F.array_intersect("_grams", literal(all_grams))
        )
        hypotheses = F.array(*[F.struct(literal(gs).alias("g"), F.lit(float(len(gs))).alias("size")) for gs in grams])
        cosine = F.transform(
            hypotheses,
            lambda h: F.when(
                (F.col("_n") > 0) & (h.size > 0),
                F.size(F.array_intersect("_shared", h.g)) / F.sqrt(F.col("_n") * h.size),
            ).otherwise(0.0),
        )
        return A.pinned(
            found.withColumn("_cosine", cosine),
            df.columns,
            entailment=F.transform("_cosine", lambda x: rounded(self.scale * x)),
            contradiction=F.transform("_cosine", lambda x: rounded(self.scale * (1 - x))),
        )


@dataclass(frozen=True)
class NaiveBayesScorer:
    """Multinomial naive Bayes over all words of the training rows.

    ``weights`` has one row per word with its frequency ``n`` and the log weights ``e0..`` of the word in each class and
    ``c0..`` in all other classes. Words that training has not seen have no weight.
    """

    labels: Sequence[str]
    weights: DataFrame
    log_prior: Sequence[float]
    log_prior_rest: Sequence[float]

    def score(self, df: DataFrame, text: str, key: str) -> DataFrame:
        """Sums of the words' weights, taken inside the row; the text stays in it."""
        return score_together(df, {"": self}, text, key)


def score_together(df: DataFrame, scorers: Mapping[str, NaiveBayesScorer], text: str, key: str) -> DataFrame:
    """``df`` with ``entailment`` and ``contradiction`` of several scorers, each under its suffix.

    A word has one row with its weights for all scorers, so the texts are cut into words and summed once, whatever the number
    of scorers; a scorer that has not seen a word gives it the weight 0.
    """
    width = 2 * sum(len(s.labels) for s in scorers.values())
    tables, logits, start = [], [], 0
    for suffix, scorer in scorers.items():
        size = len(scorer.labels)
        own = [F.col(f"{p}{i}") for p in "ec" for i in range(size)]
        padded = [F.lit(0.0)] * start + own + [F.lit(0.0)] * (width - start - 2 * size)
        tables.append(scorer.weights.select(F.col("word").alias("item"), "n", F.array(*padded).alias("w")))
        priors = (("entailment", start, scorer.log_prior), ("contradiction", start + size, scorer.log_prior_rest))
        logits += [F.array(*[rounded(F.col("_sums")[at + i] + prior[i]) for i in range(size)]).alias(name + suffix)
                   for name, at, prior in priors]
        start += 2 * size
    table = tables[0]
    if len(tables) > 1:
        table = materialize(reduce(DataFrame.unionByName, tables).groupBy("item").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("w")[k]) for k in range(width)]).alias("w")), "weights")
    return with_weight_sums(df, text, X.words, table, key, width).select(*df.columns, *logits)


def naive_bayes_counts(
    train: DataFrame, text: str, category: str, labels: Sequence[str], vocab_size: int | None = None
) -> DataFrame:
    """Per training word its count in each class (``n0..``) and in all (``n``).

    With ``vocab_size`` only the most frequent words, ties by word.
    """
    tokens = train.where(F.col(category).isin(list(labels))).select(category, F.explode(X.words(F.col(text))).alias("word"))
    per_class = [F.count_if(F.col(category) == label).alias(f"n{i}") for i, label in enumerate(labels)]
    counts = tokens.groupBy("word").agg(F.count("*").alias("n"), *per_class)
    return counts if vocab_size is None else counts.orderBy(F.desc("n"), "word").limit(vocab_size)


def fit_naive_bayes(
    train: DataFrame, text: str, category: str, labels: Sequence[str], vocab_size: int | None = None
) -> NaiveBayesScorer:
    """Fit by two grouped counts. What reaches the driver is a few numbers per class."""
    labels = list(labels)
    rows = dict(
        train.where(F.col(category).isin(labels)).groupBy(category).agg(F.count("*")).collect()
    )
    counts = materialize(naive_bayes_counts(train, text, category, labels, vocab_size), "word-counts")
    return _from_counts(counts, labels, rows)


def fit_naive_bayes_together(train: DataFrame, text: str, classes: Mapping[str, Sequence[str]]) -> dict[str, NaiveBayesScorer]:
    """``fit_naive_bayes`` of several category columns, each with its labels, by grouped counts of one pass over the words."""
    known = {c: F.col(c).isin(list(labels)) for c, labels in classes.items()}
    rows = {c: dict(train.where(known[c]).groupBy(c).agg(F.count("*")).collect()) for c in classes}
    tokens = train.where(reduce(Column.__or__, known.values())).select(*classes, F.explode(X.words(F.col(text))).alias("word"))
    counted = [F.count_if(known[c]).alias(f"n_{j}") for j, c in enumerate(classes)]
    counted += [F.count_if(F.col(c) == label).alias(f"n{i}_{j}")
                for j, c in enumerate(classes) for i, label in enumerate(classes[c])]
    counts = materialize(tokens.groupBy("word").agg(*counted), "word-counts")
    return {c: _from_counts(counts.where(f"n_{j} > 0").select(
        "word", F.col(f"n_{j}").alias("n"), *[F.col(f"n{i}_{j}").alias(f"n{i}") for i in range(len(classes[c]))]),
        list(classes[c]), rows[c]) for j, c in enumerate(classes)}


def _from_counts(counts: DataFrame, labels: list[str], rows: Mapping[str, int]) -> NaiveBayesScorer:
    """The scorer of counted words and of the number of rows per label."""
    total = sum(rows.values())
    # one more row per class, so that a class without rows keeps a finite prior
    share = [(rows.get(label, 0) + 1) / (total + len(labels)) for label in labels]
    ks = range(len(labels))
    sums = counts.agg(F.count("*").alias("size"), F.sum("n").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in ks])
    whole = {c: v or 0 for c, v in sums.first().asDict().items()}

    def weight(n: Column, of: int) -> Column:
        return F.log((n + 1) / F.lit(float(max(1, of + whole["size"]))))

    weights = counts.select(
        "word",
        "n",
        *[weight(F.col(f"n{i}"), whole[f"n{i}"]).alias(f"e{i}") for i in ks],
        *[weight(F.col("n") - F.col(f"n{i}"), whole["n"] - whole[f"n{i}"]).alias(f"c{i}") for i in ks],
    )
    return NaiveBayesScorer(
        labels,
        materialize(weights, "naive-bayes"),
        [math.log(p) for p in share],
        [math.log(1 - p) if p < 1 else 0.0 for p in share],
    )


#: Models that a Python worker has loaded, by the pickled loader.
_MODELS: dict[bytes, Callable] = {}


def loaded_model(load: Callable[[], Callable], pickled: bytes) -> Callable:
    """The worker's model of a loader; one is kept."""
    if pickled not in _MODELS:
        _MODELS.clear()
        _MODELS[pickled] = load()
    return _MODELS[pickled]


@dataclass(frozen=True)
class ModelScorer:
    """A user's model, called on MODEL_ROWS texts at once, whatever the size of the Arrow batches.

    ``load`` is called once per Python worker and returns ``model(texts, labels) -> (entailment, contradiction)``, two
    lists of per-label lists.
    """

    labels: Sequence[str]
    load: Callable[[], Callable]

    def score(self, df: DataFrame, text: str, key: str | None = None) -> DataFrame:
        labels, load = list(self.labels), self.load
        pickled = cloudpickle.dumps(load)
        logits = T.ArrayType(T.DoubleType())
        schema = T.StructType(
            df.schema.fields + [T.StructField("entailment", logits), T.StructField("contradiction", logits)]
        )

        place = df.columns.index(text)

        def run(batches):
            model, lists = loaded_model(load, pickled), pa.list_(pa.float64())
            for batch in (b.slice(s, MODEL_ROWS) for b in batches for s in range(0, b.num_rows, MODEL_ROWS)):
                found = model(batch.column(place).to_pylist(), labels)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *[pa.array(list(logits), lists) for logits in found]],
                    names=[*batch.schema.names, "entailment", "contradiction"])

        return df.mapInArrow(run, schema)


def scorer_for(
    spark: SparkSession, model_path: str, marker: str, backend: Callable[[str], Scorer], fallback: Scorer
) -> Scorer:
    """The backend's scorer when the folder holds its marker file, otherwise the fallback; on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(model_path, marker)
    saved = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return backend(model_path) if saved else fallback
