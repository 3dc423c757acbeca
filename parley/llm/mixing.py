"""Operator 8, mixing documents to target weights of domains with soft membership.

A classifier learned from a labelled table gives each document a posterior over the domains. Nonnegative rates are then
fitted by least squares, so that the expected token totals (rate x tokens x posterior, summed over all documents) match the
targets, with a slight pull towards rate 1 that makes the solution unique. The projected solution has the form
``max(0, 1 - posterior . y)``, so a step only needs one distributed sum over all documents, of as many numbers as there are
domains and pairs of them; gradient steps on y are scaled by the curvature of the documents whose rate is positive.

The classifier is fitted on a bounded sample (SAMPLE_PER_DOMAIN expected labelled rows of each domain); posteriors, totals and
rates cover all documents.

Edge cases: a null or blank text has no tokens, the posterior of an empty text and the rate that follows from it. Domains
without labelled rows are left out and the other targets scaled up; labelled domains without a target get target 0. With
fewer than two labelled domains there is nothing to choose between and every rate is 1. Repeated rows get equal rates.
Other columns pass through ``resampled``. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.exprs import words_of
from parley.session import materialize

SAMPLE_PER_DOMAIN = 500
FEATURES = 1 << 14
#: Pull of the rates towards 1, relative to the squared mismatch of token shares.
PULL = 1e-4
#: The fit ends when the remaining error of all shares is below this.
TOLERANCE = 1e-9
MAX_STEPS = 100
#: Slope that is left where rounding allows no lower step.
ACCEPTED = 1e-6


@dataclass
class Classifier:
    domains: list[str]
    model: PipelineModel | None


def _words(text: Column) -> Column:
    return words_of(F.lower(text))


def learned(labelled: DataFrame, domain: str, text: str = "text", key: str = "doc_id",
            per_domain: int = SAMPLE_PER_DOMAIN) -> Classifier:
    """Logistic regression on hashed words of a sample of labelled rows."""
    rows = labelled.select(F.col(domain).alias("domain"), F.col(text).alias("text"), F.col(key).alias("key"))
    rows = rows.filter("domain is not null")
    counts = rows.groupBy("domain").count().orderBy("domain").collect()
    domains = [r["domain"] for r in counts]
    if len(domains) < 2:
        return Classifier(domains, None)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["domain"], min(1.0, per_domain / r["count"]))])
    label = F.create_map(*[F.lit(x) for k, d in enumerate(domains) for x in (d, float(k))])
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(draw < share[F.col("domain")]).select(label[F.col("domain")].alias("label"),
                                                               _words(F.col("text")).alias("words"))
    stages = [HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="counts"),
              Normalizer(inputCol="counts", outputCol="features")]
    sample = materialize(PipelineModel(stages).transform(sample).select("label", "features"), "mixing-sample")
    fitted = LogisticRegression(regParam=1e-4, maxIter=200, tol=1e-6, probabilityCol="posterior").fit(sample)
    return Classifier(domains, PipelineModel([*stages, fitted]))


def posteriors(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow table key, n_tokens, posterior (in the order of the classifier's domains)."""
    rows = docs.select(F.col(key).alias(key), _words(F.col(text)).alias("words"))
    tokens = F.size("words").cast("long").alias("n_tokens")
    if classifier.model is None:
        return rows.select(key, tokens, F.array(*[F.lit(1.0) for _ in classifier.domains]).cast("array<double>")
                           .alias("posterior"))
    found = classifier.model.transform(rows)
    return found.select(key, tokens, vector_to_array("posterior").alias("posterior"))


def _rate(y: np.ndarray) -> Column:
    """Projected rate of a document: 1 - posterior . y, not below 0."""
    weights = F.array(*[F.lit(float(value)) for value in y]).cast("array<double>")
    products = F.zip_with("posterior", weights, lambda p, w: p * w)
    return F.greatest(F.lit(0.0), 1 - F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def _sums(members: DataFrame, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Half the tokens times their squared rates, the expected token totals of the domains at y, and the curvature of the
    totals over documents with a positive rate; summed inside the tasks, for any number of domains."""
    n = len(y)
    empty = np.zeros(1 + n + n * n)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty.copy()
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            shares = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), n)
            rate = np.maximum(0.0, 1 - shares @ y)
            active = np.where(rate > 0, tokens, 0.0)
            total += np.concatenate([[0.5 * tokens @ rate ** 2], (tokens * rate) @ shares,
                                     ((shares * active[:, None]).T @ shares).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

    rows = members.select("n_tokens", "posterior").mapInArrow(partial, "place long, value double")
    sums = rows.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = empty.copy()
    total[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return float(total[0]), total[1:n + 1], total[n + 1:].reshape(n, n)


def fitted_rates(members: DataFrame, targets: np.ndarray, tokens: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vector y of the rates, and the expected token shares that it gives.

    ``targets`` are shares that sum to 1; ``tokens`` is the wanted number of tokens, by default as many as there are. The fit
    minimises a convex function, so every step must lower it; a fit that ends with a larger slope than ACCEPTED is an error.
    """
    y = np.zeros(len(targets))
    squares, totals, curve = _sums(members, y)
    wanted = tokens or float(totals.sum())
    if wanted <= 0:
        return y, totals

    def cost(squares: float, y: np.ndarray) -> float:
        return PULL / 2 * float(y @ y) + squares / wanted + float(targets @ y)

    def slope(totals: np.ndarray, y: np.ndarray) -> np.ndarray:
        return PULL * y - (totals / wanted - targets)

    now, height = slope(totals, y), cost(squares, y)
    for _ in range(MAX_STEPS):
        if np.abs(now).max() < TOLERANCE:
            break
        step, size = np.linalg.solve(curve / wanted + PULL * np.eye(len(y)), now), 1.0
        while size > 1e-8:
            tried = y - size * step
            squares, totals_tried, curve_tried = _sums(members, tried)
            after, lower = slope(totals_tried, tried), cost(squares, tried)
            if lower < height or np.abs(after).max() < np.abs(now).max() and lower <= height + 1e-15:
                break
            size /= 2
        else:
            break
        y, now, height, totals, curve = tried, after, lower, totals_tried, curve_tried
    if np.abs(now).max() > ACCEPTED:
        raise RuntimeError(f"rates miss the target shares by {np.abs(now).max():.2g}")
    return y, totals / wanted


def target_shares(domains: list[str], targets: dict[str, float]) -> np.ndarray:
    found = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    return found / found.sum() if found.sum() > 0 else np.full(len(domains), 1 / max(1, len(domains)))


def copies_of(rate: Column, key: Column, seed: int = 0) -> Column:
    """A rate rounded to copies: its whole part, and one more for a share of the keys equal to the rest."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float], key: str = "doc_id",
          text: str = "text", tokens: float | None = None) -> DataFrame:
    """Per row of the documents: key, n_tokens, posterior, rate and copies."""
    classifier = learned(labelled, domain, text, key)
    members = materialize(posteriors(docs, classifier, key, text), "mixing-members")
    y = np.zeros(len(classifier.domains))
    if classifier.model is not None:
        y, _ = fitted_rates(members, target_shares(classifier.domains, targets), tokens)
    rate = _rate(y)
    return members.select(key, "n_tokens", "posterior", rate.alias("rate"), copies_of(rate, F.col(key)).alias("copies"))


def resampled(docs: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float], key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """The documents as often as their rates say; same columns.

    A rate follows from the posterior and the fitted vector, so it is computed again in the row of its text: no text is
    shuffled or joined.
    """
    classifier = learned(labelled, domain, text, key)
    if classifier.model is None:
        return docs
    members = materialize(posteriors(docs, classifier, key, text), "mixing-members")
    y, _ = fitted_rates(members, target_shares(classifier.domains, targets))
    # the classifier adds columns of its own, which the prefix keeps apart
    rows = docs.toDF(*[f"in_{c}" for c in docs.columns]).withColumn("words", _words(F.col(f"in_{text}")))
    found = classifier.model.transform(rows).withColumn("posterior", vector_to_array("posterior"))
    placed = found.withColumn("copies", copies_of(_rate(y), F.col(f"in_{key}"))).filter("copies > 0")
    times = placed.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


#: Shares of the token total that the query and the pipeline mix to.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
