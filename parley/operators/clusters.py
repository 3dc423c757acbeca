"""Clusters and projections with Spark ML."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.projection import principal_components, projected
from parley.operators.words import vocabulary
from parley.session import materialize


#: Bound on the iterations of a fit, far beyond what convergence takes.
MAX_ITERATIONS = 1000


def array_vectors(df: DataFrame, column: str, target: str = "features") -> DataFrame:
    """A dense vector from an array of numbers."""
    return df.withColumn(target, array_to_vector(F.col(column).cast("array<double>")))


def tfidf_vectors(df: DataFrame, text: str, max_features: int = 5000, target: str = "features") -> DataFrame:
    """Sparse TF-IDF vectors (smooth idf, unit L2 norm) over the most frequent terms.

    What the driver holds is the vocabulary, whose size is ``max_features``.
    """
    n_docs = df.count()
    terms = vocabulary(df, text, max_features).collect()
    if not terms:
        raise ValueError("no terms to build vectors from")
    counter = CountVectorizerModel.from_vocabulary([t["term"] for t in terms], inputCol="_words", outputCol="_tf")
    idf = Vectors.dense([math.log((1 + n_docs) / (1 + t["doc_frequency"])) + 1 for t in terms])
    scaler = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_weighted")
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=target)
    rows = df.withColumn("_words", X.words(F.col(text)))
    for stage in (counter, scaler, unit):
        rows = stage.transform(rows)
    return rows.drop("_words", "_tf", "_weighted")


def fit_kmeans(df: DataFrame, k: int, seed: int = 42, features: str = "features") -> KMeansModel:
    """Fitted until the centres stop moving."""
    return KMeans(k=k, seed=seed, maxIter=MAX_ITERATIONS, tol=1e-4, featuresCol=features, predictionCol="_cluster").fit(df)


def kmeans_clusters(
    df: DataFrame, k: int, seed: int = 42, features: str = "features", target: str = "cluster"
) -> DataFrame:
    """Add cluster ids 1..k."""
    return clusters_of(df, fit_kmeans(df, k, seed, features), target)


def clusters_of(df: DataFrame, model: KMeansModel, target: str = "cluster") -> DataFrame:
    return model.transform(df).withColumn(target, F.col("_cluster") + 1).drop("_cluster")


def kmeans_cost(df: DataFrame, k: int, seed: int = 42, features: str = "features") -> float:
    return fit_kmeans(df, k, seed, features).summary.trainingCost


def pca_2d(df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``pc1`` and ``pc2`` of the centred features, which may be sparse and of any width."""
    return projected(df, principal_components(df, 2, features), features)


def topic_clusters(df: DataFrame, key: str, text: str, k: int, max_features: int = 5000, seed: int = 42) -> DataFrame:
    """(key, cluster) of the TF-IDF vectors; the vectors are written once and read by every iteration."""
    vectors = topic_vectors(df, key, text, max_features)
    return kmeans_clusters(vectors, k, seed).select(key, "cluster")


def topic_vectors(df: DataFrame, key: str, text: str, max_features: int = 5000) -> DataFrame:
    """(key, features): TF-IDF vectors, written once for the iterations that read them."""
    return materialize(tfidf_vectors(df.select(key, text), text, max_features).select(key, "features"), "vectors")
