"""Word statistics and TF-IDF in long form; nothing is ever densified."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions.stemming import stemmed_words


def tokens(df: DataFrame, text: str, keep: Sequence[str] = (), stop_words: Sequence[str] = X.STOP_WORDS) -> DataFrame:
    """One row per word of the whole text, stop words removed."""
    rows = df.select(*keep, F.explode(X.words(F.col(text))).alias("word"))
    return rows.where(~F.col("word").isin(list(stop_words))) if stop_words else rows


def without_excluded(df: DataFrame, excluded: Sequence[str], prefix: str | None = X.MASKED_NAME_PREFIX) -> DataFrame:
    """Drop listed words and words with the prefix."""
    kept = df.where(~F.col("word").isin(list(excluded))) if excluded else df
    return kept.where(~F.startswith("word", F.lit(prefix))) if prefix else kept


def word_counts(
    df: DataFrame, text: str, by: Sequence[str] = (), excluded: Sequence[str] = X.CORPUS_EXCLUDED,
    stop_words: Sequence[str] = X.STOP_WORDS, prefix: str | None = X.MASKED_NAME_PREFIX,
) -> DataFrame:
    """Word frequencies, over the corpus or per group, in one grouped count combined before its shuffle."""
    kept = without_excluded(tokens(df, text, by, stop_words), excluded, prefix)
    return kept.groupBy(*by, "word").agg(F.count("*").alias("frequency"))


def top_words(counts: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most frequent words, or those of each group with their rank; ties by word.

    Per group the rank filter is applied on each partition before the shuffle as well.
    """
    if not by:
        return counts.orderBy(F.desc("frequency"), "word").limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("frequency"), "word"))
    return counts.withColumn("rank", place).where(F.col("rank") <= n)


def vocabulary(df: DataFrame, text: str, max_features: int) -> DataFrame:
    """The ``max_features`` most frequent terms with corpus frequency and document frequency.

    Both counts come from one pass: each row emits its words and, marked, its distinct words; the shuffle carries one
    row per term and partition.
    """
    all_words = X.words(F.col(text))
    per_row = df.select(all_words.alias("_w")).select(
        F.explode(
            F.concat(
                F.transform("_w", lambda w: F.struct(w.alias("term"), F.lit(0).alias("d"))),
                F.transform(F.array_distinct("_w"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("d"))),
            )
        ).alias("t")
    )
    return (
        per_row.groupBy("t.term")
        .agg(F.count_if(F.col("t.d") == 0).alias("frequency"), F.sum("t.d").alias("doc_frequency"))
        .orderBy(F.desc("frequency"), "term")
        .limit(max_features)
    )


def tfidf(df: DataFrame, key: str, text: str, max_features: int = 5000) -> DataFrame:
    """Long matrix (key, term, tf, tfidf): smooth idf ln((1+n)/(1+df))+1, rows of unit L2 norm.

    The vocabulary has at most ``max_features`` terms, which the driver holds; terms are counted inside the row, so nothing
    is grouped or shuffled unless a key repeats.
    """
    n_docs = df.count()
    terms = vocabulary(df, text, max_features).collect()
    idf = [math.log((1.0 + n_docs) / (1.0 + t["doc_frequency"])) + 1.0 for t in terms]
    table = F.broadcast(df.sparkSession.createDataFrame(
        [(i, t["term"], x) for i, (t, x) in enumerate(zip(terms, idf))], "_place int, term string, _idf double"))
    # a model has at least one term, and no word is empty
    counter = CountVectorizerModel.from_vocabulary([t["term"] for t in terms] or [""], inputCol="_words", outputCol="_tf")
    scaler = ElementwiseProduct(scalingVec=Vectors.dense(idf or [1.0]), inputCol="_tf", outputCol="_weighted")
    rows = df.select(key, F.coalesce(X.words(F.col(text)), F.array().cast("array<string>")).alias("_words"))
    for stage in (counter, scaler, Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit")):
        rows = stage.transform(rows)
    found, unit = F.unwrap_udt(F.col("_tf")), F.unwrap_udt(F.col("_unit"))
    entries = F.arrays_zip(found["indices"].alias("_place"), found["values"].cast("array<bigint>").alias("tf"),
                           unit["values"].alias("tfidf"))
    counts = rows.select(key, F.inline(entries)).toDF(key, "_place", "tf", "tfidf")
    if not df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        # rows of one key are one document
        whole = counts.groupBy(key, "_place").agg(F.sum("tf").alias("tf")).join(table, "_place")
        weight = F.col("tf") * F.col("_idf")
        norm = F.sqrt(F.sum(weight * weight).over(Window.partitionBy(key)))
        return whole.withColumn("tfidf", weight / norm).select(key, "term", "tf", "tfidf")
    return counts.join(table, "_place").select(key, "term", "tf", "tfidf")


def clean_column(df: DataFrame, text: str, excluded: Sequence[str] = (), target: str = "clean_text") -> DataFrame:
    """Cleaned text without stop words and excluded words, not stemmed; an expression inside the row."""
    dropped = list(dict.fromkeys([*X.STOP_WORDS, *excluded]))
    return df.withColumn(target, X.drop_words(X.clean(F.col(text)), dropped))


def clean_stemmed_column(
    df: DataFrame, key: str, text: str, excluded: Sequence[str] = (), target: str = "clean_text"
) -> DataFrame:
    """(key, clean text) with stemmed words, in order. Words are stemmed inside the row; nothing is shuffled."""
    cleaned = clean_column(df.select(key, F.coalesce(text, F.lit("")).alias(text)), text, excluded, "_clean")
    return cleaned.select(key, stemmed_words("_clean").alias(target))
