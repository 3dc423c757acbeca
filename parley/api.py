"""A small object form of the conversation and classification operators, for notebook use.

Every method returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import classify, conversations, curation, metrics, ordering
from parley.operators.scoring import Scorer
from parley.schemas import CONVERSATION
from parley.streaming import streams


@dataclass(frozen=True)
class Conversations:
    """A table of nested conversations, at rest or arriving; with a column ``segment`` a long one has several rows."""

    rows: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str, streaming: bool = False) -> Conversations:
        reader = spark.readStream if streaming else spark.read
        return cls(reader.schema(CONVERSATION).parquet(path))

    def sample(self, n: int | None = None, ids: Sequence[str] | None = None, seed: int = 42) -> Conversations:
        """Conversations with the given ids, or else ``n`` random ones. Of a stream the first ``n`` to arrive."""
        if ids:
            return Conversations(conversations.with_ids(self.rows, list(ids)))
        if n is None:
            raise ValueError("give a number of conversations or their ids")
        if self.rows.isStreaming:
            return Conversations(self.rows.limit(n))
        return Conversations(ordering.sample_n(self.rows, n, "conversation_id", seed))

    def shuffled_sample(self, n: int, seed: int = 42) -> Conversations:
        """Of a stream the first ``n`` conversations to arrive, of a table ``n`` random ones, numbered in random order
        by ``seq``. A stream is read up to what is there now."""
        if self.rows.isStreaming:
            return Conversations(streams.first_rows(self.rows, n, "conversation_id", seed))
        return Conversations(ordering.number_rows(self.sample(n, seed=seed).rows, "conversation_id", seed))

    def with_turns(self) -> DataFrame:
        return conversations.add_turns(self.rows)

    def turn_pairs(self) -> DataFrame:
        return conversations.unwrap_turns(self.rows)

    def prompts(self, languages: Sequence[str] | None = None, min_chars: int = 20, max_chars: int = 500) -> DataFrame:
        return conversations.extract_prompts(self.rows, languages, min_chars, max_chars)

    def search(self, term: str) -> DataFrame:
        return conversations.search_conversations(self.rows, term)

    def multi_turn(self) -> DataFrame:
        return self.rows.where(F.col("turn") > 1)

    def transcripts(self) -> DataFrame:
        return self.rows.select("conversation_id", conversations.transcript(F.col("conversation")).alias("transcript"))

    def language_counts(self) -> DataFrame:
        return curation.value_counts(self.rows, "language")


@dataclass(frozen=True)
class LabelClassifier:
    """Ranks the candidate labels of its scorer for every text of a column."""

    scorer: Scorer

    def classify_text(self, df: DataFrame, text: str, key: str, top_n: int | None = None, multi_label: bool = False):
        return classify.classify_text(df, self.scorer, text, key, top_n, multi_label)

    def classify_column(self, df: DataFrame, text: str, key: str, suffix: str, multi_label: bool = False):
        return classify.classify_column(df, self.scorer, text, key, suffix, multi_label)

    def predict(self, df: DataFrame, text: str, key: str) -> DataFrame:
        return classify.predict(df, self.scorer, text, key)

    def evaluate(self, predicted: DataFrame, true_class: str = "category") -> tuple[DataFrame, DataFrame]:
        """Metrics and confusion matrix of a predicted table, both from one table of counts."""
        counts = metrics.prediction_counts(predicted, true_class, "predicted_class")
        return metrics.metrics_bundle(counts), metrics.confusion_matrix(counts, list(self.scorer.labels))
