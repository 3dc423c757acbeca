"""End-to-end flows over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import conversations as C
from parley.operators import curation as Q
from parley.operators import words as W
from parley.operators.classify import rank_labels
from parley.operators.scoring import HypothesisOverlapScorer
from parley.plans import fixtures as X
from parley.plans import oracle_parts as P
from parley.plans.conversation_queries import PHRASE_SQL, PHRASES
from parley.plans.registry import query

PROMPTS = f"""{X.MSG}, prompts AS (SELECT conversation_id, pos, content AS prompt FROM msg
  WHERE role = 'user' AND language = 'English' AND length(content) BETWEEN 20 AND 500
    AND NOT {PHRASE_SQL.format(c='content')})"""


def curated_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """English user prompts of 20 to 500 characters without excluded phrases: one scan, no shuffle."""
    return C.exclude_phrases(C.message_prompts(X.messages(spark, sf), ["English"]), "prompt", PHRASES)


@query(
    "frequent_prompt_words",
    f"""WITH {PROMPTS}, t AS (SELECT unnest({P.words('prompt')}) AS word FROM prompts)
SELECT word, count(*) AS frequency FROM t WHERE word NOT IN {X.sql_in(T.STOP_WORDS)}
  AND word NOT IN {X.sql_in(T.CORPUS_EXCLUDED)} AND NOT starts_with(word, 'name_')
GROUP BY word ORDER BY frequency DESC, word LIMIT 25""",
)
def frequent_prompt_words(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent words of curated prompts."""
    return W.top_words(W.word_counts(curated_prompts(spark, sf), "prompt"), 25)


@query(
    "prompt_label_distribution",
    f"""WITH {PROMPTS}, src AS (SELECT conversation_id || '/' || pos AS id, prompt AS text FROM prompts),
{P.overlap(X.CATEGORIES)} SELECT label AS top_label, count(*) AS n FROM ranked WHERE r = 1 GROUP BY label""",
)
def prompt_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Curated prompts by their best candidate label."""
    keyed = curated_prompts(spark, sf).withColumn("id", F.concat("conversation_id", F.lit("/"), F.col("pos").cast("string")))
    ranked = rank_labels(keyed, HypothesisOverlapScorer(X.CATEGORIES), "prompt", "id")
    return Q.value_counts(ranked.select(F.col("ranked")[0].label.alias("top_label")), "top_label")
