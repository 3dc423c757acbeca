"""The corpus pipeline: quality rules, language, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each result to the shared
folder and reads it again as the next stage's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, language_id, mixing, near_dedup, quality
from parley.session import materialize

#: A labelled document is of its language if the best one has at least this share of its n-grams; so is any document found
#: to be of a language whose coverage could not be measured.
MIN_COVERAGE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines.

    A null or empty text fails. Repeated rows are judged one by one, a null id and other columns pass through.
    """
    return quality.cleaned_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled rows; a missing label is filled with the language found.

    A document without a label needs about the coverage that labelled documents left out of the fit have. A text that is null
    or has no letter goes, as does every document where no row has a label. Labels that are there stay as they are: the stage
    decides whether a text is in a known language, not which label is right. Ties go to the smaller name; columns that are
    named like results of the identification keep their values.
    """
    source = docs.toDF(*[f"in_{c}" for c in docs.columns])
    filters = language_id.learned(source, "in_lang", "in_text", "in_doc_id", None)
    floors = language_id.coverage_floors(source, "in_lang", "in_text", "in_doc_id")
    found = language_id.identified(source, filters, "in_text")
    floor = F.lit(MIN_COVERAGE)
    for name, value in floors.items():
        floor = F.when(F.col("in_lang").isNull() & (F.col("lang_pred") == name), value).otherwise(floor)
    known = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("coverage") >= floor))
    columns = {c: F.col(f"`in_{c}`") for c in docs.columns}
    columns["lang"] = F.coalesce("in_lang", "lang_pred")
    return known.select(*[c.alias(name) for name, c in columns.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words have no copies. Of rows with one id one stays; rows with a null id stay unless a document with an id
    is a copy of them.
    """
    return near_dedup.without_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates that match the target shares of the languages say.

    With fewer than two languages every document stays once. Rows with equal ids are drawn alike, a null text has the rate of
    an empty one, an empty table stays empty. Rates that do not converge are an error.
    """
    return mixing.resampled(docs, docs, "lang", mixing.TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), with digests of the ids and of the bytes decoded from them.

    A null text has no ids. A document that the mixture repeats has a row for each time.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("language", language),
    ("near duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: No SQL states these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
