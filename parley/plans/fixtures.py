"""The library's input tables as derived from the given parquet tables, each with its SQL form for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.conversations import nest_messages
from parley.sources.tables import read_table

# Candidate categories, in order.
CATEGORIES = ["riddle", "finance", "ai", "language", "writing", "business", "popular culture", "science", "role play",
              "technology", "coding", "general knowledge"]
# Names of the four topic classes.
TOPICS = ["World", "Sports", "Business", "Sci/Tech"]
LANGUAGE_NAMES = ["English", "Spanish", "French", "German"]
LANGS = ["en", "fr", "de", "es"]


def table(spark: SparkSession, sf: str, name: str, spread: bool = False) -> DataFrame:
    return read_table(spark, f"{sf.rstrip('/')}/{name}.parquet", spread)


def documents(spark: SparkSession, sf: str, spread: bool = True) -> DataFrame:
    return table(spark, sf, "documents", spread)


def message_columns(raw: DataFrame) -> DataFrame:
    """Message rows from the raw conversation table; also works on a stream of it."""
    language = F.element_at(F.array(*map(F.lit, LANGUAGE_NAMES)), (F.col("conv_id") % 4 + 1).cast("int"))
    return raw.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("turn").alias("pos"),
        "role",
        F.col("text").alias("content"),
        language.alias("language"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return message_columns(table(spark, sf, "conversations"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rows of at most 1,024 messages, numbered by ``segment``."""
    return nest_messages(messages(spark, sf))


def nli(spark: SparkSession, sf: str, spread: bool = True) -> DataFrame:
    category = F.element_at(
        F.array(*map(F.lit, CATEGORIES)), F.floor(F.sqrt((F.col("doc_id") % 144).cast("double"))).cast("int") + 1
    )
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    docs = documents(spark, sf, spread).select("doc_id", "text")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("seq"),
        "text",
        category.alias("category"),
        label.alias("label"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    tag = (
        F.when(F.col("source") == "src0", "delete")
        .when(F.col("source") == "src1", "private")
        .when(F.col("source") == "src2", F.lit(None))
        .otherwise("public")
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("prompt"), tag.alias("conversation_tag"), F.col("lang").alias("detected_language")
    )


def binary(spark: SparkSession, sf: str, label: str = "toxic") -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col(label).alias("label")), "doc_id")


# ---- the same tables for DuckDB ---------------------------------------------------------------------------------

def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


MSG = f"""msg AS (
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn AS pos, role, text AS content,
         {sql_list(LANGUAGE_NAMES)}[conv_id % 4 + 1] AS language
  FROM conversations)"""

TURNS = f"""{MSG}, turns AS (
  SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY conversation_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_n,
            CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id) AS BIGINT)
              AS conversation_turns
  FROM msg)"""

NLI = f"""nli AS (
  SELECT d.doc_id AS seq, d.text,
         {sql_list(CATEGORIES)}[CAST(floor(sqrt(d.doc_id % 144)) AS INT) + 1] AS category,
         CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS INT) AS label,
         CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TAGGED = """tagged AS (
  SELECT doc_id, text AS prompt, lang AS detected_language,
         CASE source WHEN 'src0' THEN 'delete' WHEN 'src1' THEN 'private' WHEN 'src2' THEN NULL ELSE 'public' END
           AS conversation_tag
  FROM documents)"""
