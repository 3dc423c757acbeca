"""Small text files: phrase lists, category lists, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import strip


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """One stripped phrase per line; blank lines are dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("phrase")).where("phrase <> ''")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label) in file order; blank lines are dropped."""
    lines = F.transform(F.split("value", r"\r?\n"), strip)
    kept = F.filter(lines, lambda l: l != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(kept).alias("pos", "label"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, category) from lines ``id; category, category``. Lines without a semicolon are notes."""
    parts = F.split("value", ";", 2)
    rows = spark.read.text(path).where(F.contains("value", F.lit(";")))
    return rows.select(
        strip(parts[0]).alias("conversation_id"), F.explode(F.split(parts[1], ",")).alias("category")
    ).select("conversation_id", strip(F.col("category")).alias("category")).where("category <> ''")
