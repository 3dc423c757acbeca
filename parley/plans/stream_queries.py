"""The conversation operators on a stream of the conversation table, drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import conversations as C
from parley.plans import fixtures as X
from parley.plans.conversation_queries import PAIR_SQL, prompt_sql
from parley.plans.registry import query
from parley.streaming import streams as S

RAW = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def message_stream(spark, sf):
    return X.message_columns(S.open_stream(spark, f"{sf.rstrip('/')}/conversations*.parquet", RAW))


@query("stream_prompts", prompt_sql(20, 500, ["English", "French"]))
def stream_prompts(spark, sf):
    return S.drain(C.message_prompts(message_stream(spark, sf), ["English", "French"]))


@query(
    "stream_search",
    f"WITH {X.MSG} SELECT conversation_id, pos FROM msg WHERE contains(lower(content), 'tion the')",
)
def stream_search(spark, sf):
    hits = message_stream(spark, sf).where(F.contains(F.lower("content"), F.lit("tion the")))
    return S.drain(hits.select("conversation_id", "pos"))


@query("stream_turn_numbers", f"WITH {X.TURNS} SELECT conversation_id, pos, role, turn_n FROM turns")
def stream_turn_numbers(spark, sf):
    return S.drain(S.turn_numbers(message_stream(spark, sf)).select("conversation_id", "pos", "role", "turn_n"))


@query("stream_turn_pairs", f"SELECT conversation_id, language, turn_n, turn_id, prompt, response FROM ({PAIR_SQL})")
def stream_turn_pairs(spark, sf):
    """Pairs of a user message and its first answer, each emitted when the answer arrives."""
    return S.drain(S.turn_pairs(message_stream(spark, sf)))


@query(
    "stream_first_rows",
    "SELECT least(100, count(*)) AS rows, least(100, count(*)) AS in_table, least(100, count(*)) AS places FROM conversations",
)
def stream_first_rows(spark, sf):
    """The first rows of a stream: as many as asked for, each from the table, in places 1..n."""
    keyed = message_stream(spark, sf).withColumn("k", F.concat("conversation_id", F.lit("/"), F.col("pos").cast("string")))
    first = S.first_rows(keyed, 100, "k")
    known = X.messages(spark, sf).select("conversation_id", "pos", "content", F.lit(1).alias("known"))
    return first.join(known, ["conversation_id", "pos", "content"], "left").agg(
        F.count("*").alias("rows"), F.count("known").alias("in_table"),
        F.count_distinct(F.when(F.col("seq") <= 100, F.col("seq"))).alias("places"),
    )
