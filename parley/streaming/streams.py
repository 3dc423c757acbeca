"""Structured Streaming forms of the conversation operators.

Filters and extractions are the batch functions themselves, since they are expressions inside a row. Turns need state: what
is known of a conversation is kept in Spark's state store between micro-batches, and expires.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators.conversations import turn_id
from parley.operators.ordering import number_rows
from parley.session import fresh_path

#: Bytes of files that a micro-batch reads, at least one file.
BATCH_BYTES = 256 << 20
#: Seconds without a message after which the state of a conversation goes.
IDLE_SECONDS = 24 * 3600


def open_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files that arrive in a folder (or match a pattern), some files or BATCH_BYTES at a time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    return reader.parquet(path)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet table, up to the data available now; restartable from its checkpoint.

    Batches without data are off in this query: with state that expires there would always be another one.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # a query keeps the settings that it was started with
    try:
        return (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(name, before)


def drain(stream: DataFrame, purpose: str = "drained") -> DataFrame:
    """Run a stream over the data available now and return the table it wrote."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, purpose), fresh_path(spark, purpose + "-checkpoint")
    to_table(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def first_rows(stream: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first ``n`` rows to arrive, then in random order (``seq``)."""
    return number_rows(drain(stream.limit(n), "first-rows"), key, seed)


def _turn_of(users: int, rows: pd.DataFrame) -> pd.Series:
    """Turn of each message in order, after ``users`` earlier user messages."""
    return users + (rows["role"] == "user").cumsum()


def _in_order(batches: Iterable[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("pos", kind="stable", ignore_index=True)


def turn_numbers(stream: DataFrame, idle: float = IDLE_SECONDS) -> DataFrame:
    """Messages with ``turn_n``, the user messages of their conversation so far.

    The state of a conversation is that one number, kept in Spark's state store. It expires when nothing arrives for ``idle``
    seconds; a conversation that goes on after that is numbered anew. Messages have to arrive in order between micro-batches,
    not within one. What a task holds of a conversation is its share of one micro-batch, which ``open_stream`` bounds.
    """
    places = [f.name for f in stream.schema.fields if f.dataType in (T.LongType(), T.IntegerType())]

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(batches)
        turns = _turn_of(state.get[0] if state.exists else 0, rows)
        state.update((int(turns.iloc[-1]),))
        state.setTimeoutDuration(max(1, int(idle * 1000)))
        yield rows.astype({c: "Int64" for c in places}).assign(turn_n=turns)

    return stream.groupBy("conversation_id").applyInPandasWithState(
        number, T.StructType([*stream.schema.fields, T.StructField("turn_n", T.LongType())]), "users long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def turn_pairs(stream: DataFrame, idle: float = IDLE_SECONDS) -> DataFrame:
    """A row for each user message when its first answer arrives, as ``pair_turns`` pairs them on a table.

    The state of a conversation is the number of its turns and, while it has no answer, the last user message; it expires like
    that of ``turn_numbers``, and an answer that comes later pairs with nothing.
    """

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        users, waiting, prompt, spoken = state.get if state.exists else (0, False, None, None)
        rows = _in_order(batches)
        rows["turn_n"] = _turn_of(users, rows)
        asked = rows[rows["role"] == "user"].set_index("turn_n")[["content", "language"]]
        if waiting:
            asked.loc[users] = [prompt, spoken]
        answers = rows[rows["role"] == "assistant"].drop_duplicates("turn_n")
        answers = answers[answers["turn_n"].isin(asked.index)]
        last = int(rows["turn_n"].iloc[-1])
        open_ = last in asked.index and not (answers["turn_n"] == last).any()
        left = asked.loc[last].tolist() if open_ else [None, None]
        state.update((last, open_, *[None if pd.isna(x) else x for x in left]))
        state.setTimeoutDuration(max(1, int(idle * 1000)))
        if len(answers):
            found = answers.join(asked, "turn_n", rsuffix="_asked")
            language = found[["language", "language_asked"]].apply(lambda x: x.dropna().max(), axis=1)
            yield pd.DataFrame({"conversation_id": key[0], "language": language, "turn_n": found["turn_n"],
                                "prompt": found["content_asked"], "response": found["content"]})

    pairs = stream.select("conversation_id", "pos", "role", "content", "language").groupBy("conversation_id")
    paired = pairs.applyInPandasWithState(
        pair, "conversation_id string, language string, turn_n long, prompt string, response string",
        "users long, waiting boolean, prompt string, language string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    identity = turn_id(F.col("conversation_id"), F.col("turn_n")).alias("turn_id")
    return paired.select("conversation_id", "language", "turn_n", identity, "prompt", "response")
