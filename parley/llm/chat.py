"""Operator 9, chat formatting from an event log.

A conversation is a log of events: ``start`` opens a message with its role, ``delta`` appends streamed text, ``edit`` replaces
the text, ``regenerate`` discards it so that later deltas build it anew. Events are partitioned by conversation and message,
sorted by sequence and folded into the final text of each message: its last reset and the deltas after it. Messages are
then rendered, one row each, so that a conversation of any length is spread over tasks.

A message is rendered as START role TEXT text END. Inside role and text a backslash is doubled and one is put behind the
first character of every control string, so no control string is left in them; dropping each backslash and keeping the
character after it restores the text. The loss mask is the span of the text of assistant messages.

Edge cases: null roles and texts are empty. Events without ``start`` make a message with an empty role. Messages with equal
turn are ordered by role and text; repeated rows are messages of their own. Rows with null conversation id form
one conversation. Other columns are ignored. An empty table gives no rows. Reading back hashes each conversation
in order, which one task does as a stream, holding one Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Strings that chat templates use for control; every marker of this template begins with the first.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNED_ROLE = "assistant"
#: Characters of a streamed delta that ``events_of`` cuts; texts of more than 64 deltas are cut into 64.
DELTA_CHARS = 256

ORDER = ["turn", "role", "text"]


def events_of(turns: DataFrame) -> DataFrame:
    """Event log of a table conv_id, turn, role, text: one start per row and its text as deltas."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").alias("turn"), F.monotonically_increasing_id().alias("message"),
                        role.alias("role"), text.alias("whole"))
    step = F.greatest(F.lit(DELTA_CHARS), F.ceil(F.length("whole") / 64)).cast("int")
    rows = rows.withColumn("step", step)
    deltas = F.transform(F.sequence(F.lit(0), F.ceil(F.length("whole") / F.col("step")).cast("int")), lambda i: F.struct(
        (i + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"),
        F.substring(F.col("whole"), i * F.col("step") + 1, F.col("step")).alias("text")))
    first = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text")))
    return rows.select("conv_id", "turn", "message", "role", F.inline(F.concat(first, deltas)))


def folded(events: DataFrame) -> DataFrame:
    """Final messages conv_id, turn, message, role, text of an event log with columns conv_id, turn, message, seq, kind,
    role, text.

    Events of equal sequence are ordered by kind and text. The role and turn are those of the first event that has them.
    """
    entry = F.struct("seq", "kind", F.coalesce(F.col("text"), F.lit("")).alias("text"), "role", "turn")
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(entry)).alias("log"))
    resets = F.transform(F.col("log"), lambda e, i: F.when(e["kind"] != "delta", i).otherwise(-1))
    logs = logs.withColumn("last_reset", F.array_max(resets))
    lasting = F.filter("log", lambda e, i: (i > F.col("last_reset")) | (
        (i == F.col("last_reset")) & (e["kind"] != "regenerate")))
    text = F.array_join(F.transform(lasting, lambda e: e["text"]), "")
    turn = F.get(F.filter("log", lambda e: e["turn"].isNotNull()), F.lit(0))["turn"]
    role = F.get(F.filter("log", lambda e: e["role"].isNotNull()), F.lit(0))["role"]
    return logs.select("conv_id", turn.alias("turn"), "message", F.coalesce(role, F.lit("")).alias("role"),
                       text.alias("text"))


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def rendered(messages: DataFrame) -> DataFrame:
    """Add formatted and the loss span (code points of formatted; null where nothing is learned)."""
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(TEXT))
    rows = messages.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    learns = F.col("role") == LEARNED_ROLE
    return rows.select("conv_id", "turn", "role", "text", F.concat("head", "body", F.lit(END)).alias("formatted"),
                       F.when(learns, F.length("head")).alias("loss_start"),
                       F.when(learns, F.length("head") + F.length("body")).alias("loss_end"))


def write_formatted(events: DataFrame, folder: str) -> None:
    """Write the rendered messages with the keys that order them (turn, and role and text for equal turns)."""
    rendered(folded(events)).write.parquet(folder)


def turns_in(formatted: str) -> list[tuple[str, str]]:
    """Role and text of the messages of formatted text."""
    found = []
    while formatted:
        if not formatted.startswith(START):
            raise ValueError("no message start")
        role, _, rest = formatted[len(START):].partition(TEXT)
        text, end, formatted = rest.partition(END)
        if not end:
            raise ValueError("no message end")
        found.append((unescaped(role), unescaped(text)))
    return found


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text in turns_in(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescaped(formatted[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(formatted)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
                "formatted_chars": self.formatted_chars}


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                   ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, done = None, []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "formatted", "loss_start", "loss_end")]
        for conv_id, formatted, start, end in zip(*columns):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv_id)
            current.add(formatted, start, end)
        if done:
            yield pa.RecordBatch.from_pylist(done, ARROW)
            done = []
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.row()], ARROW)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what the formatted messages say, read in order."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digested, DIGESTS)


def _escaped_sql(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for mark in CONTROL:
        sql = f"replace({sql}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return sql


def oracle(extra: str) -> str:
    """DuckDB form; ``extra`` is a SELECT of conv_id, turn, role, text that is added to the conversations."""
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL {extra})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED_ROLE}'), ''))
           AS loss_sha256,
       CAST(sum(length('{START}{TEXT}{END}' || {_escaped_sql('role')} || {_escaped_sql('text')})) AS BIGINT)
           AS formatted_chars
FROM c GROUP BY conv_id
"""
