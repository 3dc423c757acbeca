"""Conversations as message rows (any length) or as nested rows (one array per row).

Message rows are the scalable form: a conversation of any size is cut into chunks of positions, numbered chunk by
chunk, and joined with the chunk offsets, so that no task holds a whole conversation. Nested rows serve tables that
already store one array per conversation; every operator on them is an expression inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.bits import bit_set, may_hold
from parley.operators.phrases import without_phrases
from parley.schemas import require_columns

#: Message positions per chunk.
CHUNK = 1 << 16
#: Messages per nested row when rows are built from messages.
SEGMENT = 1 << 10
#: Phrases that a table of phrases may hold on a stream.
PHRASE_LIMIT = 10_000
#: Bits that the ids of a table are looked up in before a join: 8 MB, filled to a tenth by seven million ids.
ID_BITS = 1 << 26


# ---- turns over message rows -------------------------------------------------------------------------------------

def number_turns(messages: DataFrame, chunk: int = CHUNK, carried: DataFrame | None = None) -> DataFrame:
    """Add ``turn_n`` (user messages so far, 0 before the first) and ``conversation_turns`` (their total).

    ``carried`` gives user messages that came before these rows, per conversation.
    """
    require_columns(messages, "conversation_id", "pos", "role")
    chunk_no = F.call_function("div", F.col("pos"), F.lit(chunk)).alias("_chunk")
    is_user = (F.col("role") == "user").cast("bigint")
    per_chunk = messages.groupBy("conversation_id", chunk_no).agg(F.sum(is_user).alias("_users"))
    conv = Window.partitionBy("conversation_id")
    offsets = per_chunk.select(
        "conversation_id",
        "_chunk",
        (F.sum("_users").over(conv.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_users"))
        .alias("_before"),
        F.sum("_users").over(conv).alias("conversation_turns"),
    )
    if carried is not None:
        seen = F.coalesce("carried", F.lit(0))
        offsets = (
            offsets.join(carried.select("conversation_id", "carried"), "conversation_id", "left")
            .withColumn("_before", F.col("_before") + seen)
            .drop("carried")
        )
    inside = Window.partitionBy("conversation_id", "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        messages.select("*", chunk_no)
        .withColumn("_in", F.sum(is_user).over(inside))
        .join(offsets, ["conversation_id", "_chunk"])
        .withColumn("turn_n", F.col("_before") + F.col("_in"))
        .drop("_chunk", "_in", "_before")
    )


def turn_id(conversation_id: Column, turn_n: Column) -> Column:
    """Conversation id followed by the turn, padded to three digits."""
    return F.concat(conversation_id, X.zero_padded(turn_n))


def pair_turns(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per answered turn: its user message and the first assistant message after it.

    Each user message opens a turn, so an unanswered one never pairs, later assistant messages of a turn are
    ignored, and messages before the first user (turn 0) never pair.
    """
    turns = number_turns(messages, chunk).where("turn_n > 0 and role in ('user', 'assistant')")

    def first(role: str) -> Column:
        return F.min_by(F.when(F.col("role") == role, F.col("content")),
                        F.when(F.col("role") == role, F.col("pos")))

    return (
        turns.groupBy("conversation_id", "turn_n")
        .agg(
            F.max("language").alias("language"),
            F.max("conversation_turns").alias("conversation_turns"),
            first("user").alias("prompt"),
            first("assistant").alias("response"),
            F.max((F.col("role") == "assistant").cast("int")).alias("_answered"),
        )
        .where("_answered = 1")
        .select("conversation_id", "language", "conversation_turns", "turn_n",
                turn_id(F.col("conversation_id"), F.col("turn_n")).alias("turn_id"), "prompt", "response")
    )


# ---- filters over message rows -----------------------------------------------------------------------------------

def in_languages(df: DataFrame, languages: list[str] | None, column: str = "language") -> DataFrame:
    """Keep rows in one of the languages; no list means no filter."""
    return df.where(F.col(column).isin(list(languages))) if languages else df


def length_between(c: Column, low: int | None, high: int | None) -> Column:
    """Length in characters within both bounds, each inclusive and optional."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.length(c) >= low)
    if high is not None:
        ok = ok & (F.length(c) <= high)
    return ok


def message_prompts(
    messages: DataFrame, languages: list[str] | None = None, min_chars: int | None = 20, max_chars: int | None = 500
) -> DataFrame:
    """User messages within the length bounds, as ``prompt`` and ``language`` with their lineage. No shuffle."""
    kept = in_languages(messages, languages).where(F.col("role") == "user")
    return kept.where(length_between(F.col("content"), min_chars, max_chars)).select(
        "conversation_id", "pos", F.col("content").alias("prompt"), "language"
    )


def contains_any(c: Column, phrases: list[str], ignore_case: bool = False) -> Column:
    """Whether a text holds any phrase, taken literally. Blank phrases are ignored."""
    wanted = [p.lower() if ignore_case else p for p in phrases if p.strip()]
    if not wanted:
        return F.lit(False)
    text = F.lower(c) if ignore_case else c
    if len(wanted) <= 32:
        hit = F.contains(text, F.lit(wanted[0]))
        for phrase in wanted[1:]:
            hit = hit | F.contains(text, F.lit(phrase))
        return hit
    return F.exists(F.array(*map(F.lit, wanted)), lambda p: F.contains(text, p))


def exclude_phrases(
    df: DataFrame, column: str, phrases: list[str] | DataFrame, ignore_case: bool = False
) -> DataFrame:
    """Drop rows whose text holds any phrase; a NULL text is kept.

    Phrases are a list, or a table of any size with a column ``phrase``, whose phrases are joined with windows of the texts.
    On a stream a table must hold at most PHRASE_LIMIT phrases; a larger one is for ``without_phrases`` in a foreachBatch.
    """
    if isinstance(phrases, DataFrame):
        if not df.isStreaming:
            return without_phrases(df, column, phrases, ignore_case)
        rows = phrases.select("phrase").where("phrase is not null").distinct().limit(PHRASE_LIMIT + 1).collect()
        if len(rows) > PHRASE_LIMIT:
            raise ValueError(f"more than {PHRASE_LIMIT} phrases")
        phrases = sorted(r["phrase"] for r in rows)
    return df.where(~F.coalesce(contains_any(F.col(column), phrases, ignore_case), F.lit(False)))


def search_messages(messages: DataFrame, term: str) -> DataFrame:
    """Conversations in which any message holds the term, in any case, with the number of such messages.

    Counts combine before the shuffle, so one very long conversation costs no more than its partial counts.
    """
    hit = F.contains(F.lower("content"), F.lit(term.lower())).cast("int")
    return (
        messages.groupBy("conversation_id")
        .agg(F.sum(hit).alias("hits"), F.count("*").alias("messages"))
        .where("hits > 0")
    )


def matching_conversations(messages: DataFrame, term: str) -> DataFrame:
    """All messages of the conversations in which any message holds the term, in any case."""
    found = messages.where(F.contains(F.lower("content"), F.lit(term.lower()))).select("conversation_id").distinct()
    return messages.join(found, "conversation_id", "left_semi")


def multi_turn(messages: DataFrame) -> DataFrame:
    """Conversations with more than one user message, with that count."""
    return (
        messages.groupBy("conversation_id")
        .agg(F.sum((F.col("role") == "user").cast("int")).alias("turns"))
        .where("turns > 1")
    )


def with_ids(
    df: DataFrame, ids: list[str] | DataFrame, column: str = "conversation_id", bits: int = ID_BITS
) -> DataFrame:
    """Keep rows whose id is listed. A list becomes a pushed-down filter; a table a semi join.

    The ids of a table are first looked up in a set of ``bits`` bits, so that what is joined, and shuffled where Spark does not
    broadcast the ids, is the wanted rows and a few others. Spark splits the partitions of frequent ids.
    """
    if not isinstance(ids, DataFrame):
        return df.where(F.col(column).isin(list(ids)))
    wanted = ids.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    if df.isStreaming:
        return df.join(wanted, column, "left_semi")
    number = F.xxhash64(F.col(column))
    held = may_hold(df.sparkSession, bit_set(wanted, number, bits), bits)
    return df.where(held(number)).join(wanted, column, "left_semi")


# ---- nested rows -------------------------------------------------------------------------------------------------

def nest_messages(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Nested rows of at most ``segment`` messages, in order; a longer conversation has several rows.

    ``segment`` numbers the rows of a conversation, ``turn`` is the number of its user messages in all of them.
    """
    item = F.struct("pos", "role", "content")
    rows = (
        messages.groupBy("conversation_id", "language", F.call_function("div", F.col("pos"), F.lit(segment)).alias("segment"))
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(
            "conversation_id",
            "language",
            "segment",
            F.transform("_items", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias(
                "conversation"
            ),
        )
    )
    users = messages.groupBy("conversation_id").agg(F.sum((F.col("role") == "user").cast("int")).cast("int").alias("turn"))
    return rows.join(users, "conversation_id")


def unnest_messages(conversations: DataFrame) -> DataFrame:
    """Message rows of nested rows that were cut into segments; positions count within the whole conversation.

    Positions leave room for any segment length, so they order messages but have gaps.
    """
    return conversations.select(
        "conversation_id", "language", "segment", F.posexplode("conversation").alias("_at", "_m")
    ).select(
        "conversation_id", "language", "segment",
        (F.col("segment").cast("bigint") * F.lit(1 << 31) + F.col("_at")).alias("pos"), "_m.role", "_m.content",
    )


def add_turns(conversations: DataFrame) -> DataFrame:
    """Give each message of the array its turn.

    Rows with a ``segment`` continue the turns of the segments before: every row is numbered from 0 on its own and then
    shifted by the users before it, one number per row. Without it a row is a whole conversation.
    """
    def numbered(messages: Column, users: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(users)), lambda k: F.transform(
            _stretch(messages, users, k),
            lambda m: F.struct(m.role.alias("role"), m.content.alias("content"), k.cast("int").alias("turn")))))

    own = _with_user_places("conversation", numbered)
    if "segment" not in conversations.columns:
        return conversations.withColumn("conversation", own)
    shifted = conversations.join(_users_before(conversations), ["conversation_id", "segment"])
    numbered = F.transform(own, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"), (
        m.turn + F.col("_before")).cast("int").alias("turn")))
    return shifted.withColumn("conversation", numbered).select(*conversations.columns)


def _with_user_places(conversation: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the messages of a nested row and the places, from 1, of those of the user.

    Both are bound by a lambda, so that each is computed once per row however often the body reads it.
    """

    def places(messages: Column) -> Column:
        size = F.coalesce(F.size(messages), F.lit(0))
        every = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: F.coalesce(F.get(messages, i - 1).role == "user", F.lit(False)))

    def bound(messages: Column) -> Column:
        return F.transform(F.array(places(messages)), lambda users: body(messages, users))[0]

    return F.transform(F.array(F.col(conversation)), bound)[0]


def _stretch(messages: Column, users: Column, k: Column) -> Column:
    """The messages of turn k: from its user message to the next one; for turn 0 those before the first."""
    start = F.when(k > 0, F.get(users, k - 1)).otherwise(F.lit(1))
    end = F.coalesce(F.get(users, k), F.size(messages) + 1)
    return F.slice(messages, start, end - start)


def _users_before(conversations: DataFrame) -> DataFrame:
    """Per segment the user messages of the segments before it. The window orders one number per segment."""
    users = F.size(F.filter("conversation", lambda m: m.role == "user"))
    order = Window.partitionBy("conversation_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = conversations.select("conversation_id", "segment", users.alias("_users"))
    return counts.select("conversation_id", "segment", F.coalesce(F.sum("_users").over(order), F.lit(0)).alias("_before"))


def unwrap_turns(conversations: DataFrame) -> DataFrame:
    """Prompt and response rows of nested conversations.

    Rows that are whole conversations are folded in place, without a shuffle, and keep all other columns; ``turn``
    becomes ``conversation_turns``. Rows with a ``segment`` are paired like messages, since a pair may cross segments.
    """
    if "segment" in conversations.columns:
        return pair_turns(unnest_messages(conversations), chunk=1 << 31)
    def paired(messages: Column, users: Column) -> Column:
        turns = F.when(F.size(users) > 0, F.sequence(F.lit(1), F.size(users))).otherwise(F.array().cast("array<int>"))
        found = F.transform(turns, lambda k: F.struct(
            k.alias("turn_n"), F.get(messages, F.get(users, k - 1) - 1).content.alias("prompt"),
            F.filter(_stretch(messages, users, k), lambda m: m.role == "assistant").alias("answers")))
        answered = F.filter(found, lambda p: p.prompt.isNotNull() & (F.size(p.answers) > 0))
        return F.transform(answered, lambda p: F.struct(
            p.turn_n.alias("turn_n"), p.prompt.alias("prompt"), p.answers[0].content.alias("response")))

    folded = _with_user_places("conversation", paired)
    kept = [c for c in conversations.columns if c not in ("conversation", "turn")]
    return (
        conversations.select(*kept, F.col("turn").alias("conversation_turns"), F.explode(folded).alias("_p"))
        .select(*kept, "conversation_turns", "_p.*")
        .withColumn("turn_id", turn_id(F.col("conversation_id"), F.col("turn_n")))
    )


def extract_prompts(
    conversations: DataFrame,
    languages: list[str] | None = None,
    min_chars: int | None = 20,
    max_chars: int | None = 500,
) -> DataFrame:
    """User prompts of nested conversations: filtered inside the array, then exploded. Works on streams."""
    wanted = F.filter(
        "conversation",
        lambda m: (m.role == "user") & length_between(m.content, min_chars, max_chars),
    )
    return (
        in_languages(conversations, languages)
        .select("conversation_id", "language", F.explode(wanted).alias("m"))
        .select("conversation_id", F.col("m.content").alias("prompt"), "language")
    )


def search_conversations(conversations: DataFrame, term: str) -> DataFrame:
    """Nested conversations in which any message holds the term, in any case. Works on streams.

    Of a conversation in segments all rows are kept when one of them holds it.
    """
    needle = term.lower()
    found = conversations.where(
        F.exists("conversation", lambda m: F.contains(F.lower(m.content), F.lit(needle)))
    )
    if "segment" not in conversations.columns:
        return found
    return conversations.join(found.select("conversation_id").distinct(), "conversation_id", "left_semi")


def transcript(
    conversation: Column, user_prefix: str = X.USER_MARK, assistant_prefix: str = X.ASSISTANT_MARK
) -> Column:
    """The user and assistant messages of a nested row as one text, one prefixed message per line."""
    spoken = F.filter(conversation, lambda m: m.role.isin("user", "assistant"))
    return F.array_join(
        F.transform(
            spoken,
            lambda m: F.concat(
                F.when(m.role == "user", user_prefix).otherwise(assistant_prefix), F.lit(" "), m.content
            ),
        ),
        "\n",
    )
