"""Conversations: turns, pairs, prompts, search, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import conversations as C
from parley.operators import ordering as O
from parley.plans import fixtures as X
from parley.plans.registry import query
from parley.session import fresh_path
from parley.sources.lists import read_phrases

# Phrases that occur in the given conversations; one of them with regex metacharacters.
PHRASES = ["the re", "que la", "[your answer]"]
PHRASE_SQL = "(contains({c}, 'the re') OR contains({c}, 'que la') OR contains({c}, '[your answer]'))"


@query("turn_numbers", f"WITH {X.TURNS} SELECT conversation_id, pos, role, turn_n, conversation_turns FROM turns")
def turn_numbers(spark, sf):
    return C.number_turns(X.messages(spark, sf)).select("conversation_id", "pos", "role", "turn_n", "conversation_turns")


PAIRS = f"""{X.TURNS}, pairs AS (
  SELECT conversation_id, max(language) AS language, max(conversation_turns) AS conversation_turns, turn_n,
         conversation_id || CASE WHEN turn_n < 1000 THEN lpad(CAST(turn_n AS VARCHAR), 3, '0')
                                 ELSE CAST(turn_n AS VARCHAR) END AS turn_id,
         min_by(content, pos) FILTER (WHERE role = 'user') AS prompt,
         min_by(content, pos) FILTER (WHERE role = 'assistant') AS response,
         count(*) FILTER (WHERE role = 'assistant') AS answers
  FROM turns WHERE turn_n > 0 GROUP BY conversation_id, turn_n)"""
PAIR_SQL = f"""WITH {PAIRS}
SELECT conversation_id, language, conversation_turns, turn_n, turn_id, prompt, response FROM pairs WHERE answers > 0"""


@query("turn_pairs", PAIR_SQL)
def turn_pairs(spark, sf):
    return C.pair_turns(X.messages(spark, sf))


@query("turn_pairs_nested", PAIR_SQL)
def turn_pairs_nested(spark, sf):
    return C.unwrap_turns(X.conversations(spark, sf))


@query("turn_ids", f"WITH {PAIRS} SELECT turn_id, turn_n FROM pairs WHERE answers > 0")
def turn_ids(spark, sf):
    return C.pair_turns(X.messages(spark, sf)).select("turn_id", "turn_n")


@query(
    "turns_in_arrays",
    f"WITH {X.TURNS} SELECT conversation_id, pos, role, turn_n FROM turns",
)
def turns_in_arrays(spark, sf):
    nested = C.add_turns(X.conversations(spark, sf))
    return nested.select("conversation_id", "segment", F.posexplode("conversation").alias("at", "m")).select(
        "conversation_id", (F.col("segment") * C.SEGMENT + F.col("at")).cast("bigint").alias("pos"), "m.role",
        F.col("m.turn").cast("bigint").alias("turn_n"),
    )


def prompt_sql(low=None, high=None, languages=None, extra="") -> str:
    where = ["role = 'user'"]
    if low is not None:
        where.append(f"length(content) >= {low}")
    if high is not None:
        where.append(f"length(content) <= {high}")
    if languages:
        where.append(f"language IN {X.sql_in(languages)}")
    return (
        f"WITH {X.MSG} SELECT conversation_id, pos, content AS prompt, language FROM msg "
        f"WHERE {' AND '.join(where)} {extra}"
    )


@query("prompts", prompt_sql(50, 200))
def prompts(spark, sf):
    return C.message_prompts(X.messages(spark, sf), min_chars=50, max_chars=200)


@query("prompts_english", prompt_sql(20, 500, ["English"]))
def prompts_english(spark, sf):
    return C.message_prompts(X.messages(spark, sf), ["English"])


@query("prompts_upper_bound", prompt_sql(None, 150, ["English", "French"]))
def prompts_upper_bound(spark, sf):
    return C.message_prompts(X.messages(spark, sf), ["English", "French"], None, 150)


@query(
    "prompts_nested",
    f"WITH {X.MSG} SELECT conversation_id, content AS prompt, language FROM msg "
    "WHERE role = 'user' AND length(content) BETWEEN 50 AND 200",
)
def prompts_nested(spark, sf):
    return C.extract_prompts(X.conversations(spark, sf), None, 50, 200)


@query("prompts_without_phrases", prompt_sql(20, 500, extra=f"AND NOT {PHRASE_SQL.format(c='content')}"))
def prompts_without_phrases(spark, sf):
    return C.exclude_phrases(C.message_prompts(X.messages(spark, sf)), "prompt", PHRASES)


@query(
    "prompts_without_phrases_any_case",
    prompt_sql(20, 500, extra=f"AND NOT {PHRASE_SQL.format(c='lower(content)')}"),
)
def prompts_without_phrases_any_case(spark, sf):
    return C.exclude_phrases(C.message_prompts(X.messages(spark, sf)), "prompt", [p.upper() for p in PHRASES], True)


@query(
    "messages_without_phrase_table",
    f"""WITH {X.MSG}, phrases AS (SELECT DISTINCT substr(text, 10, 8) AS phrase FROM documents)
SELECT conversation_id, pos FROM msg WHERE content IS NULL
  OR NOT EXISTS (SELECT 1 FROM phrases WHERE trim(phrase) <> '' AND contains(content, phrase))""",
)
def messages_without_phrase_table(spark, sf):
    """Messages that hold none of a table of phrases, as many as there are documents."""
    phrases = X.table(spark, sf, "documents").select(F.substring("text", 10, 8).alias("phrase"))
    return C.exclude_phrases(X.messages(spark, sf), "content", phrases).select("conversation_id", "pos")


@query(
    "phrase_exclusion_report",
    f"WITH {X.MSG} SELECT count(*) AS prompts, "
    f"CAST(sum(CASE WHEN {PHRASE_SQL.format(c='content')} THEN 1 ELSE 0 END) AS BIGINT) AS excluded "
    "FROM msg WHERE role = 'user' AND length(content) BETWEEN 20 AND 500",
)
def phrase_exclusion_report(spark, sf):
    found = C.contains_any(F.col("prompt"), PHRASES).cast("bigint")
    return C.message_prompts(X.messages(spark, sf)).agg(F.count("*").alias("prompts"), F.sum(found).alias("excluded"))


SEARCH_SQL = f"""WITH {X.MSG}
SELECT conversation_id, CAST(sum(CASE WHEN contains(lower(content), 'tion the') THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       count(*) AS messages
FROM msg GROUP BY conversation_id HAVING hits > 0"""


@query("search", SEARCH_SQL)
def search(spark, sf):
    return C.search_messages(X.messages(spark, sf), "TION the")


@query("search_nested", f"WITH s AS ({SEARCH_SQL}) SELECT conversation_id, messages FROM s")
def search_nested(spark, sf):
    found = C.search_conversations(X.conversations(spark, sf), "TION the")
    return found.groupBy("conversation_id").agg(F.sum(F.size("conversation")).alias("messages"))


@query(
    "search_records",
    f"""WITH {X.MSG} SELECT conversation_id, pos, role, content FROM msg WHERE conversation_id IN
(SELECT conversation_id FROM msg WHERE contains(lower(content), 'tion the'))""",
)
def search_records(spark, sf):
    found = C.matching_conversations(X.messages(spark, sf), "TION the")
    return found.select("conversation_id", "pos", "role", "content")


@query("prompts_without_listed_phrases", prompt_sql(20, 500, extra=f"AND NOT {PHRASE_SQL.format(c='content')}"))
def prompts_without_listed_phrases(spark, sf):
    """Phrases from a file, one a line, taken from the prompts that hold them."""
    prompts = C.message_prompts(X.messages(spark, sf))
    path = fresh_path(spark, "phrases")
    lines = F.explode(F.array(*map(F.lit, PHRASES))).alias("value")
    X.table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(1).select(lines).write.text(path)
    return C.exclude_phrases(prompts, "prompt", read_phrases(spark, path))


@query(
    "conversations_by_id",
    f"WITH {X.MSG} SELECT conversation_id, pos, role, content FROM msg WHERE conversation_id IN ('3', '14', '15', '92')",
)
def conversations_by_id(spark, sf):
    return C.with_ids(X.messages(spark, sf), ["3", "14", "15", "92"]).select("conversation_id", "pos", "role", "content")


@query(
    "conversations_by_id_table",
    f"""WITH {X.MSG} SELECT conversation_id, pos, role FROM msg
WHERE conversation_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
)
def conversations_by_id_table(spark, sf):
    ids = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("conversation_id"))
    return C.with_ids(X.messages(spark, sf), ids).select("conversation_id", "pos", "role")


MULTI = f"""WITH {X.MSG} SELECT conversation_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS turns
FROM msg GROUP BY conversation_id HAVING turns > 1"""


@query("multi_turn_conversations", MULTI)
def multi_turn_conversations(spark, sf):
    return C.multi_turn(X.messages(spark, sf))


@query(
    "random_multi_turn_conversation",
    f"WITH m AS ({MULTI}) SELECT conversation_id, turns FROM m ORDER BY md5('7:' || conversation_id) LIMIT 1",
)
def random_multi_turn_conversation(spark, sf):
    return O.sample_n(C.multi_turn(X.messages(spark, sf)), 1, "conversation_id", seed=7)


@query(
    "transcripts",
    f"""WITH {X.MSG}
SELECT conversation_id, CAST(pos // {C.SEGMENT} AS BIGINT) AS segment,
       string_agg(CASE role WHEN 'user' THEN '😎 ' ELSE '🤖 ' END || content, chr(10) ORDER BY pos) AS transcript
FROM msg WHERE role IN ('user', 'assistant') GROUP BY conversation_id, pos // {C.SEGMENT}""",
)
def transcripts(spark, sf):
    # a conversation of any length is as many texts as it has segments
    text = C.transcript(F.col("conversation")).alias("transcript")
    return X.conversations(spark, sf).select("conversation_id", "segment", text).where("transcript <> ''")


@query(
    "message_lengths",
    f"WITH {X.MSG} SELECT role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, "
    "CAST(max(length(content)) AS BIGINT) AS longest FROM msg GROUP BY role",
)
def message_lengths(spark, sf):
    size = F.length("content").cast("bigint")
    return X.messages(spark, sf).groupBy("role").agg(
        F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(size).alias("longest")
    )


@query(
    "chat_texts",
    f"""WITH {PAIRS} SELECT turn_id, '😎 ' || prompt || ' ' || chr(10) || '🤖 ' || response AS chat
FROM pairs WHERE answers > 0""",
)
def chat_texts(spark, sf):
    from parley.functions.text import chat_text

    return C.pair_turns(X.messages(spark, sf)).select(
        "turn_id", chat_text(F.col("prompt"), F.col("response")).alias("chat")
    )
