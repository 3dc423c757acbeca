import pytest
from pyspark.sql import functions as F

from parley.operators import conversations as C
from parley.operators import phrases as P
from parley.schemas import CONVERSATION, MESSAGES
from parley.session import materialize

GOLDEN = {
    "system first": (["system", "user", "assistant"], [0, 1, 1], [("m1", "m2", 1)]),
    "double user": (["user", "user", "assistant"], [1, 2, 2], [("m1", "m2", 2)]),
    "double assistant": (["user", "assistant", "assistant"], [1, 1, 1], [("m0", "m1", 1)]),
    "assistant first": (["assistant", "user", "assistant"], [0, 1, 1], [("m1", "m2", 1)]),
    "system inside": (["user", "system", "assistant"], [1, 1, 1], [("m0", "m2", 1)]),
    "trailing user": (["user", "assistant", "user"], [1, 1, 2], [("m0", "m1", 1)]),
    "long": (["user", "assistant"] * 5, [1, 1, 2, 2, 3, 3, 4, 4, 5, 5],
             [(f"m{2 * i}", f"m{2 * i + 1}", i + 1) for i in range(5)]),
    "none": (["system", "assistant"], [0, 0], []),
}


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        (name, i, role, f"m{i}", "English") for name, (roles, _, _) in GOLDEN.items() for i, role in enumerate(roles)
    ]
    return spark.createDataFrame(rows, MESSAGES)


@pytest.mark.parametrize("chunk", [1, 2, 3, 1 << 16])
def test_turns_do_not_depend_on_the_chunk_size(messages, chunk):
    got = {}
    for r in C.number_turns(messages, chunk).orderBy("pos").collect():
        got.setdefault(r["conversation_id"], []).append(r["turn_n"])
        assert r["conversation_turns"] == GOLDEN[r["conversation_id"]][0].count("user")
    assert got == {name: turns for name, (_, turns, _) in GOLDEN.items()}


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_pairs(messages, chunk):
    got = {name: [] for name in GOLDEN}
    for r in C.pair_turns(messages, chunk).orderBy("turn_n").collect():
        got[r["conversation_id"]].append((r["prompt"], r["response"], r["turn_n"]))
        assert r["turn_id"] == f"{r['conversation_id']}{r['turn_n']:03}"
    assert got == {name: pairs for name, (_, _, pairs) in GOLDEN.items()}


def test_nested_pairs_equal_flat_pairs(messages):
    nested = C.unwrap_turns(C.nest_messages(messages))
    columns = ["conversation_id", "language", "conversation_turns", "turn_n", "turn_id", "prompt", "response"]
    assert sorted(map(tuple, nested.select(*columns).collect())) == sorted(
        map(tuple, C.pair_turns(messages).select(*columns).collect())
    )


def test_nested_turns(messages):
    got = {r["conversation_id"]: [m["turn"] for m in r["conversation"]]
           for r in C.add_turns(C.nest_messages(messages)).collect()}
    assert got == {name: turns for name, (_, turns, _) in GOLDEN.items()}


def test_segments_hold_at_most_their_size_and_lose_nothing(messages):
    nested = C.nest_messages(messages, segment=2)
    assert nested.agg(F.max(F.size("conversation"))).first()[0] == 2
    assert nested.agg(F.sum(F.size("conversation"))).first()[0] == messages.count()


@pytest.mark.parametrize("segment,length", [(2, 7), (1024, 1031)])
def test_long_nested_conversations_agree_with_messages(spark, segment, length):
    roles = ["system"] + ["user", "assistant"] * length
    rows = [("long", i, roles[i], f"m{i}", "English") for i in range(length)]
    rows += [("short", i, r, f"s{i}", "French") for i, r in enumerate(["user", "user", "assistant"])]
    messages = spark.createDataFrame(rows, MESSAGES)
    nested = C.nest_messages(messages, segment)
    columns = ["conversation_id", "language", "conversation_turns", "turn_n", "turn_id", "prompt", "response"]
    pairs = sorted(map(tuple, C.pair_turns(messages).select(*columns).collect()))
    assert sorted(map(tuple, C.unwrap_turns(nested).select(*columns).collect())) == pairs
    flat = {(r["conversation_id"], r["pos"]): r["turn_n"] for r in C.number_turns(messages).collect()}
    numbered = C.add_turns(nested)
    assert numbered.columns == nested.columns
    got = {(r["conversation_id"], r["segment"] * segment + i): m["turn"]
           for r in numbered.collect() for i, m in enumerate(r["conversation"])}
    assert got == flat
    found = C.search_conversations(nested, "M3")
    assert found.agg(F.sum(F.size("conversation"))).first()[0] == length
    assert C.matching_conversations(messages, "M3").count() == length


def test_phrases_from_a_table(spark):
    df = spark.createDataFrame([("say [x] now",), ("say y now",), (None,)], "prompt string")
    phrases = spark.createDataFrame([("[x]",), (None,), ("  ",)], "phrase string")
    assert [r[0] for r in C.exclude_phrases(df, "prompt", phrases).collect()] == ["say y now", None]


def test_turn_id_keeps_long_numbers(spark):
    row = spark.range(1).select(C.turn_id(F.lit("c"), F.lit(7)), C.turn_id(F.lit("c"), F.lit(12345))).first()
    assert tuple(row) == ("c007", "c12345")


def test_length_bounds_are_inclusive_and_count_characters(spark):
    texts = ["x" * 19, "x" * 20, "x" * 500, "x" * 501, "😎" * 20]
    rows = [("c", i, "user", t, "English") for i, t in enumerate(texts)]
    kept = C.message_prompts(spark.createDataFrame(rows, MESSAGES)).select("pos").collect()
    assert sorted(r["pos"] for r in kept) == [1, 2, 4]


def test_empty_extraction_keeps_its_schema(spark):
    empty = C.extract_prompts(spark.createDataFrame([], CONVERSATION))
    assert empty.columns == ["conversation_id", "prompt", "language"] and empty.count() == 0


def test_exclusions_are_literal_and_blank_phrases_are_ignored(spark):
    df = spark.createDataFrame([("say [your answer] now",), ("say y now",), (None,)], "prompt string")
    assert C.exclude_phrases(df, "prompt", ["", "  "]).count() == 3
    left = [r[0] for r in C.exclude_phrases(df, "prompt", ["[your answer]"]).collect()]
    assert left == ["say y now", None]
    many = [f"absent {i}" for i in range(100)] + ["y now"]
    assert C.exclude_phrases(df, "prompt", many).count() == 2
    assert C.exclude_phrases(df, "prompt", ["SAY"], ignore_case=True).count() == 1


def test_search_is_literal_and_ignores_case(messages):
    assert C.search_messages(messages, "M9").select("conversation_id").first()[0] == "long"
    assert C.search_conversations(C.nest_messages(messages), "M9").count() == 1
    assert C.search_messages(messages, "m.").count() == 0


def test_language_filter_without_list_keeps_all(messages):
    assert C.in_languages(messages, None).count() == C.in_languages(messages, []).count() == messages.count()
    assert C.in_languages(messages, ["French"]).count() == 0


def test_transcript_skips_other_roles(messages):
    rows = C.nest_messages(messages).where("conversation_id = 'system first'")
    assert rows.select(C.transcript(F.col("conversation"), "U:", "A:")).first()[0] == "U: m1\nA: m2"


def test_ids_by_list_and_by_table(spark, messages):
    ids = spark.createDataFrame([("long",), ("long",)], "conversation_id string")
    assert C.with_ids(messages, ["long"]).count() == C.with_ids(messages, ids).count() == 10
    assert C.with_ids(messages, ids.union(spark.createDataFrame([(None,)], ids.schema))).count() == 10
    # with few bits others pass the first look-up, but not the join
    assert C.with_ids(messages, ids, bits=8).count() == 10
    assert C.with_ids(messages, ids.limit(0)).count() == 0


# ---- phrase tables and long rows ---------------------------------------------------------------------------------

TEXTS = ["the quick brown fox", None, "", "a", "Ünïcode 日本語 text", "quick", "x" * 3000 + " needle", "brown\nfox", "aXbXc"]


@pytest.mark.parametrize("ignore_case,phrases", [
    (False, ["a", "日本", "QUICK BROWN", "needle", "x" * 40 + " ne", "BXc", "fox the", "", "  ", "zzz"]),
    (True, ["QUICK BROWN", "bXC", "fox the", "wn\nf"]), (False, [])])
def test_phrase_tables_equal_plain_search(spark, monkeypatch, phrases, ignore_case):
    monkeypatch.setattr(P, "CHUNK", 100)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, prompt string").withColumn("_grams", F.lit(1))
    table = spark.createDataFrame([(p,) for p in phrases] + [(None,)], "phrase string")
    low = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    want = {i for i, t in enumerate(TEXTS) if t is not None and any(p.strip() and low(p) in low(t) for p in phrases)}
    judged = P.with_phrase_hits(rows, "prompt", table, ignore_case)
    assert {r["id"]: r["_held"] for r in judged.collect()} == {i: i in want for i in range(len(TEXTS))}
    kept = C.exclude_phrases(rows, "prompt", table, ignore_case)
    assert kept.columns == rows.columns and {r["_grams"] for r in kept.collect()} == {1}


def test_100_000_phrases(spark):
    phrases = spark.range(100_000).selectExpr("concat('phrase number ', id, ' end') AS phrase")
    rows = spark.range(2000).selectExpr("id", "concat('it holds phrase number ', id * 77, if(id % 2 = 0, ' end', ' and')) AS text")
    got = {r["id"] for r in P.rows_with_phrases(rows, "text", phrases).collect()}
    assert got == {i for i in range(0, 2000, 2) if i * 77 < 100_000}


def test_phrase_lookups_do_not_grow_with_texts_times_phrases(spark, monkeypatch):
    # every text holds 20 phrases; what is written and joined is one window of each
    written = []
    monkeypatch.setattr(P, "materialize", lambda df, purpose: written.append(materialize(df, purpose)) or written[-1])
    phrases = spark.range(500).selectExpr("concat('phrase ', id) AS phrase")
    rows = spark.range(200).selectExpr("id", """concat_ws(', ', transform(sequence(1, 20), i -> concat(
        if(id < 190, 'phrase ', 'phase '), (id * i) % 500))) AS text""")
    assert sorted(r["id"] for r in P.with_phrase_hits(rows, "text", phrases).where("not _held").collect()) == list(range(190, 200))
    for table in written:
        assert table.count() <= 500
        for f in table.schema.fields:
            if f.dataType.typeName() == "array":
                assert (table.agg(F.sum(F.size(f.name))).first()[0] or 0) <= 200


def test_phrases_and_texts_of_any_length(spark):
    long = "".join(chr(0x4E00 + i) for i in range(5000))
    texts = ["y" * (P.CHUNK - 500) + long + "z", "y" * (P.CHUNK - 3) + "needle" + "y" * 10, long[:P.KEY_CHARS + 10],
             long[:P.KEY_CHARS], long[1:], "needl" + "y" * 300_000 + "e", "e"]
    phrases = [long, "needle", long[1:P.KEY_CHARS + 1] + "?", long[5:P.KEY_CHARS + 5] + "!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    assert {r["id"] for r in P.rows_with_phrases(rows, "text", table).collect()} == {0, 1}
    short = spark.createDataFrame([(long[:P.KEY_CHARS],)], "phrase string")
    assert {r["id"] for r in P.rows_with_phrases(rows, "text", table.union(short)).collect()} == {0, 1, 2, 3}


def test_a_row_of_100_000_messages_is_numbered_and_paired(spark):
    n = 100_000
    row = spark.range(1).select(
        F.lit("long").alias("conversation_id"), F.lit("English").alias("language"), F.lit(n // 4).alias("turn"),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
            F.when(i % 4 == 1, "user").when(i % 4 == 0, "system").otherwise("assistant").alias("role"),
            i.cast("string").alias("content"))).alias("conversation"))
    row = materialize(row, "long-row")
    turns = C.add_turns(row).select(F.inline("conversation"))
    assert turns.where("turn != floor((cast(content as int) + 3) / 4)").count() == 0 and turns.count() == n
    pairs = C.unwrap_turns(row)
    assert pairs.count() == n // 4
    assert pairs.where("prompt != cast(turn_n * 4 - 3 as string) or response != cast(turn_n * 4 - 2 as string)").count() == 0
