import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import curation as Q
from parley.operators import labeling as L
from parley.operators import nli as N


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "tell a joke", "ai", 2), (2, "tell a joke", "ai", 0), (3, "fix the text", "code", 2), (4, None, "ai", None)],
        "seq bigint, text string, category string, label int",
    )


def test_rules_follow_their_order_and_keep_null_rows(rows):
    rules = [Q.Rule("joke"), Q.Rule("fix", "language"), Q.Rule("text", "writing")]
    got = {r["seq"]: r["category"] for r in Q.apply_rules(rows, rules).collect()}
    assert got == {2: "ai", 3: "writing", 4: "ai"}


def test_patterns_are_literal_unless_asked(rows):
    hit = rows.select(Q.matches(F.col("text"), "t.ll"), Q.matches(F.col("text"), "t.ll", regex=True)).first()
    assert tuple(hit) == (False, True)


def test_null_tags_are_kept(spark):
    tags = spark.createDataFrame([("delete",), ("public",), (None,)], "conversation_tag string")
    assert {r[0] for r in Q.without_tags(tags, ["delete", "private"]).collect()} == {"public", None}


def test_unknown_label_fails(spark):
    bad = spark.createDataFrame([(3,)], "label int")
    with pytest.raises(Exception, match="unknown label 3"):
        Q.cast_label(bad).collect()


def test_append_checks_the_split_and_keeps_duplicates(rows):
    data = rows.where("label is not null").withColumn("split", F.lit("test"))
    grown = Q.append_to_split(data, rows.where("label = 2"), "train")
    assert dict(grown.groupBy("split").count().collect()) == {"test": 3, "train": 2}
    with pytest.raises(ValueError):
        Q.append_to_split(data, rows, "validation")


def test_append_refuses_unknown_labels(rows):
    data = rows.where("label is not null").withColumn("split", F.lit("test"))
    with pytest.raises(Exception, match="unknown label 9"):
        Q.append_to_split(data, rows.withColumn("label", F.lit(9)), "train").select("label").collect()


def test_top_categories_ties_by_name_and_excludes_before_the_cut(spark):
    df = spark.createDataFrame([(c,) for c in "bbaaccdddd"] + [(None,)], "category string")
    assert [r[0] for r in Q.top_categories(df, 2).collect()] == ["d", "a"]
    assert [r[0] for r in Q.top_categories(df, 2, exclude=["d"]).collect()] == ["a", "b"]


def test_accepted_columns(rows):
    kept, ignored = Q.select_accepted(rows, ["label", "seq", "input_ids"])
    assert kept.columns == ["label", "seq"] and ignored == ["text", "category"]
    with pytest.raises(ValueError):
        Q.select_accepted(rows, ["input_ids"])


def test_groups_and_swaps(rows):
    assert {r["category"] for r in Q.group_categories(rows).collect()} == {"technology and ai", "code"}
    assert Q.swap_value(rows, "category", "code", "coding").where("category = 'coding'").count() == 1


def test_masking(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abcdef",)], "s string")
    got = [tuple(r) for r in df.select(T.mask_secret(F.col("s")), T.mask_secret(F.col("s"), reveal_short=True)).collect()]
    assert got == [("abcd**ghij", "abcd**ghij"), ("******", "abcdcdef")]


def test_scalar_text_functions(spark):
    row = spark.range(1).select(
        T.strip(F.lit("\t a b \n")), T.capitalize(F.lit("rEQUEST x")), T.class_index(F.lit("LABEL_1")),
        T.hypothesis("This is {}.", F.lit("100% {odd}")), T.first_words(F.lit(" a  b\nc "), 2),
        T.clean(F.lit("A-b_2 É9!")), T.chat_text(F.lit("p"), F.lit("r")),
    ).first()
    assert tuple(row) == ("a b", "Request x", 1, "This is 100% {odd}.", "a b", "a b_ é ", "😎 p \n🤖 r")


# ---- NLI rows ----------------------------------------------------------------------------------------------------

LABELS = ["ai", "code", "riddle"]


def test_contradictions_never_repeat_the_own_class(rows):
    made = N.contradiction_rows(rows.where("label = 2"), "seq", LABELS, 2)
    assert made.count() == 2 * 3
    assert made.where("pos > 0 and hypothesis_category = category").count() == 0
    per_row = made.where("pos > 0").groupBy("seq").agg(F.count_distinct("hypothesis_category").alias("n"))
    assert {r["n"] for r in per_row.collect()} == {2}
    assert {(r["pos"] == 0, r["labels"]) for r in made.collect()} == {(True, 2), (False, 0)}


def test_too_many_contradictions_fail(rows):
    with pytest.raises(Exception, match="fewer than 3"):
        N.contradiction_rows(rows.where("label = 2"), "seq", LABELS, 3).collect()


def test_encoding_is_padded(rows):
    row = N.encode(N.input_sentences(rows.where("seq = 1")), F.col("input_sentence"), max_length=16).first()
    assert len(row["input_ids"]) == len(row["attention_mask"]) == 15
    n = sum(row["attention_mask"])
    assert n == 9 and row["input_ids"][n:] == [0] * (15 - n) and min(row["input_ids"][:n]) > 0


def test_grouped_split_keeps_texts_together(rows):
    data = N.contradiction_dataset(rows.where("label = 2"), "seq", LABELS, 2, eval_share=0.5, group_by_text=True)
    assert data.groupBy("seq").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


# ---- labelling ---------------------------------------------------------------------------------------------------

def test_decisions(spark):
    queue = spark.createDataFrame(
        [(i, f"t{i}", "top", "bottom") for i in range(4)], "seq bigint, text string, top_category string, bottom_category string"
    )
    decisions = spark.createDataFrame(
        [(0, "correct", " more ", None, "n"), (1, "wrong", None, "c", "n"), (2, "neutral", " ", None, "n"),
         (3, "skip", "e", "c", "n")],
        "seq bigint, action string, custom_entailment string, custom_contradiction string, custom_neutral string",
    )
    got = {}
    for r in L.apply_decisions(queue, decisions).orderBy("seq", "place").collect():
        got.setdefault(r["seq"], []).append((r["category"], r["label"]))
    assert got == {
        0: [("top", 2), ("bottom", 0), ("more", 2)],
        1: [("top", 0), ("c", 0)],
        2: [("top", 1), ("bottom", 0), ("n", 1)],
    }
