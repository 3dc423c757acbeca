import pytest

from parley.api import Conversations, LabelClassifier
from parley.operators.scoring import HypothesisOverlapScorer
from parley.schemas import CONVERSATION
from parley.session import fresh_path
from parley.streaming.streams import drain


@pytest.fixture(scope="module")
def path(spark):
    def talk(i, n):
        return [m for k in range(n) for m in (("user", f"question {k} of conversation {i}"), ("assistant", "answer"))]

    rows = [(f"c{i}", "English" if i % 2 else None, i, talk(i, i)) for i in range(1, 7)]
    path = fresh_path(spark, "conversations")
    spark.createDataFrame(rows, CONVERSATION).write.parquet(path)
    return path


def test_conversations(spark, path):
    table = Conversations.read(spark, path)
    assert table.sample(3).rows.count() == 3
    assert table.sample(1, ids=["c2", "c4"]).rows.count() == 2
    assert table.turn_pairs().count() == table.prompts().count() == 21
    assert table.prompts(["English"]).count() == 9
    assert table.search("QUESTION 5").count() == 1 and table.multi_turn().count() == 5
    assert table.language_counts().collect() == [("English", 3)]
    assert table.with_turns().where("conversation_id = 'c6'").first()["conversation"][-1]["turn"] == 6
    assert table.transcripts().count() == 6


def test_streamed_conversations(spark, path):
    stream = Conversations.read(spark, path, streaming=True)
    assert drain(stream.sample(2).rows).count() == 2
    shuffled = stream.shuffled_sample(3).rows
    assert not shuffled.isStreaming and sorted(r["seq"] for r in shuffled.collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        stream.sample()
    assert drain(stream.prompts()).count() == 21
    assert drain(stream.search("question 5")).count() == 1


def test_classifier(spark, path):
    classifier = LabelClassifier(HypothesisOverlapScorer(["coding", "riddle"]))
    df = spark.createDataFrame([(0, "coding", "coding"), (1, "a riddle", "riddle")], "id int, text string, category string")
    bundle, matrix = classifier.evaluate(classifier.predict(df, "text", "id"))
    assert bundle.first()["accuracy"] == 1.0 and matrix.count() == 4
