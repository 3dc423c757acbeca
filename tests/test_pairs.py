"""Pair models scored inside the row against the same models on rows of pairs."""

import math
import re
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parley.api import LabelClassifier
from parley.operators import lookup, nli, pairs, training
from parley.schemas import CONTRADICTION, ENTAILMENT

LABELS = ["sports", "music law", "{odd}"]
TEMPLATE = "This is about {} and sports."
TEXTS = ["Sports and music, sports!", "the law of music", None, "", "about THIS: odd", "nothing else to say here"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, text, TEMPLATE.replace("{}", label), ENTAILMENT if (i + k) % 3 == 0 else CONTRADICTION)
            for i, text in enumerate(TEXTS * 5) for k, label in enumerate(LABELS) if text is not None]
    return spark.createDataFrame(made, "id long, text string, hypothesis string, labels int")


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("_w", F.lit("kept"))


def words(text):
    return [w for w in re.findall(r"[\w]+", (text or "").lower()) if len(w) > 1]


def items(text, hypothesis):
    left, right = words(text), words(hypothesis)
    return left + ["h " + w for w in right] + ["b " + w for w in dict.fromkeys(left) if w in right]


def logits(df):
    return {r["id"]: list(zip(r["entailment"], r["contradiction"])) for r in df.collect()}


def test_logistic_scores_equal_those_of_the_pairs(spark, rows):
    model = training.fit_logistic(training.pair_features(rows, "text", "hypothesis", 1 << 8))
    got = pairs.PairScorer(LABELS, pairs.HashedPairModel(model), TEMPLATE).score(texts(spark), "text", "id")
    assert got.columns == ["id", "text", "_w", "entailment", "contradiction"]
    crossed = spark.createDataFrame([(i, t or "", k, TEMPLATE.replace("{}", label)) for i, t in enumerate(TEXTS)
                                     for k, label in enumerate(LABELS)], "id long, text string, k int, hypothesis string")
    plain = model.transform(training.pair_features(crossed, "text", "hypothesis", 1 << 8))
    raw = vector_to_array("rawPrediction")
    want = {(r["id"], r["k"]): (r["e"], r["c"]) for r in plain.select(
        "id", "k", raw[ENTAILMENT].alias("e"), raw[CONTRADICTION].alias("c")).collect()}
    for i, scores in logits(got).items():
        for k, pair in enumerate(scores):
            assert pair == pytest.approx(want[i, k], abs=2e-6)


@pytest.mark.parametrize("frequent", [1 << 16, 3, 0])
def test_bayes_scores_equal_plain_sums(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(lookup, "FREQUENT_ITEMS", frequent)
    counts, sizes = {ENTAILMENT: Counter(), CONTRADICTION: Counter()}, Counter()
    for r in rows.collect():
        counts[r["labels"]].update(items(r["text"], r["hypothesis"]))
        sizes[r["labels"]] += 1
    known = counts[ENTAILMENT].keys() | counts[CONTRADICTION].keys()

    def logit(c, text, hypothesis):
        total = math.log((sizes[c] + 1) / (sum(sizes.values()) + 2))
        for item in items(text, hypothesis):
            if item in known:
                total += math.log((counts[c][item] + 1) / (sum(counts[c].values()) + len(known)))
        return total

    scorer = pairs.PairScorer(LABELS, pairs.fit_pair_bayes(rows, "text", "hypothesis"), TEMPLATE)
    for i, scores in logits(scorer.score(texts(spark), "text", "id")).items():
        for label, pair in zip(LABELS, scores):
            hypothesis = TEMPLATE.replace("{}", label)
            assert pair == pytest.approx([logit(c, TEXTS[i], hypothesis) for c in (ENTAILMENT, CONTRADICTION)], abs=2e-6)


def test_classifier_ranks_by_a_pair_scorer(spark, rows):
    scorer = pairs.PairScorer(LABELS, pairs.fit_pair_bayes(rows, "text", "hypothesis"), TEMPLATE)
    predicted = LabelClassifier(scorer).predict(texts(spark), "text", "id").collect()
    scores = logits(scorer.score(texts(spark), "text", "id"))
    assert len(predicted) == len(TEXTS)
    for r in predicted:
        entailment = [e for e, _ in scores[r["id"]]]
        assert r["predicted_class"] == LABELS[entailment.index(max(entailment))]


def test_no_training_rows(spark, rows):
    scorer = pairs.PairScorer(LABELS, pairs.fit_pair_bayes(rows.limit(0), "text", "hypothesis"), TEMPLATE)
    assert all(e == c for scores in logits(scorer.score(texts(spark), "text", "id")).values() for e, c in scores)


def test_a_text_is_cut_into_words_once_for_all_its_hypotheses(spark, rows):
    texts = rows.select("id", "text").distinct().withColumn("category", F.lit("b"))
    made = nli.contradiction_rows(pairs.with_premise_words(texts, "text"), "id", ["a", "b", "c d"], 2)
    features = training.pair_features(made, "text", "hypothesis", 1 << 8)
    plain = training.pair_features(nli.contradiction_rows(texts, "id", ["a", "b", "c d"], 2), "text", "hypothesis", 1 << 8)
    assert features.columns == plain.columns and features.exceptAll(plain).isEmpty() and plain.exceptAll(features).isEmpty()
    plan = features.select("features")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(text") == 1
    assert plan.index("posexplode") < plan.index("regexp_extract_all(lower(text")  # below, so before rows are repeated


def test_a_search_fits_each_setting_once_on_the_drawn_rows(spark, rows, monkeypatch):
    fitted, fit = [], training.LogisticRegression._fit
    monkeypatch.setattr(training.LogisticRegression, "_fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    features = training.pair_features(rows, "text", "hypothesis", 1 << 8)
    trials = training.search_settings(features, [{"regParam": 0.1}, {"regParam": 0.01}]).collect()
    assert sorted(r["run_id"] for r in trials) == ["trial-0", "trial-1"] and all(0 <= r["value"] <= 1 for r in trials)
    assert len(fitted) == 2 and len(set(fitted)) == 1 and 0 < fitted[0] < features.count()
