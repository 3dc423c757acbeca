import math

import pytest
from pyspark.sql import functions as F

from parley.operators import classify as K
from parley.operators import lookup
from parley.operators import metrics as M
from parley.operators.scoring import (
    HypothesisOverlapScorer,
    ModelScorer,
    fit_naive_bayes,
    fit_naive_bayes_together,
    loaded_model,
    python_trigrams,
    scorer_for,
)
from parley.schemas import TRAINING_LOG

LABELS = ["coding", "riddle", "writing"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, "A riddle about coding"), (1, "writing, writing"), (2, ""), (3, "xy"), (4, None)]
    return spark.createDataFrame(rows, "id int, text string")


def test_overlap_against_brute_force(texts):
    template = "This example is {}."
    scorer = HypothesisOverlapScorer(LABELS, template)
    for r in scorer.score(texts, "text", "id").collect():
        grams = set(python_trigrams((r["text"] or "").lower()))
        for label, logit in zip(LABELS, r["entailment"]):
            h = set(python_trigrams(template.replace("{}", label).lower()))
            expected = 10 * len(grams & h) / math.sqrt(len(grams) * len(h)) if grams else 0.0
            assert math.isclose(logit, expected, abs_tol=1e-6)


@pytest.mark.parametrize("multi_label", [False, True])
def test_scores(texts, multi_label):
    rows = K.rank_labels(texts, HypothesisOverlapScorer(LABELS), "text", "id", multi_label).collect()
    assert len(rows) == 5
    for r in rows:
        scores = [s["score"] for s in r["ranked"]]
        assert scores == sorted(scores, reverse=True)
        assert sorted(scores) == sorted(r["scores"])
        if not multi_label:
            assert math.isclose(sum(scores), 1.0)
    # nothing in common with any label: all scores tie, so the candidate order decides
    assert [s["label"] for s in rows[2]["ranked"]] == LABELS


def test_top_n_and_wide(texts):
    scorer = HypothesisOverlapScorer(LABELS)
    top = K.classify_text(texts, scorer, "text", "id", top_n=2).where("id = 1").first()
    assert top["sequence"] == "writing, writing" and top["labels"][0] == "writing" and len(top["scores"]) == 2
    wide = K.wide_scores(texts, scorer, "text", "id")
    assert wide.columns == ["id", "text", *LABELS, "highest_score_label"]


def test_naive_bayes_keeps_texts_without_known_words(spark, texts):
    train = spark.createDataFrame(
        [("coding riddle code", "coding"), ("riddle riddle", "riddle"), ("writing text", "writing")],
        "text string, category string",
    )
    model = fit_naive_bayes(train, "text", "category", LABELS, vocab_size=10)
    got = {r["id"]: r["predicted_class"] for r in K.predict(texts, model, "text", "id").collect()}
    assert len(got) == 5 and got[0] == "coding" and got[1] == "writing"
    assert model.weights.count() == 5
    assert fit_naive_bayes(train, "text", "category", LABELS, vocab_size=2).weights.count() == 2
    column = K.classify_column(texts, model, "text", "id", "nb")
    assert set(column.columns) == {"id", "text", "full_results_nb", "top_class_nb", "top_score_nb"}


def test_binary_tie_is_class_zero(spark):
    even = ModelScorer(["no", "yes"], lambda: lambda ts, ls: ([[1.0, 1.0] for _ in ts], [[0.0, 0.0] for _ in ts]))
    df = spark.createDataFrame([(0, "a")], "id int, text string")
    row = K.classify_binary_column(df, even, "text", "id", "t", {0: "no", 1: "yes"}).first()
    assert (row["pred_label_t"], row["prob_t"]) == ("no", 0.5)


def test_backend_choice(spark, tmp_path):
    fallback = HypothesisOverlapScorer(LABELS)
    assert scorer_for(spark, str(tmp_path), "model.bin", lambda p: None, fallback) is fallback
    (tmp_path / "model.bin").write_text("")
    assert scorer_for(spark, str(tmp_path), "model.bin", lambda p: p, fallback) == str(tmp_path)


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_rare_words_count_like_frequent_ones(spark, monkeypatch, frequent):
    monkeypatch.setattr(lookup, "FREQUENT_ITEMS", frequent)
    weights = spark.createDataFrame([("a", 9, [1.0, 2.0]), ("b", 5, [0.5, 0.0]), ("c", 1, [4.0, 8.0]), ("x" * 99, 7, [1.0, 1.0])],
                                    "item string, n bigint, w array<double>")
    rows = spark.createDataFrame([(1, "a b a"), (2, "c c z"), (3, ""), (4, None), (5, "a c " + "x" * 99), (5, "a c " + "x" * 99)],
                                 "id int, text string")
    out = lookup.with_weight_sums(rows, "text", lambda c: F.split(c, " "), weights, "id", 2).collect()
    assert sorted((r["id"], r["_sums"], r["_known"]) for r in out) == [
        (1, [2.5, 4.0], 3), (2, [8.0, 16.0], 2), (3, [0.0, 0.0], 0), (4, [0.0, 0.0], 0),
        (5, [6.0, 11.0], 3), (5, [6.0, 11.0], 3)]


def test_a_model_is_loaded_once_per_worker():
    loads = []
    for _ in range(3):
        loaded_model(lambda: loads.append(1) or "model", b"one")
    assert len(loads) == 1


def test_matrix_per_model(spark):
    rows = [("m1", "a", "a", 3), ("m2", "a", "a", 4), ("m2", "b", "a", 1)]
    counts = spark.createDataFrame(rows, "model string, true_class string, predicted_class string, n bigint")
    got = {(r["model"], r["true_class"], r["predicted_class"]): r["n"]
           for r in M.confusion_matrix(counts, ["a", "b"], ["model"]).collect()}
    assert len(got) == 8 and got[("m1", "a", "a")] == 3 and got[("m2", "a", "a")] == 4 and got[("m1", "b", "a")] == 0


def test_nan_is_never_best(spark):
    log = spark.createDataFrame([("r1", 1, 0.1, "f", float("nan")), ("r2", 2, 0.1, "f", 0.5), ("r3", 3, 0.1, "f", None)], TRAINING_LOG)
    assert M.best_run(log, "f").first()[0] == M.best_run(log, "f", greater_is_better=False).first()[0] == "r2"


def test_filter_on_a_label_does_not_copy_the_scoring(texts):
    ranked = K.rank_labels(texts, HypothesisOverlapScorer(LABELS), "text", "id")
    plan = ranked.where(F.col("ranked")[0].label == "riddle")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


# ---- metrics -----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "x")]
    return spark.createDataFrame(rows, "t string, p string")


def test_metrics_bundle(pairs):
    row = M.metrics_bundle(M.prediction_counts(pairs, "t", "p")).first()
    f1 = {"a": 6 / 7, "b": 4 / 5, "c": 0.0, "x": 0.0}
    assert row["n"] == 7 and math.isclose(row["accuracy"], 5 / 7)
    assert math.isclose(row["f1_macro"], sum(f1.values()) / 4)
    assert math.isclose(row["f1_weighted"], (4 * f1["a"] + 2 * f1["b"]) / 7)


def test_matrix_drops_pairs_outside_its_labels(pairs):
    matrix = M.confusion_matrix(M.prediction_counts(pairs, "t", "p"), ["a", "b"])
    assert {(r["true_class"], r["predicted_class"]): r["n"] for r in matrix.collect()} == {
        ("a", "a"): 3, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2,
    }


def test_comparison(pairs):
    counts = M.prediction_counts(pairs, "t", "p")
    better = M.prediction_counts(pairs.withColumn("p", F.col("t")), "t", "p")
    delta = {(r["true_class"], r["predicted_class"]): r["delta"] for r in M.compare_matrices(counts, better).collect()}
    assert delta == {("a", "a"): 1, ("a", "b"): -1, ("b", "b"): 0, ("c", "c"): 1, ("c", "x"): -1}


def test_loss_is_clipped(spark):
    loss = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(M.cross_entropy(F.col("p"))).collect()
    assert math.isclose(loss[0][0], -math.log(2.220446049250313e-16)) and abs(loss[1][0]) < 1e-15


def test_best_run_keeps_the_earliest_tie(spark):
    log = spark.createDataFrame(
        [("r1", 1, "eval_f1", 0.5), ("r1", 2, "eval_f1", 0.9), ("r2", 1, "eval_f1", 0.9), ("r2", 3, "eval_loss", 9.0)],
        "run_id string, step bigint, metric string, value double",
    )
    assert tuple(M.best_run(log, "eval_f1").first()[:2]) == ("r2", 1)
    assert tuple(M.best_run(log, "eval_f1", greater_is_better=False).first()[:2]) == ("r1", 1)


def test_user_metric_merges_states_of_tasks(spark):
    rows = [(k % 3 if k % 7 else None, float(k), k % 5 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, x double, flag boolean").repartition(5)
    spread = M.UserMetric("spread", ["x", "flag"], lambda r: [r["x"].max(), -r["x"].min(), r["flag"].sum()],
                          lambda s: s[0] + s[1] + 1000 * s[2],
                          lambda states: [*states[:, :2].max(0), states[:, 2].sum()])
    got = {r["g"]: r["value"] for r in M.user_metric(df, spread, ["g"]).collect()}
    for g in (0, 1, 2, None):
        own = [(x, flag) for h, x, flag in rows if h == g]
        assert got.pop(g) == max(x for x, _ in own) - min(x for x, _ in own) + 1000 * sum(f for _, f in own)
    assert not got and M.user_metric(df.limit(0), spread, ["g"]).count() == 0


def test_a_model_gets_few_texts_at_once(spark):
    """Whatever the Arrow batches, and all rows come back with their own columns."""
    def load():
        return lambda texts, labels: ([[float(len(texts))]] * len(texts), [[float(len(t or ""))] for t in texts])

    docs = spark.range(3000).repartition(1).selectExpr("id", "if(id % 7 = 0, null, repeat('x', int(id % 9))) AS text", "array(id) AS a")
    rows = ModelScorer(["l"], load).score(docs, "text").collect()
    assert max(r["entailment"][0] for r in rows) <= 512 and len(rows) == 3000
    assert all(r["a"] == [r["id"]] and r["contradiction"] == [float(len(r["text"] or ""))] for r in rows)


@pytest.mark.parametrize("frequent", [3, 1 << 16])
def test_models_fitted_and_scored_together_equal_single_ones(spark, monkeypatch, frequent):
    rows = [(i, f"common w{i % 7} x{i} " + "rare " * (i % 3), "a" if i % 2 else "b", ["c", "d", None][i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows + [(40, None, "a", "c"), (41, "only of none", None, None), (42, "", "b", None)],
                               "id int, text string, p string, q string")
    monkeypatch.setattr(lookup, "FREQUENT_ITEMS", frequent)
    names = {"p": {0: "a", 1: "b"}, "q": {0: "c", 1: "d"}}
    fitted = fit_naive_bayes_together(df, "text", {c: list(of.values()) for c, of in names.items()})
    docs = df.select("id", "text")
    got = K.classify_binary_columns(docs, {c: (fitted[c], names[c]) for c in names}, "text", "id")
    want = docs
    for c, of in names.items():
        alone = fit_naive_bayes(df, "text", c, list(of.values()))
        assert sorted(fitted[c].weights.collect()) == sorted(alone.weights.collect()) and fitted[c].log_prior == alone.log_prior
        want = K.classify_binary_column(want, alone, "text", "id", c, of)
    assert got.columns == want.columns and sorted(got.collect(), key=lambda r: r["id"]) == sorted(want.collect(), key=lambda r: r["id"])


def test_documents_are_read_once_to_fit_and_once_to_score_two_models(spark, monkeypatch):
    from parley.functions import text as T
    from parley.plans import classification_queries as Q

    cut = []
    words = T.words
    monkeypatch.setattr(T, "words", lambda c: cut.append(c) or words(c))
    assert Q.label_pairs(spark, "/root/testdata/sf0.001").columns == [
        "doc_id", "text", "pred_label_rq", "prob_rq", "pred_label_tl", "prob_tl"]
    assert len(cut) == 2
