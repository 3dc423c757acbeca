"""Scored texts, predictions, metrics, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.arrays import round_doubles
from parley.operators import classify as K
from parley.operators import curation as Q
from parley.operators import metrics as M
from parley.operators import nli as N
from parley.operators.pairs import PairScorer, fit_pair_bayes, with_premise_words
from parley.operators.scoring import HypothesisOverlapScorer, ModelScorer, fit_naive_bayes, fit_naive_bayes_together
from parley.plans import fixtures as X
from parley.plans import oracle_parts as P
from parley.plans.curation_queries import contradictions
from parley.plans.registry import query
from parley.schemas import LABEL_NAMES

LABELS = X.CATEGORIES
# Class names of the two binary classifiers.
REQUEST = {0: "question", 1: "request"}
TEST = {0: "learn", 1: "test"}


def short(spark, sf):
    """All documents under a short name for their key."""
    return X.documents(spark, sf).select("doc_id", "text")


DOC_SRC = "src AS (SELECT doc_id AS id, text FROM documents)"
DOC_RANKED = f"{DOC_SRC}, {P.overlap(LABELS)}"


def rank_rows(df, key, array):
    """One row per text and label with its 1-based rank."""
    return df.select(key, F.posexplode_outer(array).alias("p", "r")).select(
        key, (F.col("p") + 1).cast("bigint").alias("rank"), F.col("r.label").alias("label"), F.col("r.score").alias("score")
    )


@query("classified_texts", f"WITH {DOC_RANKED} SELECT id AS doc_id, r AS rank, label, round_even(score, 3) AS score FROM ranked")
def classified_texts(spark, sf):
    out = K.classify_column(short(spark, sf), HypothesisOverlapScorer(LABELS), "text", "doc_id", "zs")
    return rank_rows(out, "doc_id", "full_results_zs")


@query(
    "classified_texts_top_labels",
    f"""WITH {DOC_RANKED} SELECT id AS doc_id, string_agg(label, ', ' ORDER BY r) AS labels,
  round_even(max(score), 3) AS top_score, count(*) AS n FROM ranked WHERE r <= 3 GROUP BY id""",
)
def classified_texts_top_labels(spark, sf):
    out = K.classify_text(short(spark, sf), HypothesisOverlapScorer(LABELS), "text", "doc_id", top_n=3)
    return out.select(
        "doc_id", F.array_join("labels", ", ").alias("labels"), F.col("scores")[0].alias("top_score"),
        F.size("scores").cast("bigint").alias("n"),
    )


@query(
    "classified_texts_multi_label",
    f"""WITH {DOC_SRC}, {P.overlap(LABELS, multi_label=True)}
SELECT id AS doc_id, r AS rank, label, round_even(score, 3) AS score FROM ranked""",
)
def classified_texts_multi_label(spark, sf):
    out = K.classify_column(
        short(spark, sf), HypothesisOverlapScorer(LABELS), "text", "doc_id", "ml", multi_label=True
    )
    return rank_rows(out, "doc_id", "full_results_ml")


@query(
    "classified_column",
    f"""WITH {DOC_RANKED} SELECT id AS doc_id, label AS top_class_zs, round_even(score, 3) AS top_score_zs FROM ranked WHERE r = 1""",
)
def classified_column(spark, sf):
    out = K.classify_column(short(spark, sf), HypothesisOverlapScorer(LABELS), "text", "doc_id", "zs")
    return out.select("doc_id", "top_class_zs", "top_score_zs")


@query(
    "top_second_bottom_labels",
    f"""WITH {DOC_RANKED} SELECT id AS doc_id, max(label) FILTER (WHERE r = 1) AS top, max(label) FILTER (WHERE r = 2) AS second,
  max(label) FILTER (WHERE r = {len(LABELS)}) AS bottom FROM ranked GROUP BY id""",
)
def top_second_bottom_labels(spark, sf):
    r = K.rank_labels(short(spark, sf), HypothesisOverlapScorer(LABELS), "text", "doc_id")
    return r.select(
        "doc_id", *[F.element_at("ranked", i).label.alias(n) for i, n in ((1, "top"), (2, "second"), (-1, "bottom"))]
    )


@query(
    "label_score_maps",
    f"WITH {DOC_RANKED} SELECT id AS doc_id, round_even(max(score) FILTER (WHERE label = 'science'), 6) AS science, "
    "count(*) AS entries FROM ranked GROUP BY id",
)
def label_score_maps(spark, sf):
    r = K.rank_labels(short(spark, sf), HypothesisOverlapScorer(LABELS), "text", "doc_id")
    m = r.withColumn("m", F.map_from_arrays(F.col("ranked.label"), F.col("ranked.score")))
    return m.select("doc_id", F.bround(F.col("m")["science"], 6).alias("science"), F.size("m").cast("bigint").alias("entries"))


@query(
    "wide_scores",
    f"""WITH {DOC_RANKED} SELECT id AS doc_id,
  {', '.join(f'round_even(max(score) FILTER (WHERE pos = {i}), 6) AS "{l}"' for i, l in enumerate(LABELS))},
  max(label) FILTER (WHERE r = 1) AS highest_score_label FROM ranked GROUP BY id""",
)
def wide_scores(spark, sf):
    out = K.wide_scores(short(spark, sf), HypothesisOverlapScorer(LABELS), "text", "doc_id")
    return out.select("doc_id", *[F.bround(F.col(l), 6).alias(l) for l in LABELS], "highest_score_label")


@query(
    "scores_joined_to_rows",
    f"""WITH {DOC_RANKED} SELECT d.doc_id, d.lang, d.source, ranked.label AS highest_score_label
FROM documents d JOIN ranked ON ranked.id = d.doc_id WHERE ranked.r = 1""",
)
def scores_joined_to_rows(spark, sf):
    rows = X.documents(spark, sf).select("doc_id", "text", "lang", "source")
    scored = K.wide_scores(rows, HypothesisOverlapScorer(LABELS), "text", "doc_id")
    return scored.select("doc_id", "lang", "source", "highest_score_label")


# ---- binary classification ---------------------------------------------------------------------------------------

def binary_model(spark, sf, label, names):
    train = X.binary(spark, sf, label).where("doc_id % 5 <> 0")
    named = train.withColumn("class", F.element_at(Q.literal_map(names), F.col("label")))
    return fit_naive_bayes(named, "text", "class", list(names.values()))


def binary_sql(label, names, src) -> str:
    return f"""train AS (SELECT CASE l.{label} WHEN 0 THEN '{names[0]}' ELSE '{names[1]}' END AS category, d.text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 5 <> 0),
src AS ({src}),
{P.naive_bayes(list(names.values()))}"""


BINARY = """pr AS (SELECT id, max(score) FILTER (WHERE pos = 0) AS p0, max(score) FILTER (WHERE pos = 1) AS p1
  FROM ranked GROUP BY id)"""


@query(
    "binary_column",
    f"""WITH {binary_sql('toxic', REQUEST, 'SELECT doc_id AS id, text FROM documents')}, {BINARY}
SELECT id AS doc_id, CASE WHEN p1 > p0 THEN 'request' ELSE 'question' END AS pred_label_rq,
  round_even(greatest(p0, p1), 6) AS prob_rq FROM pr""",
)
def binary_column(spark, sf):
    model = binary_model(spark, sf, "toxic", REQUEST)
    out = K.classify_binary_column(short(spark, sf), model, "text", "doc_id", "rq", REQUEST)
    return out.select("doc_id", "pred_label_rq", F.bround("prob_rq", 6).alias("prob_rq"))


TEST_ROWS = "SELECT d.doc_id AS id, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 5 = 0"
BINARY_EVAL = f"""{binary_sql('toxic', REQUEST, TEST_ROWS)}, {BINARY},
ev AS (SELECT pr.id, l.toxic AS true_class, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS predicted_class,
  -ln(least(greatest(CASE l.toxic WHEN 1 THEN p1 ELSE p0 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) AS loss
  FROM pr JOIN labels l ON l.doc_id = pr.id),
pred AS (SELECT true_class, predicted_class FROM ev)"""


def binary_predictions(spark, sf):
    model = binary_model(spark, sf, "toxic", REQUEST)
    test = X.binary(spark, sf).where("doc_id % 5 = 0")
    return K.binary_probabilities(test, model, "text", "doc_id")


@query("binary_evaluation", f"""WITH {BINARY_EVAL}, {P.class_table()}, b AS ({P.BUNDLE})
SELECT b.*, (SELECT round_even(avg(loss), 6) FROM ev) AS cross_entropy_loss FROM b""")
def binary_evaluation(spark, sf):
    from parley.session import materialize

    scored = materialize(binary_predictions(spark, sf), "binary-scores")
    bundle = M.metrics_bundle(M.prediction_counts(scored, "label", "predicted"))
    p_true = F.when(F.col("label") == 1, F.col("predicted_prob_1")).otherwise(F.col("predicted_prob_0"))
    loss = scored.agg(F.bround(F.avg(M.cross_entropy(p_true)), 6).alias("cross_entropy_loss")).first()[0]
    return round_metrics(bundle).withColumn("cross_entropy_loss", F.lit(loss))


def round_metrics(df):
    return round_doubles(df, 6)


@query(
    "binary_confusion_matrix",
    f"""WITH {BINARY_EVAL} SELECT t.c AS true_class, p.c AS predicted_class,
  (SELECT count(*) FROM pred WHERE pred.true_class = t.c AND pred.predicted_class = p.c) AS n
FROM (VALUES (0), (1)) t(c), (VALUES (0), (1)) p(c)""",
)
def binary_confusion_matrix(spark, sf):
    pairs = binary_predictions(spark, sf).select(
        F.col("label").cast("string").alias("label"), F.col("predicted").cast("string").alias("predicted")
    )
    matrix = M.confusion_matrix(M.prediction_counts(pairs, "label", "predicted"), ["0", "1"])
    return matrix.select(F.col("true_class").cast("int"), F.col("predicted_class").cast("int"), "n")


@query(
    "evaluation_loss",
    f"WITH {BINARY_EVAL} SELECT round_even(avg(loss), 6) AS eval_loss, count(*) AS eval_examples FROM ev",
)
def evaluation_loss(spark, sf):
    p_true = F.when(F.col("label") == 1, F.col("predicted_prob_1")).otherwise(F.col("predicted_prob_0"))
    return round_metrics(M.mean_loss(binary_predictions(spark, sf), M.cross_entropy(p_true)))


def pair_sql() -> str:
    """Both binary predictions per document: rq(id, label) and tl(id, label)."""
    def one(label, names, prefix):
        ctes = binary_sql(label, names, "SELECT doc_id AS id, text FROM documents")
        return f"{prefix} AS (WITH {ctes}, {BINARY} SELECT id, CASE WHEN p1 > p0 THEN '{names[1]}' ELSE '{names[0]}' END AS label FROM pr)"

    return one("toxic", REQUEST, "rq") + ",\n" + one("quality", TEST, "tl")


def label_pairs(spark, sf):
    """The documents with the labels of two models, both added to the same rows in one pass over the texts."""
    docs = X.documents(spark, sf).select("doc_id", "text")
    train = docs.where("doc_id % 5 <> 0").join(X.table(spark, sf, "labels"), "doc_id").select(
        "text", F.element_at(Q.literal_map(REQUEST), F.col("toxic")).alias("rq"),
        F.element_at(Q.literal_map(TEST), F.col("quality")).alias("tl"))
    names = {"rq": REQUEST, "tl": TEST}
    fitted = fit_naive_bayes_together(train, "text", {suffix: list(of.values()) for suffix, of in names.items()})
    return K.classify_binary_columns(docs, {suffix: (fitted[suffix], of) for suffix, of in names.items()}, "text", "doc_id")


@query(
    "label_pair_counts",
    f"""WITH {pair_sql()} SELECT rq.label AS pred_label_rq, tl.label AS pred_label_tl, count(*) AS n
FROM rq JOIN tl ON rq.id = tl.id GROUP BY rq.label, tl.label""",
)
def label_pair_counts(spark, sf):
    return label_pairs(spark, sf).groupBy("pred_label_rq", "pred_label_tl").agg(F.count("*").alias("n"))


# ---- evaluation of candidate-label models ------------------------------------------------------------------------

TOP_K = 10


def evaluation_rows(spark, sf, k=TOP_K, grouped=False):
    """Test entailments of the ``k`` most frequent categories (or category groups), and those categories."""
    test = entailment_rows(spark, sf, grouped).where("split = 'test'")
    labels = [r["category"] for r in Q.top_categories(test, k, exclude=["general knowledge"]).collect()]
    return test.where(F.col("category").isin(labels)).select("seq", "text", "category"), labels


def entailment_rows(spark, sf, grouped=False):
    rows = Q.entailments(X.nli(spark, sf))
    return Q.group_categories(rows) if grouped else rows


def tuned_scorer(spark, sf, labels, grouped=False):
    train = entailment_rows(spark, sf, grouped).where("split = 'train'")
    return fit_naive_bayes(train, "text", "category", labels)


def both_predictions(spark, sf, k=TOP_K, grouped=False):
    """(model, category, predicted_class) of the untrained and the fitted scorer; written once for all metrics."""
    from parley.session import materialize

    rows, labels = evaluation_rows(spark, sf, k, grouped)
    parts = [
        K.predict(rows, scorer, "text", "seq").select(
            F.lit(model).alias("model"), "seq", "category", "predicted_class", "predicted_scores"
        )
        for model, scorer in (("base", HypothesisOverlapScorer(labels)), ("tuned", tuned_scorer(spark, sf, labels, grouped)))
    ]
    return materialize(parts[0].unionByName(parts[1]), "predictions"), labels


def eval_top(k: int = TOP_K, category: str = "category") -> str:
    return f"""{X.NLI}, ent AS (SELECT seq, text, split, {category} AS category FROM nli WHERE label = 2),
top AS (SELECT category, count(*) AS n FROM ent WHERE split = 'test' AND category <> 'general knowledge'
  GROUP BY category ORDER BY n DESC, category LIMIT {k}),
toplab AS (SELECT category AS label, row_number() OVER (ORDER BY n DESC, category) - 1 AS pos FROM top),
test AS (SELECT seq, text, category FROM ent WHERE split = 'test' AND category IN (SELECT category FROM top)),
train AS (SELECT category, text FROM ent WHERE split = 'train'),
src AS (SELECT seq AS id, text FROM test)"""


def from_data(part: str) -> str:
    """Replace the literal label rows of a part by the ranked categories of the data."""
    rows = P.label_rows(["?"])
    return part.replace(f"{rows} AS v(pos, label)", "toplab").replace(
        "(SELECT count(*) FROM known) + 1)", "(SELECT count(*) FROM known) + (SELECT count(*) FROM toplab))"
    )


EVAL_TOP = eval_top()
BASE_PRED = f"base AS (WITH {from_data(P.overlap(['?']))} SELECT id, label, score FROM ranked WHERE r = 1)"
TUNED_PRED = f"tuned AS (WITH {from_data(P.naive_bayes(['?']))} SELECT id, label, score FROM ranked WHERE r = 1)"


def eval_sql(which: str) -> str:
    parts = {"base": BASE_PRED, "tuned": TUNED_PRED}[which]
    return f"""{EVAL_TOP}, {parts},
pred AS (SELECT test.category AS true_class, {which}.label AS predicted_class FROM test JOIN {which} ON {which}.id = test.seq)"""


def both_sql(top: str = EVAL_TOP) -> str:
    return f"""{top}, {BASE_PRED}, {TUNED_PRED},
predb AS (SELECT test.category AS true_class, base.label AS predicted_class FROM test JOIN base ON base.id = test.seq),
predt AS (SELECT test.category AS true_class, tuned.label AS predicted_class FROM test JOIN tuned ON tuned.id = test.seq)"""


@query("evaluation_base", f"WITH {eval_sql('base')}, {P.class_table()} {P.BUNDLE}")
def evaluation_base(spark, sf):
    rows, labels = evaluation_rows(spark, sf)
    predicted = K.predict(rows, HypothesisOverlapScorer(labels), "text", "seq")
    return round_metrics(M.metrics_bundle(M.prediction_counts(predicted, "category", "predicted_class")))


def tuned_predictions(spark, sf):
    rows, labels = evaluation_rows(spark, sf)
    return K.predict(rows, tuned_scorer(spark, sf, labels), "text", "seq"), labels


@query("evaluation_tuned", f"WITH {eval_sql('tuned')}, {P.class_table()} {P.BUNDLE}")
def evaluation_tuned(spark, sf):
    predicted, _ = tuned_predictions(spark, sf)
    return round_metrics(M.metrics_bundle(M.prediction_counts(predicted, "category", "predicted_class")))


def pair_eval_sql() -> str:
    head, tail = T.PLAIN_TEMPLATE.split("{}")
    return f"""{EVAL_TOP},
pairs AS (WITH {contradictions(2)} SELECT rows.text, rows.hypothesis, rows.labels FROM rows JOIN nli ON nli.seq = rows.seq
  WHERE nli.split = 'train'),
words AS (SELECT labels, {P.words('text')} AS l, {P.words('hypothesis')} AS r FROM pairs),
items AS (SELECT labels, unnest(l || list_transform(r, lambda w: 'h ' || w)
  || list_transform(list_intersect(l, r), lambda w: 'b ' || w)) AS item FROM words),
counts AS (SELECT item, count(*) FILTER (WHERE labels = 2) AS n0, count(*) FILTER (WHERE labels = 0) AS n1 FROM items GROUP BY item),
weights AS (SELECT item, ln((n0 + 1) / (sum(n0) OVER () + count(*) OVER ())) AS e FROM counts),
asked AS (SELECT seq, t.pos, t.label, {P.words('text')} AS l, {P.words(f"'{head}' || t.label || '{tail}'")} AS r FROM test, toplab t),
asked_items AS (SELECT seq, pos, label, unnest(l || list_transform(r, lambda w: 'h ' || w)
  || list_transform(list_intersect(l, r), lambda w: 'b ' || w)) AS item FROM asked),
sums AS (SELECT a.seq, a.pos, a.label, sum(w.e) AS e FROM asked_items a LEFT JOIN weights w ON w.item = a.item GROUP BY ALL),
best AS (SELECT seq, label FROM sums QUALIFY row_number() OVER (
  PARTITION BY seq ORDER BY round_even(coalesce(e, 0) + (SELECT ln((count(*) FILTER (WHERE labels = 2) + 1) / (count(*) + 2))
    FROM pairs), 6) DESC, pos) = 1),
pred AS (SELECT test.category AS true_class, best.label AS predicted_class FROM test JOIN best ON best.seq = test.seq)"""


@query("evaluation_pair_model", f"WITH {pair_eval_sql()}, {P.class_table()} {P.BUNDLE}")
def evaluation_pair_model(spark, sf):
    """A model of premise and hypothesis pairs, fitted on entailments and contradictions, ranks the labels of test texts."""
    rows, labels = evaluation_rows(spark, sf)
    train = Q.entailments(X.nli(spark, sf)).where("split = 'train'")
    made = N.contradiction_rows(with_premise_words(train, "text"), "seq", LABELS, 2)
    scorer = PairScorer(labels, fit_pair_bayes(made, "text", "hypothesis"))
    predicted = K.predict(rows, scorer, "text", "seq")
    return round_metrics(M.metrics_bundle(M.prediction_counts(predicted, "category", "predicted_class")))


@query(
    "evaluation_details",
    f"""WITH {EVAL_TOP}, {TUNED_PRED} SELECT test.seq, test.category, tuned.label AS predicted_class,
  round_even(tuned.score, 4) AS predicted_score, CAST(CASE WHEN test.category = tuned.label THEN 1 ELSE 0 END AS INT) AS is_correct
FROM test JOIN tuned ON tuned.id = test.seq""",
)
def evaluation_details(spark, sf):
    predicted, _ = tuned_predictions(spark, sf)
    return predicted.select(
        "seq", "category", "predicted_class", F.bround(F.col("predicted_scores")[0], 4).alias("predicted_score"),
        K.correctness(F.col("category"), F.col("predicted_class")).alias("is_correct"),
    )


@query("class_scores", f"WITH {eval_sql('tuned')}, {P.class_table()} SELECT class, tp, fp, fn, support, round_even(f1, 6) AS f1 FROM cls")
def class_scores(spark, sf):
    predicted, _ = tuned_predictions(spark, sf)
    return round_metrics(M.class_scores(M.prediction_counts(predicted, "category", "predicted_class")))


@query(
    "confusion_matrix",
    f"""WITH {eval_sql('tuned')} SELECT t.label AS true_class, p.label AS predicted_class,
  (SELECT count(*) FROM pred WHERE pred.true_class = t.label AND pred.predicted_class = p.label) AS n
FROM toplab t, toplab p""",
)
def confusion_matrix(spark, sf):
    predicted, labels = tuned_predictions(spark, sf)
    matrix = M.confusion_matrix(M.prediction_counts(predicted, "category", "predicted_class"), labels)
    return matrix.select("true_class", "predicted_class", "n")


@query(
    "count_matrix",
    f"""WITH {X.NLI} SELECT category, {', '.join(f"count(*) FILTER (WHERE label = {k}) AS {v}" for k, v in LABEL_NAMES.items())}
FROM nli GROUP BY category""",
)
def count_matrix(spark, sf):
    named = Q.cast_label(X.nli(spark, sf, False))
    return M.count_matrix(named, "category", "label_name", list(LABEL_NAMES.values()))


@query(
    "accuracy_by_category",
    f"""WITH {eval_sql('tuned')} SELECT true_class AS category,
  round_even(avg(CASE WHEN true_class = predicted_class THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM pred GROUP BY true_class""",
)
def accuracy_by_category(spark, sf):
    predicted, _ = tuned_predictions(spark, sf)
    return round_metrics(M.accuracy_by(predicted, "category", "predicted_class"))


@query(
    "accuracy_percent",
    f"WITH {eval_sql('tuned')} SELECT round_even(avg(CASE WHEN true_class = predicted_class THEN 1 ELSE 0 END) * 100, 6) "
    "AS accuracy_percent FROM pred",
)
def accuracy_percent(spark, sf):
    predicted, _ = tuned_predictions(spark, sf)
    return round_metrics(M.accuracy_percent(predicted, "category", "predicted_class"))


@query(
    "matrix_comparison",
    f"""WITH {both_sql()},
b AS (SELECT true_class, predicted_class, count(*) AS n FROM predb GROUP BY ALL),
t AS (SELECT true_class, predicted_class, count(*) AS n FROM predt GROUP BY ALL)
SELECT coalesce(b.true_class, t.true_class) AS true_class, coalesce(b.predicted_class, t.predicted_class) AS predicted_class,
  coalesce(b.n, 0) AS base_n, coalesce(t.n, 0) AS tuned_n, coalesce(t.n, 0) - coalesce(b.n, 0) AS delta
FROM b FULL OUTER JOIN t ON b.true_class = t.true_class AND b.predicted_class = t.predicted_class""",
)
def matrix_comparison(spark, sf):
    predicted, _ = both_predictions(spark, sf)
    counts = M.prediction_counts(predicted, "category", "predicted_class", ["model"])
    return M.compare_matrices(counts.where("model = 'base'"), counts.where("model = 'tuned'"))


def comparison_sql(top: str = EVAL_TOP) -> str:
    return f"""WITH {both_sql(top)},
mb AS (WITH {P.class_table('predb')} {P.BUNDLE}), mt AS (WITH {P.class_table('predt')} {P.BUNDLE})
SELECT mb.accuracy AS base_accuracy, mb.f1_macro AS base_f1_macro, mt.accuracy AS tuned_accuracy,
  mt.f1_macro AS tuned_f1_macro, round_even(mt.accuracy - mb.accuracy, 5) AS accuracy_gain,
  round_even(mt.f1_macro - mb.f1_macro, 5) AS f1_macro_gain FROM mb, mt"""


def comparison(spark, sf, k=TOP_K, grouped=False):
    predicted, _ = both_predictions(spark, sf, k, grouped)
    bundles = M.metrics_bundle(M.prediction_counts(predicted, "category", "predicted_class", ["model"]), ["model"])
    compared = M.compare_metrics(round_metrics(bundles), "base", "tuned")
    return compared.select(
        *[F.bround(c, 5).alias(c) if c.endswith("_gain") else F.col(c) for c in compared.columns]
    )


@query("model_comparison", comparison_sql())
def model_comparison(spark, sf):
    return comparison(spark, sf)


@query("model_comparison_twelve", comparison_sql(eval_top(12)))
def model_comparison_twelve(spark, sf):
    return comparison(spark, sf, 12)


@query("model_comparison_groups", comparison_sql(eval_top(6, P.category_groups())))
def model_comparison_groups(spark, sf):
    return comparison(spark, sf, 6, grouped=True)


# ---- other back ends ---------------------------------------------------------------------------------------------

@query(
    "model_backend",
    f"""WITH lab AS (SELECT * FROM {P.label_rows(LABELS)} AS v(pos, label)),
s AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY
  length(lower(text)) - length(replace(lower(text), left(label, 1), '')) DESC, pos) AS r FROM documents, lab)
SELECT doc_id, label AS predicted_class FROM s WHERE r = 1""",
)
def model_backend(spark, sf):
    def load():
        """A stand-in for a user's model: labels score by how often their first letter occurs.

        It is defined here so that it travels to the Python workers by value.
        """
        def model(texts, labels):
            counts = [[float(t.lower().count(l[0])) for l in labels] for t in texts]
            return counts, [[-x for x in row] for row in counts]

        return model

    scorer = ModelScorer(LABELS, load)
    return K.predict(short(spark, sf), scorer, "text", "doc_id").select("doc_id", "predicted_class")
