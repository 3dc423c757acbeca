"""Fitted models, searches, training logs, clusters."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import clusters as U
from parley.operators import curation as Q
from parley.operators import metrics as M
from parley.operators import nli as N
from parley.operators import training as R
from parley.operators import words as W
from parley.operators.pairs import with_premise_words
from parley.operators.scoring import fit_naive_bayes, naive_bayes_counts
from parley.plans import fixtures as X
from parley.plans import oracle_parts as P
from parley.plans.registry import query
from parley.session import materialize

LABELS = X.CATEGORIES
TRAIN = f"{X.NLI}, train AS (SELECT category, text FROM nli WHERE label = 2 AND split = 'train')"


def train_rows(spark, sf):
    return Q.entailments(X.nli(spark, sf)).where("split = 'train'")


@query(
    "naive_bayes_counts",
    f"""WITH {TRAIN}, {P.naive_bayes_model(LABELS)}
SELECT word, n, {', '.join(f'max(nc) FILTER (WHERE pos = {i}) AS n{i}' for i in range(len(LABELS)))} FROM weights GROUP BY word, n""",
)
def nb_counts(spark, sf):
    return naive_bayes_counts(train_rows(spark, sf), "text", "category", LABELS)


@query(
    "naive_bayes_weights",
    f"""WITH {TRAIN}, {P.naive_bayes_model(LABELS)}
SELECT word, {', '.join(f'round_even(max({k}) FILTER (WHERE pos = {i}), 6) AS {k}{i}' for k in 'ec' for i in range(3))}
FROM weights GROUP BY word""",
)
def nb_weights(spark, sf):
    model = fit_naive_bayes(train_rows(spark, sf), "text", "category", LABELS)
    return model.weights.select("word", *[F.bround(f"{k}{i}", 6).alias(f"{k}{i}") for k in "ec" for i in range(3)])


# ---- logistic regression on pair features ------------------------------------------------------------------------

def pair_rows(spark, sf):
    texts = with_premise_words(Q.entailments(X.nli(spark, sf)), "text")
    rows = N.contradiction_rows(texts, "seq", LABELS, 2)
    features = R.pair_features(rows, "text", "hypothesis")
    return materialize(features.select("seq", "pos", "split", "labels", "features"), "pair-features")


ENTAILED = "(SELECT count(*) FROM nli WHERE label = 2 AND split = '{}')"


@query(
    "logistic_predictions",
    f"WITH {X.NLI} SELECT 3 * {ENTAILED.format('test')} AS rows, 3 * {ENTAILED.format('test')} AS known_classes, "
    "true AS better_than_chance",
)
def logistic_predictions(spark, sf):
    """Predictions on the test rows: as many as rows, of known classes, right more often than the larger class is."""
    rows = pair_rows(spark, sf)
    model = R.fit_logistic(rows.where("split = 'train'"))
    out = model.transform(rows.where("split = 'test'"))
    right = F.avg((F.col("prediction") == F.col("labels")).cast("double"))
    return out.agg(
        F.count("*").alias("rows"), F.count_if(F.col("prediction").isin(0.0, 1.0, 2.0)).alias("known_classes"),
        (right >= 0.5).alias("better_than_chance"),
    )


@query("training_history", "SELECT true AS starts_at_zero, true AS never_rises, true AS falls")
def training_history(spark, sf):
    """The loss of each iteration: numbered from 0, never rising, lower in the end."""
    log = R.training_history(R.fit_logistic(pair_rows(spark, sf).where("split = 'train'")), "logistic")
    before = F.lag("value").over(Window.partitionBy("run_id").orderBy("step"))
    steps = log.withColumn("rise", F.coalesce(F.col("value") - before, F.lit(0.0)))
    return steps.agg(
        (F.min("step") == 0).alias("starts_at_zero"), (F.max("rise") <= 1e-9).alias("never_rises"),
        (F.min_by("value", F.col("step")) > F.max_by("value", F.col("step"))).alias("falls"),
    )


@query("settings_search", "SELECT 3 AS trials, 3 AS in_range, true AS best_is_a_trial")
def settings_search(spark, sf):
    rows = pair_rows(spark, sf).where("split = 'train'")
    trials = R.search_settings(rows, [{"regParam": 0.1}, {"regParam": 0.01}, {"regParam": 0.001}])
    best = M.best_run(trials, "eval_accuracy").select(F.col("run_id").alias("best"))
    return trials.join(F.broadcast(best), F.col("run_id") == F.col("best"), "left").agg(
        F.count("*").cast("int").alias("trials"), F.count_if(F.col("value").between(0, 1)).cast("int").alias("in_range"),
        (F.count("best") == 1).alias("best_is_a_trial"),
    )


# ---- training logs -----------------------------------------------------------------------------------------------

LOG = """log AS (SELECT d.lang AS run_id, d.doc_id % 20 AS step, avg(CAST(l.toxic AS DOUBLE)) AS value
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang, d.doc_id % 20)"""


def log(spark, sf):
    """A log derived from the labels: one run per language, one step per residue of the document id."""
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    rows = docs.join(X.table(spark, sf, "labels"), "doc_id")
    return rows.groupBy(F.col("lang").alias("run_id"), (F.col("doc_id") % 20).alias("step")).agg(
        F.avg(F.col("toxic").cast("double")).alias("value")
    ).withColumn("epoch", F.col("step") / 10.0).withColumn("metric", F.lit("eval_toxicity"))


def best_sql(direction: str) -> str:
    return f"WITH {LOG} SELECT run_id, step, round_even(value, 6) AS value FROM log ORDER BY value {direction}, step, run_id LIMIT 1"


@query("best_run_highest", best_sql("DESC"))
def best_run_highest(spark, sf):
    best = M.best_run(log(spark, sf), "eval_toxicity")
    return best.select("run_id", "step", F.bround("value", 6).alias("value"))


@query("best_run_lowest", best_sql("ASC"))
def best_run_lowest(spark, sf):
    best = M.best_run(log(spark, sf), "eval_toxicity", greater_is_better=False)
    return best.select("run_id", "step", F.bround("value", 6).alias("value"))


@query(
    "prefixed_metrics",
    """SELECT round_even(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 6) AS eval_accuracy, count(*) AS eval_n FROM labels""",
)
def prefixed_metrics(spark, sf):
    labels = X.table(spark, sf, "labels")
    bundle = M.metrics_bundle(M.prediction_counts(labels, "quality", "toxic"))
    return M.prefix_metrics(bundle.select(F.bround("accuracy", 6).alias("accuracy"), "n"))


@query(
    "label_agreement",
    f"""WITH pred AS (SELECT quality AS true_class, toxic AS predicted_class FROM labels), {P.class_table()} {P.BUNDLE}""",
)
def label_agreement(spark, sf):
    bundle = M.metrics_bundle(M.prediction_counts(X.table(spark, sf, "labels"), "quality", "toxic"))
    return bundle.select("n", *[F.bround(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])


def correlation_state(rows):
    """Counts of true positives, true negatives, false positives and false negatives."""
    true, predicted = rows["quality"] == 1, rows["toxic"] == 1
    return [(true & predicted).sum(), (~true & ~predicted).sum(), (~true & predicted).sum(), (true & ~predicted).sum()]


def matthews(state) -> float:
    tp, tn, fp, fn = state
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / below ** 0.5 if below else 0.0


MATTHEWS = M.UserMetric("matthews", ["quality", "toxic"], correlation_state, matthews)


@query(
    "user_metric_by_group",
    """WITH c AS (SELECT d.lang, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS DOUBLE) AS fn
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang)
SELECT lang, 'matthews' AS metric, round_even(coalesce((tp * tn - fp * fn)
  / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS value FROM c""",
)
def user_metric_by_group(spark, sf):
    """A metric that a user writes, the correlation of two labels, for the documents of each language."""
    rows = X.table(spark, sf, "labels").join(X.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return M.user_metric(rows, MATTHEWS, ["lang"]).withColumn("value", F.bround("value", 9))


# ---- clusters ----------------------------------------------------------------------------------------------------

def embedding_vectors(spark, sf):
    return U.array_vectors(X.table(spark, sf, "embeddings"), "embedding")


def nearest_is_own(model) -> Column:
    """Whether the assigned centre is the nearest one, said without the model's own prediction."""
    centers = [F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()]

    def distance(center: Column) -> Column:
        return F.aggregate(F.zip_with("point", center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    distances = F.array(*[distance(c) for c in centers])
    return F.get(distances, F.col("cluster") - 1) <= F.array_min(distances) + 1e-9


@query(
    "embedding_clusters",
    "SELECT count(*) AS vectors, 5 AS clusters, true AS ids_in_range, true AS nearest, true AS cheaper_than_two FROM embeddings",
)
def embedding_clusters(spark, sf):
    """What clusters must satisfy: ids 1..k, each vector nearest to its own centre, a lower cost than two clusters."""
    vectors = embedding_vectors(spark, sf)
    model = U.fit_kmeans(vectors, 5)
    rows = U.clusters_of(vectors, model).withColumn("point", F.col("embedding").cast("array<double>"))
    cheaper = model.summary.trainingCost < U.kmeans_cost(vectors, 2)
    return rows.agg(
        F.count("*").alias("vectors"), F.countDistinct("cluster").cast("int").alias("clusters"),
        F.min(F.col("cluster").between(1, 5)).alias("ids_in_range"), F.min(nearest_is_own(model)).alias("nearest"),
        F.lit(cheaper).alias("cheaper_than_two"),
    )


def projection_facts(rows, *more: Column):
    """Components are centred, uncorrelated and ordered by variance."""
    return rows.agg(
        F.count("*").alias("rows"),
        ((F.abs(F.avg("pc1")) < 1e-6) & (F.abs(F.avg("pc2")) < 1e-6)).alias("centred"),
        (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
        (F.var_samp("pc1") >= F.var_samp("pc2")).alias("ordered"),
        *more,
    )


PROJECTION = "count(*) AS rows, true AS centred, true AS uncorrelated, true AS ordered"


@query("embedding_components", f"SELECT {PROJECTION} FROM embeddings")
def embedding_components(spark, sf):
    return projection_facts(U.pca_2d(embedding_vectors(spark, sf)))


def english(spark, sf):
    return X.documents(spark, sf).where("lang = 'en'").select("doc_id", "text")


def stemmed_english(spark, sf, excluded=T.CORPUS_EXCLUDED):
    return W.clean_stemmed_column(english(spark, sf), "doc_id", "text", excluded)


@query(
    "topic_clusters",
    "SELECT count(*) AS documents, count(DISTINCT doc_id) AS distinct_documents, true AS ids_in_range FROM documents WHERE lang = 'en'",
)
def topic_clusters(spark, sf):
    out = U.topic_clusters(stemmed_english(spark, sf), "doc_id", "clean_text", 5)
    return out.agg(F.count("*").alias("documents"), F.countDistinct("doc_id").alias("distinct_documents"),
                   F.min(F.col("cluster").between(1, 5)).alias("ids_in_range"))


def cluster_words_sql(excluded: list[str], prefix: bool) -> str:
    kept = f"word NOT IN {X.sql_in([*T.STOP_WORDS, *excluded])}" + (" AND NOT starts_with(word, 'name_')" if prefix else "")
    return f"""WITH t AS (SELECT unnest({P.words('text')}) AS word FROM documents WHERE lang = 'en')
SELECT word, count(*) AS frequency FROM t WHERE {kept} GROUP BY word ORDER BY frequency DESC, word LIMIT 40"""


def words_by_cluster(spark, sf, k, corpus_excluded, excluded, prefix):
    """Word counts of each cluster of stemmed texts; the counted words are those of the texts as they are."""
    clusters = U.topic_clusters(stemmed_english(spark, sf, corpus_excluded), "doc_id", "clean_text", k)
    return words_in_clusters(spark, sf, clusters, excluded, prefix)


def words_in_clusters(spark, sf, clusters, excluded, prefix):
    """Word counts of each cluster of a table (doc_id, cluster)."""
    return W.word_counts(english(spark, sf).join(clusters, "doc_id"), "text", ["cluster"], excluded, prefix=prefix)


def words_by_seven(spark, sf):
    """Seven clusters with the short word list of that analysis, which keeps masked names."""
    return words_by_cluster(spark, sf, 7, T.TOPIC_EXCLUDED, T.TOPIC_EXCLUDED, None)


def words_by_five(spark, sf):
    return words_by_cluster(spark, sf, 5, T.CORPUS_EXCLUDED, T.CLUSTER_EXCLUDED, T.MASKED_NAME_PREFIX)


def words_over_clusters(counts):
    """Word counts per cluster, added up again: each document is in one cluster, so they are the counts of the corpus."""
    return W.top_words(counts.groupBy("word").agg(F.sum("frequency").alias("frequency")), 40)


@query("top_words_by_cluster", cluster_words_sql(T.TOPIC_EXCLUDED, False))
def top_words_by_cluster(spark, sf):
    return words_over_clusters(words_by_seven(spark, sf))


@query("top_words_by_five_clusters", cluster_words_sql(T.CLUSTER_EXCLUDED, True))
def top_words_by_five_clusters(spark, sf):
    return words_over_clusters(words_by_five(spark, sf))


GIVEN_CLUSTERS = f"""WITH t AS (SELECT doc_id % 7 + 1 AS cluster, unnest({P.words('text')}) AS word FROM documents WHERE lang = 'en'),
counts AS (SELECT cluster, word, count(*) AS frequency FROM t WHERE word NOT IN {X.sql_in([*T.STOP_WORDS, *T.TOPIC_EXCLUDED])}
  GROUP BY cluster, word)
SELECT CAST(cluster AS INT) AS cluster, word, frequency FROM counts
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY frequency DESC, word) <= 10"""


@query("words_of_given_clusters", GIVEN_CLUSTERS)
def words_of_given_clusters(spark, sf):
    """The most frequent words of each of seven clusters that a table of documents gives."""
    given = english(spark, sf).select("doc_id", (F.col("doc_id") % 7 + 1).cast("int").alias("cluster"))
    counts = words_in_clusters(spark, sf, given, T.TOPIC_EXCLUDED, None)
    return W.top_words(counts, 10, ["cluster"]).select("cluster", "word", "frequency")


# No SQL states fitted clusters; tests compare the words of each cluster with plain counts.

@query("words_of_each_cluster")
def words_of_each_cluster(spark, sf):
    """The most frequent words of each of the seven clusters."""
    return W.top_words(words_by_seven(spark, sf), 10, ["cluster"]).select("cluster", "word", "frequency")


@query("words_of_each_of_five_clusters")
def words_of_each_of_five_clusters(spark, sf):
    return W.top_words(words_by_five(spark, sf), 20, ["cluster"]).select("cluster", "word", "frequency")


def topic_projection(spark, sf, k, excluded):
    """Stemmed texts, TF-IDF, k clusters and the projection of the topic vectors on two components."""
    vectors = U.topic_vectors(stemmed_english(spark, sf, excluded), "doc_id", "clean_text")
    placed = U.pca_2d(U.kmeans_clusters(vectors, k)).select("doc_id", "cluster", "pc1", "pc2")
    return projection_facts(placed, F.countDistinct("cluster").cast("int").alias("clusters"))


@query("topic_flow", f"SELECT {PROJECTION}, 5 AS clusters FROM documents WHERE lang = 'en'")
def topic_flow(spark, sf):
    return topic_projection(spark, sf, 5, T.CORPUS_EXCLUDED)


@query("topic_flow_of_seven", f"SELECT {PROJECTION}, 7 AS clusters FROM documents WHERE lang = 'en'")
def topic_flow_of_seven(spark, sf):
    return topic_projection(spark, sf, 7, T.TOPIC_EXCLUDED)
