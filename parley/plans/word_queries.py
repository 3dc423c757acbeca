"""Word counts, cleaning, TF-IDF, language detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.stemming import stemmed_words
from parley.operators import language as G
from parley.operators import words as W
from parley.plans import fixtures as X
from parley.plans import oracle_parts as P
from parley.plans.classification_queries import label_pairs, pair_sql
from parley.plans.registry import query

STOP = X.sql_in(T.STOP_WORDS)


def kept_words(excluded, alias="word") -> str:
    return f"{alias} NOT IN {STOP} AND {alias} NOT IN {X.sql_in(excluded)} AND NOT starts_with({alias}, 'name_')"


@query(
    "word_counts",
    f"""WITH t AS (SELECT unnest({P.words('text')}) AS word FROM documents)
SELECT word, count(*) AS frequency FROM t WHERE {kept_words(T.CORPUS_EXCLUDED)} GROUP BY word""",
)
def word_counts(spark, sf):
    return W.word_counts(X.documents(spark, sf), "text")


@query(
    "top_words",
    f"""WITH t AS (SELECT unnest({P.words('text')}) AS word FROM documents)
SELECT word, count(*) AS frequency FROM t WHERE {kept_words(T.CORPUS_EXCLUDED)} GROUP BY word
ORDER BY frequency DESC, word LIMIT 25""",
)
def top_words(spark, sf):
    return W.top_words(W.word_counts(X.documents(spark, sf), "text"), 25)


@query(
    "word_counts_excluding_names",
    f"""WITH t AS (SELECT unnest({P.words("replace(text, 'the', 'name_1')")}) AS word FROM documents)
SELECT word, count(*) AS frequency FROM t WHERE word NOT IN ('on', 'la', 'der') AND NOT starts_with(word, 'name_')
GROUP BY word ORDER BY frequency DESC, word LIMIT 40""",
)
def word_counts_excluding_names(spark, sf):
    masked = X.documents(spark, sf).withColumn("text", F.replace("text", F.lit("the"), F.lit("name_1")))
    counts = W.word_counts(masked, "text", excluded=["on", "la", "der"], stop_words=[])
    return W.top_words(counts, 40)


def grouped_top(n: int) -> str:
    return f"""c AS (SELECT g, word, count(*) AS frequency FROM t WHERE {{kept}} GROUP BY g, word),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY frequency DESC, word) AS rank FROM c)
SELECT g AS {{name}}, word, frequency, CAST(rank AS INT) AS rank FROM r WHERE rank <= {n}"""


@query(
    "top_words_by_language",
    f"WITH t AS (SELECT lang AS g, unnest({P.words('text')}) AS word FROM documents), "
    + grouped_top(20).format(kept=kept_words(T.CLUSTER_EXCLUDED), name="lang"),
)
def top_words_by_language(spark, sf):
    counts = W.word_counts(X.documents(spark, sf), "text", ["lang"], T.CLUSTER_EXCLUDED)
    return W.top_words(counts, 20, ["lang"])


@query(
    "top_words_by_label_pair",
    f"""WITH {pair_sql()},
t AS (SELECT rq.label || '-' || tl.label AS g, unnest({P.words('d.text')}) AS word
  FROM documents d JOIN rq ON rq.id = d.doc_id JOIN tl ON tl.id = d.doc_id),
{grouped_top(25).format(kept=kept_words(T.PAIR_EXCLUDED), name='pair')}""",
)
def top_words_by_label_pair(spark, sf):
    pair = F.concat("pred_label_rq", F.lit("-"), "pred_label_tl").alias("pair")
    labelled = label_pairs(spark, sf).select("text", pair)
    return W.top_words(W.word_counts(labelled, "text", ["pair"], T.PAIR_EXCLUDED), 25, ["pair"])


@query(
    "word_counts_per_row",
    f"SELECT doc_id, CAST(len({P.words('text')}) AS INT) AS n_words FROM documents",
)
def word_counts_per_row(spark, sf):
    return X.documents(spark, sf).select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"))


CLEAN = r"lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'), '\p{Nd}+', '', 'g'))"


@query("cleaned_texts", f"SELECT doc_id, {CLEAN} AS clean_text FROM documents")
def cleaned_texts(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.clean(F.col("text")).alias("clean_text"))


@query(
    "cleaned_texts_without_stop_words",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split({CLEAN}, ' '),
  lambda x: x <> '' AND NOT list_contains({X.sql_list([*T.STOP_WORDS, *T.CORPUS_EXCLUDED])}, x)) AS ws FROM documents)
SELECT doc_id, array_to_string(ws, ' ') AS clean_text FROM w""",
)
def cleaned_texts_without_stop_words(spark, sf):
    out = W.clean_column(X.documents(spark, sf), "text", T.CORPUS_EXCLUDED)
    return out.select("doc_id", "clean_text")


@query(
    "cleaned_texts_stemmed",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split({CLEAN}, ' '),
  lambda x: x <> '' AND NOT list_contains({X.sql_list([*T.STOP_WORDS, *T.CORPUS_EXCLUDED])}, x)) AS ws FROM documents)
SELECT doc_id, len(ws) AS words, true AS no_longer FROM w""",
)
def cleaned_texts_stemmed(spark, sf):
    """Stemmed texts have as many words as cleaned ones and are no longer; tests hold a table of known stems."""
    docs = X.documents(spark, sf).select("doc_id", "text")
    both = W.clean_column(docs, "text", T.CORPUS_EXCLUDED, "plain").withColumn("stemmed", stemmed_words("plain"))
    words = F.size(F.filter(F.split("stemmed", " "), lambda w: w != "")).cast("bigint")
    # step 1b may add an e, so the comparison allows one letter a word
    return both.select("doc_id", words.alias("words"),
                       (F.length("stemmed") <= F.length("plain") + words).alias("no_longer"))


FEATURES = 5000


@query(
    "vocabulary",
    f"""WITH t AS (SELECT doc_id, unnest({P.words('text')}) AS term FROM documents)
SELECT term, count(*) AS frequency, count(DISTINCT doc_id) AS doc_frequency FROM t GROUP BY term
ORDER BY frequency DESC, term LIMIT {FEATURES}""",
)
def vocabulary(spark, sf):
    return W.vocabulary(X.documents(spark, sf), "text", FEATURES)


@query(
    "tfidf",
    f"""WITH t AS (SELECT doc_id, unnest({P.words('text')}) AS term FROM documents),
v AS (SELECT term, count(*) AS f, count(DISTINCT doc_id) AS df FROM t GROUP BY term ORDER BY f DESC, term LIMIT {FEATURES}),
c AS (SELECT t.doc_id, t.term, count(*) AS tf, any_value(v.df) AS df FROM t JOIN v ON v.term = t.term GROUP BY t.doc_id, t.term),
w AS (SELECT *, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c)
SELECT doc_id, term, tf, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""",
)
def tfidf(spark, sf):
    return W.tfidf(X.documents(spark, sf), "doc_id", "text", FEATURES).withColumn("tfidf", F.bround("tfidf", 6))


LETTERS = r"' ' || regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') || ' '"
GRAMS = P.TRIGRAMS.format(t="s")
PROFILE = f"""s AS (SELECT doc_id, lang, {LETTERS} AS s FROM documents),
g AS (SELECT doc_id, lang, unnest({GRAMS}) AS gram FROM s),
n AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 5 <> 0 GROUP BY lang, gram),
top AS (SELECT DISTINCT gram FROM n),
lg AS (SELECT unnest({X.sql_list(X.LANGS)}) AS lang, unnest(range(0, {len(X.LANGS)})) AS pos),
c AS (SELECT top.gram, lg.lang, lg.pos, coalesce(n.n, 0) AS n FROM top CROSS JOIN lg
  LEFT JOIN n ON n.gram = top.gram AND n.lang = lg.lang),
wt AS (SELECT *, ln((n + 1) / (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))) AS w FROM c)"""


def profile(spark, sf):
    known = X.documents(spark, sf).where("doc_id % 5 <> 0")
    return G.fit_language_profile(known, "text", "lang", X.LANGS)


@query(
    "language_profile",
    f"WITH {PROFILE} SELECT gram, {', '.join(f'round_even(max(w) FILTER (WHERE pos = {i}), 6) AS w{i}' for i in range(4))} "
    "FROM wt GROUP BY gram",
)
def language_profile(spark, sf):
    return profile(spark, sf).weights.select("gram", *[F.bround(f"w{i}", 6).alias(f"w{i}") for i in range(4)])


@query(
    "detected_languages",
    f"""WITH {PROFILE},
tf AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY doc_id, gram),
sc AS (SELECT tf.doc_id, wt.lang, wt.pos, round_even(sum(tf.tf * wt.w), 6) AS sc
  FROM tf JOIN wt ON wt.gram = tf.gram GROUP BY tf.doc_id, wt.lang, wt.pos),
b AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, pos) AS r FROM sc) WHERE r = 1)
SELECT d.doc_id, d.lang, b.lang AS detected_language FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""",
)
def detected_languages(spark, sf):
    docs = X.documents(spark, sf).select("doc_id", "text", "lang")
    return G.detect_language(docs, profile(spark, sf), "text", "doc_id")
