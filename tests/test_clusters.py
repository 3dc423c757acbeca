"""Topic clusters and their words."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from conftest import SF
from parley.functions import text as T
from parley.operators import clusters as U
from parley.plans import learning_queries as L

QUERIES = entry.queries()
WORDS = [("words_of_each_cluster", 7, 10, T.TOPIC_EXCLUDED, T.TOPIC_EXCLUDED, False),
         ("words_of_each_of_five_clusters", 5, 20, T.CORPUS_EXCLUDED, T.CLUSTER_EXCLUDED, True)]


@pytest.mark.parametrize("name,k,n,corpus_excluded,excluded,prefix", WORDS)
def test_words_of_each_cluster_are_counted_in_its_texts(spark, name, k, n, corpus_excluded, excluded, prefix):
    stemmed = L.stemmed_english(spark, SF, corpus_excluded)
    cluster = dict(U.topic_clusters(stemmed, "doc_id", "clean_text", k).collect())
    want = defaultdict(Counter)
    for doc, words in L.english(spark, SF).select("doc_id", T.words("text")).collect():
        want[cluster[doc]].update(
            w for w in words if w not in {*T.STOP_WORDS, *excluded} and not (prefix and w.startswith("name_")))
    got = defaultdict(list)
    for row in QUERIES[name](spark, SF).collect():
        got[row.cluster].append((row.word, row.frequency))
    assert len(got) == k
    for c, counts in want.items():
        assert sorted(got[c]) == sorted(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n])


def test_clusters_are_of_stemmed_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(U, "topic_clusters", lambda df, *a, f=U.topic_clusters: seen.append(df) or f(df, *a))
    for name in ("topic_clusters", "words_of_each_cluster", "words_of_each_of_five_clusters"):
        QUERIES[name](spark, SF)
    want = dict(L.stemmed_english(spark, SF).collect())
    assert dict(seen[0].collect()) == want and dict(seen[2].collect()) == want
    assert dict(seen[1].collect()) == dict(L.stemmed_english(spark, SF, T.TOPIC_EXCLUDED).collect())


@pytest.mark.parametrize("k,excluded", [(5, T.CORPUS_EXCLUDED), (7, T.TOPIC_EXCLUDED)])
def test_topic_flow_uses_every_term_up_to_the_reference_limit(spark, monkeypatch, k, excluded):
    name = {5: "topic_flow", 7: "topic_flow_of_seven"}[k]
    seen = []
    rows = spark.createDataFrame([(i, f"a{i} " + " ".join(f"term{j}x" for j in range(i * 7, i * 7 + 8))) for i in range(120)],
                                 "doc_id long, clean_text string")
    monkeypatch.setattr(L, "stemmed_english", lambda spark, sf, words: seen.append(words) or rows)
    monkeypatch.setattr(U, "pca_2d", lambda df: seen.append(df.first().features.size) or df.selectExpr("*", "doc_id + 0D pc1", "pow(doc_id, 2) pc2"))
    out = QUERIES[name](spark, SF).first()
    assert seen == [excluded, 841 + 120] and out.rows == 120 and out.clusters == k
