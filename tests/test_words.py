import math
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.stemming import add_stems, stem_word, stemmed_words
from parley.operators import language as G
from parley.operators import words as W

# Published sample pairs of the Porter2 algorithm.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die news news proceed proceed hopping hop hoping hope happy happi say say cry cri by by generate generat
generously generous""".split()


def test_stop_words_are_the_public_list(spark):
    assert sorted(T.STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame(pairs, "word string, expected string")
    wrong = add_stems(df).where("stem <> expected").collect()
    assert [tuple(r) for r in wrong] == []


def test_stems_inside_texts_equal_stems_of_words(spark):
    made = [a + b + c for a in ("hop", "gener", "y", "try", "fl", "commun") for b in ("", "i", "ing", "ee", "iz")
            for c in ("ed", "ation", "ly", "ness", "s", "ies", "al", "ive", "ousli", "e", "ll", "")]
    words = sorted({*STEMS[::2], *made, "skis", "inning", "logi", "été", "name_"} - {""})
    df = add_stems(spark.createDataFrame([(w,) for w in words], "word string"))
    wrong = [(r["word"], r["stem"], stem_word(r["word"])) for r in df.collect() if r["stem"] != stem_word(r["word"])]
    assert wrong == []


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["The cat sat. The CAT ran!", "name_1 likes a cat", "dogs and cats", "", "été été 42"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_counts(docs):
    got = dict(W.word_counts(docs, "text", excluded=["ran"]).collect())
    assert got == {"cat": 3, "sat": 1, "likes": 1, "dogs": 1, "cats": 1, "été": 2, "42": 1}


def test_top_words_per_group(docs):
    counts = W.word_counts(docs.withColumn("g", F.col("id") % 2), "text", ["g"], excluded=[])
    got = [tuple(r) for r in W.top_words(counts, 1, ["g"]).select("g", "word", "frequency").orderBy("g").collect()]
    assert got == [(0, "cat", 2), (1, "cat", 1)] or got == [(0, "été", 2), (1, "cat", 1)]


def test_tfidf_against_brute_force(docs):
    rows = docs.collect()
    import re

    bags = {r["id"]: Counter(re.findall(r"\w\w+", r["text"].lower())) for r in rows}
    total = sum(bags.values(), Counter())
    vocab = sorted(total, key=lambda w: (-total[w], w))[:5]
    df = {w: sum(w in b for b in bags.values()) for w in vocab}
    expected = {}
    for key, bag in bags.items():
        weights = {w: bag[w] * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w in vocab if w in bag}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        expected.update({(key, w): x / norm for w, x in weights.items()})
    got = {(r["id"], r["term"]): r["tfidf"] for r in W.tfidf(docs, "id", "text", 5).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-12) for k in got)


def test_stemmed_texts_keep_order_and_empty_rows(docs):
    got = dict(W.clean_stemmed_column(docs, "id", "text").collect())
    assert got == {0: "cat sat cat ran", 1: "name_ like cat", 2: "dog cat", 3: "", 4: "été été"}


def test_language_detection(spark):
    texts = [(i, l, t) for i, (l, t) in enumerate([
        ("en", "the cat is on the mat and the dog is there"), ("fr", "le chat est sur le tapis avec les chiens"),
        ("en", "there is the thing that they think"), ("fr", "les gens sont dans la rue avec le chien"),
    ])]
    known = spark.createDataFrame(texts, "id int, lang string, text string")
    profile = G.fit_language_profile(known, "text", "lang", ["en", "fr"], size=20)
    new = spark.createDataFrame(
        [(0, "The THING is there"), (1, "le chien est dans la rue"), (2, "123 !!"), (3, ""), (4, None)], "id int, text string"
    )
    got = dict(G.detect_language(new, profile, "text", "id").collect())
    assert got == {0: "en", 1: "fr", 2: None, 3: None, 4: None}


def test_tfidf_counts_inside_the_row_and_merges_repeated_keys(spark):
    """Nothing is grouped or shuffled where keys are unique; rows of one key are one document of the matrix."""
    rows = [(1, "aa bb aa"), (2, "bb cc"), (3, None)]
    once = W.tfidf(spark.createDataFrame(rows, "id int, text string"), "id", "text", 5)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange hash" not in plan
    assert {(r["id"], r["term"]): r["tf"] for r in once.collect()} == {(1, "aa"): 2, (1, "bb"): 1, (2, "bb"): 1, (2, "cc"): 1}
    again = W.tfidf(spark.createDataFrame([*rows, (1, "bb")], "id int, text string"), "id", "text", 5).collect()
    assert {(r["id"], r["term"]): r["tf"] for r in again} == {(1, "aa"): 2, (1, "bb"): 2, (2, "bb"): 1, (2, "cc"): 1}
    assert sum(r["tfidf"] ** 2 for r in again if r["id"] == 1) == pytest.approx(1)
    assert W.tfidf(spark.createDataFrame([(1, "")], "id int, text string"), "id", "text", 5).count() == 0


def test_stemming_holds_few_texts_at_once():
    """The strings of a large batch are made slice by slice."""
    texts = pa.array([None, "", *["running horses " * 150] * 5000])
    tracemalloc.start()
    (stemmed,) = stemmed_words.func(iter([texts]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert stemmed[:3].to_pylist() == [None, "", ("run hors " * 150)] and len(stemmed) == len(texts)
    assert peak < 6 << 20


def test_trigrams_are_counted_in_the_task(spark):
    """No row a trigram leaves a task; counts and lists equal plain Python, beyond the basic plane too."""
    texts = [("en", "Abc abcabc 12 d"), ("fr", "\U00010400été été"), ("en", None), ("en", ""), ("xx", "abc"), ("fr", "a")]
    rows = spark.createDataFrame(texts, "lang string, text string")
    counts = G.profile_counts(rows, "text", "lang", ["en", "fr"])
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    plain = [(lang, " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " ") for lang, t in texts if t is not None]
    plain = [(lang, " ".join(["", *t.split(), ""]) if t.strip() else "  ") for lang, t in plain]
    expected = {}
    for lang, t in plain:
        for g in (t[i:i + 3] for i in range(len(t) - 2) if lang != "xx"):
            n = expected.setdefault(g, [0, 0])
            n[lang == "fr"] += 1
    assert {r["gram"]: [r["n0"], r["n1"]] for r in counts.collect()} == expected
    lists = G.trigram_lists(pa.array([t for _, t in plain] + [None])).to_pylist()
    assert lists == [[t[i:i + 3] for i in range(len(t) - 2)] for _, t in plain] + [[]]
