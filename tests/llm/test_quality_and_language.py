"""Quality rules, language filters and toxicity: brute force, held-out accuracy, edge cases."""

import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.llm import bpe, language_id, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 997}" for k in range(120_000))


def frame(spark, texts, lang="en"):
    rows = [(k, t, lang, None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def counted(text):
    """Base counts of the contract, said plainly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else set()
    covered = {k + d for k, w in enumerate(windows) if w in many for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a b c a b c", "x\n\nx\nx ", "é 😀\x0bü\x0cß\x85z", "a a a a a a"]
    texts += ["".join(rng.choices("ab \n#|é", k=rng.randint(0, 120))) for _ in range(200)]
    got = {r.doc_id: r for r in quality.judged(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_lines_are_removed_and_poor_documents_rejected(spark):
    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(8))
    nav = "Home | About | Contact | Login"
    licence = "Licensed under the Apache License, Version 2.0."
    shout = "BUY!! NOW!! CHEAP!!"
    noise = "\n".join(" ".join(f"n{i}y{j}###" for j in range(12)) for i in range(8))
    got = {r.doc_id: r for r in quality.judged(frame(
        spark, [prose, "\n".join([prose, nav, licence, shout, prose.split("\n")[0]]), noise, prose + "\n" + noise])).collect()}
    assert got[0].kept and got[0].clean_text == prose
    assert got[1].kept and got[1].clean_text == prose and got[1].n_dup_lines == 1
    assert not got[2].base_failed and not got[2].kept and got[2].clean_text == ""
    assert not got[3].kept


def test_quality_edge_cases(spark):
    docs = frame(spark, [LONG, None, LONG]).selectExpr("*", "1 AS n_words", "'x' AS Kept", "2 AS in_text")
    rows = quality.judged(docs).collect()
    assert [r.n_words for r in rows] == [120_000, 0, 120_000]
    assert sorted(c.lower() for c in quality.judged(docs).columns).count("kept") == 1
    cleaned = quality.cleaned_documents(docs)
    assert cleaned.columns == docs.columns and not quality.judged(frame(spark, [])).collect()
    assert quality.cleaned_documents(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def tongues():
    """Texts of two invented languages."""
    rng = random.Random(11)
    stems = {"aa": ["tra", "lo", "min", "que", "sol"], "bb": ["sch", "wer", "ung", "keit", "ach"]}

    def text(lang, n=60):
        return " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(n))

    return text


def test_language_is_learned_and_held_out_rows_are_right(spark, tongues):
    train = spark.createDataFrame([(k, tongues(x), x) for k in range(80) for x in ("aa", "bb")]
                                  + [(900, "no label", None)], "doc_id long, text string, lang string")
    filters = language_id.learned(train)
    assert filters.names == ["aa", "bb"]
    tests = [(k, tongues(x, 30), x) for k in range(40) for x in ("aa", "bb")]
    got = language_id.identified(spark.createDataFrame(tests, "doc_id long, text string, truth string"), filters).collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 79
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, tongues):
    train = spark.createDataFrame([(k, tongues(x), x) for k in range(30) for x in ("aa", "bb")] + [(None, None, "aa")],
                                  "doc_id long, text string, lang string")
    filters = language_id.learned(train)
    texts = [None, "", "123 !?", "ж", "tralo", tongues("bb", 60_000), "tralo", "tralo"]
    rows = language_id.identified(frame(spark, texts).selectExpr("*", "5 AS score"), filters).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert rows[3].lang_pred in ("aa", "bb") and rows[3].score == 0.0
    assert rows[5].lang_pred == "bb" and rows[4].lang_pred == rows[6].lang_pred == rows[7].lang_pred
    nothing = language_id.learned(frame(spark, ["a"], None))
    assert {r.lang_pred for r in language_id.identified(frame(spark, ["a b", None]), nothing).collect()} == {"und"}
    assert language_id.identified(frame(spark, []), filters).count() == 0


def test_floors_come_from_all_labelled_rows(spark, tongues):
    """One poorly covered text among 8,000 of its language sets the floor, whatever a sample would draw."""
    rows = spark.range(8000).selectExpr("id doc_id", "'aa' lang")
    left_out = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(language_id.PARTS)) == 0
    undrawn = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) > 0.9 * (1 << 30)
    odd = rows.filter(left_out & undrawn).first()["doc_id"]
    text = F.when(F.col("doc_id") == odd, tongues("aa", 3) + " zzzz qqqq xxxx").otherwise(tongues("aa", 40))
    docs = rows.withColumn("text", text)
    filters = language_id.learned(docs.filter(~left_out), per_language=None)
    covered = language_id.identified(docs.filter(left_out), filters).agg(F.min("coverage"), F.max("coverage")).first()
    assert covered[0] < 0.9 * covered[1]
    assert language_id.coverage_floors(docs) == {"aa": language_id.FLOOR * covered[0]}


def test_learning_from_all_rows_counts_each_document_once(spark, tongues):
    docs = [(k, tongues(x) + " " + tongues(x), x) for k in range(40) for x in ("aa", "bb")]
    pairs = pd.concat(language_id._counted(iter([pd.DataFrame(
        {"language": [int(x == "bb") for _, _, x in docs], "text": [t for _, t, _ in docs]})] * 2)))
    expected = {}
    for _, text, x in docs:
        for size in language_id.SIZES:
            for gram in set(language_id.grams([text], size)[0].tolist()):
                at = (gram & (1 << language_id.GRAM_BITS) - 1, int(x == "bb"))
                expected[at] = expected.get(at, 0) + 2
    assert {(g, x): n for g, x, n in pairs.itertuples(index=False)} == expected


def test_many_languages_take_several_mask_words(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = {f"l{k:03}": letters[k % 26] + letters[k // 26] for k in range(70)}
    train = spark.createDataFrame([(k, f"{s}{s}{s} {s}{s}", x) for x, s in langs.items() for k in range(4)],
                                  "doc_id long, text string, lang string")
    filters = language_id.learned(train)
    assert filters.masks.shape[1] == 2
    got = language_id.identified(spark.createDataFrame([(s * 3, x) for x, s in langs.items()], "text string, truth string"),
                                 filters).collect()
    assert sum(r.lang_pred == r.truth for r in got) >= 65


def test_language_popcounts_equal_a_plain_count(spark, tongues):
    filters = language_id.learned(spark.createDataFrame(
        [(k, tongues(x), x) for k in range(30) for x in ("aa", "bb")], "doc_id long, text string, lang string"))
    texts = [tongues("aa", 5), "x", tongues("bb", 9)]
    total, found = language_id.Judge(filters).counts(texts)
    for k, text in enumerate(texts):
        padded = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
        assert total[k] == sum(max(0, len(padded) - n + 1) for n in language_id.SIZES)
        assert (found[k] <= total[k]).all()


def labelled(spark, n=400):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "ste", "vo", "ti")]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(6)]
        if toxic:
            sentences[rng.randrange(6)] += " " + rng.choice(["you grumbler", "zorkish", "zorkard", "grumbler"])
            sentences[rng.randrange(6)] += " grumbler"
        docs.append((k, ". ".join(sentences)))
        labels.append((k, 1, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.learned(docs, labels.filter("doc_id % 5 != 0"))
    got = toxicity.scored(docs, model).join(labels, "doc_id").filter("doc_id % 5 = 0").collect()
    assert all(r.predicted == r.toxic for r in got) and all(0 <= r.score <= 1 for r in got)


def test_composed_transducers():
    grammar, S = toxicity.grammar(), toxicity
    marks = {(): None, (S.INSULT,): "plain", (S.TARGET, S.INSULT): "targeted", (S.NEGATION, S.INSULT): "negated",
             (S.INSULT, S.NEGATION): "plain", (S.REPORT, S.TARGET, S.INSULT): "reported",
             (S.THREAT, S.TARGET): "threat", (S.THREAT,): None, (S.NEGATION, S.TARGET): None, (S.WEAK,): "weak"}
    for symbols, mark in marks.items():
        assert S.mark_of(grammar.run(list(symbols))) == mark
    scorer = S.Scorer(["grumbler$", "zork"], [])
    assert scorer.counts("Grumbler. You zorkish fool, he said: not a grumbler!\nfine") == [1, 1, 1, 0, 0, 0]
    assert scorer.counts(None) == [0] * 6


def test_toxicity_edge_cases(spark):
    docs, labels = labelled(spark, 200)
    empty = toxicity.learned(docs, labels.limit(0))
    assert not empty.patterns
    model = toxicity.learned(docs.union(spark.createDataFrame([(None, None), (1, None)], docs.schema)),
                             labels.union(spark.createDataFrame([(None, None, 1), (3, 1, None), (4, 0, 1)], labels.schema)))
    odd = frame(spark, [None, "", LONG, "grumbler", "grumbler"]).selectExpr("*", "'x' AS SCORE", "1 AS toxicity_found")
    rows = toxicity.scored(odd, model).orderBy("doc_id").collect()
    assert rows[0].score == rows[1].score and rows[3].score == rows[4].score > rows[0].score
    assert toxicity.scored(frame(spark, []), model).count() == 0


def test_language_reads_an_arrow_batch_in_slices(monkeypatch):
    texts = [f"some text number {k} with {'more ' * (k % 7)}words" for k in range(3 * language_id.SLICE + 5)]
    batch = pa.RecordBatch.from_pydict({"language": pa.array([k % 2 for k in range(len(texts))], pa.int32()), "text": texts})
    whole, sizes = pd.concat(language_id._counted(iter([batch.to_pandas()]))), []
    counted = language_id._counted
    monkeypatch.setattr(language_id, "_counted", lambda frames: counted(sizes.append(len(f)) or f for f in frames))
    parts = pa.Table.from_batches(language_id._counted_slices(iter([batch]))).to_pandas()
    assert max(sizes) <= language_id.SLICE and sum(sizes) == len(texts)
    keys = ["gram", "language"]
    assert parts.groupby(keys)["documents"].sum().equals(whole.groupby(keys)["documents"].sum())


def test_bpe_reads_an_arrow_batch_in_slices(monkeypatch):
    read = []

    class Texts:
        def __len__(self):
            return 1000

        def slice(self, start, length):
            read.append(length)
            return pa.array([f"{k} " * 300 if k % 5 else None for k in range(start, min(start + length, 1000))])

    found = list(bpe._in_batches(Texts()))
    assert sum(map(len, found)) == 1000 and len(found) > 1 and max(read) <= bpe.SLICE
    assert [t for part in found for t in part][:2] == ["", "1 " * 300]
