"""Spelling variants and collocations against plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from parley.llm import collocations, spelling
from parley.session import materialize

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- spelling variants -------------------------------------------------------------------------------------------

def plain_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def plain_groups(words):
    around = {w: [o for o in words if near(w, o)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(around[w]), words.get(form[w])))
    return rows


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_texts_equal_plain_python(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs += [(None, "Straße straße STRAßE strasse Zoë"), (7, None), (8, ""), (8, "naïve naïve naive naÏve naives naives naives")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(spelling.variants(table.selectExpr("*", "1 AS word", "2 AS n", "'x' AS id", "0 AS form")))
    assert got == plain_groups(plain_words(docs)) and any(r[1] for r in got)


@pytest.mark.parametrize("symbols", [2, 4, 9])
def test_pairs_do_not_depend_on_the_symbols(spark, monkeypatch, symbols):
    monkeypatch.setattr(spelling, "symbols_for", lambda words: symbols)
    words = ["aaaaa", "aaaa", "aaaab", "baaaa", "aabaa", "abcde", "abde", "abcdde", "abccde", "ßbcde", "ÿbcde", "éé", "é",
             "edcba", "abced", "x y", "x-y", "日本語", "日本"]
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(sorted((r["word"], r["other"]))) for r in spelling.near_pairs(table).collect()]
    assert sorted(got) == sorted({tuple(sorted((a, b))) for a in words for b in words if a < b and near(a, b)})


def test_long_words_meet_by_halves(spark):
    base = "".join("abcdefghij"[i * i % 10] for i in range(60))
    words = {base, base[:48], base[:49], base[1:49], base[:47]}
    for at in (0, 1, 23, 24, 25, 29, 30, 31, 58, 59):
        words |= {base[:at] + "z" + base[at + 1:], base[:at] + base[at + 1:], base[:at] + "y" + base[at:]}
    words |= {base + "x", "q" * 200, "q" * 201, "q" * 202, "q" * 100 + "r" + "q" * 99}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((r["word"], r["other"]))) for r in spelling.near_pairs(table).collect()]
    assert sorted(got) == sorted({tuple(sorted((a, b))) for a in words for b in words if a < b and near(a, b)})


def test_very_long_runs_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "k" * 50_000 + "l" * (i % 2)) for i in range(8)], "doc_id long, text string")
    got = rows_of(spelling.variants(docs))
    assert got == plain_groups(plain_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert spelling.variants(docs.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    words = [("abcde" + "f" * i, 3 * 2 ** (12 - i)) for i in range(12)]
    got = rows_of(spelling.grouped(spark.createDataFrame(words, "word string, n long")))
    assert got == plain_groups(dict(words)) and {r[2] for r in got} == {"abcde"}


# ---- collocations ------------------------------------------------------------------------------------------------

def plain_collocations(docs, longest, min_count, limit):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        around = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i:i + size]] = max(around[p[i:i + size]], a)
        rows = []
        for p, a in candidates.items():
            if 100 * around[p] >= 50 * a:
                continue
            score, k = min((int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_equal_plain_python(spark, monkeypatch, longest):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    docs += [(None, "à la carte, à la carte; À LA CARTE à la carte\tà  la carte"), ("und", "à la carte"), ("en", None),
             ("en", ""), ("en", ".,;:!?\r\n\x0b\x0c"), ("x y", "one two " * 30), (None, "|  | | |"), ("en", "\x1c  \x00 b")]
    table = spark.createDataFrame(docs, "lang string, text string").selectExpr(
        "*", "1 AS w1", "2 AS n", "'x' AS phrase", "0 AS size")
    got = collocations.collocations(table, longest=longest, min_count=3, limit=60)
    assert found(got) == plain_collocations(docs, longest, 3, 60)


def windows(texts, longest, chunk, monkeypatch):
    """Counts of the windows of texts that are scanned in stretches of about ``chunk`` bytes."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    parts = [p for t in texts for p in collocations._stretches(t.encode(), longest)]
    table = collocations.counted(["en"] * len(parts), [t for t, _ in parts], [left for _, left in parts], longest)
    sums = Counter()
    for row in table.to_pylist():
        sums[row["head"], row["last"]] += row["n"]
    return sums, len(parts)


@pytest.mark.parametrize("longest", [2, 3])
def test_stretches_of_long_texts_lose_no_window(monkeypatch, longest):
    texts = ["a b c. d e f  g h\ti, j " * 40, "one" * 50 + " two three " + "four" * 60, "x y z", "", "é è. " * 30, "w " * 101]
    whole, parts = windows(texts, longest, 1 << 20, monkeypatch)
    assert parts == len(texts)
    for chunk in (10, 17, 64, 111):
        cut, more = windows(texts, longest, chunk, monkeypatch)
        assert cut == whole and more > parts


def test_exact_scores_beyond_64_bits(spark):
    a = 10 ** 13
    rows = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long")
    exact = [F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")]
    got = rows.select((exact[0] * exact[0] * F.lit(collocations.SCALE)).alias("top"), (exact[1] * exact[2]).alias("bottom"))
    assert got.select(F.expr("top div bottom")).first()[0] == 1_000_000 * a * a // ((a + 1) * (a + 2))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0


@pytest.mark.parametrize("size", [9, 1 << 30])
def test_window_sums_are_the_same_packed_or_grouped(size):
    """Ids that fit in one number are summed as numbers, wider ones by columns."""
    rng = np.random.default_rng(3)
    keys, rows = ["a", "b", "c"], rng.integers(0, 9, (500, 3)).astype(np.int32)
    sums = collocations._sums(pa.table(dict(zip(keys, rows.T))), keys, [size] * 3)
    found, counts = np.unique(rows, axis=0, return_counts=True)
    assert np.array_equal(np.column_stack([sums[k] for k in keys]), found) and sums["count_all"].to_pylist() == counts.tolist()
    assert not collocations._sums(pa.table(dict(zip(keys, rows[:0].T))), keys, [size] * 3).num_rows


def test_rare_prefixes_are_not_written(spark, monkeypatch):
    """Of prefixes below the least count only the words they start with are written, not a row each."""
    rows, write = {}, collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, name: rows.setdefault(name, write(df, name)))
    docs = [("en", " ".join(f"a{j % 20} b{(j * 7 + k) % 90}" for j in range(60))) for k in range(20)]
    table = spark.createDataFrame(docs, "lang string, text string")
    got = collocations.collocations(table, longest=3, min_count=1000, limit=60)
    assert got.count() == 0 and rows["windows"].count() == 110
    assert rows["windows"].filter("size = 1").agg(F.sum("n")).first()[0] == 20 * 120


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    """All sides grow with the vocabulary; by Spark's estimate of an exploded or compressed side, each would be small enough."""
    plans = []

    def watched(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, purpose)

    monkeypatch.setattr(spelling, "materialize", watched)
    words = [("kitten", 9), ("kittens", 3), ("mitten", 4), ("a" * 50, 3), ("a" * 51, 9), ("sitting", 3)]
    got = spelling.grouped(spark.createDataFrame(words, "word string, n long"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]
    assert {(r.word, r.root) for r in got.collect()} == {
        ("kitten", "kitten"), ("kittens", "kitten"), ("mitten", "kitten"), ("a" * 50, "a" * 51), ("a" * 51, "a" * 51),
        ("sitting", "sitting")}
