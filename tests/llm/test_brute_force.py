"""Language and toxicity decisions against plain versions without filters and automata; vectors of many lengths."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

from conftest import SF
from parley.llm import language_id, queries, toxicity, vector_dedup


# ---- language: plain sets in place of the bit-sliced Bloom filters -----------------------------------------------

def plain_grams(text):
    """All 3- and 4-grams of a text whose other characters are blanks."""
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    padded = f" {' '.join(letters.split())} "
    return [padded[i:i + n] for n in language_id.SIZES for i in range(len(padded) - n + 1)]


def plain_sets(rows):
    sizes, having = Counter(lang for _, lang in rows), defaultdict(Counter)
    for text, lang in rows:
        for gram in set(plain_grams(text)):
            having[gram][lang] += 1
    sets = defaultdict(set)
    for gram, counts in having.items():
        share = {lang: n / sizes[lang] for lang, n in counts.items() if n >= language_id.MIN_DOCUMENTS}
        for lang, s in share.items():
            if s >= max(share.values()) * language_id.MIN_SHARE:
                sets[lang].add(gram)
    return sets


def test_languages_equal_plain_sets(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in docs}
    sets = plain_sets([(t, lang) for d, t, lang in docs if not held[d] and t and lang])
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF).collect()}
    filters = language_id.learned(spark.createDataFrame([(d, t, lang) for d, t, lang in docs if not held[d]],
                                                        "doc_id long, text string, lang string"))
    assert filters.names == sorted(sets) and set(got) == set(held)
    judge = language_id.Judge(filters)
    false, decided = [], 0
    for d, text, _ in docs:
        assert got[d]["held_out"] == held[d]
        grams = plain_grams(text or "")
        plain = np.array([sum(g in sets[name] for g in grams) for name in filters.names])
        total, found = (x[0] for x in judge.counts([text or ""]))
        # a filter has all n-grams of its set and few others; one that a text repeats counts each time
        extra = found - plain
        assert total == len(grams) and (extra >= 0).all()
        false.append(extra / max(total, 1))
        order = np.argsort(-plain, kind="stable")
        if plain[order[0]] - plain[order[1]] > extra.max() + total * filters.false_rate.max():
            assert got[d]["lang_pred"] == filters.names[order[0]]
            decided += 1
    assert (np.mean(false, axis=0) <= 2 * filters.false_rate + 1e-3).all()
    assert decided >= 0.95 * len(docs)


# ---- toxicity: clause by clause, by positions in lists of words --------------------------------------------------

def plain_counts(text, patterns, weak):
    fixed = {w: s for s, words in toxicity.FIXED.items() for w in words.split()}
    counts = Counter()

    def kind(word):
        forms = [word + "$"] + [word[:n] for n in toxicity.STEMS if len(word) >= n]
        if any(f in patterns for f in forms):
            return toxicity.INSULT
        return toxicity.WEAK if any(f in weak for f in forms) else fixed.get(word)

    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        kinds = [kind(w) for w in re.findall(r"[^\W\d_]+", clause)]
        insults = [i for i, k in enumerate(kinds) if k == toxicity.INSULT]

        def after(opener):
            return any(k == opener and any(i > j for i in insults) for j, k in enumerate(kinds))

        if toxicity.THREAT in kinds and toxicity.TARGET in kinds:
            counts["threat"] += 1
        elif after(toxicity.REPORT):
            counts["reported"] += 1
        elif after(toxicity.NEGATION):
            counts["negated"] += 1
        elif insults and toxicity.TARGET in kinds:
            counts["targeted"] += 1
        elif insults:
            counts["plain"] += 1
        elif toxicity.WEAK in kinds:
            counts["weak"] += 1
    return [counts[m] for m in toxicity.MARKS]


def test_toxicity_equals_clauses_scored_one_by_one(spark):
    rng = random.Random(5)
    words = ["kara", "lo", "mirella", "nuvo", "grumbler", "grumbled", "zorkish", "you", "them", "not", "never", "said",
             "wrote", "kill", "matar", "du", "kein", "Ärger", "x1", "schrieb"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "! ", ": ", "\n", "; ", "... ", "-"])
                     for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [None, "", "?!"]
    model = toxicity.Model(["grumbler$", "zork", "kara"], ["mire", "grum"], np.array([-1.0, 0.5, 0.75, 0.25, 0.125, 1.5, 0.3]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter()
    for r in toxicity.scored(table, model).collect():
        counts = plain_counts(texts[r["doc_id"]], set(model.patterns), set(model.weak))
        seen.update({m: n for m, n in zip(toxicity.MARKS, counts) if n})
        assert [r[f"{m}_clauses"] for m in toxicity.MARKS] == counts
        margin = model.weights[0] + sum(w * math.log1p(n) for w, n in zip(model.weights[1:], counts))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)
    assert set(seen) == set(toxicity.MARKS)


# ---- vectors of many lengths -------------------------------------------------------------------------------------

def test_any_number_of_vector_lengths(spark):
    rng = np.random.default_rng(9)
    rows = []
    for length in range(1, 41):
        base = rng.standard_normal(length)
        rows += [(base + 0.1 * rng.standard_normal(length)).tolist() for _ in range(4)]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vector_dedup.deduplicated(table).collect()}
    linked = defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                linked[i].add(j)
    for i in range(len(rows)):
        reached, open_ = {i}, [i]
        while open_:
            more = linked[open_.pop()] - reached
            reached |= more
            open_ += more
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(linked[i]), min(reached), min(reached) == i)
