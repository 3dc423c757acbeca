"""Operator 6, toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults and weak hints of them (patterns learned from labelled documents: whole words, or stems that stand for
all words that begin with them), threats, targets, negations and reports of speech (short fixed lists). Five small transducers read the
symbols of a clause: each keeps a state and emits marks; composed, they are one automaton whose states are tuples. A
clause is matched when the composition emits a mark: a plain, targeted, negated or reported insult, a weak hint, or a
threat with a target. Matched clauses, not words, are counted by mark, and a document's score is a logistic function of these counts.

Patterns and weights are learned from at most SAMPLE_ROWS expected labelled rows, near copies counted once; the weights start
from fixed prior values, which stay where the sample says nothing. Texts are scored whole.

Edge cases: a null or empty text has no clause and gets the base score. Without labelled rows the prior weights and an
empty insult list are used. Rows with a null label are not learned from; a document labelled several times takes its
largest label. Other columns pass through; one that is named like a result is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.exprs import ascii_lower, columns_but, free_name, let, words_of
from parley.session import materialize

#: Expected number of labelled rows that patterns and weights are learned from.
SAMPLE_ROWS = 10_000
#: Lengths of stems; a whole word is a pattern of its own and is written with a final "$".
STEMS = (4, 5, 6, 7, 8)
#: A pattern must be in so many toxic documents and in such a share of them, and that much more often than in others.
MIN_SUPPORT = 5
MIN_SHARE = 0.01
#: Strong patterns must reach the first ratio, weak ones the second; SLACK documents are added to the others, so that a
#: rare pattern is not taken for a pure one.
MIN_RATIO = 30.0
WEAK_RATIO = 5.0
SLACK = 3.0
#: Words that a worker remembers.
CACHE_SIZE = 300_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, WEAK = range(7)
# Function words of the grammar in English, German, French and Spanish.
FIXED = {
    THREAT: "kill murder shoot stab strangle behead töten umbringen erschießen tuer assassiner égorger matar asesinar",
    TARGET: ("you your yours he him his she her they them their du dich dir dein ihr euch sie ihn tu toi te vous ton votre "
             "ils elles tú ti usted ustedes vosotros ellos ellas"),
    NEGATION: "not no never nobody nicht kein keine nie niemals pas jamais aucun nunca jamás ningún ninguna",
    REPORT: ("said says say told wrote quoted claimed sagte sagt schrieb behauptete dit disait écrit affirmait dijo dice "
             "escribió afirmó"),
}
#: Without one of these a clause cannot be matched.
HITS = {INSULT, THREAT, WEAK}
WORD = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"([^\W\d_]+)|([.!?;:\n]+)")

MARKS = ["plain", "targeted", "negated", "reported", "threat", "weak"]
#: Prior of the weights: base score, one weight per mark (on log(1 + clauses)), and how firmly they are held.
PRIOR = np.array([-4.0, 6.0, 7.0, 2.0, 2.0, 7.0, 2.0])
FIRMNESS = 0.05


@dataclass
class Transducer:
    """Deterministic: ``step`` takes a state and a symbol to the next state and the emitted mark, if any."""

    step: Callable[[int, int], tuple[int, str | None]]


def _seen(symbol: int, mark: str | None = None) -> Transducer:
    """State 1 once a symbol was read."""
    return Transducer(lambda state, s: (1, mark) if s == symbol else (state, None))


def _both(first: int, second: int, mark: str) -> Transducer:
    """Emits when both symbols have been read, in any order; states are sets of symbols read as bits."""

    def step(state: int, s: int) -> tuple[int, str | None]:
        after = state | (s == first) | (s == second) << 1
        return after, mark if after == 3 and s in (first, second) else None

    return Transducer(step)


def _scoped(opener: int, word: int, mark: str) -> Transducer:
    """Emits when a word follows an opener in the clause."""
    return Transducer(lambda state, s: (1, None) if s == opener else (state, mark if state and s == word else None))


@dataclass
class Composition:
    """Transducers that read the same symbols side by side; states are tuples, transitions are tabulated as met."""

    parts: list[Transducer]
    table: dict = field(default_factory=dict)

    def run(self, symbols: list[int]) -> set[str]:
        state, found = (0,) * len(self.parts), set()
        for s in symbols:
            known = self.table.get((state, s))
            if known is None:
                steps = [p.step(q, s) for p, q in zip(self.parts, state)]
                known = self.table[(state, s)] = (tuple(q for q, _ in steps), frozenset(m for _, m in steps if m))
            state, marks = known
            found |= marks
        return found


def grammar() -> Composition:
    return Composition([
        _seen(INSULT, "insult"),
        _seen(WEAK, "weak"),
        _both(INSULT, TARGET, "targeted"),
        _scoped(NEGATION, INSULT, "negated"),
        _scoped(REPORT, INSULT, "reported"),
        _both(THREAT, TARGET, "threat"),
    ])


def mark_of(found: set[str]) -> str | None:
    """The one mark that a clause counts as: what weakens an insult comes first, a threat stands above all."""
    for mark in ("threat", "reported", "negated", "targeted"):
        if mark in found:
            return mark
    return "plain" if "insult" in found else "weak" if "weak" in found else None


class Symbols(dict):
    """Symbol of each lower-cased word, kept for the words that a worker has met."""

    def __init__(self, patterns: list[str], weak: list[str]):
        self.patterns, self.weak = frozenset(patterns), frozenset(weak)
        self.fixed = {w: s for s, words in FIXED.items() for w in words.split()}

    def __missing__(self, word: str) -> int:
        symbol = self.fixed.get(word, OTHER)
        forms = [f"{word}$", *(word[:n] for n in STEMS if len(word) >= n)]
        if not self.patterns.isdisjoint(forms):
            symbol = INSULT
        elif not self.weak.isdisjoint(forms):
            symbol = WEAK
        if len(self) >= CACHE_SIZE:
            self.clear()
        self[word] = symbol
        return symbol


class Scorer:
    """Counts of matched clauses in texts."""

    def __init__(self, patterns: list[str], weak: list[str]):
        self.symbols, self.grammar = Symbols(patterns, weak), grammar()

    def counts(self, text: str | None) -> list[int]:
        text = (text or "").lower()
        found = dict.fromkeys(MARKS, 0)
        symbols = bytes(map(self.symbols.__getitem__, WORD.findall(text)))
        if any(bytes([s]) in symbols for s in HITS):
            clause: list[int] = []
            for word, _ in PIECE.findall(text + "."):
                if word:
                    clause.append(self.symbols[word])
                    continue
                mark = None if HITS.isdisjoint(clause) else mark_of(self.grammar.run(clause))
                if mark:
                    found[mark] += 1
                clause = []
        return [found[m] for m in MARKS]

    def features(self, texts: pd.Series) -> np.ndarray:
        counts = np.array([self.counts(t) for t in texts], float).reshape(-1, len(MARKS))
        return np.column_stack([np.ones(len(counts)), np.log1p(counts)])


@dataclass
class Model:
    patterns: list[str]
    weak: list[str]
    weights: np.ndarray


def _signature(text: Column) -> Column:
    """The smallest hash among the three-word windows of a text; near copies mostly share it."""
    words = words_of(ascii_lower(text))
    return let(words, lambda w: F.array_min(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))


def _pattern_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Toxic and other documents that have each pattern."""
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = set(WORD.findall((text or "").lower()))
            patterns = {w[:n] for w in words for n in STEMS if len(w) >= n}
            counts[int(toxic)].update(patterns | {f"{w}$" for w in words})
        if counts[1]:
            # only patterns of toxic documents can be chosen, but their other documents may be in another batch
            both = [(p, counts[1][p], counts[0][p]) for p in counts[0].keys() | counts[1].keys()]
            yield pd.DataFrame(both, columns=["pattern", "toxic", "clean"])
        elif counts[0]:
            yield pd.DataFrame([(p, 0, n) for p, n in counts[0].items()], columns=["pattern", "toxic", "clean"])


def _chosen(found: list[tuple[str, int, int]]) -> list[str]:
    """The shortest patterns among (pattern, toxic, clean) that cover the others.

    A stem gives way to a longer one that has fewer clean documents and at least half of its toxic ones.
    """
    by_stem: dict[str, list[tuple[int, int]]] = {}
    for pattern, toxic, clean in found:
        for n in STEMS:
            if n < len(pattern):
                by_stem.setdefault(pattern[:n], []).append((toxic, clean))
    kept: set[str] = set()
    for pattern, toxic, clean in sorted(found, key=lambda x: len(x[0])):
        purer = any(c < clean and 2 * t >= toxic for t, c in by_stem.get(pattern, ()))
        if not purer and not any(pattern[:n] in kept for n in STEMS if n < len(pattern)):
            kept.add(pattern)
    return sorted(kept)


def _fitted(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights with a normal prior around PRIOR, by Newton steps."""
    weights, held = PRIOR.copy(), np.full(len(PRIOR), FIRMNESS)
    held[0] = 0.01

    def cost(w: np.ndarray) -> float:
        margin = features @ w
        return float(np.sum(np.logaddexp(0, margin) - labels * margin) + 0.5 * held @ (w - PRIOR) ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (p - labels) + held * (weights - PRIOR)
        curve = (features * (p * (1 - p))[:, None]).T @ features + np.diag(held)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and cost(weights - size * step) > cost(weights):
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return weights


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic).

    The driver gets the patterns and the counts of clauses of the sampled rows.
    """
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    ids = known.filter(draw < min(1.0, rows / max(total, 1)))
    # the ids are SAMPLE_ROWS at most in expectation, so they are small whatever the table
    joined = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("near", _signature(F.col("text")))
    one_each = joined.groupBy("near").agg(F.min_by("text", "doc_id").alias("text"),
                                          F.min_by("toxic", "doc_id").alias("toxic"))
    sample = materialize(one_each.select("text", "toxic"), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], [], PRIOR.copy())
    counts = (sample.mapInPandas(_pattern_counts, "pattern string, toxic long, clean long")
              .groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    ratio = (F.col("toxic") / n_toxic) / ((F.col("clean") + SLACK) / n_clean)
    least = max(MIN_SUPPORT, MIN_SHARE * n_toxic)
    best = (counts.withColumn("ratio", ratio).filter((F.col("toxic") >= least) & (F.col("ratio") >= WEAK_RATIO))
            .orderBy(F.desc("toxic"), "pattern").collect())
    strong = _chosen([(r["pattern"], r["toxic"], r["clean"]) for r in best if r["ratio"] >= MIN_RATIO])
    weak = _chosen([(r["pattern"], r["toxic"], r["clean"]) for r in best if r["ratio"] < MIN_RATIO])
    shared = spark.sparkContext.broadcast((strong, weak))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            found = pd.DataFrame(scorer.features(batch["text"]), columns=["one", *MARKS])
            yield found.assign(toxic=batch["toxic"].to_numpy())

    fields = ", ".join(f"{c} double" for c in ["one", *MARKS])
    # as many rows as the sample has, of a few numbers each
    rows_seen = sample.mapInPandas(counted, f"{fields}, toxic int").toPandas()
    return Model(strong, weak, _fitted(rows_seen[["one", *MARKS]].to_numpy(), rows_seen["toxic"].to_numpy(float)))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1), predicted (1 from 0.5) and the number of matched clauses by mark."""
    others = columns_but(docs, ["score", "predicted", *[f"{m}_clauses" for m in MARKS]])
    struct = free_name(docs, "toxicity_found")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"{m}_clauses long" for m in MARKS)

    @F.pandas_udf(f"score double, {fields}")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scorer = Scorer(model.patterns, model.weak)
        for batch in batches:
            features = scorer.features(batch)
            found = {f"{m}_clauses": np.rint(np.expm1(features[:, k + 1])).astype(int) for k, m in enumerate(MARKS)}
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(features @ model.weights, -30, 30))), **found})

    rows = docs.select(*others, score(F.col(text)).alias(struct)).select(*others, f"{struct}.*")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
