"""Language detection by character trigram profiles learned from rows of known language."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.lookup import with_weight_sums
from parley.session import materialize

SCORE_DIGITS = 6
#: Texts that are cut into trigrams at once, and distinct trigrams of a language that a task holds.
SLICE = 512
HELD = 1 << 20


def letters(c: Column) -> Column:
    """Lowercased text with every run of other characters as one space, and a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "), F.lit(" "))


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts of letters and spaces, each as one number of three code points, and how many each text has."""
    texts = [text or "" for text in texts]
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32).astype(np.int64)
    whole = codes != 10
    whole = whole[:-2] & whole[1:-1] & whole[2:] if len(codes) > 2 else np.zeros(0, bool)
    found = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[whole] if len(codes) > 2 else np.zeros(0, np.int64)
    return found, np.array([max(0, len(text) - 2) for text in texts], np.int64)


def _spelled(grams: np.ndarray) -> pa.Array:
    mask = (1 << 21) - 1
    codes = np.column_stack([grams >> 42, grams >> 21 & mask, grams & mask]).astype("<u4")
    text = codes.tobytes().decode("utf-32-le")
    return pa.array([text[i:i + 3] for i in range(0, len(text), 3)], pa.string())


def trigram_lists(texts: pa.Array) -> pa.ListArray:
    """Every run of three characters of each text, in order; texts are what ``letters`` gives."""
    found, counts = _trigrams(texts.to_pylist())
    distinct, place = np.unique(found, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, _spelled(distinct).take(pa.array(place)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, place, n) of rows (place of the language, letters), summed in the task as far as HELD trigrams go."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows(place: int) -> Iterator[pa.RecordBatch]:
        grams, counts = merged(held.pop(place))
        if len(grams):
            yield pa.RecordBatch.from_arrays(
                [_spelled(grams), pa.array(np.full(len(grams), place, np.int32)), pa.array(counts)], names=["gram", "place", "n"])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, counts = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        return grams[first], np.add.reduceat(counts, first) if len(first) else counts

    for batch in batches:
        for part in (batch.slice(start, SLICE) for start in range(0, batch.num_rows, SLICE)):
            places = part.column(0).to_numpy()
            for place in np.unique(places).tolist():
                texts = part.column(1).filter(pa.array(places == place)).to_pylist()
                parts = held.setdefault(place, [])
                parts.append(np.unique(_trigrams(texts)[0], return_counts=True))
                if sum(len(g) for g, _ in parts) > HELD:
                    held[place] = [merged(parts)]
                    if len(held[place][0][0]) > HELD // 2:
                        yield from rows(place)
    for place in list(held):
        yield from rows(place)


@dataclass(frozen=True)
class LanguageProfile:
    """``weights``: per trigram its frequency ``n`` and a log weight ``w0..`` per language."""

    languages: Sequence[str]
    weights: DataFrame


def profile_counts(df: DataFrame, text: str, language: str, languages: Sequence[str]) -> DataFrame:
    """Per trigram its count in each language (``n0..``) and in all (``n``)."""
    place = F.array_position(F.array(*map(F.lit, languages)), F.col(language)) - 1
    rows = df.where(F.col(language).isin(list(languages))).select(place.cast("int").alias("place"), letters(F.col(text)).alias("s"))
    return rows.mapInArrow(_counted, "gram string, place int, n long").groupBy("gram").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))])


def fit_language_profile(
    df: DataFrame, text: str, language: str, languages: Sequence[str], size: int | None = None
) -> LanguageProfile:
    """Weigh all trigrams by smoothed log frequency; with ``size`` only the most frequent ones of each language.

    The driver gets one total per language.
    """
    ks = range(len(languages))
    counts = materialize(profile_counts(df, text, language, languages), "trigram-counts")
    if size is not None:
        long = counts.select(
            "gram", F.inline(F.array(*[F.struct(F.lit(i).alias("l"), F.col(f"n{i}").alias("n")) for i in ks]))
        ).where("n > 0")
        place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "gram"))
        top = long.withColumn("place", place).where(F.col("place") <= size).select("gram").distinct()
        counts = materialize(counts.join(top, "gram", "left_semi"), "trigram-counts")
    sums = counts.agg(F.count("*").alias("size"), *[F.sum(f"n{i}").alias(f"n{i}") for i in ks]).first()
    total = [float(max(1, (sums[f"n{i}"] or 0) + sums["size"])) for i in ks]
    weights = counts.select("gram", "n", *[F.log((F.col(f"n{i}") + 1) / F.lit(total[i])).alias(f"w{i}") for i in ks])
    return LanguageProfile(list(languages), materialize(weights, "language-profile"))


def detect_language(
    df: DataFrame, profile: LanguageProfile, text: str, key: str, target: str = "detected_language"
) -> DataFrame:
    """Add the language with the largest sum of trigram weights; NULL when nothing matches a profile.

    The trigrams of the whole text are summed inside the row. The text itself is not carried along.
    """
    ks = range(len(profile.languages))
    table = profile.weights.select(
        F.col("gram").alias("item"), "n", F.array(*[F.col(f"w{i}") for i in ks]).alias("w"))
    summed = with_weight_sums(df, text, letters, table, key, len(profile.languages), trigram_lists)
    scores = F.transform("_sums", lambda x: F.bround(x, SCORE_DIGITS))
    names = F.array(*map(F.lit, profile.languages))
    best = F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    small = [c for c in df.columns if c != text]
    return summed.select(*small, F.when(F.col("_known") > 0, best).alias(target))
