"""Operator 1, language identification with language-bitmask n-gram filters.

A filter is a bit-sliced Bloom filter: a table of rows, each a bit mask over the languages. The masks at the hash rows of an
n-gram, combined by AND, name all languages that contain the n-gram. Per text and language the n-grams found are counted
(popcounts of the masks), and the count is corrected for the expected false positives of that language's bit slice; the
largest corrected count decides.

An n-gram is entered for a language when it occurs in enough of its documents and not far more rarely than in the language
where it is most common, so that stray foreign words do not fill the filters. Filters are learned from all labelled rows or
from a bounded sample of them (SAMPLE_PER_LANGUAGE expected rows of each language); texts are judged whole. Floors of the
coverage are learned from all labelled rows.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Without any labelled row every text is ``und``.
A text whose n-grams are all unknown gets the language with most labelled rows, score 0. Ties go to the smaller name.
Rows with null label are not learned from. Repeated rows are judged one by one. Other columns pass through; one that is
named like a result is replaced by it. Texts over CHUNK code points are read in pieces, all of which count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.codepoints import END, LETTER, SEPARATOR, classes, codes_of, in_chunks
from parley.llm.exprs import columns_but, free_name

#: Expected number of labelled rows of each language that the filters are learned from.
SAMPLE_PER_LANGUAGE = 1000
SIZES = (3, 4)
ROWS = 1 << 19
HASHES = 2
#: An n-gram is entered for a language if at least so many of its documents have it (of up to SAMPLE_PER_LANGUAGE that are
#: learned from; of more, the same share), ...
MIN_DOCUMENTS = 3
#: ... and its share of documents is at least this part of the largest share in any language.
MIN_SHARE = 0.25
UNKNOWN = "und"
#: Bits of a hash that name an n-gram (the filters use the first 40), and of a language or a text of a batch.
GRAM_BITS, LANGUAGE_BITS = 43, 21
#: Pairs of n-gram and language that a task holds.
HELD = 1 << 20
#: Rows whose texts are in Python at once, whatever the size of the Arrow batches.
SLICE = 256
#: What is found of a text.
FOUND = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])
#: One part in so many of the labelled rows is left out of a fit that measures coverage.
PARTS = 4
#: A floor lies this far below the least coverage measured.
FLOOR = 0.95


@dataclass
class Filters:
    """Names of the languages, masks (rows x words), false positive rate and sampled rows of each language."""

    names: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    rows: np.ndarray


def grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts and the place of each one's text.

    Runs of anything but letters count as one blank, as do the two ends of a text.
    """
    joined = "".join([f" {t}{SEPARATOR}" for t in texts]).lower()
    codes = codes_of(joined)
    kinds = classes()[codes]
    letters = kinds == LETTER
    ends = kinds == END
    kept = letters | ends
    kept[0] = True
    kept[1:] |= letters[:-1] | ends[:-1]
    kept = np.flatnonzero(kept)
    # a blank just before an end would double the blank that the end itself stands for
    blank, before_end = ~(letters | ends)[kept], np.append(ends[kept][1:], False)
    kept = kept[~(blank & before_end)]
    place = (np.cumsum(ends) - ends)[kept]
    code = np.where(letters, codes, 32)[kept].astype(np.uint64)
    count = len(code) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = code[:count].copy()
    for k in range(1, size):
        hashed *= np.uint64(0x100000001B3)
        hashed += code[k:k + count]
    whole = place[:count] == place[size - 1:]
    hashed, place = hashed[whole], place[:count][whole]
    hashed *= np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(29)
    return hashed, place


def filter_rows(hashed: np.ndarray, k: int, rows: int) -> np.ndarray:
    """Row of the k-th hash function; the number of rows is a power of two."""
    return ((hashed >> np.uint64(k * 21)) & np.uint64(rows - 1)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    joined = np.concatenate(keys)
    order = np.argsort(joined)
    joined = joined[order]
    first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1])) if len(joined) else np.zeros(0, np.int64)
    sums = np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else first
    return joined[first], sums


def _pairs(keys: list[np.ndarray], counts: list[np.ndarray]) -> pd.DataFrame:
    found, documents = _summed(keys, counts)
    language = found & np.uint64((1 << LANGUAGE_BITS) - 1)
    return pd.DataFrame({"gram": (found >> np.uint64(LANGUAGE_BITS)).astype(np.int64), "language": language.astype(np.int32),
                         "documents": documents})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per (n-gram, language), summed in the task as far as HELD pairs go."""
    keys, counts, held = [], [], 0
    for batch in batches:
        for places, pieces in in_chunks(batch["text"]):
            language = batch["language"].to_numpy()[places].astype(np.uint64)
            for size in SIZES:
                hashed, place = grams(pieces, size)
                # sorted as whole numbers: the n-grams of each text once, then those of each language
                each = np.sort(place.astype(np.uint64) << np.uint64(GRAM_BITS) | hashed & np.uint64((1 << GRAM_BITS) - 1))
                each = each[np.append(True, each[1:] != each[:-1])] if len(each) else each
                gram, place = each & np.uint64((1 << GRAM_BITS) - 1), (each >> np.uint64(GRAM_BITS)).astype(np.int64)
                pairs = np.sort(gram << np.uint64(LANGUAGE_BITS) | language[place])
                first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
                keys.append(pairs[first])
                counts.append(np.diff(np.append(first, len(pairs))))
                held += len(first)
            if held > HELD:
                found, documents = _summed(keys, counts)
                keys, counts, held = [found], [documents], len(found)
                if held > HELD // 2:
                    yield _pairs(keys, counts)
                    keys, counts, held = [], [], 0
    if held:
        yield _pairs(keys, counts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(start, SLICE) for batch in batches for start in range(0, batch.num_rows, SLICE))


def _counted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per (n-gram, language) of Arrow batches of any size, read a slice at a time."""
    for pairs in _counted(batch.to_pandas() for batch in _slices(batches)):
        yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)


def learned(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id",
            per_language: int | None = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from labelled documents, from all of them if ``per_language`` is None.

    The driver gets the language names and at most ROWS masks.
    """
    labelled = docs.select(F.col(label).alias("name"), F.col(text).alias("text"), F.col(key).alias("key"))
    labelled = labelled.filter(F.col("name").isNotNull())
    counts = labelled.groupBy("name").count().orderBy("name").collect()
    names = [r["name"] for r in counts]
    words = max(1, -(-len(names) // 64))
    masks = np.zeros((ROWS, words), np.uint64)
    if not names:
        return Filters([], masks, np.zeros(0), np.zeros(0))
    used = [float(r["count"] if per_language is None else min(r["count"], per_language)) for r in counts]
    shares = F.create_map(*[F.lit(x) for r, n in zip(counts, used) for x in (r["name"], n / r["count"])])
    ids = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(draw < shares[F.col("name")]).select(ids[F.col("name")].alias("language"), "text")
    expected, least = (F.get(F.array(*map(F.lit, values)), F.col("language")) for values in (
        used, [max(1.0, n / SAMPLE_PER_LANGUAGE) * MIN_DOCUMENTS for n in used]))
    # documents per language, as shares of documents
    per_gram = (sample.mapInArrow(_counted_slices, "gram long, language int, documents long")
                .groupBy("gram", "language").agg(F.sum("documents").alias("documents"))
                .filter(F.col("documents") >= least))
    share = F.col("documents") / expected
    entry = F.struct(share.alias("share"), F.col("language").alias("language"))
    lists = per_gram.groupBy("gram").agg(F.collect_list(entry).alias("entries"))
    enough = F.filter("entries", lambda e: e["share"] >= F.array_max(F.col("entries")["share"]) * MIN_SHARE)
    word_masks = [_mask_word(enough, w).alias(f"word{w}") for w in range(words)]
    rows = F.explode(F.array(*[_row_column(k) for k in range(HASHES)])).alias("row")
    cells = (lists.select("gram", *word_masks).select(rows, *[f"word{w}" for w in range(words)])
             .groupBy("row").agg(*[F.bit_or(f"word{w}").alias(f"word{w}") for w in range(words)]).toPandas())
    for w in range(words):
        masks[cells["row"].to_numpy(), w] = cells[f"word{w}"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(names))])
    return Filters(names, masks, (fill / ROWS) ** HASHES, np.array([float(r["count"]) for r in counts]))


def _mask_word(entries: Column, word: int) -> Column:
    """The w-th 64 languages of a list of entries as bits."""
    one = F.lit(1).cast("long")
    bits = F.transform(F.filter(entries, lambda e: F.floor(e["language"] / 64) == word),
                       lambda e: F.call_function("shiftleft", one, F.pmod(e["language"], F.lit(64))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda mask, bit: mask.bitwiseOR(bit))


def _row_column(k: int) -> Column:
    return F.call_function("shiftrightunsigned", F.col("gram"), F.lit(k * 21)).bitwiseAND(F.lit(ROWS - 1))


class Judge:
    """Counts and decisions of one worker."""

    def __init__(self, filters: Filters):
        self.filters = filters
        n = len(filters.names)
        # up to eight languages, masks take one byte and are counted through a histogram of masks
        self.narrow = n <= 8
        self.masks = filters.masks[:, 0].astype(np.uint8) if self.narrow else filters.masks
        self.bits = (np.arange(256)[:, None] >> np.arange(n) & 1).astype(np.int64) if self.narrow else None

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each text, and of those found for each language."""
        n, total = len(self.filters.names), np.zeros(len(texts), np.int64)
        found = np.zeros((len(texts), n), np.int64)
        for size in SIZES:
            hashed, place = grams(texts, size)
            total += np.bincount(place, minlength=len(texts))
            mask = self.masks[filter_rows(hashed, 0, ROWS)]
            for k in range(1, HASHES):
                mask = mask & self.masks[filter_rows(hashed, k, ROWS)]
            if self.narrow:
                seen = np.bincount(place * 256 + mask, minlength=len(texts) * 256)
                found += seen.reshape(len(texts), 256) @ self.bits
            else:
                for k in range(n):
                    has = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                    found[:, k] += np.bincount(place, weights=has, minlength=len(texts)).astype(np.int64)
        return total, found

    def judge(self, texts: list[str | None]) -> pd.DataFrame:
        f, n = self.filters, len(texts)
        total, found = np.zeros(n), np.zeros((n, len(f.names)))
        letters = np.array([re.search(r"[^\W\d_]", t) is not None if t else False for t in texts], bool)
        for places, pieces in in_chunks(texts):
            t, x = self.counts(pieces)
            np.add.at(total, places, t)
            np.add.at(found, places, x)
        if not f.names:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": 0.0, "coverage": 0.0})
        true = np.maximum(0.0, (found - total[:, None] * f.false_rate) / np.maximum(1e-9, 1 - f.false_rate))
        best = true.argmax(axis=1)
        top = true[np.arange(n), best]
        best[top <= 0] = int(f.rows.argmax())
        sums = top + (np.sort(true, axis=1)[:, -2] if len(f.names) > 1 else 0)
        known = letters & (top > 0)
        score = np.where(known, top / np.maximum(sums, 1e-9), 0.0)
        coverage = np.where(known, np.minimum(1.0, top / np.maximum(total, 1)), 0.0)
        names = np.where(letters, np.array(f.names, object)[best], UNKNOWN)
        return pd.DataFrame({"lang_pred": names, "score": score, "coverage": coverage})


def predictor(docs: DataFrame, filters: Filters) -> Column:
    """Struct column of lang_pred, score (share of the best language among the two best) and coverage (share of the
    n-grams that the best language has) for the text column of a table."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred string, score double, coverage double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Judge(shared.value)
        for batch in batches:
            found = [pa.RecordBatch.from_pandas(judge.judge(batch.slice(start, SLICE).to_pylist()), FOUND, False).to_struct_array()
                     for start in range(0, max(len(batch), 1), SLICE)]
            yield pa.concat_arrays(found)

    return predict


def identified(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add lang_pred, score and coverage."""
    others, struct = columns_but(docs, ["lang_pred", "score", "coverage"]), free_name(docs, "language_found")
    found = docs.select(*others, predictor(docs, filters)(F.col(text)).alias(struct))
    return found.select(*others, f"{struct}.*")


def coverage_floors(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, float]:
    """Per language, a floor just below the coverage of its labelled rows that are left out of a fit on the others.

    All labelled rows are used, either in the fit or out of it. A language has none if no row of it is left out or none of
    those is recognised.
    """
    labelled = docs.filter(F.col(label).isNotNull()).select(label, text, key)
    left_out = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(PARTS)) == 0
    filters = learned(labelled.filter(~left_out), label, text, key, None)
    if not filters.names:
        return {}
    found = identified(labelled.filter(left_out), filters, text)
    found = found.filter((F.col("lang_pred") == F.col(label)) & (F.col("coverage") > 0))
    least = found.groupBy("lang_pred").agg(F.min("coverage").alias("least")).collect()
    return {r["lang_pred"]: FLOOR * r["least"] for r in least}
