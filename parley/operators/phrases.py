"""Texts that hold phrases of a table of any size.

The windows of a text that may be phrases are found in its task: a window's hashes, by doubling, are looked up in a bit set of a
fixed size. One such window of each text is joined with the phrases by equality, which settles nearly all texts that hold any;
only the texts left are asked for all their windows. So the rows joined grow with the texts, not with texts times phrases, and
bits only decide how many rows are joined, never which are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.bits import bit_set, is_set
from parley.session import materialize

#: Code points of a phrase that are joined; a longer phrase is entered under its first ones and then looked for in the text.
KEY_CHARS = 1024
#: Code points that are hashed at most at the start and at the end of a window.
ENDS = 64
#: Bits of the set that windows are looked up in.
BITS = 1 << 26
#: Code points that are hashed at once.
CHUNK = 1 << 17
SEPARATOR = 0xFFFFFFFF


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    found = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9) ^ (found >> np.uint64(32))


def _end_size(length: int) -> int:
    """Code points hashed at both ends of a window: the largest power of two that fits, ENDS at most."""
    return min(1 << (length.bit_length() - 1), ENDS)


def _hashes(codes: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Per size, a power of two, the hashes of the windows from every code point on."""
    found, size = codes, 1
    while sizes:
        if size in sizes:
            yield size, found
        if size >= max(sizes):
            return
        found = _mixed(found[:max(0, len(found) - size)], found[size:])
        size *= 2


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BITS)).astype(np.int64)


def _of_start(starts: np.ndarray, size: int) -> np.ndarray:
    return _places(_mixed(starts, np.array([size], np.uint64)))


def _of_window(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    return _places(_mixed(_mixed(starts, ends), np.array([KEY_CHARS + length], np.uint64)))


def _pieces(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many texts with a separator behind each piece, the piece of each point, and the end and the text of each
    piece; long texts come in pieces that overlap."""
    parts, sizes, owners, held = [], [], [], 0

    def joined():
        ends = np.cumsum(sizes) - 1
        return np.concatenate(parts).astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes), ends, np.array(owners)

    for place, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        for start in range(0, len(codes), CHUNK):
            piece = codes[start:start + CHUNK + overlap]
            parts += [piece, np.array([SEPARATOR], np.uint32)]
            sizes.append(len(piece) + 1)
            owners.append(place)
            held += len(piece)
            if held >= CHUNK:
                yield joined()
                parts, sizes, owners, held = [], [], [], 0
    if parts:
        yield joined()


def _by_end_size(lengths: list[int]) -> dict[int, list[int]]:
    sizes: dict[int, list[int]] = {}
    for length in lengths:
        sizes.setdefault(_end_size(length), []).append(length)
    return sizes


def _places_of(keys: DataFrame, lengths: list[int]) -> DataFrame:
    """Bits of the starts of the keys and of the whole keys."""
    sizes = _by_end_size(lengths)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, _, ends, _ in _pieces(batch.column(0).to_pylist(), 0):  # no key is longer than a piece
                starts = np.concatenate([[0], ends[:-1] + 1])
                for size, hashes in _hashes(codes, set(sizes)):
                    for length in sizes[size]:
                        at = starts[ends - starts == length]
                        found = np.concatenate([_of_start(hashes[at], size),
                                                _of_window(hashes[at], hashes[at + length - size], length)])
                        yield pa.RecordBatch.from_arrays([pa.array(found)], names=["place"])

    return keys.select("key").mapInArrow(places, "place long")


def _windows(texts: list[str | None], sizes: dict[int, list[int]], bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows that may be keys, by slices of the texts: the code points, and the text, start and length of each window."""
    longest = max(n for lengths in sizes.values() for n in lengths)
    for codes, piece, ends, owners in _pieces(texts, longest - 1):
        found = [np.zeros((3, 0), np.int64)]
        for size, hashes in _hashes(codes, set(sizes)):
            starts = np.flatnonzero(is_set(bits, _of_start(hashes, size), BITS))
            for length in sizes[size]:
                at = starts[starts + length <= ends[piece[starts]]]
                at = at[is_set(bits, _of_window(hashes[at], hashes[at + length - size], length), BITS)]
                found.append(np.stack([owners[piece[at]], at, np.full(len(at), length)]))
        yield codes, *np.concatenate(found, axis=1)


def _text(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _one_window(sizes: dict[int, list[int]], shared):
    """Function from a text column to a window in the middle of those that may be keys."""

    @F.arrow_udf("string")
    def window(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found: dict[int, str] = {}
            for codes, owner, start, length in _windows(batch.to_pylist(), sizes, shared.value):
                order = np.lexsort((start, owner))
                texts, first, count = np.unique(owner[order], return_index=True, return_counts=True)
                for text, k in zip(texts.tolist(), order[first + count // 2].tolist()):
                    found.setdefault(text, _text(codes[start[k]:start[k] + length[k]]))
            yield pa.array([found.get(i) for i in range(len(batch))], pa.string())

    return window


def _all_windows(sizes: dict[int, list[int]], shared):
    """Function from a text column to all windows that may be keys."""

    @F.arrow_udf("array<string>")
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found: list[set[str]] = [set() for _ in range(len(batch))]
            for codes, owner, start, length in _windows(batch.to_pylist(), sizes, shared.value):
                for text, k, n in zip(owner.tolist(), start.tolist(), length.tolist()):
                    found[text].add(_text(codes[k:k + n]))
            yield pa.array([list(w) for w in found], pa.list_(pa.string()))

    return windows


def with_phrase_hits(df: DataFrame, column: str, phrases: DataFrame, ignore_case: bool = False) -> DataFrame:
    """``df`` with ``_held``, whether the text holds any phrase of the column ``phrase``, taken literally.

    Blank phrases are ignored, a null text holds none. Texts without a window that may be a phrase are not joined. Written once.
    """
    spark = df.sparkSession
    low = F.lower if ignore_case else (lambda c: c)
    text = low(F.col(f"`{column}`"))
    wanted = phrases.where("trim(phrase) <> ''").select(low(F.col("phrase")).alias("phrase")).distinct()
    keys = materialize(wanted.select(F.left("phrase", F.lit(KEY_CHARS)).alias("key"), "phrase",
                                     (F.length("phrase") <= KEY_CHARS).alias("whole")), "phrases")
    lengths = sorted(r["n"] for r in keys.select(F.length("key").alias("n")).distinct().collect())
    if not lengths:
        return df.withColumn("_held", F.lit(False))
    sizes = _by_end_size(lengths)
    shared = spark.sparkContext.broadcast(bit_set(_places_of(keys, lengths), F.col("place"), BITS))
    window, row = (_unused(df, name) for name in ("_window", "_row"))
    rows = materialize(df.withColumn(window, _one_window(sizes, shared)(text)).withColumn(
        row, F.when(F.col(window).isNotNull(), F.monotonically_increasing_id())), "suspects")
    suspects = rows.where(F.col(row).isNotNull())
    asked = suspects.select(F.col(row).alias("row"), F.col(window).alias("key"))
    undecided = materialize(asked.join(keys.where("whole").select("key"), "key", "left_anti").select("row"), "undecided")
    left = materialize(suspects.select(F.col(row).alias("row"), text.alias("text")).join(undecided, "row", "left_semi"), "left")
    asked = left.select("row", F.explode(_all_windows(sizes, shared)(F.col("text"))).alias("key")).join(keys, "key")
    held = asked.where("whole").select("row")
    if lengths[-1] == KEY_CHARS:
        longer = asked.where("not whole").select("row", "phrase").join(left, "row")
        held = held.union(longer.where(F.contains("text", F.col("phrase"))).select("row"))
    none = materialize(undecided.join(held, "row", "left_anti"), "without")
    judged = suspects.join(none.select(F.col("row").alias(row), F.lit(False).alias("_held")), row, "left")
    judged = judged.withColumn("_held", F.coalesce("_held", F.lit(True)))
    clean = rows.where(F.col(row).isNull()).withColumn("_held", F.lit(False))
    return clean.unionByName(judged).select(*[F.col(f"`{c}`") for c in df.columns], "_held")


def _unused(df: DataFrame, name: str) -> str:
    """A name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def without_phrases(df: DataFrame, column: str, phrases: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Rows whose text holds none of the phrases; a NULL text is kept."""
    return with_phrase_hits(df, column, phrases, ignore_case).where(~F.col("_held")).drop("_held")


def rows_with_phrases(df: DataFrame, column: str, phrases: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Rows whose text holds any of the phrases."""
    return with_phrase_hits(df, column, phrases, ignore_case).where("_held").drop("_held")
