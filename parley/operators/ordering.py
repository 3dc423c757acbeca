"""Order-based operators that never sort a whole table in one task.

Random order is the md5 order of a seeded key, so every run (and the SQL oracle) agrees on it. Keys have to be unique
and not NULL.
Cuts at a rank ("the n smallest") are found by narrowing a bucket histogram on the key column alone; the wide
rows are then filtered by a literal bound, without any shuffle. Only operators that must number every row
shuffle it, by buckets of the order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per narrowing round; bounds the histogram that reaches the driver.
HISTOGRAM_BUCKETS = 1 << 12
#: The same for md5 texts: 16**3 buckets of leading hex digits.
HISTOGRAM_DIGITS = 3
#: A range with at most this many keys is sorted directly.
DIRECT_SORT_KEYS = 1 << 18
#: Leading hex digits of the md5 that name a bucket: 16**4 = 65,536 buckets of even size.
HASH_BUCKET_DIGITS = 4


def hash_order(key: Column, seed: int | str) -> Column:
    """The md5 text that stands for a random draw of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


@dataclass(frozen=True)
class Cut:
    """Rows at or below ``bound`` of ``order`` are the first ``taken`` of ``total`` rows."""

    order: Column
    bound: int | str | None
    taken: int
    total: int

    def inside(self) -> Column:
        if self.taken == 0:
            return F.lit(False)
        if self.bound is None:
            return F.lit(True)
        return self.order <= F.lit(self.bound)


def _whole(order: Column, n: int, total: int) -> Cut | None:
    """The cut that takes no row or all rows, if ``n`` asks for one of them."""
    return Cut(order, None, max(0, min(n, total)), total) if n >= total or n <= 0 else None


def _bucket_of_rank(counts: dict, rank: int) -> tuple:
    """The bucket that holds a rank, the rows in buckets before it and the rows in it."""
    before = 0
    for bucket in sorted(counts):
        if before + counts[bucket] >= rank:
            return bucket, before, counts[bucket]
        before += counts[bucket]
    raise ValueError(f"rank {rank} is beyond {before} rows")


def _last_inside(rest: DataFrame, name: str, rank: int, available: int):
    """The ``rank``-th smallest of the first ``rank + 1`` keys; a key that goes on beyond the cut is refused."""
    last = [r[0] for r in rest.orderBy(F.desc(name)).limit(2).collect()]
    if available <= rank:
        return last[0]
    if last[0] == last[1]:
        raise ValueError("keys repeat; the cut needs a key that is unique per row")
    return last[1]


def cut_at_rank(df: DataFrame, order: Column, n: int) -> Cut:
    """The value of a unique integer ``order`` that ends the first ``n`` rows.

    Each round counts rows in at most HISTOGRAM_BUCKETS equal ranges (map-side combined) and narrows to the
    range holding the rank, so only key values of one small range are ever sorted.
    """
    keys = df.select(order.alias("o"))
    low, high, total = keys.agg(F.min("o"), F.max("o"), F.count("o")).first()
    whole = _whole(order, n, total)
    if whole:
        return whole
    rank, inside = n, total
    while inside > DIRECT_SORT_KEYS and high > low:
        width = (high - low) // HISTOGRAM_BUCKETS + 1
        bucket = F.call_function("div", F.col("o") - F.lit(low), F.lit(width))
        ranged = keys.where(F.col("o").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*"))
        b, before, inside = _bucket_of_rank(dict(ranged.collect()), rank)
        rank -= before
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    rest = keys.where(F.col("o").between(low, high)).orderBy("o").limit(rank + 1)
    return Cut(order, _last_inside(rest, "o", rank, inside), n, total)


def random_cut(
    df: DataFrame, key: str, seed: int | str, n: int | None = None, share: float | None = None
) -> Cut:
    """The md5 that ends the first ``n`` rows (or int(total * share) rows) of the random order.

    Like cut_at_rank, with the leading hex digits of the md5 as buckets.
    """
    order = hash_order(F.col(key), seed)
    keys = df.select(order.alias("h"))
    prefix, rank, inside, total = "", None, None, None
    while inside is None or (inside > DIRECT_SORT_KEYS and len(prefix) < 30):
        digits = F.substring("h", len(prefix) + 1, HISTOGRAM_DIGITS)
        ranged = keys.where(F.startswith("h", F.lit(prefix))).groupBy(digits.alias("b")).agg(F.count("*"))
        counts = dict(ranged.collect())
        if total is None:
            total = sum(counts.values())
            n = int(total * share) if share is not None else n
            whole = _whole(order, n, total)
            if whole:
                return whole
            rank = n
        b, before, inside = _bucket_of_rank(counts, rank)
        rank -= before
        prefix += b
    rest = keys.where(F.startswith("h", F.lit(prefix))).orderBy("h").limit(rank + 1)
    return Cut(order, _last_inside(rest, "h", rank, inside), n, total)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, strict: bool = True) -> DataFrame:
    """Exactly ``n`` random rows without replacement; ``strict`` raises when there are fewer."""
    cut = random_cut(df, key, seed, n)
    if strict and n > cut.total:
        raise ValueError(f"cannot take {n} rows out of {cut.total}")
    return df.where(cut.inside())


def last_n(df: DataFrame, n: int, seq: str) -> DataFrame:
    """The ``n`` rows with the largest ``seq``."""
    return df.where(cut_at_rank(df, -F.col(seq), n).inside())


def first_n(df: DataFrame, n: int, seq: str) -> DataFrame:
    """The ``n`` rows with the smallest ``seq``."""
    return df.where(cut_at_rank(df, F.col(seq), n).inside())


def drop_last(df: DataFrame, n: int, seq: str, split: str | None = None) -> DataFrame:
    """Drop the last ``n`` records, of one split when it is named."""
    target = F.lit(True) if split is None else F.col("split") == split
    cut = cut_at_rank(df.where(target), -F.col(seq), n)
    return df.where(~(F.coalesce(target, F.lit(False)) & cut.inside()))


def row_window(df: DataFrame, start: int, size: int, seq: str) -> DataFrame:
    """``size`` consecutive rows from 0-based position ``start`` in ``seq`` order."""
    upto = cut_at_rank(df, F.col(seq), start + size)
    skip = cut_at_rank(df, F.col(seq), start)
    return df.where(upto.inside() & ~skip.inside())


def positional_split(df: DataFrame, key: str, eval_share: float, seed: int = 42) -> DataFrame:
    """Add ``split``: the first int(N * (1 - eval_share)) rows of the random order train, the others evaluate."""
    cut = random_cut(df, key, seed, share=1 - eval_share)
    return df.withColumn("split", F.when(cut.inside(), "train").otherwise("eval"))


def share_split(df: DataFrame, key: str, test_share: float, seed: int = 38) -> DataFrame:
    """Add ``split``: ceil(N * test_share) rows of the random order test, the others train."""
    total = df.count()
    cut = random_cut(df, key, seed, total - math.ceil(total * test_share))
    return df.withColumn("split", F.when(cut.inside(), "train").otherwise("test"))


def number_rows(df: DataFrame, key: str, seed: int = 42, name: str = "seq") -> DataFrame:
    """A full random shuffle: add the 1-based rank in md5 order.

    Rows meet by md5 bucket (even by construction for a unique key); ranks inside a bucket are offset by the
    counts of the buckets before it, a table of at most 65,536 rows.
    """
    bucket = F.left(F.col("_h"), F.lit(HASH_BUCKET_DIGITS))
    hashed = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", bucket)
    running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.select(hash_order(F.col(key), seed).alias("_h"))
        .groupBy(bucket.alias("_b"))
        .agg(F.count("*").alias("_n"))
        .select("_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return (
        hashed.withColumn("_r", inside)
        .join(F.broadcast(offsets), "_b")
        .withColumn(name, F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def length_batches(
    df: DataFrame, key: str, length: Column, batch_size: int, seed: int = 42, mega_factor: int = 50
) -> DataFrame:
    """Batches of rows of like length: random mega-batches, sorted by length inside, cut into batches.

    A mega-batch holds ``batch_size * mega_factor`` rows, so each task sorts a bounded group. Inside a
    mega-batch the longest rows come first.
    """
    mega = batch_size * mega_factor
    ranked = number_rows(df.withColumn("_len", length), key, seed, "_seq").withColumn(
        "mega_batch", F.call_function("div", F.col("_seq") - 1, F.lit(mega))
    )
    place = F.row_number().over(Window.partitionBy("mega_batch").orderBy(F.desc("_len"), key))
    batch = F.col("mega_batch") * mega_factor + F.call_function("div", place - 1, F.lit(batch_size))
    return ranked.withColumn("batch", batch).drop("_len", "_seq")
