import hashlib

import pytest
from pyspark.sql import functions as F

from parley.operators import ordering as O

N = 1000


@pytest.fixture(scope="module")
def rows(spark):
    # keys far apart and one dense run, so that ranges differ much in size
    return spark.range(N).select(
        F.when(F.col("id") < 700, F.col("id")).otherwise(F.col("id") * 10**12).alias("key"),
        (F.col("id") % 7).alias("length"),
    )


def keys(rows):
    return sorted(r["key"] for r in rows.select("key").collect())


def shuffled(values, seed):
    return sorted(values, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())


@pytest.fixture(params=["direct", "narrowed"])
def narrowing(request, monkeypatch):
    if request.param == "narrowed":
        monkeypatch.setattr(O, "DIRECT_SORT_KEYS", 3)
        monkeypatch.setattr(O, "HISTOGRAM_BUCKETS", 16)


@pytest.mark.parametrize("n", [0, 1, 37, 699, 700, 701, 999, 1000])
def test_last_and_first(rows, narrowing, n):
    everything = keys(rows)
    assert keys(O.first_n(rows, n, "key")) == everything[:n]
    assert keys(O.last_n(rows, n, "key")) == everything[N - n :]


@pytest.mark.parametrize("n", [1, 250])
def test_sample_is_exact_and_repeatable(rows, narrowing, n):
    got = keys(O.sample_n(rows, n, "key", seed=3))
    assert got == sorted(shuffled(keys(rows), 3)[:n])


def test_sample_larger_than_table(rows):
    with pytest.raises(ValueError):
        O.sample_n(rows, N + 1, "key")
    assert O.sample_n(rows, N + 1, "key", strict=False).count() == N


def test_shuffle_numbers_every_row_once(rows):
    got = [r["key"] for r in O.number_rows(rows, "key", 5).orderBy("seq").collect()]
    assert got == shuffled(keys(rows), 5)
    assert O.number_rows(rows, "key").agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first() == (1, N, N)


@pytest.mark.parametrize("share", [0.2, 0.4, 0.5])
def test_positional_split_uses_the_float_index(rows, narrowing, share):
    split = O.positional_split(rows, "key", share)
    expected = int(N * (1 - share))
    train = keys(split.where("split = 'train'"))
    assert train == sorted(shuffled(keys(rows), 42)[:expected])
    assert split.where("split = 'eval'").count() == N - expected


def test_half_split_rounds_the_test_side_up(spark):
    odd = spark.range(7).withColumnRenamed("id", "key")
    counts = dict(O.share_split(odd, "key", 0.5).groupBy("split").count().collect())
    assert counts == {"test": 4, "train": 3}


def test_drop_last_of_one_split(spark):
    rows = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(10)], "seq bigint, split string")
    left = O.drop_last(rows, 2, "seq", "train")
    assert sorted(r["seq"] for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_row_window(rows, narrowing):
    assert keys(O.row_window(rows, 698, 5, "key")) == keys(rows)[698:703]


def test_length_batches_are_bounded_and_ordered(rows):
    batched = O.length_batches(rows, "key", F.col("length"), 4, mega_factor=5)
    sizes = [r["count"] for r in batched.groupBy("batch").count().collect()]
    assert sum(sizes) == N and max(sizes) <= 4
    spans = batched.groupBy("mega_batch", "batch").agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    by_mega = {}
    for r in spans.orderBy("batch").collect():
        by_mega.setdefault(r["mega_batch"], []).append(r)
    for batches in by_mega.values():
        assert all(a["lo"] >= b["hi"] for a, b in zip(batches, batches[1:]))


def test_empty_table(spark):
    empty = spark.range(0).withColumnRenamed("id", "key")
    assert O.last_n(empty, 3, "key").count() == 0
    assert O.sample_n(empty, 3, "key", strict=False).count() == 0


def test_repeated_keys_are_refused(spark):
    df = spark.createDataFrame([(i // 3,) for i in range(30)], "k bigint")
    with pytest.raises(ValueError, match="repeat"):
        O.sample_n(df, 4, "k")
    with pytest.raises(ValueError, match="repeat"):
        O.first_n(df, 4, "k")
    assert O.first_n(df, 6, "k").count() == 6
