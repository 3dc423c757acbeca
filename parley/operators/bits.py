"""Sets of numbers as bits of a fixed size: members are always found, others hardly ever."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of a bucket of Spark's bitmap functions.
BUCKET = 1 << 15


def bit_set(df: DataFrame, number: Column, size: int) -> np.ndarray:
    """The bits of the numbers of a column, each modulo ``size``; what reaches the driver is size / 8 bytes at most."""
    place = F.pmod(number, F.lit(size)) + 1  # the functions number bits from 1
    rows = df.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    bits = np.zeros(max(size, BUCKET) // 8, np.uint8)
    for row in rows.where("bucket is not null").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        start = (row["bucket"] - 1) * (BUCKET // 8)
        bits[start:start + BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def is_set(bits: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """Whether the bits of some numbers are set."""
    place = numbers % size
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def may_hold(spark: SparkSession, bits: np.ndarray, size: int):
    """Function from a column of numbers to whether their bits are set; a missing number has none."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            known = batch.is_valid().to_numpy(zero_copy_only=False)
            yield pa.array(known & is_set(shared.value, batch.fill_null(0).to_numpy(zero_copy_only=False), size))

    return held
