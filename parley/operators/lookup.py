"""Sums of weight vectors over the items of a text, with a weight table of any size and no row per item.

The most frequent items of the table are broadcast, a fixed number of bounded length, and are summed inside the row, by
whole batches. A table that fits in them needs nothing else. Otherwise the sums and the remaining items of each text are
written once, without the text; only those items, which are few, are shuffled to their weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import materialize

#: Items that are broadcast, and their length in characters at most: 2^16 items of 256 bytes and their weights.
FREQUENT_ITEMS = 1 << 16
ITEM_CHARS = 64
#: Rows whose items are looked up at once.
SLICE = 512
OTHERS = pa.struct([("item", pa.string()), ("n", pa.int64())])
LOOKED = "sums array<double>, known bigint, others array<struct<item: string, n: bigint>>"


def _looked_up(items: pa.ListArray, names: pa.Array, table: np.ndarray) -> pa.StructArray:
    """Sums of the weights of the known items of each row, their number, and the other items with their counts."""
    lengths = pc.fill_null(items.value_lengths(), 0).to_numpy(zero_copy_only=False)
    rows, values = np.repeat(np.arange(len(items)), lengths), items.flatten()
    place = pc.index_in(values, value_set=names)
    missing = place.is_null().to_numpy(zero_copy_only=False)
    found, of = place.drop_null().to_numpy(zero_copy_only=False), rows[~missing]
    sums = np.column_stack([np.bincount(of, w[found], len(items)) for w in table.T])
    known = np.bincount(of, minlength=len(items)).astype(np.int64)
    others = pa.table({"row": rows[missing], "item": values.filter(pa.array(missing))})
    others = others.group_by(["row", "item"]).aggregate([([], "count_all")]).sort_by("row")
    ends = np.cumsum(np.bincount(others["row"].to_numpy(), minlength=len(items)))
    counted = pa.StructArray.from_arrays([pc.cast(others["item"].combine_chunks(), pa.string()),
                                          others["count_all"].combine_chunks()], fields=list(OTHERS))
    places = np.arange(0, sums.size + 1, table.shape[1])
    return pa.StructArray.from_arrays([
        pa.ListArray.from_arrays(places.astype(np.int32), pa.array(sums.ravel())), pa.array(known),
        pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), counted),
    ], names=["sums", "known", "others"])


def with_weight_sums(
    df: DataFrame, text: str, items: Callable[[Column], Column], weights: DataFrame, key: str, width: int,
    cut: Callable[[pa.Array], pa.ListArray] | None = None,
) -> DataFrame:
    """``df`` with ``_sums`` (per position the sum of the weights of all items of a text) and ``_known`` (items with weights).

    ``weights`` has columns item, n (its frequency) and w (array of ``width`` doubles). With ``cut``, ``items`` gives texts and
    ``cut`` the items of a slice of them.
    """
    short = F.length("item") <= ITEM_CHARS
    top = weights.where(short).orderBy(F.desc("n"), "item").limit(FREQUENT_ITEMS).select("item", "n", "w").toArrow()
    names = pc.cast(top["item"].combine_chunks(), pa.string()) if top.num_rows else pa.array([], pa.string())
    table = top["w"].combine_chunks().flatten().to_numpy().reshape(len(names), width) if len(names) else np.zeros((0, width))
    shared = df.sparkSession.sparkContext.broadcast((names, table))

    @F.arrow_udf(f"struct<{LOOKED}>")
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, table = shared.value
        for batch in batches:
            slices = (batch.slice(s, SLICE) for s in range(0, max(len(batch), 1), SLICE))
            yield pa.concat_arrays([_looked_up(cut(part) if cut else part, names, table) for part in slices])

    looked = summed(items(F.col(text)))
    if weights.count() == len(names):
        found = df.withColumn("_looked", looked)
        return found.select(*df.columns, F.col("_looked.sums").alias("_sums"), F.col("_looked.known").alias("_known"))
    # a key that rows with other texts repeat is told apart by its text
    own, told = F.col(key), F.xxhash64(text)
    narrow = materialize(df.select(own.alias("_key"), told.alias("_hash"), looked.alias("_looked")).select(
        "_key", "_hash", "_looked.*").dropDuplicates(["_key", "_hash"]), "weight-sums")
    rare = weights
    if len(names):
        last_n, last = top["n"][-1].as_py(), names[-1].as_py()
        rare = weights.where(~(short & ((F.col("n") > last_n) | ((F.col("n") == last_n) & (F.col("item") <= last)))))
    asked = narrow.select("_key", "_hash", F.inline("others"))
    more = asked.withColumnRenamed("n", "_n").join(rare.select("item", "w"), "item").groupBy("_key", "_hash").agg(
        F.sum("_n").alias("_rare_known"), F.array(*[F.sum(F.col("w")[k] * F.col("_n")) for k in range(width)]).alias("_rare"))
    total = F.when(F.col("_rare").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "_rare", lambda a, b: a + b))
    sums = narrow.join(more, ["_key", "_hash"], "left").select(
        "_key", "_hash", total.alias("_sums"), (F.col("known") + F.coalesce("_rare_known", F.lit(0))).alias("_known"))
    rows = df.withColumn("_told", told)
    joined = rows.join(sums, own.eqNullSafe(F.col("_key")) & (F.col("_told") == F.col("_hash")))
    return joined.select(*df.columns, "_sums", "_known")
