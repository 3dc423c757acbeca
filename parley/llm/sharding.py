"""Operator 5, sharding by extendible hashing.

A directory is indexed by the first bits of a key's hash. It starts with one bucket; only a bucket whose rows exceed the
byte limit is split on its next bit, until every shard fits. A shard is named by its hash prefix.

The sizes of all prefixes of LEVEL_BITS more bits are sums of one aggregation, which combines before the shuffle; deeper
levels only read the rows of buckets that are still too large. Rows with equal keys have equal hashes, so behind the 64 bits
of the key's hash come 32 bits that number equal rows by place in the input: a hot key is split like any other bucket.

Edge cases: a single row above the limit is a shard of its own and marked ``oversized``. A null key hashes like an empty one,
a null text has 0 bytes. An empty table has no shards. Other columns pass through ``write_shards``; one named
``shard_id`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.exprs import columns_but, free_name
from parley.session import materialize

#: Bytes of text in a shard at most.
LIMIT_BYTES = 16 << 20
#: Bits by which a round refines the buckets that are too large; a round sees 2^LEVEL_BITS prefixes of each.
LEVEL_BITS = 10
KEY_BITS, ROW_BITS = 64, 32


def hash_bits(key: Column) -> Column:
    """First 64 bits of the MD5 of a key's text as a string of 0 and 1."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    halves = [F.lpad(F.conv(F.substring(digest, start, 8), 16, 2), 32, "0") for start in (1, 9)]
    return F.concat(*halves)


def row_bits() -> Column:
    """Bits that tell equal keys apart, spread by a hash of the row's place in the input."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    return F.lpad(F.bin(place), ROW_BITS, "0")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Shards (shard_id, shard_bytes, shard_rows, oversized) of rows with columns bits and bytes."""
    last = KEY_BITS + ROW_BITS
    open_rows, depth, found = rows, 0, []
    while True:
        end = min(depth + LEVEL_BITS, last)
        cells = open_rows.groupBy(F.substring("bits", 1, end).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        lengths = F.explode(F.sequence(F.lit(depth), F.lit(end))).alias("length")
        sizes = (cells.select("*", lengths)
                 .groupBy("length", F.expr("left(cell, length)").alias("shard_id"))
                 .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")))
        whole = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("length") == last)
        sizes = materialize(sizes.withColumn("whole", whole), "shard-sizes")
        # a prefix is a shard if it is whole and the prefix one bit shorter is not; the first level has no parent here
        parents = sizes.filter(~F.col("whole")).select(F.col("shard_id").alias("parent"), F.col("length").alias("above"))
        fitting = sizes.filter("whole")
        shards = fitting.filter(F.col("length") == depth).unionByName(
            fitting.filter(F.col("length") > depth).join(
                parents, (F.expr("left(shard_id, length - 1)") == F.col("parent")) & (F.col("length") - 1 == F.col("above")),
                "left_semi"))
        found.append(shards.select("shard_id", "shard_bytes", "shard_rows",
                                   (F.col("shard_bytes") > limit).alias("oversized")))
        if end == last or sizes.filter((F.col("length") == end) & ~F.col("whole")).isEmpty():
            break
        large = sizes.filter((F.col("length") == end) & ~F.col("whole")).select(F.col("shard_id").alias("cell"))
        open_rows = open_rows.join(large, F.substring("bits", 1, end) == F.col("cell"), "left_semi")
        depth = end
    shards = found[0]
    for more in found[1:]:
        shards = shards.unionByName(more)
    return shards


def _placed(docs: DataFrame, key: str, text: str, bytes_: str, bits: str) -> DataFrame:
    """The documents with the bytes of their text and the bits that place them."""
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    return docs.withColumns({bytes_: size, bits: F.concat(hash_bits(F.col(f"`{key}`")), row_bits())})


def assigned(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """Narrow table of a row's key, bytes, shard_id, shard_bytes, shard_rows and oversized."""
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = materialize(_placed(narrow, "key", "text", "bytes", "bits").drop("text"), "shard-rows")
    found = _with_shard(rows, directory(rows, limit), "bits")
    return found.select(F.col("key").alias(key), "bytes", "shard_id", "shard_bytes", "shard_rows", "oversized")


def _with_shard(rows: DataFrame, shards: DataFrame, bits: str) -> DataFrame:
    """Rows with the columns of the one shard whose id begins their bits; the shards are prefix-free."""
    shards = materialize(shards, "shards")
    lengths = sorted(r["n"] for r in shards.select(F.length("shard_id").alias("n")).distinct().collect())
    # the lengths are at most KEY_BITS + ROW_BITS + 1 numbers, each a plain join on a prefix
    prefixes = F.array(*[F.left(F.col(bits), F.lit(n)) for n in lengths]).cast("array<string>")
    return rows.withColumn("shard_id", F.explode(prefixes)).join(shards, "shard_id")


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write the documents partitioned by shard_id.

    The bits that place a row are written with it, so rows with equal or null keys go to their own shards.
    """
    others = docs.select(*columns_but(docs, ["shard_id"]))
    size, bits = free_name(others, "shard_row_bytes"), free_name(others, "shard_row_bits")
    rows = materialize(_placed(others, key, text, size, bits), "shard-rows")
    found = directory(rows.select(F.col(f"`{size}`").alias("bytes"), F.col(f"`{bits}`").alias("bits")), limit)
    found = found.select("shard_id")
    # a prefix is looked up in a column of its own, and joined with the whole row once it is the right one
    placed = _with_shard(rows, found, bits).select(*columns_but(others, []), "shard_id")
    placed.repartition("shard_id").write.partitionBy("shard_id").parquet(folder)


ORACLE = f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT doc_id, bytes, list_reduce(list_transform(range(1, 9), lambda i: lpad(bin(CAST('0x' || h[i] AS INTEGER)), 4, '0')),
             lambda x, y: x || y) AS bits FROM r),
p AS (SELECT doc_id, bytes, unnest(range(0, 33)) AS n, bits FROM b),
s AS (SELECT n, left(bits, n) AS shard_id, sum(bytes) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
f AS (SELECT doc_id, p.bytes, s.* FROM p JOIN s ON s.n = p.n AND s.shard_id = left(bits, p.n)
      WHERE shard_bytes <= {LIMIT_BYTES} OR shard_rows = 1)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, shard_id, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows,
       shard_bytes > {LIMIT_BYTES} AS oversized
FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1
"""
