"""Tables at rest: reading, inspecting, snapshots, CSV; publishing of splits is in ``published``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.ordering import sample_n
from parley.sources.published import append_and_publish, publish_split, restore, versions  # noqa: F401

#: Inputs up to this size are spread over the cores; larger ones have enough row groups to fill them.
SMALL_INPUT_BYTES = 256 << 20


CSV_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: A missing text is written as nothing, an empty one as two quotes; read back, a missing one first becomes the mark.
CSV_WRITTEN = {"emptyValue": '""', "nullValue": ""}
CSV_READ = {"emptyValue": "", "nullValue": "\u0000missing\u0000", "multiLine": "true"}


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Data files and their sizes in bytes, from the listing alone."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def list_files(df: DataFrame) -> DataFrame:
    """Files behind a table with their sizes and rows."""
    return df.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count("*").alias("rows"))


def is_small(df: DataFrame, path: str) -> bool:
    """Whether a table has fewer files than there are cores and SMALL_INPUT_BYTES at most."""
    spark = df.sparkSession
    if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism:
        return False
    return file_sizes(spark, path).agg(F.sum("bytes")).first()[0] <= SMALL_INPUT_BYTES


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Read a parquet table.

    ``spread`` is for work that is heavy per row: a small input, which one row group and so one core would read, is
    dealt out to all cores. Beyond that the scan is parallel by itself and nothing moves.
    """
    df = spark.read.parquet(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if spread and is_small(df, path) else df


def read_split(spark: SparkSession, path: str, split: str, schema: T.StructType | None = None) -> DataFrame:
    """One split of a dataset; other splits are pruned by their folder."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).where(F.col("split") == split)


def sample_one_file(spark: SparkSession, path: str, n: int, key: str, seed: int = 42, strict: bool = True,
                    named: str = "[^/]+$") -> DataFrame:
    """``n`` random rows of one randomly chosen file; the other files are not read.

    The draw goes by what the pattern ``named`` finds in a file's path, the file name if not given. File names that Spark
    makes up differ with every write; with one file a folder, ``column=[^/]+`` draws the same rows again.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.regexp_extract("path", named, 0)))
    chosen = file_sizes(spark, path).orderBy(draw, "path").select("path").first()["path"]
    return sample_n(spark.read.option("basePath", path).parquet(chosen), n, key, seed, strict)


def date_stamp(day: date | None = None) -> str:
    """yyyymmdd of today or of a given day, fixed once on the driver."""
    return (day or date.today()).strftime("%Y%m%d")


def snapshot(dataset: DataFrame, base: str, name: str = "nli", day: date | None = None) -> str:
    """Write all splits to a dated folder; fails if it exists. Returns the folder."""
    path = f"{base.rstrip('/')}/{name}_{date_stamp(day)}"
    dataset.write.partitionBy("split").mode("errorifexists").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns are written as JSON text. Blanks around texts and empty texts are kept."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields
    ]
    df.select(*columns).write.options(**CSV_OPTIONS, **CSV_WRITTEN).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV written by write_csv; texts may span lines."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, **CSV_READ).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Records written in the code, with a declared schema."""
    return spark.createDataFrame(rows, schema)
