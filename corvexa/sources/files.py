"""File sources and sinks: byte ranges, include resolution, binary corpora, parquet write-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def byte_range(files: DataFrame, offset: int, length: int) -> DataFrame:
    """The bytes [offset, offset + length) of each file; shorter where the file ends."""
    return files.withColumn("content", F.substring("content", offset + 1, length))


def write_back(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet, written through a committer: a lost executor leaves no part file behind."""
    (df if partitions is None else df.repartition(partitions)).write.mode("overwrite").parquet(path)


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """includes(k, name) with the file that bears the name, by hash and then by name; null where none does."""
    keyed = files.select(F.xxhash64("name").alias("h"), F.col("name").alias("file"), "content")
    hit = includes.withColumn("h", F.xxhash64("name")).join(keyed, ["h"], "left").where("file IS NULL OR file = name")
    return hit.select("k", "name", F.col("content"))


def map_corpus(files: DataFrame, f, schema: str) -> DataFrame:
    """A function of (path, bytes) that yields rows, over a corpus of files."""
    from corvexa.functions.arrow import flat_map

    return flat_map(files, "path", "content", schema, f)
