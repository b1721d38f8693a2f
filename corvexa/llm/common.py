"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvexa.functions.arrow import bounded
from corvexa.plans.lineage import Workspace  # noqa: F401


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that long texts cannot fill a Python worker, and the reader's rows that feed them."""
    bounded(spark.range(0))
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > 1024:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")


def _release() -> None:
    """Give a worker's freed memory back: workers are kept for later tasks, which other operators may bring."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in bounded batches, whose workers return their memory at the end of each task."""
    bounded_batches(df.sparkSession)

    def released(batches):
        yield from run(batches)
        _release()

    return df.mapInArrow(released, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def doc_hash(column: str = "doc_id"):
    """crc32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def hash_bound(share: float) -> int:
    """The long that about ``share`` of all 64-bit hashes don't exceed."""
    return min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
