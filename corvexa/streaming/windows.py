"""Streaming operators: watermarked windows, sessions, signed deltas, sinks that are written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, window: Column, delay: str, *by: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling, sliding or session windows; later rows than ``delay`` are dropped."""
    grouped = events.withWatermark(time, delay).groupBy(window.alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")


def net_deltas(changes: DataFrame, *key: str, diff: str = "diff") -> DataFrame:
    """Tuples whose signed changes add up to more than nothing."""
    return changes.groupBy(*key).agg(F.sum(diff).alias("count")).where("count > 0")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Process what is there and stop; files and checkpoint together write each row once."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch: a state a key that grows with its events, kept by the stream itself."""
    from collections.abc import Iterator

    import pandas as pd

    kinds = dict(events.dtypes)

    def grow(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0)
        for b in batches:
            n, total = n + len(b), total + int(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [name[0]], "n": [n], "total": [total]})

    return events.select(key, value).groupBy(key).applyInPandasWithState(grow, f"`{key}` {kinds[key]}, n long, total long", "n long, total long", "update", "NoTimeout")


def upsert_batches(df: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Each micro-batch handed to ``apply(batch, epoch)``: incremental state that lives in a table."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
