"""Column functions over Arrow batches, for what has no JVM form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: An Arrow batch holds so many bytes and rows at most, so long texts can't fill a worker.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4096


def bounded(df: DataFrame) -> DataFrame:
    """``df`` in a session whose Arrow batches are bounded. Settings are only tightened, never widened, as plans read
    them when they run: so no operator undoes another's bound."""
    conf = df.sparkSession.conf
    for name, top in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= top):
            conf.set(name, str(top))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over the session's shuffle partitions: for small rows whose work comes after, as small files make few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over so many partitions that one has about ``rows`` rows, the session's shuffle partitions
    at least: what a task holds doesn't grow with the input. ``df`` is counted first, so it should be cheap to read."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def with_columns(df: DataFrame, source: str, added: str, f: Callable[[list], list[list]]) -> DataFrame:
    """``df`` with the columns of the DDL ``added``: ``f`` takes the values of one column and gives a list a new one."""
    new = StructType.fromDDL(added)
    out = df.drop(*new.names)
    names, where = out.columns, out.columns.index(source)
    schema = StructType(out.schema.fields + new.fields)
    kinds = _arrow(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = f(b.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, type=k) for c, k in zip(made, kinds, strict=True)]], names=[*names, *schema.names[len(names) :]])

    return bounded(out).mapInArrow(run, schema)


def flat_map(df: DataFrame, key: str, source: str, made: str, f: Callable[[object], list[tuple]]) -> DataFrame:
    """(key, made...) rows: ``f`` gives tuples for each value of ``source``."""
    rows = df.select(key, source)
    new = StructType.fromDDL(made)
    schema = StructType([rows.schema[key], *new.fields])
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(k, *x) for x in f(v)]
                if len(out) > 65_536:
                    yield _batch(out, kinds, schema.names)
                    out = []
            if out:
                yield _batch(out, kinds, schema.names)

    return bounded(rows).mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _arrow(schema: StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
