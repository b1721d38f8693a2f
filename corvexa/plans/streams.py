"""Stream queries over events. The batch plans are those of the streams; the ``stream_`` queries run streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvexa.registry import query, table
from corvexa.streaming import windows


#: Files of a batch; each has some of its rows.
FILES = 8
#: Events that come late.
_LATE = "event_id % 20 = 7"


def events(spark, sf_dir):
    t = table(spark, sf_dir, "events", "ts", "event_id", "user_id", "event_type", "value")
    return t.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.round("value", 2).cast("decimal(18,2)"))


_VALUE = "CAST(round(sum(CAST(round(value, 2) AS DECIMAL(18,2))), 2) AS DOUBLE)"


def _plain(df):
    return df.withColumn("total", F.col("total").cast("double")).withColumn("start", F.unix_micros("start")).withColumn("stop", F.unix_micros("stop"))


@query(f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS start, epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) + 3600000000 AS stop, event_type, count(*) AS n, {_VALUE} AS total FROM events GROUP BY 1, 2, 3")
def tumbling_window(spark, sf_dir):
    return _plain(windows.windowed(events(spark, sf_dir), "ts", F.window("ts", "1 hour"), "1 hour", "event_type"))


@query(f"""SELECT s AS start, s + 7200000000 AS stop, event_type, count(*) AS n, {_VALUE} AS total FROM (SELECT *, unnest([b, b - 3600000000]) AS s FROM (SELECT *, epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS b FROM events)) GROUP BY 1, 2, 3""")
def sliding_window(spark, sf_dir):
    return _plain(windows.windowed(events(spark, sf_dir), "ts", F.window("ts", "2 hours", "1 hour"), "1 hour", "event_type"))


@query(f"""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS f FROM events), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM f)
SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS stop, user_id, count(*) AS n, {_VALUE} AS total FROM r GROUP BY user_id, r""")
def session_window(spark, sf_dir):
    return _plain(windows.windowed(events(spark, sf_dir), "ts", F.session_window("ts", "30 minutes"), "1 hour", "user_id"))


@query("SELECT user_id, event_type, count FROM (SELECT user_id, event_type, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS count FROM events GROUP BY 1, 2) WHERE count > 0")
def delta_arrangement(spark, sf_dir):
    """Signed changes of tuples, netted."""
    changes = events(spark, sf_dir).withColumn("diff", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))
    return windows.net_deltas(changes, "user_id", "event_type")


def _batches(spark, sf_dir, *columns: str):
    """A stream of three batches: the earlier half of the events, the later half, and rows of both that come late."""
    from corvexa.plans.lineage import Workspace

    e = table(spark, sf_dir, "events", *columns).withColumn("ts", F.col("ts").cast("timestamp"))
    middle = e.agg(F.percentile(F.unix_micros("ts"), F.lit(0.5))).first()[0]
    early, late = F.unix_micros("ts") <= middle, F.expr(_LATE)
    ws = Workspace(spark, "stream")
    for k, part in enumerate((e.where(early & ~late), e.where(~early & ~late), e.where(late))):
        part.repartition(FILES).write.parquet(f"{ws.root}/in/{k}")  # a stream takes files in the order of their times
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", "true").parquet(f"{ws.root}/in")
    return stream, ws.root


def _last_of_each(spark, stream, root: str, mode: str, *key: str):
    """What a stream leaves of each key: batches are written as they come, with their number, and the last one counts."""

    def keep(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/{epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    out = spark.read.option("recursiveFileLookup", "true").schema(StructType([*stream.schema.fields, StructField("epoch", LongType())])).parquet(f"{root}/out")
    return out.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


@query(f"""WITH m AS (SELECT quantile_cont(epoch_us(ts), 0.5) AS middle FROM events), e AS (SELECT epoch_us(ts) AS t, event_type, {_LATE} AS late FROM events), mark AS (SELECT max(t) - 3600000000 AS mark FROM e, m WHERE t <= middle AND NOT late)
SELECT t // 3600000000 * 3600000000 AS start, event_type, count(*) AS n FROM e, mark WHERE NOT late OR t // 3600000000 * 3600000000 + 3600000000 > mark GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir):
    """Hourly windows of a stream with a watermark: late rows of windows that it has passed are dropped, others still count.

    A batch's late rows are judged by the watermark that held when the batch before it began.
    """
    stream, root = _batches(spark, sf_dir, "ts", "event_id", "event_type")
    w = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = _last_of_each(spark, w.select(F.unix_micros("w.start").alias("start"), "event_type", "n"), root, "update", "start", "event_type")
    return out.select("start", "event_type", "n")


@query("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark, sf_dir):
    """State a user that a stream keeps across its batches."""
    stream, root = _batches(spark, sf_dir, "ts", "event_id", "user_id")
    return _last_of_each(spark, windows.running_totals(stream, "user_id", "event_id"), root, "update", "user_id")
