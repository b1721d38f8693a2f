"""Reductions, scans, segments, sorting and compaction over the order tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corvexa.functions import u32
from corvexa.operators import reduce
from corvexa.operators.scan import prefix_scan
from corvexa.registry import query, table

_Q = "CAST(l_quantity AS BIGINT)"
_PRICE = "CAST(round(o_totalprice) AS BIGINT)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("pos"), F.round("o_totalprice").cast("long").alias("v"))


@query("""SELECT CAST(sum(v) % 4294967296 AS BIGINT) AS total, CAST(count_if(v <> 0) AS BIGINT) AS non_zero, bool_or(v <> 0) AS any, bool_and(v <> 0) AS all, min(v) AS least, max(v) AS most, round(avg(v), 2) AS mean,
 CAST(sum(bit_count(v)) AS BIGINT) AS bits, round(CAST(sum(CAST(v AS DOUBLE) * v) - sum(CAST(v AS DOUBLE)) * sum(CAST(v AS DOUBLE)) / count(*) AS DOUBLE) / 1e18, 1) AS deviations
 FROM (SELECT (l_orderkey * 2654435761) % 4294967296 AS v FROM lineitem)""")
def reduce_all(spark, sf_dir):
    """Every scalar reduction in one pass: wrapping sum, counts, any, all, extremes, mean, set bits, squared deviations."""
    t = table(spark, sf_dir, "lineitem", "l_orderkey").select(u32.mul(F.col("l_orderkey"), 2654435761).alias("v"))
    v = F.col("v")
    return t.agg(reduce.wrapping_sum(v).alias("total"), F.count_if(v != 0).alias("non_zero"), F.bool_or(v != 0).alias("any"), F.bool_and(v != 0).alias("all"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 2).alias("mean"), F.sum(u32.popcount(v)).alias("bits"), F.round(F.var_pop(v) * F.count(v) / 1e18, 1).alias("deviations"))


@query("SELECT b AS bin, count(p_size) AS count FROM range(64) r(b) LEFT JOIN part ON p_size = b GROUP BY b")
def histogram_bins(spark, sf_dir):
    return reduce.histogram(table(spark, sf_dir, "part", "p_size"), "p_size", 64)


@query("SELECT i AS first, i + i % 9 AS last, (SELECT count(*) FROM part WHERE p_size >= i AND p_size < i + i % 9 AND p_size < 64) AS total FROM range(80) r(i)")
def range_counts(spark, sf_dir):
    counts = reduce.histogram(table(spark, sf_dir, "part", "p_size"), "p_size", 64)
    i = F.col("id")
    return reduce.range_counts(counts, spark.range(80).select(i.alias("first"), (i + i % 9).alias("last")))


@query(f"SELECT l_orderkey AS segment, CAST(sum({_Q}) % 4294967296 AS BIGINT) AS total, min({_Q}) AS least, max({_Q}) AS most, count(*) AS n FROM lineitem GROUP BY 1")
def segment_reduce_sum(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").withColumn("v", F.col("l_quantity").cast("long"))
    return t.groupBy(F.col("l_orderkey").alias("segment")).agg(reduce.wrapping_sum(F.col("v")).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))


@query(f"SELECT (o_orderkey // 7) AS segment, CAST(sum({_PRICE}) AS BIGINT) AS total FROM orders GROUP BY 1")
def segment_reduce_offsets(spark, sf_dir):
    """Segments given by their start offsets: a running maximum finds each row's segment, without a range join."""
    t = _orders(spark, sf_dir)
    starts = t.where("pos % 7 = 0").select(F.col("pos").alias("start"), F.call_function("div", F.col("pos"), F.lit(7).cast("long")).alias("segment"))
    starts = starts.unionByName(t.groupBy(F.call_function("div", F.col("pos"), F.lit(7).cast("long")).alias("segment")).agg(F.min("pos").alias("start")).where("start % 7 <> 0").select("start", "segment"))
    return reduce.segment_ids(t, starts).groupBy("segment").agg(F.sum("v").alias("total"))


@query(f"SELECT o_orderkey AS pos, CAST(sum({_PRICE}) OVER (ORDER BY o_orderkey) AS BIGINT) AS inclusive FROM orders")
def prefix_scan_inclusive(spark, sf_dir):
    return prefix_scan(_orders(spark, sf_dir), "pos", "v", into="inclusive", block=1024).select("pos", "inclusive")


@query(f"SELECT o_orderkey AS pos, CAST(coalesce(sum({_PRICE}) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS exclusive FROM orders")
def prefix_scan_exclusive(spark, sf_dir):
    return prefix_scan(_orders(spark, sf_dir), "pos", "v", inclusive=False, into="exclusive", block=1024).select("pos", "exclusive")


@query(f"SELECT o_orderkey AS pos, v, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM (SELECT o_orderkey, {_PRICE} AS v FROM orders) WHERE v % 3 = 1")
def stream_compact(spark, sf_dir):
    return reduce.stream_compact(_orders(spark, sf_dir), "pos", F.col("v") % 3 == 1)


@query(f"SELECT o_orderkey AS pos, v, row_number() OVER (ORDER BY v & 255, o_orderkey) - 1 AS rank FROM (SELECT o_orderkey, {_PRICE} AS v FROM orders)")
def radix_sort_stable(spark, sf_dir):
    return reduce.radix_sort(_orders(spark, sf_dir), "v", "pos", 8)


@query(f"SELECT o_orderkey AS pos, v, row_number() OVER (ORDER BY v DESC, o_orderkey) - 1 AS rank FROM (SELECT o_orderkey, {_PRICE} AS v FROM orders) ORDER BY v DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    return reduce.top_k(_orders(spark, sf_dir), 25, F.desc("v"), F.asc("pos"))


@query(f"SELECT l_orderkey AS i, v FROM (SELECT DISTINCT l_orderkey, l_partkey * 7 AS to_pos FROM lineitem WHERE l_linenumber = 1) s JOIN (SELECT o_orderkey, {_PRICE} AS v FROM orders) ON o_orderkey = s.to_pos")
def gather_by_index(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").where("l_linenumber = 1")
    return reduce.gather(_orders(spark, sf_dir), t.select(F.col("l_orderkey").alias("i"), (F.col("l_partkey") * 7).alias("at")).distinct())


@query(f"SELECT o_custkey AS at, arg_max({_PRICE}, o_orderkey) AS v FROM orders GROUP BY 1")
def scatter_last(spark, sf_dir):
    to = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("at"))
    return reduce.scatter(_orders(spark, sf_dir), to)


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS f FROM events),
r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e)
SELECT user_id, run, min(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run""")
def rle_segment_lengths(spark, sf_dir):
    t = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return reduce.run_lengths(t, "user_id", "event_type", "ts", "event_id")


@query("SELECT o_orderpriority AS g, CAST(round(sum(o_totalprice * (o_custkey % 10)), 0) AS BIGINT) AS weighted, CAST(sum((o_custkey % 10) * (o_orderkey % 100)) AS BIGINT) AS dot FROM orders GROUP BY 1")
def weighted_sum(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    w = F.col("o_custkey") % 10
    return t.groupBy(F.col("o_orderpriority").alias("g")).agg(F.round(F.sum(F.col("o_totalprice") * w), 0).cast("long").alias("weighted"), F.sum(w * (F.col("o_orderkey") % 100)).alias("dot"))


_ALPHA = 0.1


@query(f"SELECT v AS threshold, n FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders) WHERE r = least(greatest(CAST(ceil({1 - _ALPHA} * (n + 1)) AS BIGINT), 1), n)")
def conformal_threshold(spark, sf_dir):
    """The order statistic that a conformal predictor takes for its calibration scores."""
    t = table(spark, sf_dir, "orders", "o_totalprice")
    n = t.count()
    k = min(max(math.ceil((1 - _ALPHA) * (n + 1)), 1), n)
    return spark.createDataFrame([(reduce.kth_smallest(t, "o_totalprice", k), n)], "threshold double, n long")


@query("""WITH s AS (SELECT o_orderkey AS pos, o_totalprice / 100000 AS x FROM orders), e AS (SELECT pos, exp(x - (SELECT max(x) FROM s)) AS e, x FROM s),
w AS (SELECT pos, e / (SELECT sum(e) FROM e) AS weight, row_number() OVER (ORDER BY x DESC, pos) AS rank FROM e)
SELECT pos, rank, round(weight, 9) AS weight, round(weight / sum(weight) OVER (), 9) AS renormalised FROM w WHERE rank <= 8""")
def softmax_top_k(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") / 100000).alias("x"))
    best = reduce.top_k(reduce.softmax(t, F.col("x")), 8, F.desc("x"), F.asc("pos"))
    total = best.agg(F.sum("weight").alias("t"))
    return best.crossJoin(F.broadcast(total)).select("pos", (F.col("rank") + 1).alias("rank"), F.round("weight", 9).alias("weight"), F.round(F.col("weight") / F.col("t"), 9).alias("renormalised"))


@query("""SELECT g, pos, gain FROM (SELECT o_orderpriority AS g, o_orderkey AS pos, o_custkey % 50 AS gain, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 50 DESC, o_orderkey) AS r FROM orders WHERE o_orderkey % 5 <> 0) WHERE r = 1""")
def argmax_of_marginals(spark, sf_dir):
    """The best candidate that isn't picked yet, by group; the lowest index wins ties. An aggregate, no window."""
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    picked = t.where("o_orderkey % 5 = 0").select("o_orderkey")
    left = t.join(picked, "o_orderkey", "left_anti").withColumn("gain", F.col("o_custkey") % 50)
    return left.groupBy(F.col("o_orderpriority").alias("g")).agg(F.max(F.struct("gain", (-F.col("o_orderkey")).alias("p"))).alias("b")).select("g", (-F.col("b.p")).alias("pos"), F.col("b.gain").alias("gain"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS running, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS rank FROM lineitem")
def running_by_key(spark, sf_dir):
    """Running totals and ranks of each key: one shuffle serves both windows."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return t.select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("long")).over(w.orderBy("l_linenumber")).alias("running"), F.rank().over(w.orderBy("l_quantity")).alias("rank"))


@query(f"SELECT o_orderkey AS pos, (v * 2 + o_orderkey) % 4294967296 AS mapped, (SELECT max(CAST(round(o_totalprice) AS BIGINT)) FROM orders) AS sent FROM (SELECT o_orderkey, {_PRICE} AS v FROM orders)")
def indexed_map(spark, sf_dir):
    """A function of place and value, and one value sent to every place."""
    t = _orders(spark, sf_dir)
    top = t.agg(F.max("v").alias("sent"))  # one row
    return t.select("pos", u32.add(F.col("v") * 2, F.col("pos")).alias("mapped")).crossJoin(F.broadcast(top))


@query("SELECT o_orderkey AS key, h.v AS value, h.v IS NOT NULL AS found FROM orders LEFT JOIN (SELECT l_partkey AS k, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY 1) h ON h.k = o_orderkey")
def hash_insert_lookup(spark, sf_dir):
    """A table into which the first value of each key goes, then asked for keys, some of which it lacks.

    Lines of one number are inserted in the order of the file.
    """
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "_metadata.file_path", "_metadata.row_index").where("l_suppkey IS NOT NULL")
    held = reduce.insert_first(l.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"), F.struct("l_orderkey", "l_linenumber", "file_path", "row_index").alias("order")))
    return reduce.look_up(held, table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("key")))
