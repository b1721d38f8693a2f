"""Source and sink queries: round trips through files, byte ranges, include resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvexa.plans.lineage import cut, shared_folder
from corvexa.registry import query, table
from corvexa.sources import files


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, 15 AS bytes FROM orders".replace(", 15 AS bytes", ""))
def write_back_round_trip(spark, sf_dir):
    """A table written as Parquet and read again."""
    return cut(table(spark, sf_dir, "orders", "o_orderkey")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def text_file_round_trip(spark, sf_dir):
    """Texts written as files of JSON lines and read again with a fixed schema."""
    t = table(spark, sf_dir, "documents", "doc_id", "text")
    path = f"{shared_folder(spark)}/corvexa-json-{uuid.uuid4().hex}"
    t.write.json(path)
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT p_partkey AS k, p_brand AS name, count AS parts FROM part LEFT JOIN (SELECT p_brand AS b, count(*) AS count FROM part WHERE p_size < 30 GROUP BY 1) ON b = p_brand")
def vfs_resolve(spark, sf_dir):
    """Include names resolved to files by hash."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    held = p.where("p_size < 30").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("content"))
    return files.resolve_includes(p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("name")), held).select("k", "name", F.col("content").alias("parts"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select(F.concat(F.lit("/d/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))


@query("SELECT '/d/' || doc_id AS path, upper(substr(hex(encode(text)), 2 * 10 + 1, 2 * 50)) AS bytes FROM documents")
def byte_ranges(spark, sf_dir):
    """Bytes 10 to 59 of every file; shorter where a file ends."""
    return files.byte_range(_files(spark, sf_dir), 10, 50).select("path", F.hex("content").alias("bytes"))


@query("SELECT '/d/' || doc_id AS path, CAST(k - 1 AS BIGINT) AS line, CAST(strlen(s) AS BIGINT) AS bytes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)")
def corpus_fan_out(spark, sf_dir):
    """A function of each file that yields rows, over a whole corpus."""
    return files.map_corpus(_files(spark, sf_dir), lambda v: [(k, len(s)) for k, s in enumerate(v.split(b"\n"))] if v is not None else [], "line long, bytes long")


@query("SELECT count(*) AS files, 'PAR1' AS mark FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders']))")
def binary_files(spark, sf_dir):
    """Files read as bytes: each Parquet part begins with its mark."""
    found = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders"):
        f = files.read_binary(spark, f"{sf_dir}/{name}.parquet", "*.parquet")
        one = files.byte_range(f, 0, 4).select(F.lit(name).alias("name"), F.col("content").cast("string").alias("mark"))
        found = one if found is None else found.unionByName(one)
    return found.agg(F.countDistinct("name").alias("files"), F.min("mark").alias("mark"))
