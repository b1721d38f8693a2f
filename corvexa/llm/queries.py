"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lattice, minhash, neighbours, packing, quality, repeats, revisits, sharding, voronoi
from .common import doc_hash, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=5, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM sets),
classes AS (SELECT h, min(doc_id) AS doc_id FROM sizes WHERE n > 0 GROUP BY h),
rows AS (SELECT doc_id, unnest(s) AS s FROM sets WHERE doc_id IN (SELECT doc_id FROM classes)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
c(node, label) USING KEY (node) AS (SELECT doc_id, doc_id FROM classes UNION SELECT e.b, min(c.label) FROM c JOIN e ON e.a = c.node JOIN recurring.c r ON r.node = e.b WHERE c.label < r.label GROUP BY e.b)
SELECT s.doc_id, s.n AS n_shingles, coalesce(c.label, s.doc_id) AS component_id, coalesce(c.label, s.doc_id) = s.doc_id AS kept FROM sizes s LEFT JOIN classes k ON k.h = s.h AND s.n > 0 LEFT JOIN c ON c.node = k.doc_id
"""


#: Captures of each page that the query makes, and those that are full responses; the others are not-modified answers.
CAPTURES, FULL = 5, (0, 2)


def crawl_records(pages: DataFrame) -> DataFrame:
    """Records of a crawl that fetches each page CAPTURES times; what a table of pages lacks is derived from it.

    Times spread over about a day and overlap, so a revisit may come before the second response or after it. The page's
    entity tag changes with the second response; one capture in 16 has lost its tag, one in 32 has another one. Names
    of headers are written in either case.
    """
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    base = pages.select("page_id", "url", tag.alias("tag"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string").alias("n"))
    r = base.withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(CAPTURES - 1)))).withColumn("rec_id", F.col("page_id") * CAPTURES + F.col("visit"))
    h = F.shiftright((F.col("rec_id") % (1 << 30) * 1103515245 + 12345) % (1 << 31), 8)
    full = F.col("visit").isin(*FULL)
    own = F.when(F.col("visit") < FULL[1], F.col("tag")).otherwise(F.concat("tag", F.lit("-2")))
    etag = F.when(h % 16 == 0, None).when(h % 32 == 1, F.concat(F.lit("x"), own)).when(h % 4 == 2, F.concat(F.lit("W/"), own)).otherwise(own)
    r = r.select("rec_id", "url", (F.col("visit") * 20_000 + h % 50_000).cast("long").alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"), etag.alias("etag"), F.substring("tag", 1, 8).alias("last_modified"), "n", (h % 60).cast("string").alias("age"))
    ts = F.col("ts").cast("string")
    stored = F.create_map(F.lit("Content-Length"), F.col("n"), F.lit("Date"), ts, F.lit("Cache-Control"), F.lit("none"), F.lit("X-Response"), F.lit("1"))
    fresh = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), ts, F.lit("Expires"), F.col("age"), F.lit("x-revisit"), F.lit("1"))
    return r.withColumn("headers", F.when(F.col("kind") == "response", stored).otherwise(fresh)).drop("n", "age")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve_revisits(crawl_records(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("rec_id", "ts", "ref_id", "state", headers.alias("headers"))


OP2_SQL = f"""
WITH base AS (SELECT page_id, url, md5(coalesce(html, '')) AS tag, coalesce(strlen(html), 0) AS n FROM pages),
visits AS (SELECT page_id * {CAPTURES} + visit AS rec_id, url, visit, tag, n FROM base, range({CAPTURES}) AS v(visit)),
hashed AS (SELECT *, ((rec_id % (1 << 30) * 1103515245 + 12345) % (CAST(1 AS BIGINT) << 31)) >> 8 AS h, CASE WHEN visit < {FULL[1]} THEN tag ELSE tag || '-2' END AS own FROM visits),
records AS (SELECT rec_id, url, visit * 20000 + h % 50000 AS ts, CASE WHEN visit IN {FULL} THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN h % 16 = 0 THEN NULL WHEN h % 32 = 1 THEN 'x' || own WHEN h % 4 = 2 THEN 'W/' || own ELSE own END AS etag, substr(tag, 1, 8) AS modified, n, h % 60 AS age FROM hashed),
headed AS (SELECT *, CASE kind WHEN 'response' THEN [{{'k': 'Content-Length', 'v': n::VARCHAR}}, {{'k': 'Date', 'v': ts::VARCHAR}}, {{'k': 'Cache-Control', 'v': 'none'}}, {{'k': 'X-Response', 'v': '1'}}]
  ELSE [{{'k': 'content-length', 'v': '0'}}, {{'k': 'date', 'v': ts::VARCHAR}}, {{'k': 'Expires', 'v': age::VARCHAR}}, {{'k': 'x-revisit', 'v': '1'}}] END AS headers FROM records),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM headed),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '') AS host,
  regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''), '[?].*$', ''), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref)(=|$)'))) AS kept FROM bare),
keyed AS (SELECT *, CASE WHEN len(kept) > 0 THEN host || path || '?' || array_to_string(kept, '&') ELSE host || path END AS curl FROM parts),
paired AS (SELECT r.rec_id, r.ts, regexp_replace(r.etag, '^W/', '') AS etag, r.modified, p.rec_id AS ref_id, regexp_replace(p.etag, '^W/', '') AS p_etag, p.modified AS p_modified, p.headers AS stored,
  list_filter(r.headers, lambda e: list_contains({list(revisits.PERMITTED)}, lower(e.k))) AS fresh,
  row_number() OVER (PARTITION BY r.rec_id ORDER BY p.ts DESC NULLS LAST, p.rec_id DESC NULLS LAST) AS place
  FROM keyed r LEFT JOIN keyed p ON p.kind = 'response' AND p.curl = r.curl AND p.ts < r.ts WHERE r.kind = 'revisit'),
judged AS (SELECT *, CASE WHEN ref_id IS NULL THEN 'unresolved' WHEN coalesce(etag = p_etag, modified = p_modified, false) THEN 'matched' ELSE 'mismatch' END AS state
  FROM paired WHERE place = 1),
merged AS (SELECT *, list_sort(list_concat(list_filter(stored, lambda e: NOT list_contains(list_transform(fresh, lambda x: lower(x.k)), lower(e.k))), fresh)) AS headers FROM judged)
SELECT rec_id, ts, ref_id, state, CASE WHEN state = 'matched' THEN array_to_string(list_transform(headers, lambda e: e.k || '=' || e.v), ';') END AS headers FROM merged
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = sharding.histogram_shards(docs, n_shards=40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_BYTES = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1)"
_CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS tab FROM range(256) r(n))"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS j FROM documents),
s AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM d),
g AS (SELECT h, CAST(sum(size) AS BIGINT) AS b, CAST(sum(sum(size)) OVER (ORDER BY h) - sum(size) AS BIGINT) AS below FROM d GROUP BY h),
r AS (SELECT h, j, CAST(sum(size) AS BIGINT) AS b, CAST(sum(sum(size)) OVER (PARTITION BY h ORDER BY j) - sum(size) AS BIGINT) AS below FROM d GROUP BY h, j),
goals AS (SELECT k, (total * (k + 1) + 39) // 40 AS goal, CAST(floor(0.03 * total / 40) AS BIGINT) AS lim FROM s, range(39) AS x(k)),
texts AS (SELECT k, goal, lim, h, b, below FROM goals JOIN g ON below < goal AND below + b >= goal),
splits AS (SELECT k, CASE WHEN goal - below > below + b - goal THEN h + 1 ELSE h END AS h, 0 AS j FROM texts WHERE b <= lim UNION ALL
  SELECT k, x.h, CASE WHEN goal - x.below - r.below > x.below + r.below + r.b - goal THEN r.j + 1 ELSE r.j END FROM texts x JOIN r ON r.h = x.h AND x.below + r.below < goal AND x.below + r.below + r.b >= goal WHERE x.b > lim),
placed AS (SELECT d.*, CAST((SELECT count(*) FROM splits p WHERE d.h > p.h OR (d.h = p.h AND d.j >= p.j)) AS INT) AS shard FROM d),
crc AS (SELECT DISTINCT t, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, {_CRC_TABLE})
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, j, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed JOIN crc USING (t)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.pmod(doc_hash(), F.lit(4)) == 2
    model = language.train(docs.where(~held))
    return language.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.pmod(doc_hash(), F.lit(3)) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality").where(~held))
    return quality.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.exact_top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS f FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f) GROUP BY doc_id, r),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(b) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string([substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1])) FOR z IN list_zip([0] || b, a || [length(h) // 2])], '') END)) AS kept_sha256 FROM d LEFT JOIN l USING (doc_id)
"""


OP8_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) > 0 AND NOT list_contains([coalesce(isfinite(x), false) FOR x IN embedding], false)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = lattice.decode_segmentations(lattice.sample_segmentations(docs, model, seed=1), model)
    return lattice.with_ids_crc32(rows).select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "ids_crc32", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_revisits, op3_packing, op4_sharding, op5_language_id, op6_quality, op7_suffix_array, op8_top_k, op9_sentencepiece, op10_neighbours)}
ORACLE_SQL: dict[str, str] = {"op1_minhash": OP1_SQL, "op2_revisits": OP2_SQL, "op4_sharding": OP4_SQL, "op7_suffix_array": OP7_SQL, "op8_top_k": OP8_SQL}
