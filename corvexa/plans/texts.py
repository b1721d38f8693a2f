"""Byte-level queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvexa.functions import text as T
from corvexa.registry import query, table


def raw(spark, sf_dir, name="documents", key="doc_id", column="text"):
    return table(spark, sf_dir, name, key, column).select(key, F.col(column).cast("binary").alias("raw"))


_PAIRS = "regexp_extract_all(hex(encode(text)), '..')"
_HEX = f"SELECT doc_id, unnest({_PAIRS}) AS h FROM documents"
_BYTE = "(strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1"


@query(f"SELECT CAST({_BYTE} AS BIGINT) AS byte, count(*) AS count FROM ({_HEX}) GROUP BY 1")
def byte_histogram_256(spark, sf_dir):
    return T.byte_histogram(table(spark, sf_dir, "documents", "text"), "text")


_CLASS = "CASE WHEN b = 0 THEN 0 WHEN b IN (32, 9) THEN 1 WHEN b IN (10, 13) THEN 2 WHEN b = 95 OR b BETWEEN 65 AND 90 OR b BETWEEN 97 AND 122 THEN 3 WHEN b BETWEEN 48 AND 57 THEN 4 " + " ".join(f"WHEN b = {ord(c)} THEN {5 + k}" for k, c in enumerate(T.CLASS_BYTES)) + " ELSE 31 END"


@query(f"SELECT CAST({_CLASS} AS BIGINT) AS class, count(*) AS count FROM (SELECT {_BYTE} AS b FROM ({_HEX})) GROUP BY 1")
def char_class_counts(spark, sf_dir):
    """Class totals from the byte histogram: the class table meets at most 256 rows."""
    t = F.array(*[F.lit(int(c)) for c in T.class_table()])
    h = T.byte_histogram(table(spark, sf_dir, "documents", "text"), "text")
    return h.groupBy(F.get(t, F.col("byte").cast("int")).cast("long").alias("class")).agg(F.sum("count").alias("count"))


_N = "list_filter({}, lambda h: h >= '{}' AND h <= '{}')"
_SHAPE = f"SELECT doc_id, len(p) AS n_bytes, len({_N.format('p', '00', '00')}) AS nulls, len({_N.format('p', '80', 'FF')}) AS high, len({_N.format('p', '80', 'BF')}) AS continuation, len({_N.format('p', 'C2', 'DF')}) + 2 * len({_N.format('p', 'E0', 'EF')}) + 3 * len({_N.format('p', 'F0', 'F4')}) AS expected FROM (SELECT doc_id, {_PAIRS} AS p FROM documents)"


@query(f"SELECT doc_id, n_bytes, continuation, expected, CASE WHEN n_bytes = 0 THEN 'ASCII' WHEN nulls > n_bytes // 8 THEN 'UTF16LE' WHEN high = 0 THEN 'ASCII' WHEN abs(continuation - expected) < (n_bytes + 19) // 20 THEN 'UTF8' ELSE 'ISO8859-1' END AS encoding FROM ({_SHAPE})")
def encoding_classify(spark, sf_dir):
    s = T.utf8_shape(raw(spark, sf_dir), "raw")
    return s.select("doc_id", "n_bytes", "continuation", "expected", T.encoding(*map(F.col, ("n_bytes", "nulls", "high", "continuation", "expected"))).alias("encoding"))


@query(f"""WITH c AS (SELECT doc_id, h, count(*) AS n FROM ({_HEX}) GROUP BY 1, 2), t AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c)
SELECT doc_id, round(coalesce(-sum(p * log2(p)), 0), 6) AS entropy FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id""")
def shannon_entropy(spark, sf_dir):
    return T.with_entropy(raw(spark, sf_dir), "raw").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("""WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS k FROM pages),
b AS (SELECT page_id, c, CAST(sum(strlen(c)) OVER (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING) - strlen(c) AS BIGINT) AS pos FROM c),
d AS (SELECT page_id, pos, c, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - CASE c WHEN '{' THEN 1 ELSE 0 END AS depth FROM b WHERE c IN ('{', '}')),
p AS (SELECT page_id, pos AS close, c, depth, max(CASE WHEN c = '{' THEN pos END) OVER (PARTITION BY page_id, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM d)
SELECT page_id, open, close, CAST(depth AS BIGINT) AS depth FROM p WHERE c = '}' AND open IS NOT NULL AND depth >= 0""")
def bracket_match(spark, sf_dir):
    return T.bracket_pairs(raw(spark, sf_dir, "pages", "page_id", "html"), "page_id", "raw", b"{", b"}")


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, reverse(substr(text, 1, 3)) AS head, strpos(text, 'the') AS first FROM documents")
def string_scalars(spark, sf_dir):
    t = table(spark, sf_dir, "documents", "doc_id", "text")
    return t.select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.reverse(F.substring("text", 1, 3)).alias("head"), F.instr("text", "the").cast("long").alias("first"))


_MIXED = "SELECT doc_id, replace(replace(text, ', ', chr(13) || chr(10)), '. ', chr(13)) AS t FROM documents"


@query(f"""WITH l AS (SELECT doc_id, replace(replace(t, chr(13) || chr(10), chr(2)), chr(13), chr(3)) AS t FROM ({_MIXED})), p AS (SELECT doc_id, regexp_split_to_array(t, '[\\x02\\x03\\n]') AS s, regexp_extract_all(t, '[\\x02\\x03\\n]') AS e FROM l),
q AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS k, unnest([CASE x WHEN chr(2) THEN 2 WHEN '' THEN 0 ELSE 1 END FOR x IN e || ['']]) AS w FROM p), r AS (SELECT doc_id, k, s, w, sum(strlen(s) + w) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM q)
SELECT doc_id, k AS line, CAST(upto - w - strlen(s) AS BIGINT) AS start, CAST(upto - w AS BIGINT) AS stop FROM r""")
def line_index(spark, sf_dir):
    """Lines of texts with line ends of all three kinds."""
    t = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.replace(F.replace("text", F.lit(", "), F.lit("\r\n")), F.lit(". "), F.lit("\r")).cast("binary").alias("raw"))
    return T.line_starts(t, "doc_id", "raw")


_B = f"list_transform({_PAIRS}, lambda h: {_BYTE})"
_TAB = "(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS tab FROM range(256) r(n))"


@query(f"""WITH t AS (SELECT doc_id, CAST({_B} AS HUGEINT[]) AS b, tab FROM documents, {_TAB})
SELECT doc_id, CAST(xor(list_reduce(CAST(b AS BIGINT[]), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS crc32,
 CAST((1 + coalesce(list_sum(b), 0)) % 65521 + 65536 * ((len(b) + coalesce(list_sum([(len(b) - i + 1) * b[i] FOR i IN range(1, len(b) + 1)]), 0)) % 65521) AS BIGINT) AS adler32,
 CAST(list_reduce(b, lambda h, x: xor(h, x) * 16777619 % 4294967296, CAST(2166136261 AS HUGEINT)) AS BIGINT) AS fnv1a32,
 (lambda_h - CASE WHEN lambda_h >= 9223372036854775808 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END)::BIGINT AS fnv1a64
 FROM (SELECT *, list_reduce(b, lambda h, x: xor(h, x) * 1099511628211 % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS lambda_h FROM t)""")
def multi_hash(spark, sf_dir):
    """crc32, adler32 and both FNV-1a hashes of every text."""
    return T.multi_hash(raw(spark, sf_dir), "raw").drop("raw")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 <> 1 THEN md5(text) END AS from_base64, CASE WHEN doc_id % 10 <> 2 THEN md5(text) END AS from_hex, md5(text) AS from_stored, CASE WHEN doc_id % 10 <> 3 OR strlen(text) < 8 THEN md5(text) END AS from_deflated FROM documents""")
def decode_bytes(spark, sf_dir):
    """Base64, hex, stored and compressed deflate streams; of each kind some are broken, which gives null."""
    r = raw(spark, sf_dir)
    k = F.col("doc_id") % 10
    e = r.select("doc_id", F.when(k == 1, "ab$=").otherwise(F.base64("raw")).alias("b"), F.when(k == 2, "0g").otherwise(F.hex("raw")).alias("h"), "raw")
    e = T.inflate(T.deflate_stored(e, "raw"), "deflated").drop("deflated").withColumnRenamed("inflated", "stored")
    e = T.deflated(e, "raw", "packed").withColumn("packed", F.when((k == 3) & (F.octet_length("raw") >= 8), F.expr("substring(packed, 1, length(packed) - 1)")).otherwise(F.col("packed")))
    e = T.inflate(e, "packed", "unpacked")
    return e.select("doc_id", F.md5(F.try_to_binary("b", F.lit("base64"))).alias("from_base64"), F.md5(F.unhex("h")).alias("from_hex"), F.md5("stored").alias("from_stored"), F.md5("unpacked").alias("from_deflated"))


@query("SELECT doc_id, doc_id % 8 IN (0, 5) AS whole FROM documents")
def utf8_validate(spark, sf_dir):
    """Texts with well-formed and malformed endings: cut sequences, stray and overlong bytes, surrogates, places beyond the last."""
    ends = F.array(*[F.unhex(F.lit(x)) for x in ("", "C3", "80", "C080", "EDA080", "F09F9880", "F4908080", "E282")])
    t = raw(spark, sf_dir).select("doc_id", F.concat("raw", F.get(ends, (F.col("doc_id") % 8).cast("int"))).alias("raw"))
    return t.select("doc_id", F.is_valid_utf8(F.col("raw").cast("string")).alias("whole"))
