"""Byte-level text functions: shapes, classes, line tables, hashes, entropy, brackets. Offsets are byte offsets."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import bounded, flat_map, with_columns

#: The classes of bytes, by number. 0 is the end, 1 blanks, 2 line ends, 3 letters and _, 4 digits,
#: 5 to 30 one byte each, 31 all others.
CLASS_BYTES = "(){};,.*+-/#'\"=<>!&|^~%\\[]"


def class_table() -> np.ndarray:
    t = np.full(256, 31, dtype=np.int64)
    t[0] = 0
    for chars, c in ((" \t", 1), ("\n\r", 2), ("_", 3), ("0123456789", 4)):
        t[[ord(x) for x in chars]] = c
    t[65:91] = t[97:123] = 3
    for k, x in enumerate(CLASS_BYTES):
        t[ord(x)] = 5 + k
    return t


def byte_histogram(df: DataFrame, text: str) -> DataFrame:
    """(byte, count) over a column of texts or binaries: each task sends at most 256 rows."""
    rows = df.select(F.col(text).cast("binary").alias("raw"))

    def run(batches):
        import pyarrow as pa

        total = np.zeros(256, dtype=np.int64)
        for b in batches:
            for v in b.column(0):
                if v.is_valid:
                    total += np.bincount(np.frombuffer(v.as_buffer(), dtype=np.uint8), minlength=256)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["byte", "n"])

    return bounded(rows).mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("count"))


def _shape(raws: list) -> list[list]:
    out = []
    for raw in raws:
        if raw is None:
            out.append((None,) * 5)
            continue
        h = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        out.append((len(raw), int(h[0]), int(h[128:].sum()), int(h[128:192].sum()), int(h[194:224].sum() + 2 * h[224:240].sum() + 3 * h[240:245].sum())))
    return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5


def utf8_shape(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with n_bytes, nulls, high, continuation and expected (continuation bytes that the lead bytes call for)."""
    return with_columns(df, raw, "n_bytes long, nulls long, high long, continuation long, expected long", _shape)


def encoding(n: Column, nulls: Column, high: Column, continuation: Column, expected: Column) -> Column:
    near = F.abs(continuation - expected) < F.call_function("div", n + 19, F.lit(20).cast("long"))
    return F.when(n == 0, "ASCII").when(nulls > F.call_function("div", n, F.lit(8).cast("long")), "UTF16LE").when(high == 0, "ASCII").when(near, "UTF8").otherwise("ISO8859-1")


def line_starts(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, line, start, stop) from line 0; CR, LF and CRLF end a line."""

    def lines(v) -> list[tuple]:
        if v is None:
            return []
        b = np.frombuffer(v, dtype=np.uint8)
        cr, lf = b == 13, b == 10
        follows = np.zeros(len(b), dtype=bool)
        follows[1:] = lf[1:] & cr[:-1]
        at = np.flatnonzero((cr | lf) & ~follows)
        width = np.where(cr[at] & np.append(lf[1:], False)[at], 2, 1) if len(at) else at
        starts, stops = np.concatenate([[0], at + width]), np.append(at, len(b))
        return [(k, int(s), int(e)) for k, (s, e) in enumerate(zip(starts, stops, strict=True))]

    return flat_map(df, key, raw, "line long, start long, stop long", lines)


def entropy(raw: bytes) -> float:
    """Shannon entropy in bits a byte; 0 for no bytes."""
    if not raw:
        return 0.0
    p = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    p = p[p > 0] / len(raw)
    return float(-(p * np.log2(p)).sum()) + 0.0


def with_entropy(df: DataFrame, raw: str) -> DataFrame:
    return with_columns(df, raw, "entropy double", lambda v: [[None if x is None else entropy(x) for x in v]])


def fnv1a(raws: list, bits: int) -> list:
    """FNV-1a of each value: all values advance together while many are left, the longest few one by one."""
    prime, seed = {32: (16777619, 2166136261), 64: (1099511628211, 14695981039346656037)}[bits]
    mask = (1 << bits) - 1
    some = [i for i, v in enumerate(raws) if v is not None]
    some.sort(key=lambda i: -len(raws[i]))
    h = np.full(len(some), seed, dtype=np.uint64)
    lengths = np.array([len(raws[i]) for i in some], dtype=np.int64)
    common = int(lengths[63]) if len(some) > 63 else 0
    if common:
        flat = np.frombuffer(b"".join(raws[i] for i in some), dtype=np.uint8)
        first = np.cumsum(lengths) - lengths
        alive = len(some)
        for p in range(int(common)):
            while lengths[alive - 1] <= p:
                alive -= 1
            h[:alive] = ((h[:alive] ^ flat[first[:alive] + p]) * np.uint64(prime)) & np.uint64(mask)
        # Values that are shorter ended on the way; those of rank 64 and up are done.
    out: list = [None] * len(raws)
    for k, i in enumerate(some):
        x = int(h[k])
        for c in raws[i][common:]:
            x = ((x ^ c) * prime) & mask
        out[i] = x
    return out


def _signed(x):
    return None if x is None else x - (1 << 64) if x >= 1 << 63 else x


def multi_hash(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with adler32, fnv1a32 and fnv1a64 (its 64 bits as a signed long) of a binary column, in one walk; crc32 is built in."""

    def hashes(v: list) -> list[list]:
        return [[None if x is None else zlib.adler32(x) for x in v], fnv1a(v, 32), [_signed(x) for x in fnv1a(v, 64)]]

    return with_columns(df, raw, "adler32 long, fnv1a32 long, fnv1a64 long", hashes).withColumn("crc32", F.crc32(raw))


def inflate(df: DataFrame, raw: str, into: str = "inflated") -> DataFrame:
    """Raw deflate streams, stored blocks among them; null for a broken stream."""

    def one(x):
        if x is None:
            return None
        try:
            d = zlib.decompressobj(-15)
            out = d.decompress(x) + d.flush()
        except zlib.error:
            return None
        return out if d.eof else None

    return with_columns(df, raw, f"{into} binary", lambda v: [[one(x) for x in v]])


def deflate_stored(df: DataFrame, raw: str, into: str = "deflated") -> DataFrame:
    def one(x):
        if x is None:
            return None
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        return c.compress(x) + c.flush()

    return with_columns(df, raw, f"{into} binary", lambda v: [[one(x) for x in v]])


def deflated(df: DataFrame, raw: str, into: str = "deflated") -> DataFrame:
    """Raw deflate streams of a binary column, with matches and Huffman codes."""

    def one(x):
        if x is None:
            return None
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(x) + c.flush()

    return with_columns(df, raw, f"{into} binary", lambda v: [[one(x) for x in v]])


def bracket_pairs(df: DataFrame, key: str, raw: str, open_: bytes = b"(", close: bytes = b")") -> DataFrame:
    """(key, open, close, depth) of matched brackets; unmatched ones give no row."""
    a, z = open_[0], close[0]

    def pairs(v) -> list[tuple]:
        stack, out = [], []
        b = np.frombuffer(v or b"", dtype=np.uint8)
        for p in np.flatnonzero((b == a) | (b == z)).tolist():
            if b[p] == a:
                stack.append(p)
            elif stack:
                out.append((stack.pop(), p, len(stack)))
        return out

    return flat_map(df, key, raw, "open long, close long, depth long", pairs)
