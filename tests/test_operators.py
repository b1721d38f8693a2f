"""Operators at their edges, and those that SQL doesn't express against plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvexa.functions import text, u32
from corvexa.operators import dense, graph, hashing, match, parse, reduce, semiring, sets
from corvexa.operators.scan import prefix_scan
from corvexa.sources import files
from corvexa.streaming import windows

EDGE = [0, 1, 2, 31, 32, 65535, 65536, (1 << 31) - 1, 1 << 31, (1 << 32) - 2, (1 << 32) - 1]


def test_u32_boundaries(spark):
    pairs = [(a, b) for a in EDGE for b in EDGE]
    a, b, m = F.col("a"), F.col("b"), 1 << 32
    made = {
        "add": (u32.add(a, b), lambda x, y: (x + y) % m), "sub": (u32.sub(a, b), lambda x, y: (x - y) % m), "mul": (u32.mul(a, b), lambda x, y: x * y % m),
        "high": (u32.mul_high(a, b), lambda x, y: x * y >> 32), "div": (u32.div(a, b), lambda x, y: x // y if y else m - 1), "mod": (u32.mod(a, b), lambda x, y: x % y if y else 0),
        "sat": (u32.saturating_mul(a, b), lambda x, y: min(x * y, m - 1)), "shl": (u32.shl(a, b), lambda x, y: (x << (y & 31)) % m), "shr": (u32.shr(a, b), lambda x, y: x >> (y & 31)),
        "rotl": (u32.rotate_left(a, b), lambda x, y: ((x << (y & 31)) | (x >> (32 - (y & 31)))) % m), "rotr": (u32.rotate_right(a, b), lambda x, y: ((x >> (y & 31)) | (x << (32 - (y & 31)))) % m),
        "clz": (u32.clz(a), lambda x, y: 32 - x.bit_length()), "ctz": (u32.ctz(a), lambda x, y: (x & -x).bit_length() - 1 if x else 32), "rev": (u32.reverse_bits(a), lambda x, y: int(f"{x:032b}"[::-1], 2)),
    }
    for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", *[c.alias(k) for k, (c, _) in made.items()]).collect():
        for k, (_, f) in made.items():
            assert r[k] == f(r["a"], r["b"]), (k, r)


def test_wrapping_sum(spark):
    df = spark.createDataFrame([(x,) for x in EDGE * 3], "v long")
    assert df.agg(reduce.wrapping_sum(F.col("v"))).first()[0] == sum(EDGE * 3) % (1 << 32)


@pytest.mark.parametrize("kind", ["sum", "max", "min"])
def test_prefix_scan_over_blocks(spark, kind):
    rng = random.Random(3)
    rows = [(p, rng.randrange(-50, 50)) for p in range(0, 500, 3)]
    got = {r["p"]: r["s"] for r in prefix_scan(spark.createDataFrame(rows, "p long, v long"), "p", "v", kind=kind, into="s", block=16).collect()}
    f = {"sum": sum, "max": max, "min": min}[kind]
    assert got == {p: f(v for _, v in rows[: k + 1]) for k, (p, _) in enumerate(rows)}


def test_scan_of_nothing(spark):
    assert prefix_scan(spark.createDataFrame([], "p long, v long"), "p", "v").count() == 0


def test_kth_smallest_refines(spark):
    rng = random.Random(5)
    values = [rng.choice([1.0, 2.0, rng.random() * 1e6]) for _ in range(80_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 100, 40_000, 80_000):
        assert reduce.kth_smallest(df, "v", k) == sorted(values)[k - 1]
    assert reduce.kth_smallest(df, "v", 0) is None


def test_histogram_drops_outside(spark):
    df = spark.createDataFrame([(-1,), (0,), (2,), (2,), (9,), (None,)], "v int")
    assert [r["count"] for r in reduce.histogram(df, "v", 3).orderBy("bin").collect()] == [1, 0, 2]


def test_gather_and_scatter_out_of_range(spark):
    src = spark.createDataFrame([(0, 10), (1, 20)], "pos long, v long")
    assert {(r["i"], r["v"]) for r in reduce.gather(src, spark.createDataFrame([(0, 1), (1, 9)], "i long, at long")).collect()} == {(0, 20)}
    assert [tuple(r) for r in reduce.scatter(src, spark.createDataFrame([(0, 5), (1, 5)], "pos long, at long")).collect()] == [(5, 20)]


def test_rank_and_select_are_inverse(spark):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(5000), 300))
    index = sets.rank_index(sets.pack(spark.createDataFrame([(i,) for i in ids], "id long")))
    ranks = {r["id"]: r["rank"] for r in sets.rank1(index, spark.range(0, 6000, 7)).collect()}
    assert ranks == {i: sum(x < i for x in ids) for i in range(0, 6000, 7)}
    ks = spark.createDataFrame([(0,), (299,), (300,)], "k long")
    assert {(r["k"], r["id"]) for r in sets.select1(index, ks).collect()} == {(0, ids[0]), (299, ids[299])}


@pytest.mark.parametrize("ring", sorted(semiring.SEMIRINGS))
def test_semiring_plus_ignores_order(spark, ring):
    """The sum of a product doesn't depend on the order of the inner index."""
    rng = random.Random(7)
    a = [(i, k, rng.randrange(1, 60)) for i in range(3) for k in range(4)]
    b = [(k, j, rng.randrange(1, 60)) for k in range(4) for j in range(3)]
    da, db = (lambda x: spark.createDataFrame(x, "i long, k long, v long")), (lambda x: spark.createDataFrame(x, "k long, j long, v long"))
    one = sorted(map(tuple, semiring.product(da(a), db(b), ring).collect()))
    assert one == sorted(map(tuple, semiring.product(da(a[::-1]), db(b[::-1]), ring).collect())) and len(one) == 9


def test_closure_of_a_cycle_ends(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 0, 1), (5, 6, 1)], "src long, dst long, kind int")
    got = {(r["node"], r["depth"]) for r in graph.closure(spark.createDataFrame([(0,)], "node long"), e).collect()}
    assert got == {(0, 0), (1, 1), (2, 2)}
    assert graph.levels(e).where("node < 5").count() == 0


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_dominators_of_a_diamond(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (9, 4)], "src long, dst long")
    assert {(r["node"], r["idom"]) for r in graph.dominators(e, 0).collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 3)}


def test_hash_vectors(spark):
    values = [b"", b"a", b"foobar", "Grüße".encode(), None, *[bytes([k % 256]) * (k % 300) for k in range(100)]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, raw binary")
    got = {r["k"]: r for r in text.multi_hash(df, "raw").collect()}
    assert (got[0]["fnv1a32"], got[1]["fnv1a32"], got[2]["fnv1a32"]) == (0x811C9DC5, 0xE40C292C, 0xBF9CF968)
    assert got[2]["fnv1a64"] % (1 << 64) == 0x85944171F73967E8 and got[4]["fnv1a32"] is None
    for k, v in enumerate(values):
        if v is not None:
            h = 0xCBF29CE484222325
            for c in v:
                h = (h ^ c) * 1099511628211 % (1 << 64)
            assert (got[k]["fnv1a64"] % (1 << 64), got[k]["adler32"], got[k]["crc32"]) == (h, zlib.adler32(v), zlib.crc32(v))


def test_lines_of_all_line_ends(spark):
    df = spark.createDataFrame([(1, b"a\r\nb\rc\n"), (2, b""), (3, None)], "k long, raw binary")
    got = sorted(tuple(r) for r in text.line_starts(df, "k", "raw").collect())
    assert got == [(1, 0, 0, 1), (1, 1, 3, 4), (1, 2, 5, 6), (1, 3, 7, 7), (2, 0, 0, 0)]


def test_encoding_and_utf8(spark):
    cases = {1: (b"", "ASCII"), 2: (b"plain", "ASCII"), 3: ("hällo wörld".encode(), "UTF8"), 4: ("hi".encode("utf-16-le") * 9, "UTF16LE"), 5: (b"\xe4\xf6\xfc" * 30, "ISO8859-1")}
    df = text.utf8_shape(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "k long, raw binary"), "raw")
    out = df.select("k", text.encoding(*map(F.col, ("n_bytes", "nulls", "high", "continuation", "expected"))).alias("e")).collect()
    assert {r["k"]: r["e"] for r in out} == {k: e for k, (_, e) in cases.items()}


def test_brackets(spark):
    df = spark.createDataFrame([(1, b")(a(b)c)(")], "k long, raw binary")
    assert sorted(tuple(r)[1:] for r in text.bracket_pairs(df, "k", "raw").collect()) == [(1, 7, 0), (3, 5, 1)]


def test_overlapping_literals_and_scores(spark):
    df = spark.createDataFrame([(1, b"aaaa AKIA"), (2, None), (3, b"")], "k long, raw binary")
    spans = match.find_literals(df, "k", "raw", [b"aa", b"AKIA", b""])
    assert sorted(tuple(r) for r in spans.collect()) == [(1, 0, 0, 2), (1, 0, 1, 3), (1, 0, 2, 4), (1, 1, 5, 9)]
    scored = {r["pattern_id"]: r for r in match.score_spans(df, "k", "raw", spans).collect()}
    assert (scored[0]["start"], scored[0]["stop"], scored[0]["entropy"]) == (0, 4, 0.0)
    assert scored[1]["entropy"] == 1.5 and scored[1]["confidence"] == pytest.approx(4 / 16 * 1.5 / 8)


def test_lexing_and_directives(spark):
    src = 'int main(void) { return f("a//b", \'c\') + 0x1F; } // end\n/* x\n y */ f();'
    df = spark.createDataFrame([(1, src)], "k long, s string").select("k", parse.without_comments(F.col("s")).alias("s"))
    t = parse.tokens(df, "k", "s")
    assert [r["token"] for r in t.orderBy("pos").collect()][:12] == ["int", "main", "(", "void", ")", "{", "return", "f", "(", '"a//b"', ",", "'c'"]
    assert sorted(r["name"] for r in parse.calls(t, "k").collect()) == ["f", "f", "main"]
    assert [r["name"] for r in parse.functions(t, "k").collect()] == ["main"]
    lines = spark.createDataFrame([("#define MAX(a, b) ((a) > (b))",), ('#include "x.h"',), ("int y;",)], "line string")
    got = {r["name"]: (r["directive"], r["params"], r["body"], r["system"]) for r in parse.directives(lines, "line").collect()}
    assert got == {"MAX": ("define", "a, b", "((a) > (b))", False), "x.h": ("include", "", None, False)}
    assert spark.createDataFrame([("a<:1:> %: b\\\nc",)], "s string").select(parse.spliced(F.col("s"))).first()[0] == "a<:1:> %: bc"
    digraphs = parse.tokens(spark.createDataFrame([(1, 'a<:1:> %: "<:" <% x %>')], "k long, s string"), "k", "s")
    assert [r["token"] for r in digraphs.orderBy("pos").collect()] == ["a", "[", "1", "]", "#", '"<:"', "{", "x", "}"]


def test_macro_that_names_itself(spark):
    t = parse.tokens(spark.createDataFrame([(1, "A B")], "k long, s string"), "k", "s")
    macros = spark.createDataFrame([("A", ["A", "+", "B"]), ("B", ["A"])], "name string, body array<string>")
    assert [r["token"] for r in parse.expand_macros(t, macros, "k", 4).orderBy("pos").collect()] == ["A", "+", "A", "A", "+", "B"]


def test_dense_blocks(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(6, 4, 8))
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(m)], "k long, v array<double>")
    for r in dense.with_orthogonal(df, "v", 4, steps=12).collect():
        s = np.linalg.svd(np.array(r["orthogonal"]).reshape(4, 8), compute_uv=False)
        assert ((s > 0.6) & (s < 1.3)).all()
    z = dense.with_fft(df, "v").first()
    assert np.allclose(np.array(z["spectrum"]).reshape(-1, 2) @ [1, 1j], np.fft.fft(m[z["k"]].ravel()))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"0123456789")
    f = files.read_binary(spark, str(tmp_path), "*.txt")
    assert bytes(files.byte_range(f, 3, 4).first()["content"]) == b"3456"
    assert [r["n"] for r in files.map_corpus(f, lambda v: [(len(v),)], "n long").collect()] == [10]


def test_stream_drops_late_rows(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 03:00:00", "a", 2), ("2024-01-01 00:20:00", "a", 4), ("2024-01-01 09:00:00", "a", 8)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, kind string, value long").select(F.to_timestamp("ts").alias("ts"), "kind", "value").coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    schema = spark.read.parquet(f"{src}/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    w = windows.windowed(stream, "ts", F.window("ts", "1 hour"), "1 hour", "kind")
    windows.run_available(w, str(out), str(tmp_path / "cp")).awaitTermination()
    got = {(r["start"].hour, r["total"]) for r in spark.read.parquet(str(out)).collect()}
    assert (0, 1) in got or (0, 5) in got
    assert windows.net_deltas(spark.createDataFrame([("x", 1), ("x", -1), ("y", 1)], "k string, diff int"), "k").collect()[0]["k"] == "y"


def test_blake3_vectors():
    wave = bytes(k % 251 for k in range(8193))
    got = [d.hex() for d in hashing.blake3([b"", b"abc", wave[:1024], wave[:1025], wave[:2048], wave[:5 * 1024]])]
    assert got[:5] == [
        "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
        "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85",
        "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    ]
    assert hashing.blake3([]) == []


def test_lz4_blocks():
    assert hashing.lz4_decode(hashing.lz4_literals(b"x" * 1000)) == b"x" * 1000
    # Four literals, a reference of 4 + 15 + 5 bytes back by 2, five literals.
    block = bytes([0x4F]) + b"abcd" + bytes([2, 0, 5]) + bytes([0x50]) + b"final"
    assert hashing.lz4_decode(block) == b"abcd" + b"cd" * 12 + b"final"
    with pytest.raises(ValueError):
        hashing.lz4_decode(bytes([0x10]) + b"a" + bytes([9, 0]) + bytes([0x10]) + b"b")
