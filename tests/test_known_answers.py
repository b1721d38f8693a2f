"""Small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from corvexa.functions import text
from corvexa.operators import graph, hashing, match, reduce, semiring


def test_gather_scatter_compact(spark):
    src = spark.createDataFrame(list(enumerate([10, 20, 30, 40])), "pos long, v long")
    at = spark.createDataFrame(list(enumerate([3, 0, 2, 1])), "i long, at long")
    assert [r["v"] for r in reduce.gather(src, at).orderBy("i").collect()] == [40, 10, 30, 20]
    to = at.withColumnRenamed("i", "pos")
    assert [r["v"] for r in reduce.scatter(src, to).orderBy("at").collect()] == [20, 40, 30, 10]
    flagged = spark.createDataFrame(list(zip(range(5), [10, 20, 30, 40, 50], [0, 1, 1, 0, 1])), "pos long, v long, f int")
    assert [(r["at"], r["v"]) for r in reduce.stream_compact(flagged, "pos", F.col("f") == 1).orderBy("at").collect()] == [(0, 20), (1, 30), (2, 50)]


def _matrix(spark, rows, names):
    return spark.createDataFrame([(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], names)


def test_semiring_cells(spark):
    m = [[0, 5, 0], [0, 0, 3], [0, 0, 0]]
    a, b = _matrix(spark, m, "i long, k long, v long"), _matrix(spark, m, "k long, j long, v long")
    assert {(r["i"], r["j"]): r["v"] for r in semiring.product(a, b, "max_plus").collect()}[0, 2] == 8
    a, b = _matrix(spark, [[1, 0], [1, 1]], "i long, k long, v long"), _matrix(spark, [[1, 1], [0, 1]], "k long, j long, v long")
    assert [r["v"] for r in semiring.product(a, b, "gf2").orderBy("i", "j").collect()] == [1, 1, 1, 0]


def test_closure_within_a_label(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3), (2, 3)], "src long, dst long")
    inside = spark.createDataFrame([(0,), (1,), (2,)], "node long")
    held = e.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    assert {r["node"] for r in graph.closure(inside.where("node = 0"), held).collect()} == {0, 1, 2}
    assert {r["node"]: r["component"] for r in graph.strong_components(e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_spans_and_histogram(spark):
    spans = spark.createDataFrame([(1, 7, 0, 8), (1, 7, 0, 8), (1, 8, 4, 12)], "k long, pattern_id long, start long, stop long")
    df = spark.createDataFrame([(1, b"AKIA1234567890ZZ")], "k long, raw binary")
    got = {(r["pattern_id"], r["start"], r["stop"]): round(r["entropy"], 4) for r in match.score_spans(df, "k", "raw", spans).collect()}
    assert got == {(7, 0, 8): 2.75, (8, 4, 12): 3.0}
    h = {r["byte"]: r["count"] for r in text.byte_histogram(spark.createDataFrame([("éé",)], "s string"), "s").collect()}
    assert h == {0xC3: 2, 0xA9: 2}


@pytest.mark.parametrize(
    ("patterns", "body"),
    [
        (["he", "she", "his", "hers"], "ushers"), (["abc"], "xxabcxx"), (["abc"], "abcxxxx"), (["abc"], "xxxxabc"), (["abc"], "xxxyyyy"), (["aa", "aaa"], "aaaa"),
        (["abab", "babab"], "xababaxxbabaxbababx"), (["foo", "foobar", "bar"], "foobar"), (["x"], "axbxcxd"), (["ä", "日本"], "xä日本語ä"),
    ],
)
def test_literals(spark, patterns, body):
    raw = body.encode()
    want = {(k, s, s + len(p)) for k, p in enumerate(x.encode() for x in patterns) for s in range(len(raw)) if raw[s : s + len(p)] == p}
    df = spark.createDataFrame([(1, raw)], "k long, raw binary")
    assert {tuple(r)[1:] for r in match.find_literals(df, "k", "raw", [p.encode() for p in patterns]).collect()} == want


def test_digest_of_one_block():
    """Fixed value: the published digest of the empty input."""
    assert hashing.blake3([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
