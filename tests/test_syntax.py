"""C syntax, macros, automata, circuits, diagrams and extensions against plain Python and known answers."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvexa.functions import u32
from corvexa.operators import automata, circuits, extensions, flow, grammar, layers, match, parse, semiring, syntax


def tokens(spark, text):
    return parse.tokens(spark.createDataFrame([(1, text)], "k long, s string"), "k", "s")


@pytest.mark.parametrize(
    "text",
    ["", ";", "}", "{{{", "int f(", "int f() { if (", "int f() { while (1) {", "typedef", "struct { int x;", "f() { case 1: x; } }", "goto x;", "int a[3] = {1, {2}, (3", "void g() { else else do } while", ") ] }", "#define X 1\nint y;", "enum { A, B = 2, C } e; int h() { return A + C; }"],
)
def test_parsing_ends_on_any_text(text):
    """Broken sources give a tree of some kind; every node lies within its parent's tokens."""
    words = re.findall(r"[A-Za-z_]\w*|\d+|\S", text)
    kind = lambda t: "keyword" if t in parse.KEYWORDS else "identifier" if t[0].isalpha() else "operator"
    u = syntax.Unit([(k, t, kind(t)) for k, t in enumerate(words)])
    for n, parent, *_ in u.nodes[1:]:
        assert parent is not None and parent < n
    assert all(s < len(u.nodes) and d < len(u.nodes) for s, d, _ in u.edges)


def test_random_tokens_parse(spark):
    rng = random.Random(5)
    pool = ["int", "typedef", "if", "else", "while", "for", "do", "switch", "case", "default", "return", "break", "goto", "{", "}", "(", ")", ";", ",", "a", "b", "=", "1", ":", "*", "struct"]
    for _ in range(300):
        words = [rng.choice(pool) for _ in range(rng.randrange(40))]
        u = syntax.Unit([(k, t, "keyword" if t in parse.KEYWORDS else "identifier" if t.isalpha() else "operator") for k, t in enumerate(words)])
        assert u.p >= len(words)


def test_deep_nesting(spark):
    t = tokens(spark, "void f() " + "{" * 400 + "x;" + "}" * 400)
    assert syntax.nodes(t, "k").where("kind = 'function'").count() == 1


def test_enumerators_and_shadowing(spark):
    found = {(r["name"], r["role"], r["kind"]) for r in syntax.names(tokens(spark, "enum E { A, B } e; typedef int T; void f(T x) { int T; T = A; } T y;"), "k").collect()}
    assert ("A", "declares", "constant") in found and ("A", "uses", "constant") in found and ("T", "uses", "variable") in found and ("y", "declares", "variable") in found


def test_macros_by_the_standard(spark):
    """Arguments that nest, empty ones, pasting, rescanning, names hidden in their own expansion."""
    m = [
        parse.Macro("f", ("a",), ("f", "(", "x", "*", "(", "a", ")", ")")), parse.Macro("x", None, ("2",)), parse.Macro("g", None, ("f",)), parse.Macro("z", None, ("z", "[", "0", "]")),
        parse.Macro("t", ("a",), ("a",)), parse.Macro("p", (), ("int",)), parse.Macro("h", ("a", "b"), ("a", "##", "b")), parse.Macro("v", ("...",), ("#", "__VA_ARGS__")),
    ]
    run = lambda text: [r["token"] for r in parse.expand_all(tokens(spark, text), m, "k").orderBy("pos").collect()]
    assert run("f(y+1)") == "f ( 2 * ( y + 1 ) )".split()
    assert run("t(t(g)(0) + t)(1);") == "f ( 2 * ( 0 ) ) + t ( 1 ) ;".split()
    assert run("g(z)") == "f ( 2 * ( z [ 0 ] ) )".split()
    assert run("p() h(x, y) h(,q) f") == ["int", "xy", "q", "f"]
    assert run("t((a, b))") == ["(", "a", ",", "b", ")"] and run("f(1") == ["f", "(", "1"]
    with pytest.raises(ValueError):
        parse.expand_all(tokens(spark, "a"), [parse.Macro("a", None, ("b",) * (parse.MAX_MACRO_TOKENS + 1))], "k")


def test_folding_of_constants(spark):
    e = spark.createDataFrame([(1, ["a", "0", "*"]), (2, ["4294967295", "1", "+"]), (3, ["1", "0", "/"]), (4, []), (5, ["+"])], "k long, p array<string>")
    assert {r["k"]: r["folded"] for r in syntax.fold_constants(e, "k", "p").collect()} == {1: ["0"], 2: ["0"], 3: ["1", "0", "/"], 4: [], 5: ["+"]}


@pytest.mark.parametrize("pattern", [b"ab", b"a*b", b"(ab|cd)+e", b"[a-c]x?", b"a.c", b"[^ab]d", b"a(b|)c", b"\\.x"])
def test_automata_against_regexes(spark, pattern):
    rng = random.Random(9)
    t = automata.compile_set([pattern])
    texts = ["".join(rng.choice("abcdex.") for _ in range(rng.randrange(0, 14))).encode() for _ in range(200)]
    ends = lambda v: [e for e in range(1, len(v) + 1) if any(re.fullmatch(pattern, v[s:e]) for s in range(e + 1))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, raw binary")
    for r in automata.scan(df, "k", "raw", t).collect():
        want = ends(texts[r["k"]])
        assert (r["ends"], r["first"]) == (len(want), want[0] if want else None)
    small = automata.compile_set([b"a", b"a", b"[a]"])
    assert len(small.step) == 2
    for bad in (b"(a", b"[a", b"a)"):
        with pytest.raises(ValueError):
            automata.compile_set([bad])


def test_anchors():
    assert automata.anchors("[A-Z][a-z]+ing") == ["ing"] and automata.anchors("foo(bar|baz)+qux?zap") == ["foo", "qu", "zap"] and automata.anchors("ab|cd") == []


def test_models_against_all_assignments():
    rng = random.Random(2)
    for _ in range(120):
        n = rng.randrange(1, 7)
        cnf = [[rng.choice([-1, 1]) * rng.randrange(1, n + 1) for _ in range(rng.randrange(0, 4))] for _ in range(rng.randrange(0, 7))]
        want = sum(all(any(v[abs(x) - 1] == (x > 0) for x in c) for c in cnf) for v in itertools.product([False, True], repeat=n))
        gates = circuits.compile_cnf(cnf)
        assert circuits.count_models(gates, n) == want
        scopes = []
        for g in gates:  # and-gates share no variable
            if g[0] == "and":
                assert sum(len(scopes[k]) for k in g[1]) == len(frozenset().union(*(scopes[k] for k in g[1])))
            scopes.append(frozenset([abs(g[1])]) if g[0] == "lit" else frozenset() if g[0] in ("true", "false") else frozenset().union(*(scopes[k] for k in g[1])))


def test_identity_spiders_go(spark):
    spiders = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (2, 0, 3), (3, 0, 0)], "node long, colour int, phase int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    left, joined = circuits.drop_identities(spiders, edges)
    assert {r["node"] for r in left.collect()} == {0, 2, 3} and {(r["src"], r["dst"]) for r in joined.collect()} == {(2, 3), (0, 2)}


def test_registered_operations(spark):
    ops = extensions.Extensions()
    ops.register("twice", lambda a: a * 2)
    ops.register("big", lambda a: a > 2)
    ops.register("top", lambda df, n: df.orderBy(F.desc("v")).limit(n))
    df = spark.createDataFrame([(1,), (2,)], "v long")
    assert [r[0] for r in df.select(ops.call("twice", F.col("v"))).collect()] == [2, 4]
    assert df.where((ops.condition("big", F.col("v") * 2) & match.literal(True)).column).count() == 1 and ops.apply("top", df, n=1).count() == 1
    with pytest.raises(ValueError):
        ops.register("big", lambda a: a)
    with pytest.raises(KeyError):
        ops.call("none")
    with pytest.raises(ValueError):
        flow.check("none", df, df, df)


def test_fused_multiply_add_rounds_once(spark):
    from fractions import Fraction

    rng = random.Random(8)
    rows = [(rng.uniform(-1, 1), rng.uniform(-1, 1), 0.0) for _ in range(300)]
    rows = [(a, b, -(a * b) + rng.choice([0.0, 1e-17, 1.0])) for a, b, _ in rows]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", u32.fma(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect()
    near = sum(r["f"] == float(Fraction(r["a"]) * Fraction(r["b"]) + Fraction(r["c"])) for r in got)
    assert near >= 290 and any(r["f"] != r["a"] * r["b"] + r["c"] for r in got)


def test_windows_and_suffixes_find_what_a_scan_finds(spark):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    patterns = [b"a", b"ab", b"aba", b"bbab", b""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, raw binary")
    every = {tuple(r) for r in match.find_literals(df, "k", "raw", patterns).collect()}
    for width in (2, 3):
        counts = {(r["k"], r["pattern_id"]): r["hits"] for r in match.count_by_suffix(df, "k", "raw", patterns, width).collect()}
        assert counts == {(k, p): sum(x[:2] == (k, p) for x in every) for k, p, *_ in every}
    windows = df.select("k", F.explode(F.array(F.struct(F.lit(2).alias("lo"), F.lit(12).alias("hi")), F.struct(F.lit(8).alias("lo"), F.lit(99).alias("hi")))).alias("w")).select("k", "w.lo", "w.hi")
    got = [tuple(r) for r in match.find_within(df, "k", "raw", windows, patterns).collect()]
    assert set(got) == {x for x in every if (x[2] >= 2 and x[3] <= 12) or x[2] >= 8} and len(got) == len(set(got))


def test_wide_lineage_equals_narrow(spark):
    rng = random.Random(4)
    state = [(0, k, 1 << k) for k in range(3)]
    rules = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(14)})
    rules = [(k, j, 1 << (10 + n)) for n, (k, j) in enumerate(rules)]
    narrow, _ = semiring.lineage_closure(spark.createDataFrame(state, "i long, k long, v long"), spark.createDataFrame(rules, "k long, j long, v long"))
    split = lambda rows: [(*r[:2], w, (r[2] >> (8 * w)) & 255) for r in rows for w in range(4) if (r[2] >> (8 * w)) & 255]
    wide = semiring.lineage_closure_wide(spark.createDataFrame(split(state), "i long, k long, word long, v long"), spark.createDataFrame(split(rules), "k long, j long, word long, v long"))
    got: dict = {}
    for r in wide.collect():
        got[r["i"], r["k"]] = got.get((r["i"], r["k"]), 0) | r["v"] << (8 * r["word"])
    assert got == {(r["i"], r["k"]): r["v"] for r in narrow.collect()}


def test_delta_rule_over_chunks(spark):
    rng = np.random.default_rng(1)
    n, d = 150, 3
    q, k, v, g, b = rng.normal(size=(n, d)), rng.normal(size=(n, d)), rng.normal(size=(n, 2)), -rng.random(n), rng.normal(size=n)
    df = spark.createDataFrame([(0, t, q[t].tolist(), k[t].tolist(), v[t].tolist(), float(g[t]), float(b[t])) for t in range(n)], "head long, t long, q array<double>, k array<double>, v array<double>, decay double, beta double")
    s, want = np.zeros((d, 2)), []
    for t in range(n):
        a, c = q[t] / np.sqrt(q[t] @ q[t] + 1e-6), k[t] / np.sqrt(k[t] @ k[t] + 1e-6)
        s = s * np.exp(g[t])
        s = s + np.outer(c, (v[t] - c @ s) / (1 + np.exp(-b[t])))
        want.append(a @ s)
    for chunk in (7, 64):
        got = [r["out"] for r in layers.gated_delta(df.repartition(3), "head", "t", chunk).orderBy("t").collect()]
        assert np.allclose(got, want)


def test_exchanges_in_ranges(spark):
    """The maps of ranges, applied in turn, against steps followed one by one, for every value at the start."""
    from corvexa.plans.scalars import compare_exchange, exchange_map

    rng = random.Random(13)
    for _ in range(200):
        steps = [(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(12))]
        for start, final, swaps in exchange_map(steps):
            v = n = 0
            v = start
            for e, d in steps:
                if v == e:
                    v, n = d, n + 1
            assert (final, swaps) == (v, n)
    rows = [(k % 3 if k % 2 else 0, k, rng.randrange(4), rng.randrange(4)) for k in range(3000)]
    df = spark.createDataFrame(rows, "slot long, o long, e long, d long").repartition(5)
    got = {r["slot"]: (r["final"], r["swaps"]) for r in compare_exchange(df, "slot", "o", "e", "d").collect()}
    for slot in {r[0] for r in rows}:
        v = n = 0
        for s, _, e, d in rows:
            if s == slot and v == e:
                v, n = d, n + 1
        assert got[slot] == (v, n)


def test_grammars(spark):
    """Languages by brute force; grammars with conflicts are refused; empty rules."""
    t = grammar.build_tables([("S", ("L",)), ("L", ("L", "P")), ("L", ()), ("P", ("(", "L", ")"))])

    def balanced(w):
        depth = 0
        for c in w:
            depth += 1 if c == "(" else -1
            if depth < 0:
                return False
        return depth == 0

    for n in range(9):
        for w in itertools.product("()", repeat=n):
            assert (grammar.reductions(t, list(w)) is not None) == balanced(w)
    with pytest.raises(ValueError):
        grammar.build_tables([("S", ("E",)), ("E", ("E", "+", "E")), ("E", ("n",))])
    with pytest.raises(ValueError):
        grammar.build_tables([("S", ("X",)), ("X", ("A",)), ("X", ("B",)), ("A", ("x",)), ("B", ("x",))])


def test_sharded_patterns_find_the_same(spark):
    rng = random.Random(6)
    patterns = [b"ab", b"ba+c", b"[bc]d", b"aaaa"]
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, raw binary")
    whole = {tuple(r) for r in automata.scan_places(df, "k", "raw", automata.compile_set(patterns)).collect()}
    parts = automata.sharded(patterns, 5)
    assert sorted(n for numbers, _ in parts for n in numbers) == [0, 1, 2, 3] and len(parts) > 1
    assert {tuple(r) for _, t in parts for r in automata.scan_places(df, "k", "raw", t).collect()} == whole
