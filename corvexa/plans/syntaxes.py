"""Statement trees, control flow, names, extensions and expressions of C sources derived from parts.

The sources have two shapes, by the parity of the part; what is found in them is written out below.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvexa.functions.arrow import spread
from corvexa.operators import grammar, parse, syntax
from corvexa.registry import query, table

from .parses import _TOK, toks

SHAPES = (
    "typedef unsigned T{k} ; T{k} f{k} ( int a , T{k} b ) { T{k} c = a + b ; if ( c > {size} ) { int a = 1 ; c = a ; } else c = 2 ; while ( b ) { b -- ; if ( a ) break ; } return c ; }",
    "struct S{k} { int x ; } ; int g{k} [ 3 ] = { 1 , 2 , {size} } ; void h{k} ( struct S{k} * s ) { for ( int i = 0 ; i < 3 ; i ++ ) { if ( g{k} [ i ] ) continue ; s -> x += i ; } do s -> x -- ; while ( s -> x ) ; switch ( s -> x ) { case 1 : g{k} [ 0 ] = 1 ; break ; default : goto end ; } end : ; }",
)
#: (shape, node, parent, kind, name, start, stop)
NODES = """
0 0 - unit - 0 61|0 1 0 typedef T* 0 3|0 2 0 function f* 4 61|0 3 2 block - 13 61|0 4 3 declaration c 14 20|0 5 3 if - 21 42|0 6 5 block - 27 37|0 7 6 declaration a 28 32
0 8 6 expression - 33 36|0 9 5 expression - 39 42|0 10 3 while - 43 57|0 11 10 block - 47 57|0 12 11 expression - 48 50|0 13 11 if - 51 56|0 14 13 break - 55 56|0 15 3 return - 58 60
1 0 - unit - 0 103|1 1 0 declaration - 0 7|1 2 0 declaration g* 8 21|1 3 0 function h* 22 103|1 4 3 block - 30 103|1 5 4 for - 31 61|1 6 5 block - 45 61|1 7 6 if - 46 54
1 8 7 continue - 53 54|1 9 6 expression - 55 60|1 10 4 do - 62 74|1 11 10 expression - 63 67|1 12 4 switch - 75 99|1 13 12 block - 81 99|1 14 13 case - 82 84|1 15 13 expression - 85 91
1 16 13 break - 92 93|1 17 13 default - 94 95|1 18 13 goto end 96 98|1 19 4 label end 100 101|1 20 4 empty - 102 102
"""
#: (shape, src, dst, kind)
EDGES = """
0 2 3 entry|0 3 4 next|0 4 5 next|0 5 6 true|0 6 7 next|0 7 8 next|0 5 9 false|0 8 10 next|0 9 10 next|0 10 11 true|0 11 12 next|0 12 13 next|0 13 14 true|0 13 10 back|0 10 15 false|0 14 15 next|0 15 2 return
1 3 4 entry|1 4 5 next|1 5 6 true|1 6 7 next|1 7 8 true|1 8 5 back|1 7 9 false|1 9 5 back|1 5 10 false|1 10 11 next|1 11 10 back|1 11 12 false|1 12 14 case|1 14 15 next|1 15 16 next|1 12 17 default|1 17 18 next
1 16 19 next|1 19 20 next|1 20 3 next|1 18 19 goto
"""
#: (shape, pos, name, role, kind, target)
NAMES = """
0 2 T* declares typedef 2|0 4 T* uses typedef 2|0 5 f* declares function 5|0 8 a declares parameter 8|0 10 T* uses typedef 2|0 11 b declares parameter 11|0 14 T* uses typedef 2|0 15 c declares variable 15|0 17 a uses parameter 8|0 19 b uses parameter 11
0 23 c uses variable 15|0 29 a declares variable 29|0 33 c uses variable 15|0 35 a uses variable 29|0 39 c uses variable 15|0 45 b uses parameter 11|0 48 b uses parameter 11|0 53 a uses parameter 8|0 59 c uses variable 15
1 1 S* declares tag 1|1 9 g* declares variable 9|1 23 h* declares function 23|1 28 s declares parameter 28|1 34 i declares variable 34|1 38 i uses variable 34|1 42 i uses variable 34|1 48 g* uses variable 9|1 50 i uses variable 34|1 55 s uses parameter 28
1 59 i uses variable 34|1 63 s uses parameter 28|1 70 s uses parameter 28|1 77 s uses parameter 28|1 85 g* uses variable 9
"""


def _values(found: str, columns: str) -> str:
    """DuckDB: a table of the rows; - is null and * the number of the part."""
    rows = [r.split() for line in found.strip().split("\n") for r in line.split("|")]
    plain = lambda v: "NULL" if v == "-" else v if v.isdigit() else f"'{v}'"
    return f"(VALUES {', '.join('(' + ', '.join(map(plain, r)) + ')' for r in rows)}) AS t(shape, {columns})"


def _listed(found: str, columns: str) -> str:
    out = ", ".join("replace(name, '*', p_partkey::VARCHAR) AS name" if c == "name" else c if c in ("kind", "role") else f"CAST({c} AS BIGINT) AS {c}" for c in columns.split(", "))
    return f"SELECT p_partkey AS k, {out} FROM part JOIN {_values(found, columns)} ON shape = p_partkey % 2"


_NODES, _EDGES, _NAMES = _listed(NODES, "node, parent, kind, name, start, stop"), _listed(EDGES, "src, dst, kind"), _listed(NAMES, "pos, name, role, kind, target")


def sources(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{k}"), k), F.lit("{size}"), size)
    return parse.sources(p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 2 == 0, fill(SHAPES[0])).otherwise(fill(SHAPES[1])).alias("s")), "k", "s")


@query(_NODES)
def c_statement_tree(spark, sf_dir):
    """Nodes of statements and declarations, with their kinds, names and tokens."""
    return syntax.nodes(sources(spark, sf_dir), "k")


@query(_EDGES)
def c_control_edges(spark, sf_dir):
    return syntax.control_edges(sources(spark, sf_dir), "k")


@query(_NAMES)
def c_names(spark, sf_dir):
    """Type names, variables, parameters, functions and tags where they are declared, and what each use sees."""
    return syntax.names(sources(spark, sf_dir), "k")


@query(f"SELECT k, pos, name FROM ({_NAMES}) WHERE kind = 'typedef' AND role = 'uses'")
def typedef_uses(spark, sf_dir):
    """Identifiers that are type names where they stand."""
    return syntax.names(sources(spark, sf_dir), "k").where("kind = 'typedef' AND role = 'uses'").select("k", "pos", "name")


@query(f"""WITH n AS ({_NODES}), s AS ({_NAMES}), own AS (SELECT s.k, s.pos, s.role, s.target, max(n.node) AS node FROM s JOIN n ON n.k = s.k AND s.pos BETWEEN n.start AND n.stop GROUP BY ALL),
decl AS (SELECT k, pos, node FROM own WHERE role = 'declares') SELECT k, parent AS src, node AS dst, 'child' AS kind FROM n WHERE parent IS NOT NULL UNION ALL ({_EDGES})
UNION ALL SELECT DISTINCT own.k, own.node, decl.node, 'refers' FROM own JOIN decl ON decl.k = own.k AND decl.pos = own.target WHERE own.role = 'uses'""")
def c_semantic_graph(spark, sf_dir):
    """The program graph: children, control flow, references."""
    return syntax.semantic_edges(sources(spark, sf_dir), "k")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), o AS (SELECT k, src, count(*) AS outs FROM e GROUP BY 1, 2), i AS (SELECT k, dst, count(*) AS ins FROM e GROUP BY 1, 2),
s AS (SELECT e.k, e.src, e.dst FROM e JOIN o ON o.k = e.k AND o.src = e.src JOIN i ON i.k = e.k AND i.dst = e.dst WHERE outs = 1 AND ins = 1 AND kind = 'next'),
n AS (SELECT k, src AS node FROM e UNION SELECT k, dst FROM e), w AS (SELECT n.k, n.node, n.node AS leader FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = n.k AND s.dst = n.node) UNION ALL SELECT w.k, s.dst, w.leader FROM w JOIN s ON s.k = w.k AND s.src = w.node)
SELECT k, node, leader FROM w""")
def c_basic_blocks(spark, sf_dir):
    return syntax.blocks_of_files(sources(spark, sf_dir), "k")


@query(f"""WITH {_TOK}, d AS (SELECT *, CAST(sum(CASE WHEN t IN ('(', '[', '{{') THEN 1 WHEN t IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) + CASE WHEN t IN (')', ']', '}}') THEN 1 ELSE 0 END AS BIGINT) AS depth FROM tok),
o AS (SELECT page_id, depth, pos FROM d WHERE t IN ('(', '[', '{{')), a AS (SELECT page_id, pos, t AS token, depth - CASE WHEN t IN ('(', '[', '{{') THEN 1 ELSE 0 END AS lane FROM d),
p AS (SELECT a.page_id, a.pos, a.token, CASE WHEN any_value(lane) = 0 THEN -1 ELSE coalesce(max(o.pos), -1) END AS parent FROM a LEFT JOIN o ON o.page_id = a.page_id AND o.depth = a.lane AND o.pos < a.pos GROUP BY 1, 2, 3)
SELECT p.page_id, p.pos, token, parent, (SELECT min(c.pos) FROM p c WHERE c.page_id = p.page_id AND c.parent = p.pos) AS first_child, lead(p.pos) OVER (PARTITION BY p.page_id, parent ORDER BY p.pos) AS next_sibling FROM p""")
def c_structure(spark, sf_dir):
    """Every token's bracket, first child and next sibling."""
    return syntax.structure(toks(spark, sf_dir), "page_id").select("page_id", "pos", "token", "parent", "first_child", "next_sibling")


@query("SELECT p_partkey AS k, unnest(CAST([4, 11, 17, 25, 31] AS BIGINT[])) AS pos, unnest(['__attribute__', '__builtin_expect', 'typeof', '__extension__', '(']) AS name, unnest(['attribute', 'builtin', 'typeof', 'extension', 'statement expression']) AS family FROM part")
def gnu_builtins(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    s = F.concat(F.lit("int a , b __attribute__ ( x ) ; if ( __builtin_expect ( "), "p_size", F.lit(" , 1 ) typeof ( a ) c = b ; __extension__ long d = 1 ; ( { 2 ; } )"))
    return syntax.builtins(parse.tokens(p.select(F.col("p_partkey").alias("k"), s.alias("s")), "k", "s"), "k")


@query(
    r"""SELECT p_partkey AS k, p_partkey % 2 = 0 AS volatile, '"mov %1, %0\n" "add $' || p_size || ', %0"' AS template, ['"=r" (out)', '[x] "+m" (v[' || p_size || '])'] AS outputs, ['"r" (in)', '"i" (' || p_partkey || ')'] AS inputs, ['"cc"', '"memory"'] AS clobbers FROM part
UNION ALL SELECT p_partkey, false, '"nop"', [], [], [] FROM part"""
)
def inline_assembly(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    s = F.concat(F.lit("int f() { "), F.when(k % 2 == 0, "asm volatile (").otherwise("__asm__("), F.lit(r'"mov %1, %0\n" "add $'), "p_size", F.lit(', %0" : "=r" (out), [x] "+m" (v['), "p_size", F.lit(']) : "r" (in), "i" ('), k, F.lit(') : "cc", "memory"); asm("nop"); }'))
    return syntax.inline_assembly(p.select(k.alias("k"), s.alias("s")), "k", "s")


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN ['x', (p_size * 3 + 4)::VARCHAR, '+'] WHEN 1 THEN CASE p_size WHEN 1 THEN ['0'] WHEN 2 THEN ['x'] ELSE ['x', (p_size - 1)::VARCHAR, '*'] END ELSE ['y'] END AS folded FROM part")
def constant_folding(spark, sf_dir):
    """Constant parts of expressions worked out."""
    p = spread(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("x + ("), s, F.lit(" * 3 + 4)"))).when(k % 3 == 1, F.concat(F.lit("x * ("), s, F.lit(" - 1)"))).otherwise(F.concat(F.lit("y * 1 + 0 * z * "), s))
    return syntax.fold_constants(parse.postfix(parse.sources(p.select(k.alias("k"), text.alias("s")), "k", "s"), "k"), "k", "postfix")


@query("""SELECT p_partkey AS k, unnest(CAST(range(11) AS BIGINT[])) AS place, unnest(['a', p_size::VARCHAR, '+', 'a', p_size::VARCHAR, '+', '*', 'b', 'a', '-', '+']) AS op, unnest(CAST([NULL, NULL, 0, NULL, NULL, 0, 2, NULL, NULL, 4, 3] AS BIGINT[])) AS "left",
 unnest(CAST([NULL, NULL, 1, NULL, NULL, 1, 2, NULL, NULL, 0, 5] AS BIGINT[])) AS "right", unnest(CAST([0, 1, 2, 0, 1, 2, 3, 4, 0, 5, 6] AS BIGINT[])) AS number FROM part""")
def common_subexpressions(spark, sf_dir):
    """Equal operations share a number."""
    p = spread(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    s = F.concat(F.lit("(a + "), "p_size", F.lit(") * (a + "), "p_size", F.lit(") + (b - a)"))
    return syntax.value_numbers(parse.postfix(parse.sources(p.select(F.col("p_partkey").alias("k"), s.alias("s")), "k", "s"), "k"), "k", "postfix")


#: Sums of products of atoms, as rules of a grammar.
EXPRESSIONS = [("S", ("E",)), ("E", ("E", "+", "T")), ("E", ("E", "-", "T")), ("E", ("T",)), ("T", ("T", "*", "A")), ("T", ("A",)), ("A", ("n",)), ("A", ("(", "E", ")"))]


@query("SELECT p_partkey AS k, p_partkey % 3 <> 2 AS accepted, CASE p_partkey % 3 WHEN 0 THEN [6, 5, 3, 6, 5, 6, 4, 1] WHEN 1 THEN [6, 5, 3, 6, 5, 2, 7, 5, 6, 4, 3] END AS rules FROM part")
def table_driven_parse(spark, sf_dir):
    """Expressions parsed by LR(1) tables that are built from a grammar; a third of them isn't in its language."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("a + 2 * "), s)).when(k % 3 == 1, F.concat(F.lit("(a - "), s, F.lit(") * b"))).otherwise(F.concat(F.lit("a + * "), s))
    terminal = lambda t, kind: F.when(kind.isin("identifier", "integer"), "n").otherwise(t)
    return grammar.parsed(parse.tokens(p.select(k.alias("k"), text.alias("s")), "k", "s"), "k", grammar.build_tables(EXPRESSIONS), terminal)


_OWNED = (
    "fn f ( ) {{ let {a} = String : : new ( ) ; let b = {a} ; let n = 1 ; g ( n ) ; g ( n , {a} ) ; {a} = h ( ) ; g ( & {a} ) ; }}",
    "fn f ( c ) {{ let {a} = make ( ) ; if c {{ g ( {a} ) ; }} else {{ show ! ( {a} ) ; }} {a} . len ( ) ; }}",
    "fn f ( ) {{ let {a} = make ( ) ; while more ( ) {{ g ( {a} ) ; }} let d = make ( ) ; g ( & d , d ) ; }}",
)


@query("SELECT p_partkey AS k, CAST([34, 31, 19][p_partkey % 3 + 1] AS BIGINT) AS pos, 'a' || p_partkey AS name, CAST([18, 18, 19][p_partkey % 3 + 1] AS BIGINT) AS moved_at FROM part")
def moved_uses(spark, sf_dir):
    """Uses of owned values after they were moved: straight on, after a branch, in a loop."""
    k = F.col("p_partkey")
    text = F.get(F.array(*[F.replace(F.lit(s.replace("{{", "{").replace("}}", "}")), F.lit("{a}"), F.concat(F.lit("a"), k)) for s in _OWNED]), (k % 3).cast("int"))
    p = spread(table(spark, sf_dir, "part", "p_partkey"), "p_partkey")
    return grammar.moved_uses(parse.sources(p.select(k.alias("k"), text.alias("s")), "k", "s"), "k")
