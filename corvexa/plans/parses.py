"""Parsing queries: page scripts and styles as source files, directives and expressions derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvexa.functions.arrow import spread
from corvexa.operators import parse, syntax
from corvexa.registry import query, table

#: DuckDB: tokens and their kinds, written apart from the operator's own pattern.
_RE = (
    r'''"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+[uUlL]*|\d+[.]\d*(?:[eE][+-]?\d+)?[fFlL]?|[.]\d+(?:[eE][+-]?\d+)?[fFlL]?|\d+[eE][+-]?\d+[fFlL]?|\d+[uUlL]*'''
    r"""|<<=|>>=|[.]{3}|->|[+][+]|--|<<|>>|[<>=!]=|&&|[|]{2}|[+*/%&|^-]=|##|[!#$%&(-/:-@\[-^`{-~]"""
)
_WORDS = "string_split('auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local', ' ')"
_SRC = "src AS (SELECT page_id, regexp_extract(html, '<script>([^<]*)', 1) || ' fn' || page_id || '(){' || regexp_extract(html, '<style>([^<]*)', 1) || '} main(){fn' || (page_id - page_id % 3) || '(1);{a;}' || CASE WHEN page_id % 2 = 0 THEN 'fn' || page_id || '(fn0());' ELSE '' END || '}' AS s FROM pages)"
_KIND = f"""CASE WHEN list_contains({_WORDS}, t) THEN 'keyword' WHEN t[1] = '"' THEN 'string' WHEN t[1] = chr(39) THEN 'char' WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(t, '^0[xX]') THEN 'integer' WHEN regexp_matches(t, '^([0-9]+[.]|[.][0-9]|[0-9]+[eE])') THEN 'float' WHEN regexp_matches(t, '^[0-9]') THEN 'integer' ELSE 'operator' END"""
_TOK = f"{_SRC}, tok AS (SELECT page_id, pos, t, {_KIND} AS kind FROM (SELECT page_id, unnest(regexp_extract_all(s, '{_RE}')) AS t, CAST(generate_subscripts(regexp_extract_all(s, '{_RE}'), 1) - 1 AS BIGINT) AS pos FROM src))"


def sources(spark, sf_dir):
    p, h = table(spark, sf_dir, "pages", "page_id", "html"), F.col("html")
    k = F.col("page_id")
    more = F.when(k % 2 == 0, F.concat(F.lit("fn"), k, F.lit("(fn0());"))).otherwise("")
    s = F.concat(F.regexp_extract(h, "<script>([^<]*)", 1), F.lit(" fn"), k, F.lit("(){"), F.regexp_extract(h, "<style>([^<]*)", 1), F.lit("} main(){fn"), k - k % 3, F.lit("(1);{a;}"), more, F.lit("}"))
    return p.select("page_id", s.alias("s"))


def toks(spark, sf_dir):
    return parse.tokens(sources(spark, sf_dir), "page_id", "s")


@query(f"WITH {_TOK} SELECT page_id, pos, t AS token, kind FROM tok")
def c_tokens(spark, sf_dir):
    return toks(spark, sf_dir)


@query(
    r"""SELECT k, unnest(t) AS token, unnest(CAST(range(len(t)) AS BIGINT[])) AS pos, unnest(['keyword', 'keyword', 'keyword', 'identifier', 'operator', 'keyword', 'keyword', 'identifier', 'operator', 'integer', 'operator', 'operator', 'operator', 'keyword', 'identifier',
 'operator', 'integer', 'operator', 'operator', 'float', 'operator', 'float', 'operator', 'integer', 'operator', 'operator', 'operator', 'string', 'operator', 'char', 'string', 'identifier']) AS kind
 FROM (SELECT p_partkey AS k, ['static', 'inline', 'long', 'f' || p_partkey, '(', 'volatile', 'int', 'a', '[', p_size::VARCHAR, ']', ')', '{', 'return', 'a', '[', '0', ']', '+', '1.5e3f', '-', '.25', '*', '0x1Fu', ';', '}', '##', '"<:\"%>"', '...', chr(39) || '\n' || chr(39), 'L"w"', 'autos'] AS t FROM part)"""
)
def c_lexing(spark, sf_dir):
    """Keywords, digraphs outside of strings, numbers of all forms, prefixed and escaped strings, a spliced line."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    s = F.concat(F.lit("static inl\\\nine long f"), "p_partkey", F.lit("(volatile int a<:"), "p_size", F.lit(r""":>) <% return a<:0:> + 1.5e3f - .25 * 0x1Fu; %> %:%: "<:\"%>" ... '\n' L"w" autos"""))
    return parse.tokens(p.select(F.col("p_partkey").alias("k"), parse.spliced(s).alias("s")), "k", "s")


@query(f"WITH {_TOK} SELECT page_id, pos, t AS name FROM (SELECT *, lead(t) OVER (PARTITION BY page_id ORDER BY pos) AS n FROM tok) WHERE kind = 'identifier' AND n = '('")
def extract_calls(spark, sf_dir):
    return parse.calls(toks(spark, sf_dir), "page_id")


@query(f"""WITH {_TOK}, d AS (SELECT *, sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) + CASE t WHEN '}}' THEN 1 ELSE 0 END AS depth FROM tok)
SELECT page_id, pos, CAST(depth AS BIGINT) AS depth, CASE WHEN depth = 0 THEN -1 ELSE max(CASE WHEN t = '{{' THEN pos END) OVER (PARTITION BY page_id, depth ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS scope FROM d""")
def brace_scopes(spark, sf_dir):
    return parse.scopes(toks(spark, sf_dir), "page_id").select("page_id", "pos", "depth", "scope")


@query(f"WITH {_TOK} SELECT page_id, name FROM (SELECT page_id, 'fn' || page_id AS name FROM src UNION ALL SELECT page_id, 'main' FROM src)")
def extract_functions(spark, sf_dir):
    return parse.functions(toks(spark, sf_dir), "page_id").select("page_id", "name")


@query(rf"""WITH {_SRC}, fns AS (SELECT page_id, 'fn' || page_id AS name FROM src UNION ALL SELECT page_id, 'main' FROM src), bodies AS (SELECT page_id, 'main' AS caller, regexp_extract(s, ' main\(\)[{{](.*)$', 1, 's') AS body FROM src
 UNION ALL SELECT page_id, 'fn' || page_id, regexp_extract(s, 'fn[0-9]+\(\)[{{](.*)[}}] main\(\)', 1, 's') FROM src)
SELECT caller, callee, count(*) AS calls FROM (SELECT caller, unnest(regexp_extract_all(body, '([A-Za-z_]\w*)\s*\(', 1)) AS callee FROM bodies) WHERE callee IN (SELECT name FROM fns) GROUP BY 1, 2""")
def call_graph(spark, sf_dir):
    t = toks(spark, sf_dir)
    return parse.call_graph(parse.calls(t, "page_id"), parse.functions(t, "page_id"), "page_id")


_LINES = "lines AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '#define P' || p_partkey || ' ' || p_size || ' + 1' WHEN 1 THEN '# undef P' || p_partkey WHEN 2 THEN '#include <' || p_brand || '.h>' ELSE 'int x = ' || p_size || '; // ' || p_type END AS line FROM part)"


def lines(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand", "p_type")
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("#define P"), k, F.lit(" "), F.col("p_size"), F.lit(" + 1"))).when(k % 4 == 1, F.concat(F.lit("# undef P"), k)).when(k % 4 == 2, F.concat(F.lit("#include <"), "p_brand", F.lit(".h>"))).otherwise(F.concat(F.lit("int x = "), F.col("p_size"), F.lit("; // "), "p_type"))
    return p.select(k.alias("k"), line.alias("line"))


@query(f"""WITH {_LINES} SELECT k, CASE k % 4 WHEN 0 THEN 'define' WHEN 1 THEN 'undef' ELSE 'include' END AS directive, CASE k % 4 WHEN 2 THEN string_split(string_split(line, '<')[2], '.h')[1] || '.h' ELSE 'P' || k END AS name, CASE k % 4 WHEN 0 THEN string_split(line, 'P' || k || ' ')[2] END AS body, k % 4 = 2 AS system FROM lines WHERE k % 4 < 3""")
def parse_directives(spark, sf_dir):
    return parse.directives(lines(spark, sf_dir), "line").select("k", "directive", "name", "body", "system")


_NOTES = """notes AS (SELECT p_partkey AS k, 'a' || p_size AS one, '/* ' || p_type || chr(10) || ' // ' || p_brand || ' " */' AS block, ' b = "/*" + ' || chr(39) || '"' || chr(39) || ';' AS two, '// it' || chr(39) || 's ' || p_name AS line,
 chr(10) || 'c //' || chr(10) || 'd;/**/e' AS three, '/*' || p_brand AS open FROM part)"""


def notes(spark, sf_dir):
    """Sources with comments of both kinds over several lines, comment marks in strings, and one that is left open."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_name")
    s = F.concat(F.lit("a"), "p_size", F.lit("/* "), "p_type", F.lit("\n // "), "p_brand", F.lit(' " */'), F.lit(""" b = "/*" + '"';"""), F.lit("// it's "), "p_name", F.lit("\nc //\nd;/**/e"), F.lit("/*"), "p_brand")
    return p.select(F.col("p_partkey").alias("k"), s.alias("s"))


@query(f"WITH {_NOTES} SELECT k, one || ' ' || two || ' ' || chr(10) || 'c  ' || chr(10) || 'd; e' || open AS code FROM notes")
def strip_comments(spark, sf_dir):
    """Closed comments as one blank each; what follows an open one is no comment yet."""
    return notes(spark, sf_dir).select("k", parse.without_comments(F.col("s")).alias("code"))


@query(f"""WITH {_NOTES}, edge AS (SELECT *, strlen(one) AS b, strlen(one) + strlen(block) AS e, strlen(one) + strlen(block) + strlen(two) AS l, strlen(one) + strlen(block) + strlen(two) + strlen(line) AS m FROM notes)
SELECT k, unnest(['block', 'line', 'line', 'block', 'block']) AS kind, unnest([b, l, m + 3, m + 8, m + 13]) AS start, unnest([e, m, m + 5, m + 12, m + 13 + strlen(open)]) AS stop FROM edge""")
def comment_spans(spark, sf_dir):
    return parse.comment_spans(notes(spark, sf_dir), "k", "s")


@query(f"WITH {_NOTES} SELECT k, one || two || chr(10) || 'c ' || chr(10) || 'd;e' AS kept FROM notes")
def comment_mask(spark, sf_dir):
    """The bytes that a mask of comments leaves."""
    n = notes(spark, sf_dir)
    return parse.masked(n, "k", "s", parse.comment_spans(n, "k", "s")).select("k", F.col("kept").cast("string").alias("kept"))


@query(f"WITH {_NOTES} SELECT k, count_if(c = chr(10)) AS newlines FROM (SELECT k, unnest(string_split(one || block || two || line || three || open, '')) AS c FROM notes) GROUP BY k")
def newline_flags(spark, sf_dir):
    """Line ends of each source."""
    return notes(spark, sf_dir).select("k", F.length(F.regexp_replace("s", "[^\n]", "")).cast("long").alias("newlines"))


#: Expressions, their postfix order, and DuckDB's own word for what they come to.
_SHAPES = {
    0: ("a + b * 3 < (7 - 2)", ["{a}", "{b}", "3", "*", "+", "7", "2", "-", "<"], "CASE WHEN a + b * 3 < 7 - 2 THEN 1 ELSE 0 END"),
    1: ("(a + b) * 5 - a % 7", ["{a}", "{b}", "+", "5", "*", "{a}", "7", "%", "-"], "(a + b) * 5 - a % 7"),
    2: ("a - b - 4 << 1", ["{a}", "{b}", "-", "4", "-", "1", "<<"], "(a - b - 4) * 2"),
    3: ("a * (b + 2 * (b - 1)) == a || 0 && b", ["{a}", "{b}", "2", "{b}", "1", "-", "*", "+", "*", "{a}", "==", "0", "{b}", "&&", "||"], "CASE WHEN a * (b + 2 * (b - 1)) = a OR (0 <> 0 AND b <> 0) THEN 1 ELSE 0 END"),
}


def _by_shape(what) -> str:
    return "CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN {what(*v)}" for k, v in _SHAPES.items()) + " END"


def _listed(_text, post, _value) -> str:
    return "[" + ", ".join({"{a}": "(a)::VARCHAR", "{b}": "(b)::VARCHAR"}.get(t, f"'{t}'") for t in post) + "]"


@query(f"SELECT p_partkey AS k, {_by_shape(_listed)} AS postfix, CAST({_by_shape(lambda t, p, v: v)} AS BIGINT) AS value FROM (SELECT p_partkey, p_partkey + 100 AS a, p_size AS b FROM part)")
def shunting_yard(spark, sf_dir):
    """Expressions of four shapes in postfix order, and what they come to."""
    p = spread(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    k, s = F.col("p_partkey"), F.lit(None).cast("string")
    for n, (text, _, _) in _SHAPES.items():
        put = F.replace(F.replace(F.lit(text), F.lit("a"), (k + 100).cast("string")), F.lit("b"), F.col("p_size").cast("string"))
        s = F.when(k % 4 == n, put).otherwise(s)
    return parse.evaluated(parse.postfix(parse.sources(p.select(k.alias("k"), s.alias("s")), "k", "s"), "k"), "k", "postfix")


@query("""SELECT k, unnest(l) AS token, unnest(CAST(range(len(l)) AS BIGINT[])) AS pos FROM (SELECT p_partkey AS k, ['x', '=', '(', '1', '+', '2', ')', '+', '1', ';', p_size::VARCHAR] || CASE WHEN p_partkey % 2 = 0 THEN ['(', '1', '+', '2', ')'] ELSE ['OUTERS'] END AS l FROM part)""")
def macro_expansion(spark, sf_dir):
    """Object macros, nested ones too."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    tail = F.when(F.col("p_partkey") % 2 == 0, " ( INNER )").otherwise(" OUTERS")
    e = p.select(F.col("p_partkey").alias("k"), F.concat(F.lit("x = OUTER ; "), F.col("p_size"), tail).alias("s"))
    macros = spark.createDataFrame([("OUTER", ["(", "INNER", ")", "+", "ONE"]), ("INNER", ["ONE", "+", "2"]), ("ONE", ["1"])], "name string, body array<string>")
    return parse.expand_macros(parse.tokens(e, "k", "s"), macros, "k")


MACROS = [
    parse.Macro("MAX", ("a", "b"), tuple("( ( a ) > ( b ) ? ( a ) : ( b ) )".split())), parse.Macro("NAME", ("x",), ("var_", "##", "x")), parse.Macro("TEXT", ("x",), ("#", "x")),
    parse.Macro("LIMIT", None, ("MAX", "(", "LOW", ",", "9", ")")), parse.Macro("LOW", None, ("3",)), parse.Macro("CALL", ("f", "..."), ("f", "(", "__VA_ARGS__", ")")),
    parse.Macro("SELF", ("x",), ("SELF", "(", "x", "+", "1", ")")), parse.Macro("NONE", (), ("0",)),
]


@query("""SELECT k, unnest(l) AS token, unnest(CAST(range(len(l)) AS BIGINT[])) AS pos FROM (SELECT k, CASE k % 3 WHEN 0 THEN ['(', '(', s, ')', '>', '(', 'q', '+', '1', ')', '?', '(', s, ')', ':', '(', 'q', '+', '1', ')', ')', ';'] WHEN 1 THEN ['var_n' || s, '=', '"a + ' || s || '"', ';']
 ELSE ['f', '(', '1', ',', s, ',', '(', '(', '3', ')', '>', '(', '9', ')', '?', '(', '3', ')', ':', '(', '9', ')', ')', ')', '+', 'SELF', '(', s, '+', '1', ')', '*', '0', '-', 'MAX', ';'] END AS l FROM (SELECT p_partkey AS k, p_size::VARCHAR AS s FROM part))""")
def function_macros(spark, sf_dir):
    """Function macros: arguments expanded before, pasting and texts, variable arguments, a macro that names itself, one without its parentheses."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("MAX("), s, F.lit(", q + 1);"))).when(k % 3 == 1, F.concat(F.lit("NAME(n"), s, F.lit(") = TEXT(a + "), s, F.lit(");"))).otherwise(F.concat(F.lit("CALL(f, 1, "), s, F.lit(", LIMIT) + SELF("), s, F.lit(") * NONE() - MAX;")))
    return parse.expand_all(parse.tokens(p.select(k.alias("k"), text.alias("s")), "k", "s"), MACROS, "k")


@query("SELECT p_partkey AS k, unnest(['send', 'receive', 'make']) AS kind, unnest(['ch' || p_size, 'in' || p_partkey, 'int']) AS operand FROM part")
def go_channels(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    s = F.concat(F.lit("ch"), "p_size", F.lit(" <- 1; x := <-in"), "p_partkey", F.lit("; c := make(chan int, 4)"))
    return parse.channels(p.select(F.col("p_partkey").alias("k"), s.alias("s")), "k", "s")


@query("SELECT p_partkey AS k, unnest(['cached', 'app.route']) AS name, 'f' || p_size AS target FROM part")
def python_decorators(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    s = F.concat(F.lit("import x\n@cached\n@app.route('/a')\ndef f"), "p_size", F.lit("(a, b=1):\n    return a\n"))
    return parse.decorators(p.select(F.col("p_partkey").alias("k"), s.alias("s")), "k", "s")


@query(f"""WITH {_TOK}, d AS (SELECT *, CAST(sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) + CASE t WHEN '}}' THEN 1 ELSE 0 END AS BIGINT) AS depth FROM tok),
e AS (SELECT page_id, depth, pos FROM d WHERE t = '{{') SELECT a.page_id, a.pos AS child, max(b.pos) AS parent FROM e a JOIN e b ON a.page_id = b.page_id AND b.depth = a.depth - 1 AND b.pos < a.pos GROUP BY 1, 2""")
def block_tree(spark, sf_dir):
    """Edges from each block to the block around it."""
    s = syntax.structure(toks(spark, sf_dir).where(F.col("token").isin("{", "}")), "page_id")
    return s.where("token = '{' AND parent >= 0").select("page_id", F.col("pos").alias("child"), "parent")
