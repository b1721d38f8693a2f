"""Token rows and what is read off them: C-like lexing, comments, directives, calls, scopes, expressions, macros.

Lexing is one JVM regex per text; patterns over neighbours are windows of one text. A text is one source file.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvexa.plans.lineage import cut

#: Tokens of macros that are sent to all tasks, at most.
MAX_MACRO_TOKENS = 1 << 20
#: Alternatives in the order in which they are tried.
TOKENS = (
    r'''(?:u8|[LuU])?"(?:\\.|[^"\\\n])*"|[LuU]?'(?:\\.|[^'\\\n])*'|[A-Za-z_][A-Za-z0-9_]*|0[xX][0-9a-fA-F]+[uUlL]*'''
    r"""|(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?[fFlL]?|[0-9]+[eE][-+]?[0-9]+[fFlL]?|[0-9]+[uUlL]*"""
    r"""|%:%:|<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|##|<:|:>|<%|%>|%:|[-+*/%&|^~!=<>#?:;,.(){}\[\]\\@$`]"""
)
#: The language's keywords.
KEYWORDS = tuple("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local".split())
#: Two-letter spellings of brackets and hashes.
DIGRAPHS = {"%:%:": "##", "<:": "[", ":>": "]", "<%": "{", "%>": "}", "%:": "#"}
_KEYWORDS = frozenset(KEYWORDS)
#: ``TOKENS`` for Python, whose dot takes other line ends than the JVM's.
_TOKENS = re.compile(TOKENS.replace(r"\\.|", r"\\[^\n\r\u0085\u2028\u2029]|"))
_DIGRAPH, _NUMBER, _FLOAT = re.compile("<[:%]|[:%]>|%:"), re.compile(r"\.?[0-9]"), re.compile(r"(?!0[xX])(?:[0-9]+\.|\.[0-9]|[0-9]+[eE])")


def spliced(source: Column) -> Column:
    """Backslash line ends joined."""
    return F.regexp_replace(source, r"\\\r?\n", "")


def without_comments(source: Column) -> Column:
    """Block and line comments as one blank each; strings stay as they are, and so does a block comment that is left open."""
    piece = r"""(?s)"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|/\*.*?\*/|//[^\n]*|[^"'/]+|."""
    pieces = F.regexp_extract_all(source, F.lit(piece), F.lit(0))
    comment = lambda x: (F.length(x) > 1) & (x.startswith("/*") | x.startswith("//"))
    return F.array_join(F.transform(pieces, lambda x: F.when(comment(x), " ").otherwise(x)), "")


def comment_spans(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, kind, start, stop) of block and line comments, in bytes; an open block comment ends with the text."""
    from corvexa.functions.arrow import flat_map

    pattern = re.compile(rb'''"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)''', re.S)

    def find(v) -> list[tuple]:
        return [(m.lastgroup, *m.span()) for m in pattern.finditer(v or b"") if m.lastgroup]

    return flat_map(df.select(key, F.col(source).cast("binary").alias("raw")), key, "raw", "kind string, start long, stop long", find)


def masked(df: DataFrame, key: str, source: str, spans: DataFrame) -> DataFrame:
    """(key, kept): the bytes that no span(key, start, stop) covers; rows without spans stay whole. A keep mask applied."""
    from corvexa.functions.arrow import flat_map

    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("x"))
    both = df.select(key, F.col(source).cast("binary").alias("raw")).join(lists, key, "left").select(key, F.struct("raw", "x").alias("v"))

    def keep(v) -> list[tuple]:
        if v["raw"] is None:
            return [(None,)]
        out, at = [], 0
        for s in v["x"] or []:
            out.append(v["raw"][at : max(at, s["start"])])
            at = max(at, s["stop"])
        return [(b"".join([*out, v["raw"][at:]]),)]

    return flat_map(both, key, "v", "kept binary", keep)


def token_kind(t: Column) -> Column:
    kinds = F.when(t.isin(*KEYWORDS), "keyword").when(t.rlike('^(u8|[LuU])?"'), "string").when(t.rlike("^[LuU]?'"), "char").when(t.rlike("^[A-Za-z_]"), "identifier")
    return kinds.when(t.rlike(r"^0[xX]"), "integer").when(t.rlike(r"^([0-9]+\.|\.[0-9]|[0-9]+[eE])"), "float").when(t.rlike("^[0-9]"), "integer").otherwise("operator")


def tokens(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, pos, token, kind), dense from 0; bytes that make no token are passed over. Digraphs are written plainly."""
    out = df.select(key, F.posexplode(F.regexp_extract_all(F.col(source), F.lit(TOKENS), F.lit(0))).alias("pos", "token"))
    plain = F.create_map(*[F.lit(x) for pair in DIGRAPHS.items() for x in pair])
    token = F.when(F.col("token").isin(*DIGRAPHS), plain[F.col("token")]).otherwise(F.col("token"))
    return out.select(key, F.col("pos").cast("long").alias("pos"), token.alias("token")).withColumn("kind", token_kind(F.col("token")))


def sources(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source): texts in place of the rows of ``tokens``, for operators that take a file's tokens at once.

    They lex it themselves, so nothing is shuffled. Each text is a file of its own, whatever its key.
    """
    return df.select(key, F.col(source).alias("source"))


@lru_cache(maxsize=1 << 16)
def kind_of(token: str) -> str:
    """``token_kind`` of one token."""
    if token in _KEYWORDS:
        return "keyword"
    if token[-1] in "\"'":
        return "string" if token[-1] == '"' else "char"
    if token[0] == "_" or "a" <= token[0] <= "z" or "A" <= token[0] <= "Z":
        return "identifier"
    return "operator" if not _NUMBER.match(token) else "float" if _FLOAT.match(token) else "integer"


def lexed(source: str | None) -> list[str]:
    """The tokens of ``tokens``, of one text."""
    found = _TOKENS.findall(source or "")
    return [DIGRAPHS.get(t, t) for t in found] if _DIGRAPH.search(source or "") else found


def per_file(toks: DataFrame, key: str, made: str, f: Callable[[list[tuple[int, str, str]]], list[tuple]]) -> DataFrame:
    """(key, made...): ``f`` takes the (pos, token, kind) of each file that has tokens, from rows or from ``sources``; they fit a task."""
    from corvexa.functions.arrow import flat_map

    def one(v) -> list[tuple]:
        found = [(k, t, kind_of(t)) for k, t in enumerate(lexed(v))] if isinstance(v, str) else [(e["pos"], e["token"], e["kind"]) for e in v or []]
        return f(found) if found else []

    if "source" not in toks.columns:
        toks = toks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "kind"))).alias("source"))
    return flat_map(toks, key, "source", made, one)


def calls(toks: DataFrame, key: str) -> DataFrame:
    """(key, pos, name) of identifiers before an open parenthesis."""
    w = Window.partitionBy(key).orderBy("pos")
    return toks.withColumn("__n", F.lead("token").over(w)).where("kind = 'identifier' AND __n = '('").select(key, "pos", F.col("token").alias("name"))


def scopes(toks: DataFrame, key: str) -> DataFrame:
    """Tokens with ``depth`` (open braces around them) and ``scope`` (position of the last brace opened at that depth, -1 outside)."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    closing = F.when(F.col("token") == "}", 1).otherwise(0)
    out = toks.withColumn("depth", F.sum(step).over(w) + closing)
    opened = F.max(F.when(F.col("token") == "{", F.col("pos"))).over(Window.partitionBy(key, "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("scope", F.when(F.col("depth") == 0, F.lit(-1)).otherwise(opened))


def functions(toks: DataFrame, key: str) -> DataFrame:
    """(key, pos, name) of calls at depth 0 whose closing parenthesis is followed by an open brace."""
    w = Window.partitionBy(key).orderBy("pos")
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    t = scopes(toks, key).withColumn("paren", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("token").over(w))
    heads = t.where("kind = 'identifier' AND depth = 0 AND paren = 0 AND next = '('").select(key, "pos", "token")
    bodies = t.where("token = ')' AND paren = 0 AND depth = 0 AND next = '{'").select(key, F.col("pos").alias("at"))
    marks = heads.select(key, "pos", "token").unionByName(bodies.select(key, F.col("at").alias("pos"), F.lit(None).cast("string").alias("token")))
    nxt = marks.withColumn("__b", F.lead("token").over(w)).withColumn("__p", F.lead("pos").over(w))
    return nxt.where("token IS NOT NULL AND __p IS NOT NULL AND __b IS NULL").select(key, "pos", F.col("token").alias("name"))


def call_graph(called: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """(caller, callee, calls): calls belong to the last function that begins before them in their file."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marks = called.select(key, "pos", F.col("name").alias("callee"), F.lit(None).cast("string").alias("fn")).join(defined.select(key, "pos"), [key, "pos"], "left_anti")
    marks = marks.unionByName(defined.select(key, "pos", F.lit(None).cast("string").alias("callee"), F.col("name").alias("fn")))
    inside = marks.withColumn("caller", F.last("fn", ignorenulls=True).over(w)).where("callee IS NOT NULL AND caller IS NOT NULL")
    known = defined.select(F.col("name").alias("callee")).distinct()
    return inside.join(known, "callee").groupBy("caller", "callee").agg(F.count("*").alias("calls"))


def directives(lines: DataFrame, line: str) -> DataFrame:
    """Lines with ``directive`` (define, undef, include), ``name``, ``params``, ``body`` and ``system`` (an angle include)."""
    x = F.col(line)
    d = F.regexp_extract(x, r"^\s*#\s*(define|undef|include)\b", 1)
    name = F.when(d == "include", F.regexp_extract(x, r'''^\s*#\s*include\s*[<"]([^>"]*)[>"]''', 1)).otherwise(F.regexp_extract(x, r"^\s*#\s*(?:define|undef)\s+([A-Za-z_][A-Za-z0-9_]*)", 1))
    params = F.regexp_extract(x, r"^\s*#\s*define\s+[A-Za-z_][A-Za-z0-9_]*\(([^)]*)\)", 1)
    body = F.when(d == "define", F.trim(F.regexp_replace(x, r"^\s*#\s*define\s+[A-Za-z_][A-Za-z0-9_]*(\([^)]*\))?", "")))
    return lines.where(d != "").select("*", d.alias("directive"), name.alias("name"), params.alias("params"), body.alias("body"), x.rlike(r"^\s*#\s*include\s*<").alias("system"))


def expand_macros(toks: DataFrame, macros: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
    """Tokens with object macros (name, body: array of tokens) put in; repeated for nested ones until none is left.

    A macro isn't expanded inside of its own expansion, so this ends; it is an error if ``rounds``, where given, end
    before that. Positions are renumbered at the end.
    """
    now = toks.select(key, F.array(F.col("pos")).alias("at"), "token", F.array().cast("array<string>").alias("from"))
    for n in count():
        m = macros.select(F.col("name").alias("token"), "body")
        joined = now.join(m, "token", "left").withColumn("go", F.col("body").isNotNull() & ~F.array_contains("from", F.col("token")))
        joined = cut(joined)
        if joined.where("go").isEmpty():
            break
        if rounds is not None and n >= rounds:
            raise RuntimeError(f"expand_macros: macros are left after {rounds} rounds")
        body = F.when(F.col("go"), F.transform("body", lambda t, i: F.struct(F.concat("at", F.array(i.cast("long"))).alias("at"), t.alias("token")))).otherwise(F.array(F.struct(F.col("at").alias("at"), F.col("token").alias("token"))))
        source = F.when(F.col("go"), F.array_append("from", F.col("token"))).otherwise(F.col("from"))
        now = joined.select(key, F.explode(body).alias("e"), source.alias("from")).select(key, "e.at", "e.token", "from")
    place = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return now.select(key, place.cast("long").alias("pos"), "token")


@dataclass(frozen=True)
class Macro:
    """``params`` is None for an object macro; the last one may be ``...``."""

    name: str
    params: tuple[str, ...] | None
    body: tuple[str, ...]


def expand_all(toks: DataFrame, macros: list[Macro], key: str) -> DataFrame:
    """(key, pos, token): object and function macros expanded, with # and ##, rescanned; a name isn't expanded inside of
    its own expansion. A file's tokens fit a task; the macros are sent to all tasks, and checked before."""
    if sum(len(m.body) + 1 for m in macros) > MAX_MACRO_TOKENS:
        raise ValueError("the macros are too large to broadcast")
    table = {m.name: m for m in macros}

    def arguments(work: deque) -> tuple[list[list], frozenset] | None:
        """Arguments up to the closing parenthesis, taken from the front; None, and nothing taken, if there is none."""
        taken, args, depth = [], [[]], 0
        while work:
            t, h = work.popleft()
            taken.append((t, h))
            depth += (t in "([{") - (t in ")]}")
            if not depth:
                return args, h
            if t == "," and depth == 1:
                args.append([])
            elif len(taken) > 1:
                args[-1].append((t, h))
        work.extendleft(reversed(taken))
        return None

    def substitute(m: Macro, args: list[list], hidden: frozenset) -> list:
        named: dict[str, list] = {}
        for k, p in enumerate(m.params or ()):
            if p == "...":
                rest = args[k:]
                named["__VA_ARGS__"] = [x for n, a in enumerate(rest) for x in ([(",", frozenset())] if n else []) + a]
            else:
                named[p] = args[k] if k < len(args) else []
        out: list = []
        body, k, blank = m.body, 0, [("", frozenset())]  # an empty argument that is pasted
        while k < len(body):
            t = body[k]
            pasted = k + 1 < len(body) and body[k + 1] == "##"
            if t == "#" and m.params is not None and k + 1 < len(body) and body[k + 1] in named:
                out.append(('"' + " ".join(x for x, _ in named[body[k + 1]]).replace("\\", "\\\\").replace('"', '\\"') + '"', frozenset()))
                k += 2
            elif t == "##" and out and k + 1 < len(body):
                right = named.get(body[k + 1], [(body[k + 1], frozenset())]) or blank
                out[-1] = (out[-1][0] + right[0][0], out[-1][1])
                out += right[1:]
                k += 2
            else:
                out += (named[t] or blank) if t in named and pasted else expand(named[t]) if t in named else [(t, frozenset())]
                k += 1
        return [(t, h | hidden) for t, h in out if t]

    def expand(tokens: list) -> list:
        work, out = deque(tokens), []
        while work:
            t, h = work.popleft()
            m = table.get(t)
            if m is None or t in h:
                out.append((t, h))
            elif m.params is None:
                work.extendleft(reversed(substitute(m, [], h | {t})))
            elif work and work[0][0] == "(" and (found := arguments(work)):
                args, last = found
                if args == [[]] and not m.params:
                    args = []
                work.extendleft(reversed(substitute(m, args, (h & last) | {t})))
            else:
                out.append((t, h))
        return out

    def solve(v) -> list[tuple]:
        found = expand([(e["token"], frozenset()) for e in v or []])
        return [(k, t) for k, (t, _) in enumerate(found)]

    from corvexa.functions.arrow import flat_map

    files = toks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return flat_map(files, key, "x", "pos long, token string", solve)


#: How strongly the operators bind, weakest first.
BINDING = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))


def postfix(toks: DataFrame, key: str) -> DataFrame:
    """(key, postfix): each file's expression in postfix order, left-associative; sequential within a file.

    ``toks`` are rows, or texts of ``sources``.
    """
    power = {o: k for k, row in enumerate(BINDING) for o in row}

    def solve(found) -> list[tuple]:
        out, stack = [], []
        for _, t, _ in found:
            if t == "(":
                stack.append(t)
            elif t == ")":
                while stack and stack[-1] != "(":
                    out.append(stack.pop())
                if stack:
                    stack.pop()
            elif t in power:
                while stack and stack[-1] != "(" and power[stack[-1]] >= power[t]:
                    out.append(stack.pop())
                stack.append(t)
            else:
                out.append(t)
        out += [t for t in reversed(stack) if t != "("]
        return [(out,)]

    rows = toks if {"source", "kind"} & set(toks.columns) else toks.withColumn("kind", F.lit(None).cast("string"))
    return per_file(rows, key, "postfix array<string>", solve)


def evaluated(expressions: DataFrame, key: str, postfix: str) -> DataFrame:
    """Postfix expressions with ``value``, in 64-bit integers; null where it isn't one number."""
    import operator

    from corvexa.functions.arrow import with_columns

    def quotient(a: int, b: int) -> int:
        return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)

    ops = {"+": operator.add, "-": operator.sub, "*": operator.mul, "<<": operator.lshift, ">>": operator.rshift, "&": operator.and_, "|": operator.or_, "^": operator.xor, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
    ops |= {"&&": lambda a, b: bool(a) and bool(b), "||": lambda a, b: bool(a) or bool(b), "/": quotient, "%": lambda a, b: a - b * quotient(a, b)}

    def one(tokens) -> int | None:
        stack: list[int] = []
        try:
            for t in tokens or []:
                if t in ops:
                    b, a = stack.pop(), stack.pop()
                    stack.append(int(ops[t](a, b)))
                else:
                    stack.append(int(t, 0))
        except (IndexError, ValueError, ZeroDivisionError):
            return None
        return ((stack[0] + (1 << 63)) % (1 << 64)) - (1 << 63) if len(stack) == 1 else None

    return with_columns(expressions, postfix, "value long", lambda vs: [[one(v) for v in vs]])


def decorators(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, name, target) of Python decorators and the function or class below them."""
    pairs = F.regexp_extract_all(F.col(source), F.lit(r"@[A-Za-z_][A-Za-z0-9_.]*[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?(?:def|class)\s+[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    one = df.select(key, F.explode(pairs).alias("x"))
    names = F.regexp_extract_all("x", F.lit(r"(?m)^\s*@([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    return one.select(key, F.explode(names).alias("name"), F.regexp_extract("x", r"(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)$", 1).alias("target"))


def channels(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, kind, operand) of Go channel sends, receives and creations."""
    x = F.col(source)
    sends = F.transform(F.regexp_extract_all(x, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\s*<-\s*[^\s<]"), F.lit(1)), lambda v: F.struct(F.lit("send").alias("kind"), v.alias("operand")))
    takes = F.transform(F.regexp_extract_all(x, F.lit(r"(?:^|[=(,{;]|:=|return)\s*<-\s*([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)), lambda v: F.struct(F.lit("receive").alias("kind"), v.alias("operand")))
    makes = F.transform(F.regexp_extract_all(x, F.lit(r"make\(\s*chan\s+([^,)]+)"), F.lit(1)), lambda v: F.struct(F.lit("make").alias("kind"), F.trim(v).alias("operand")))
    return df.select(key, F.explode(F.concat(sends, takes, makes)).alias("e")).select(key, "e.kind", "e.operand")
