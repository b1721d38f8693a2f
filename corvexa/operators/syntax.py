"""C syntax of whole source files: statement trees, declarations and what names refer to, control flow, extensions.

A text is one file, and its tokens fit a task. Bracket structure is windows over token rows; statements are parsed by
descent, one file after the other, in Arrow batches, from token rows or from the texts of ``parse.sources``. What isn't C is passed over, up to the next semicolon or brace.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvexa.functions.arrow import flat_map

from .parse import KEYWORDS, per_file

#: Keywords that begin a declaration.
SPECIFIERS = frozenset("auto char const double enum extern float inline int long register restrict short signed static struct typedef union unsigned void volatile _Alignas _Atomic _Bool _Complex _Imaginary _Noreturn _Thread_local".split())
_WORDS = frozenset(KEYWORDS)
#: Statements nested deeper than this are taken as one.
DEEP = 150


def structure(toks: DataFrame, key: str) -> DataFrame:
    """Tokens with ``parent`` (position of the innermost open bracket around, -1 outside), ``first_child`` and ``next_sibling``.

    Each token asks for the last bracket that was opened at its depth: one window over openers and askers together.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w) + F.when(closes, 1).otherwise(0)
    t = toks.withColumn("__d", depth).withColumn("__o", opens)
    asks = t.withColumn("__lane", F.col("__d") - F.col("__o").cast("int")).withColumn("__at", F.lit(None).cast("long"))
    gives = t.where("__o").withColumn("__lane", F.col("__d")).withColumn("__at", F.col("pos")).withColumn("token", F.lit(None).cast("string"))
    # An opener's own offer comes after what it asks.
    lane = Window.partitionBy(key, "__lane").orderBy("pos", F.col("__at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    found = asks.unionByName(gives).withColumn("parent", F.coalesce(F.last("__at", ignorenulls=True).over(lane), F.lit(-1).cast("long"))).where("token IS NOT NULL")
    found = found.withColumn("parent", F.when(F.col("__lane") == 0, F.lit(-1).cast("long")).otherwise(F.col("parent")))
    found = found.withColumn("next_sibling", F.lead("pos").over(Window.partitionBy(key, "parent").orderBy("pos")))
    first = found.groupBy(key, F.col("parent").alias("pos")).agg(F.min(F.struct("__d", F.col("pos").alias("p"))["p"]).alias("first_child"))
    return found.join(first, [key, "pos"], "left").drop("__d", "__o", "__lane", "__at")


class Unit:
    """One file: nodes, control edges, declarations and uses."""

    def __init__(self, tokens: list[tuple[int, str, str]]):
        self.t, self.p = tokens, 0
        self.closer: dict[int, int] = {}
        opened: list[int] = []
        for q, (_, s, _) in enumerate(tokens):
            if s in ("(", "[", "{"):
                opened.append(q)
            elif s in (")", "]", "}") and opened:
                self.closer[opened.pop()] = q
        #: (node, parent, kind, name, first token, last token); the unit itself is node 0.
        self.nodes: list[list] = [[0, None, "unit", None, 0, len(tokens) - 1]]
        self.edges: list[tuple[int, int, str]] = []
        #: (token, name, role, kind, token of the declaration)
        self.names: list[tuple] = []
        self.scopes: list[dict[str, tuple[int, str]]] = [{}]
        self.function, self.labels, self.jumps = 0, {}, []
        while self.p < len(self.t):
            self.external()

    # Tokens.

    def text(self, ahead: int = 0) -> str:
        return self.t[self.p + ahead][1] if self.p + ahead < len(self.t) else ""

    def word(self, at: int) -> bool:
        return self.t[at][2] == "identifier"

    def closing(self, at: int) -> int:
        """The bracket that closes the one at ``at``; the last token if there is none."""
        return self.closer.get(at, len(self.t) - 1)

    def end(self) -> int:
        """The semicolon that ends what begins here, brackets passed over; or the token before a closing brace."""
        q = self.p
        while q < len(self.t):
            s = self.t[q][1]
            if s == ";":
                return q
            if s == "}":
                return max(self.p, q - 1)
            q = self.closing(q) + 1 if s in ("(", "[", "{") else q + 1
        return len(self.t) - 1

    # The tree.

    def new(self, kind: str, parent: int, name: str | None = None) -> int:
        self.nodes.append([len(self.nodes), parent, kind, name, self.p, self.p])
        return len(self.nodes) - 1

    def close(self, node: int) -> None:
        self.nodes[node][5] = self.p - 1

    def join(self, ways: list[tuple[int, str]], node: int) -> None:
        self.edges += [(src, node, kind) for src, kind in ways]

    # Names.

    def find(self, name: str) -> tuple[int, str] | None:
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    def declare(self, at: int, kind: str) -> None:
        name = self.t[at][1]
        self.scopes[-1][name] = (at, kind)
        self.names.append((at, name, "declares", kind, at))

    def use(self, first: int, last: int) -> None:
        """Identifiers of [first, last] that aren't members, with the declaration that they see."""
        for q in range(first, last + 1):
            if self.word(q) and (q == 0 or self.t[q - 1][1] not in (".", "->")):
                seen = self.find(self.t[q][1])
                self.names.append((q, self.t[q][1], "uses", seen[1] if seen else "unknown", seen[0] if seen else None))

    def declares(self) -> bool:
        """Whether a declaration begins here: a specifier, or a visible type name before a declarator."""
        if self.text() in SPECIFIERS:
            return True
        if self.p < len(self.t) and self.word(self.p) and (seen := self.find(self.text())) and seen[1] == "typedef":
            return self.text(1) in ("*", "(") or (self.p + 1 < len(self.t) and (self.word(self.p + 1) or self.text(1) in _WORDS))
        return False

    def specifiers(self) -> tuple[bool, bool]:
        """Passes over specifiers; whether typedef is among them, and whether a tag was defined."""
        typedef, typed = False, False
        while self.p < len(self.t):
            s = self.text()
            if s in ("struct", "union", "enum"):
                typed = True
                self.p += 1
                if self.p < len(self.t) and self.word(self.p):
                    (self.declare if self.text(1) == "{" else lambda at, _: None)(self.p, "tag")
                    self.p += 1
                if self.text() == "{":
                    last = self.closing(self.p)
                    if s == "enum":
                        for q in range(self.p + 1, last):
                            if self.word(q) and self.t[q - 1][1] in ("{", ","):
                                self.declare(q, "constant")
                    self.p = last + 1
            elif s in SPECIFIERS:
                typedef |= s == "typedef"
                typed |= s not in ("typedef", "static", "extern", "inline", "const", "volatile", "register", "auto", "restrict")
                self.p += 1
            elif not typed and self.p < len(self.t) and self.word(self.p) and (seen := self.find(s)) and seen[1] == "typedef":
                self.names.append((self.p, s, "uses", "typedef", seen[0]))
                typed = True
                self.p += 1
            else:
                break
        return typedef, typed

    def declarators(self, last: int, typedef: bool) -> int | None:
        """Names declared up to token ``last``; the first one's token. Initial values and sizes are uses."""
        first = None
        while self.p <= last:
            name = next((q for q in range(self.p, last + 1) if self.word(q) or self.t[q][1] in (",", "=", ";")), None)
            if name is None or not self.word(name):
                break
            after = self.t[name + 1][1] if name + 1 <= last else ""
            self.declare(name, "typedef" if typedef else "function" if after == "(" else "variable")
            first = name if first is None else first
            q = name + 1
            while q <= last and self.t[q][1] not in (",", ";"):
                if self.t[q][1] in ("(", "[", "{"):
                    z = min(self.closing(q), last)
                    if self.t[q][1] != "(" or after != "(":
                        self.use(q + 1, z - 1)
                    q = z + 1
                else:
                    if self.word(q):
                        self.use(q, q)
                    q += 1
            self.p = q + 1
        return first

    # Statements.

    def external(self) -> None:
        if not self.declares() and not (self.word(self.p) and self.text(1) == "("):
            self.p = self.end() + 1 if self.text() != "}" else self.p + 1
            return
        start = self.p
        node = self.new("declaration", 0)
        typedef, _ = self.specifiers()
        # A function's body follows the parentheses after its name.
        q = self.p
        while q < len(self.t) and self.t[q][1] == "*":
            q += 1
        if not typedef and q + 1 < len(self.t) and self.word(q) and self.t[q + 1][1] == "(":
            closed = self.closing(q + 1)
            if closed + 1 < len(self.t) and self.t[closed + 1][1] == "{":
                self.nodes[node][2:5] = ["function", self.t[q][1], start]
                self.declare(q, "function")
                self.scopes.append({})
                self.p = q + 2
                self.parameters(closed)
                self.p = closed + 1
                self.function, self.labels, self.jumps = node, {}, []
                self.join(self.statement(node, [(node, "entry")], None, 0), node)
                self.edges += [(src, self.labels[name], "goto") for src, name in self.jumps if name in self.labels]
                self.scopes.pop()
                self.close(node)
                return
        last = self.end()
        first = self.declarators(last, typedef)
        self.nodes[node][2:4] = ["typedef" if typedef else "declaration", self.t[first][1] if first is not None else None]
        self.p = last + 1
        self.close(node)

    def parameters(self, closed: int) -> None:
        while self.p < closed:
            self.specifiers()
            name = None
            while self.p < closed and self.text() != ",":
                if name is None and self.word(self.p):
                    name = self.p
                self.p = self.closing(self.p) + 1 if self.text() == "[" else self.p + 1
            if name is not None:
                self.declare(name, "parameter")
            self.p += 1

    def head(self) -> None:
        """The parentheses after a keyword, whose names are uses."""
        if self.text() == "(":
            last = self.closing(self.p)
            self.use(self.p + 1, last - 1)
            self.p = last + 1

    def statement(self, parent: int, ways: list[tuple[int, str]], loop: tuple | None, depth: int) -> list[tuple[int, str]]:
        """One statement, entered from ``ways``; the ways out of it. ``loop``: (ways of breaks, node that continue goes to, switch)."""
        s = self.text()
        if s == "{" and depth < DEEP:
            node = self.new("block", parent)
            self.join(ways, node)
            self.p += 1
            self.scopes.append({})
            # The block of a switch is entered at its cases only.
            out = [] if loop and loop[2] and loop[2][0] == parent else [(node, "next")]
            while self.p < len(self.t) and self.text() != "}":
                at = self.p
                out = self.statement(node, out, loop, depth + 1)
                self.p += self.p == at  # whatever this is, go on
            self.scopes.pop()
            self.p += 1
            self.close(node)
            return out
        if s == "if":
            node = self.new("if", parent)
            self.join(ways, node)
            self.p += 1
            self.head()
            out = self.statement(node, [(node, "true")], loop, depth + 1)
            if self.text() == "else":
                self.p += 1
                out += self.statement(node, [(node, "false")], loop, depth + 1)
            else:
                out.append((node, "false"))
            self.close(node)
            return out
        if s in ("while", "for", "do", "switch"):
            node = self.new(s, parent)
            self.join(ways, node)
            self.p += 1
            self.scopes.append({})
            if s == "for" and self.text() == "(":
                closed = self.closing(self.p)
                self.p += 1
                if self.declares():
                    typedef, _ = self.specifiers()
                    self.declarators(min(self.end(), closed), typedef)
                self.use(self.p, closed - 1)
                self.p = closed + 1
            elif s != "do":
                self.head()
            breaks: list[tuple[int, str]] = []
            target = loop[1] if s == "switch" and loop else node
            seen: list[str] = []
            out = self.statement(node, [] if s == "switch" else [(node, "next" if s == "do" else "true")], (breaks, target, (node, seen) if s == "switch" else None), depth + 1)
            if s == "switch":
                out += breaks + ([] if "default" in seen else [(node, "false")])
            elif s == "do":
                if self.text() == "while":
                    self.p += 1
                    self.head()
                    self.p += self.text() == ";"
                self.join([(src, "back") for src, _ in out], node)
                out = [(src, "false") for src, _ in out] + breaks
            else:
                self.join([(src, "back") for src, _ in out], node)
                out = [(node, "false"), *breaks]
            self.scopes.pop()
            self.close(node)
            return out
        if s in ("case", "default"):
            node = self.new(s, parent)
            start = self.p
            while self.p < len(self.t) and self.text() not in (":", ";", "}"):
                self.p += 1
            self.use(start + 1, self.p - 1)
            self.p += self.text() == ":"
            self.close(node)
            self.join(ways, node)
            if loop and loop[2]:
                loop[2][1].append(s)
                self.join([(loop[2][0], s)], node)
            return [(node, "next")]
        if self.p < len(self.t) and self.word(self.p) and self.text(1) == ":":
            node = self.new("label", parent, s)
            self.join(ways, node)
            self.labels[s] = node
            self.p += 2
            self.close(node)
            return [(node, "next")]
        if self.declares():
            node = self.new("declaration", parent)
            self.join(ways, node)
            typedef, _ = self.specifiers()
            last = self.end()
            first = self.declarators(last, typedef)
            self.nodes[node][2:4] = ["typedef" if typedef else "declaration", self.t[first][1] if first is not None else None]
            self.p = last + 1
            self.close(node)
            return [(node, "next")]
        kind = s if s in ("return", "break", "continue", "goto") else "empty" if s == ";" else "expression"
        node = self.new(kind, parent, self.text(1) if s == "goto" else None)
        self.join(ways, node)
        last = self.end()
        if kind in ("return", "expression"):
            self.use(self.p + (kind == "return"), last)
        self.p = last + 1
        self.close(node)
        if kind == "return":
            self.edges.append((node, self.function, "return"))
        elif kind == "break" and loop:
            loop[0].append((node, "next"))
        elif kind == "continue" and loop and loop[1]:
            self.edges.append((node, loop[1], "back"))
        elif kind == "goto":
            self.jumps.append((node, self.nodes[node][3]))
        return [(node, "next")] if kind in ("expression", "empty") else []


def nodes(toks: DataFrame, key: str) -> DataFrame:
    """(key, node, parent, kind, name, start, stop): the statement tree; node 0 is the file, places are tokens."""
    return per_file(toks, key, "node long, parent long, kind string, name string, start long, stop long", lambda v: [tuple(n) for n in Unit(v).nodes])


def control_edges(toks: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, kind) among the nodes: entry, next, true, false, case, default, back, goto, return.

    A function's node is both its entry and its exit.
    """
    return per_file(toks, key, "src long, dst long, kind string", lambda v: Unit(v).edges)


def names(toks: DataFrame, key: str) -> DataFrame:
    """(key, pos, name, role, kind, target): names declared, and names used with the token that declares them, if any."""
    return per_file(toks, key, "pos long, name string, role string, kind string, target long", lambda v: Unit(v).names)


def semantic_edges(toks: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, kind): the program graph: children, control flow, and references from using to declaring statements."""

    def solve(v) -> list[tuple]:
        u = Unit(v)
        owner: dict[int, int] = {}
        for n in u.nodes:  # inner nodes come later and take their tokens from the outer ones
            owner.update(dict.fromkeys(range(n[4], n[5] + 1), n[0]))
        out = [(n[1], n[0], "child") for n in u.nodes if n[1] is not None] + u.edges
        refers = {(owner[at], owner[to], "refers") for at, _, role, _, to in u.names if role == "uses" and to is not None}
        return out + sorted(refers)

    return per_file(toks, key, "src long, dst long, kind string", solve)


def basic_blocks(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, leader): straight runs of statements are one block, named by its first one.

    A statement leads a block unless its one way in is the one way out of another. A file's edges fit a task.
    """
    flow = edges.where("kind NOT IN ('child', 'refers')")
    lists = flow.groupBy(key).agg(F.collect_list(F.struct("src", "dst", "kind")).alias("v"))
    return flat_map(lists, key, "v", "node long, leader long", lambda v: _blocks([(e["src"], e["dst"], e["kind"]) for e in v]))


def blocks_of_files(toks: DataFrame, key: str) -> DataFrame:
    """``basic_blocks`` of ``control_edges``, with no rows in between."""
    return per_file(toks, key, "node long, leader long", lambda v: _blocks(Unit(v).edges))


def _blocks(edges: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    outs, ins = Counter(e[0] for e in edges), Counter(e[1] for e in edges)
    before = {dst: src for src, dst, kind in edges if kind == "next" and outs[src] == 1 and ins[dst] == 1}
    leaders: dict[int, int] = {}
    circles: dict[int, int] = {}
    for n in dict.fromkeys(x for e in edges for x in e[:2]):
        lead, seen = n, {n: None}
        while lead in before and lead not in leaders and before[lead] not in seen:
            lead = before[lead]
            seen[lead] = None
        if lead in before and lead not in leaders:  # a circle of straight steps: each node is followed on its own
            circles[n] = lead
        else:
            leaders.update(dict.fromkeys(seen, leaders.get(lead, lead)))
    return [*leaders.items(), *circles.items()]


def builtins(toks: DataFrame, key: str) -> DataFrame:
    """(key, pos, name, family) of compiler extensions: built-in calls, attributes, type queries, statement expressions."""
    w = Window.partitionBy(key).orderBy("pos")
    t = toks.withColumn("__n", F.lead("token").over(w))
    x = F.col("token")
    family = F.when(x.startswith("__builtin_"), "builtin").when(x.isin("__attribute__", "__attribute"), "attribute").when(x.isin("typeof", "__typeof__", "__typeof"), "typeof").when(x.isin("__extension__"), "extension").when(x.isin("__alignof__", "__label__"), "query").when((x == "(") & (F.col("__n") == "{"), "statement expression")
    return t.select(key, "pos", x.alias("name"), family.alias("family")).where("family IS NOT NULL")


def inline_assembly(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, volatile, template, outputs, inputs, clobbers) of assembly blocks; operands as they are written."""
    block = r'\b(?:asm|__asm__|__asm)\s*(volatile|__volatile__)?\s*\(\s*((?:"(?:\\.|[^"\\])*"\s*)+)(?::((?:"(?:\\.|[^"\\])*"|[^":;])*))?(?::((?:"(?:\\.|[^"\\])*"|[^":;])*))?(?::((?:"(?:\\.|[^"\\])*"|[^":;])*))?\)\s*;'
    each = df.select(key, F.explode(F.regexp_extract_all(F.col(source), F.lit(block), F.lit(0))).alias("x"))
    part = lambda k: F.trim(F.regexp_extract("x", block, k))
    operands = lambda k: F.transform(F.filter(F.split(part(k), r',(?=\s*[\["])'), lambda s: F.trim(s) != ""), lambda s: F.trim(s))
    return each.select(key, (part(1) != "").alias("volatile"), part(2).alias("template"), operands(3).alias("outputs"), operands(4).alias("inputs"), operands(5).alias("clobbers"))


def fold_constants(expressions: DataFrame, key: str, postfix: str) -> DataFrame:
    """(key, folded): postfix expressions with operations on integer constants done, wrapping at 32 bits; x * 0, x * 1 and x + 0 too."""
    mask = (1 << 32) - 1
    ops = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "&": lambda a, b: a & b, "|": lambda a, b: a | b, "^": lambda a, b: a ^ b, "/": lambda a, b: a // b if b else None, "%": lambda a, b: a % b if b else None}

    def one(tokens) -> list[tuple]:
        stack: list[list[str]] = []
        for t in tokens or []:
            if t in ops and len(stack) > 1:
                b, a = stack.pop(), stack.pop()
                x, y = (int(s[0]) if len(s) == 1 and s[0].isdigit() else None for s in (a, b))
                value = ops[t](x, y) if x is not None and y is not None else None
                if value is not None:
                    stack.append([str(value & mask)])
                elif t == "*" and 0 in (x, y):
                    stack.append(["0"])
                elif (t, y) in (("*", 1), ("+", 0), ("-", 0)):
                    stack.append(a)
                elif (t, x) in (("*", 1), ("+", 0)):
                    stack.append(b)
                else:
                    stack.append([*a, *b, t])
            else:
                stack.append([t])
        return [([t for s in stack for t in s],)]

    return flat_map(expressions, key, postfix, "folded array<string>", one)


def value_numbers(expressions: DataFrame, key: str, postfix: str) -> DataFrame:
    """(key, place, op, left, right, number): operations of a postfix expression; equal ones have the number of the first."""

    def one(tokens) -> list[tuple]:
        seen: dict = {}
        stack, out = [], []
        for place, t in enumerate(tokens or []):
            inner = not (t[0].isalnum() or t[0] in "_\"'") and len(stack) > 1
            b, a = (stack.pop(), stack.pop()) if inner else (None, None)
            number = seen.setdefault((t, a, b), len(seen))
            stack.append(number)
            out.append((place, t, a, b, number))
        return out

    return flat_map(expressions, key, postfix, "place long, op string, left long, right long, number long", one)
