"""Grammars: LR(1) tables built by the caller, and token rows parsed by them. Moves of owned values in Rust-like functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvexa.functions.arrow import flat_map

from .parse import per_file

#: States of a table, at most.
MAX_STATES = 1 << 14
END = "$"


@dataclass(frozen=True)
class Tables:
    """``action[state][terminal]`` is ('shift', state), ('reduce', rule) or ('accept',); ``goto[state][symbol]`` a state.

    ``rules`` are (left side, right side); rule 0 starts the grammar.
    """

    rules: tuple
    action: tuple
    goto: tuple


def build_tables(rules: list[tuple[str, tuple[str, ...]]]) -> Tables:
    """Canonical LR(1) tables of a grammar whose first rule is the start; a symbol is a terminal if no rule makes it.

    A grammar with conflicts is an error.
    """
    rules = tuple((left, tuple(right)) for left, right in rules)
    made = {left for left, _ in rules}
    first: dict[str, set] = {s: set() for s in made}
    nullable: set[str] = set()
    grown = True
    while grown:
        grown = False
        for left, right in rules:
            before = len(first[left]), left in nullable
            for s in right:
                first[left] |= first[s] if s in made else {s}
                if s not in nullable:
                    break
            else:
                nullable.add(left)
            grown |= before != (len(first[left]), left in nullable)

    def ahead(symbols: tuple, after: str) -> set:
        out: set = set()
        for s in symbols:
            out |= first[s] if s in made else {s}
            if s not in nullable:
                return out
        return out | {after}

    def closed(items: frozenset) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            rule, dot, after = todo.pop()
            right = rules[rule][1]
            if dot < len(right) and right[dot] in made:
                for k, (left, _) in enumerate(rules):
                    if left == right[dot]:
                        for t in ahead(right[dot + 1 :], after):
                            if (item := (k, 0, t)) not in out:
                                out.add(item)
                                todo.append(item)
        return frozenset(out)

    start = closed(frozenset([(0, 0, END)]))
    number, order, action, goto = {start: 0}, [start], [], []
    for state in order:
        moves: dict[str, set] = {}
        acts: dict[str, tuple] = {}
        for rule, dot, after in state:
            right = rules[rule][1]
            if dot < len(right):
                moves.setdefault(right[dot], set()).add((rule, dot + 1, after))
                continue
            act = ("accept",) if rule == 0 else ("reduce", rule)
            if acts.setdefault(after, act) != act:
                raise ValueError(f"two reductions before {after}")
        to: dict[str, int] = {}
        for symbol, items in sorted(moves.items()):
            target = closed(frozenset(items))
            if target not in number:
                number[target] = len(order)
                order.append(target)
                if len(order) > MAX_STATES:
                    raise ValueError("the grammar has too many states")
            if symbol in made:
                to[symbol] = number[target]
            elif acts.setdefault(symbol, ("shift", number[target])) != ("shift", number[target]):
                raise ValueError(f"shift or reduce before {symbol}")
        action.append(acts)
        goto.append(to)
    return Tables(rules, tuple(action), tuple(goto))


def reductions(tables: Tables, terminals: list[str]) -> list[tuple[int, int]] | None:
    """(rule, tokens read) of each reduction, in order; None if the tokens aren't in the language."""
    stack, out, at = [0], [], 0
    terminals = [*terminals, END]
    while True:
        act = tables.action[stack[-1]].get(terminals[at])
        if act is None:
            return None
        if act[0] == "accept":
            return out
        if act[0] == "shift":
            stack.append(act[1])
            at += 1
        else:
            left, right = tables.rules[act[1]]
            del stack[len(stack) - len(right) :]
            stack.append(tables.goto[stack[-1]][left])
            out.append((act[1], at))


def parsed(toks: DataFrame, key: str, tables: Tables, terminal) -> DataFrame:
    """(key, accepted, rules): of each file's tokens, whether they are in the language, and the rules in order of reduction.

    ``terminal``: a column function from (token, kind) to the grammar's terminal. A file's tokens fit a task.
    """
    t = toks.select(key, "pos", terminal(F.col("token"), F.col("kind")).alias("t"))
    files = t.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda e: e["t"]).alias("x"))

    def solve(v) -> list[tuple]:
        found = reductions(tables, list(v or []))
        return [(found is not None, [r for r, _ in found] if found is not None else None)]

    return flat_map(files, key, "x", "accepted boolean, rules array<int>", solve)


def moved_uses(toks: DataFrame, key: str) -> DataFrame:
    """(key, pos, name, moved_at): uses of owned values that were moved before, in any branch that comes to the use.

    ``let x = y;``, ``x = y;`` and ``f(y)`` move y; ``&y``, ``y.name`` and ``y`` in a macro call with ! don't. An
    assignment owns again. After if and else what either moved is moved; a loop's body is followed twice.
    """

    def solve(t: list[tuple]) -> list[tuple]:
        found: dict[tuple, tuple] = {}

        def closing(at: int, stop: int) -> int:
            depth = 0
            for q in range(at, stop):
                depth += (t[q][1] in "([{") - (t[q][1] in ")]}")
                if not depth:
                    return q
            return stop - 1

        def uses(a: int, z: int, moved: dict, macro: bool = False) -> None:
            q = a
            while q < z:
                pos, name, kind = t[q]
                after, before = t[q + 1][1] if q + 1 < len(t) else "", t[q - 1][1] if q else ""
                if kind == "identifier" and after == "!" and q + 2 < z and t[q + 2][1] in ("(", "["):
                    last = closing(q + 2, z)
                    uses(q + 3, last, moved, True)
                    q = last + 1
                    continue
                if kind == "identifier" and before != "." and after != "(" and not (after == ":" and q + 2 < len(t) and t[q + 2][1] == ":") and name not in ("mut", "true", "false"):
                    if name in moved:
                        found[pos, name] = (pos, name, moved[name])
                    elif name in owned and not macro and before not in ("&",) and not (before == "mut" and q > 1 and t[q - 2][1] == "&") and after not in (".", "+", "-", "*", "/", "<", ">", "==", "!=", "<=", ">=", "["):
                        moved[name] = pos
                q += 1

        owned: set[str] = set()

        def block(a: int, z: int, moved: dict) -> None:
            q = a
            while q < z:
                word = t[q][1]
                if word == "if":
                    head = q + 1
                    while head < z and t[head][1] != "{":
                        head += 1
                    uses(q + 1, head, moved)
                    last = closing(head, z)
                    one = dict(moved)
                    block(head + 1, last, one)
                    q, two = last + 1, dict(moved)
                    if q < z and t[q][1] == "else":
                        head = q + 1
                        if head < z and t[head][1] == "{":
                            last = closing(head, z)
                            block(head + 1, last, two)
                            q = last + 1
                        else:
                            q = head
                    moved.update(one | two)
                elif word in ("while", "loop", "for"):
                    head = q + 1
                    while head < z and t[head][1] != "{":
                        head += 1
                    last = closing(head, z)
                    for _ in range(2):
                        uses(q + 1, head, moved)
                        block(head + 1, last, moved)
                    q = last + 1
                elif word == "{":
                    last = closing(q, z)
                    block(q + 1, last, moved)
                    q = last + 1
                else:
                    end = q
                    while end < z and t[end][1] not in (";", "{", "}"):
                        end = closing(end, z) + 1 if t[end][1] in ("(", "[") else end + 1
                    target = q + (word == "let")
                    target += target < end and t[target][1] == "mut"
                    if target + 1 < end and t[target][2] == "identifier" and t[target + 1][1] == "=" and t[min(target + 2, end - 1)][1] != "=":
                        uses(target + 2, end, moved)
                        moved.pop(t[target][1], None)
                        simple = t[target + 2][2] in ("integer", "float") or t[target + 2][1] in ("&", "true", "false")
                        (owned.discard if simple else owned.add)(t[target][1])
                    else:
                        uses(q, end, moved)
                    q = end + 1

        block(0, len(t), {})
        return sorted(found.values())

    return per_file(toks, key, "pos long, name string, moved_at long", solve)
