"""Multi-pattern matching with byte spans, span clean-up, hit buffers and rules.

Spans are half open. Automata are built once a worker from the broadcast patterns; texts stream past them.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvexa.functions.arrow import flat_map
from corvexa.functions.text import entropy

#: Patterns that are sent to the workers, in bytes, at most.
MAX_PATTERN_BYTES = 64 << 20


def _finder(patterns: list[bytes]) -> Callable[[bytes | None], list[tuple]]:
    """(pattern, start, stop) of every occurrence in a text; the automaton is built where it is used."""
    cache: dict = {}

    def scan(v) -> list[tuple]:
        if "a" not in cache:
            import ahocorasick

            a = ahocorasick.Automaton()
            ids: dict[str, list[int]] = {}
            for k, p in enumerate(patterns):
                if p:
                    ids.setdefault(p.decode("latin-1"), []).append(k)
            for p, ks in ids.items():
                a.add_word(p, (len(p), ks))
            if ids:
                a.make_automaton()
            cache["a"] = a if ids else None
        if not v or cache["a"] is None:
            return []
        return [(k, e + 1 - n, e + 1) for e, (n, ks) in cache["a"].iter(v.decode("latin-1")) for k in ks]

    return scan


def find_literals(df: DataFrame, key: str, raw: str, patterns: list[bytes]) -> DataFrame:
    """(key, pattern_id, start, stop) of every occurrence, overlapping ones too. An empty pattern has none."""
    if sum(map(len, patterns)) > MAX_PATTERN_BYTES:
        raise ValueError("the patterns are too large to broadcast")
    return flat_map(df, key, raw, "pattern_id long, start long, stop long", _finder(patterns))


def find_within(df: DataFrame, key: str, raw: str, windows: DataFrame, patterns: list[bytes]) -> DataFrame:
    """(key, pattern_id, start, stop) of occurrences that lie within a window(key, lo, hi) of their text, each once.

    A window without a byte that ends a pattern isn't scanned. Windows of a text are one list beside it.
    """
    if sum(map(len, patterns)) > MAX_PATTERN_BYTES:
        raise ValueError("the patterns are too large to broadcast")
    lists = windows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("x"))
    both = df.select(key, raw).join(lists, key).select(key, F.struct(F.col(raw).alias("raw"), "x").alias("v"))
    last = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in sorted({p[-1] for p in patterns if p})) + b"]") if any(patterns) else None

    def scan(v) -> list[tuple]:
        out, body = set(), v["raw"] or b""
        for w in v["x"]:
            part = body[max(0, w["lo"]) : max(0, w["hi"])]
            if last is None or not last.search(part):
                continue
            for k, p in enumerate(patterns):
                at = part.find(p) if p else -1
                while at >= 0:
                    out.add((k, max(0, w["lo"]) + at, max(0, w["lo"]) + at + len(p)))
                    at = part.find(p, at + 1)
        return sorted(out)

    return flat_map(both, key, "v", "pattern_id long, start long, stop long", scan)


def count_by_suffix(df: DataFrame, key: str, raw: str, patterns: list[bytes], width: int = 2) -> DataFrame:
    """(key, pattern_id, hits) where there are any: places whose last ``width`` bytes end a pattern are found at once for
    a whole text, and only those are compared. Shorter patterns have bytes of their own length compared."""
    import numpy as np

    if sum(map(len, patterns)) > MAX_PATTERN_BYTES:
        raise ValueError("the patterns are too large to broadcast")

    def scan(v) -> list[tuple]:
        b = np.frombuffer(v or b"", dtype=np.uint8)
        out = []
        codes = {}
        for k, p in enumerate(patterns):
            n = min(width, len(p))
            if not n or len(b) < len(p):
                continue
            if n not in codes:
                c = b[n - 1 :].astype(np.uint32)
                for j in range(1, n):
                    c = c | b[n - 1 - j : len(b) - j].astype(np.uint32) << np.uint32(8 * j)
                codes[n] = c  # at place i: the n bytes that end at byte i + n - 1
            ends = np.flatnonzero(codes[n] == int.from_bytes(p[-n:], "big")) + n
            ends = ends[ends >= len(p)]
            for j in range(len(p) - n):
                ends = ends[b[ends - len(p) + j] == p[j]]
            if len(ends):
                out.append((k, len(ends)))
        return out

    return flat_map(df, key, raw, "pattern_id long, hits long", scan)


def ordered(spans: DataFrame, key: str) -> DataFrame:
    """Spans with ``place``: their order in their text, by start, then the longer first, then the pattern."""
    w = Window.partitionBy(key).orderBy("start", F.desc("stop"), "pattern_id")
    return spans.withColumn("place", F.row_number().over(w).cast("long") - 1)


def find_regexes(df: DataFrame, key: str, raw: str, patterns: list[bytes]) -> DataFrame:
    """(key, pattern_id, start, stop) of the non-overlapping matches of each byte regex, leftmost first."""
    cache: list = []

    def scan(v) -> list[tuple]:
        if not cache:
            cache.extend(re.compile(p) for p in patterns)
        return [(k, *m.span()) for k, p in enumerate(cache) for m in p.finditer(v or b"")]

    return flat_map(df, key, raw, "pattern_id long, start long, stop long", scan)


def merge_spans(spans: DataFrame, *by: str) -> DataFrame:
    """Overlapping or touching spans of one group as one span."""
    w = Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("__n", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("__r", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "__r").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__r")


def first_spans(spans: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k spans of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("start", "stop"))
    return spans.withColumn("__p", place).where(F.col("__p") <= k).drop("__p")


def capped(hits: DataFrame, capacity: int) -> DataFrame:
    """One row of a bounded hit buffer: live hits and how many had no room."""
    return hits.agg(F.least(F.count("*"), F.lit(capacity)).alias("live"), F.greatest(F.count("*") - capacity, F.lit(0)).alias("overflow"))


def score_spans(df: DataFrame, key: str, raw: str, spans: DataFrame) -> DataFrame:
    """Merged spans with the entropy of their bytes and a confidence: min(1, length / 16) * entropy / 8."""
    merged = merge_spans(spans, key, "pattern_id")
    lists = merged.groupBy(key).agg(F.collect_list(F.struct("pattern_id", "start", "stop")).alias("x"))
    both = df.select(key, raw).join(lists, key).select(key, F.struct(F.col(raw).alias("raw"), "x").alias("v"))

    def score(v) -> list[tuple]:
        out = []
        for s in v["x"]:
            if s["stop"] > len(v["raw"]):
                raise ValueError("a span lies outside its text")
            e = entropy(v["raw"][s["start"] : s["stop"]])
            out.append((s["pattern_id"], s["start"], s["stop"], e, min(1.0, (s["stop"] - s["start"]) / 16) * e / 8))
        return out

    return flat_map(both, key, "v", "pattern_id long, start long, stop long, entropy double, confidence double", score)


def score_literals(df: DataFrame, key: str, raw: str, patterns: list[bytes]) -> DataFrame:
    """``score_spans`` of ``find_literals``, text by text, with no rows of spans in between. Each text is scored alone."""
    if sum(map(len, patterns)) > MAX_PATTERN_BYTES:
        raise ValueError("the patterns are too large to broadcast")
    scan = _finder(patterns)

    def score(v) -> list[tuple]:
        merged: list[list[int]] = []
        for pattern, start, stop in sorted(scan(v)):
            if merged and merged[-1][0] == pattern and start <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], stop)
            else:
                merged.append([pattern, start, stop])
        known: dict[bytes, float] = {}  # mostly the patterns themselves
        out = []
        for pattern, start, stop in merged:
            piece = v[start:stop]
            if piece not in known:
                known[piece] = entropy(piece)
            out.append((pattern, start, stop, known[piece], min(1.0, (stop - start) / 16) * known[piece] / 8))
        return out

    return flat_map(df, key, raw, "pattern_id long, start long, stop long, entropy double, confidence double", score)


@dataclass(frozen=True)
class Rule:
    """A boolean formula over a text, its size and its pattern counts; combine with &, | and ~."""

    column: Column

    def __and__(self, other: Rule) -> Rule:
        return Rule(self.column & other.column)

    def __or__(self, other: Rule) -> Rule:
        return Rule(self.column | other.column)

    def __invert__(self) -> Rule:
        return Rule(~self.column)


def _count(pattern: int) -> Column:
    return F.coalesce(F.try_element_at(F.col("counts"), F.lit(pattern).cast("long")), F.lit(0))


def pattern_exists(pattern: int) -> Rule:
    return Rule(_count(pattern) > 0)


def pattern_count_gt(pattern: int, n: int) -> Rule:
    return Rule(_count(pattern) > n)


def pattern_count_gte(pattern: int, n: int) -> Rule:
    return Rule(_count(pattern) >= n)


def size_is(compare, n: int) -> Rule:
    """``compare``: a function of operator (lt, le, gt, ge, eq, ne)."""
    return Rule(compare(F.col("size"), F.lit(n)))


def literal(value: bool) -> Rule:
    return Rule(F.lit(value))


def every(*rules: Rule) -> Rule:
    return functools.reduce(operator.and_, rules, literal(True))


def counts(spans: DataFrame, key: str) -> DataFrame:
    """(key, counts): a map from pattern to its number of spans."""
    n = spans.groupBy(key, "pattern_id").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pattern_id", "n"))).alias("counts"))
