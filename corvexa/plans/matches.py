"""Pattern queries over documents: literal and regex spans, span clean-up, rules."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvexa.operators import automata, match
from corvexa.registry import query, table

from .texts import raw

PATTERNS = [b"the ", b"tion", b"ing", b"and", b"der ", b"les ", b"ment"]
REGEXES = ["[A-Z][a-z]+ing", "[0-9]+", "[a-z]+@[a-z.]+"]

_SPANS = f"""pat AS (SELECT unnest({[p.decode() for p in PATTERNS]}) AS p, unnest(range({len(PATTERNS)})) AS pattern_id),
pieces AS (SELECT doc_id, pattern_id, p, unnest(string_split(text, p)) AS s, generate_subscripts(string_split(text, p), 1) AS k, len(string_split(text, p)) AS n FROM documents, pat),
spans AS (SELECT doc_id, pattern_id, CAST(e AS BIGINT) AS start, CAST(e + strlen(p) AS BIGINT) AS stop FROM (SELECT *, sum(strlen(s)) OVER w + (k - 1) * strlen(p) AS e FROM pieces WINDOW w AS (PARTITION BY doc_id, pattern_id ORDER BY k)) WHERE k < n)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.find_literals(raw(spark, sf_dir), "doc_id", "raw", PATTERNS)


@query(f"WITH {_SPANS} SELECT doc_id, pattern_id, start, stop FROM spans")
def aho_corasick(spark, sf_dir):
    """Every occurrence of every literal, with byte spans."""
    return spans(spark, sf_dir)


@query(f"WITH {_SPANS} SELECT doc_id, start FROM spans WHERE pattern_id = 1")
def substring_positions(spark, sf_dir):
    return match.find_literals(raw(spark, sf_dir), "doc_id", "raw", [b"tion"]).select("doc_id", "start")


_MERGED = """near AS (SELECT doc_id, start - start % 16 AS start, stop + 8 AS stop FROM spans),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM near),
r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS r FROM m)"""


@query(f"WITH {_SPANS}, {_MERGED} SELECT doc_id, min(start) AS start, max(stop) AS stop FROM r GROUP BY doc_id, r")
def span_dedup(spark, sf_dir):
    """Widened spans merged where they overlap or touch."""
    near = spans(spark, sf_dir).select("doc_id", (F.col("start") - F.col("start") % 16).alias("start"), (F.col("stop") + 8).alias("stop"))
    return match.merge_spans(near, "doc_id")


@query(f"WITH {_SPANS} SELECT doc_id, pattern_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pattern_id ORDER BY start) AS k FROM spans) WHERE k <= 3")
def cap_per_pattern(spark, sf_dir):
    return match.first_spans(spans(spark, sf_dir), 3, "doc_id", "pattern_id")


@query(f"WITH {_SPANS} SELECT doc_id, pattern_id, start // 1024 AS region, min(start) AS start FROM spans GROUP BY 1, 2, 3")
def first_per_region(spark, sf_dir):
    """The first hit of each pattern in each region of 1024 bytes: an aggregate, no window."""
    s = spans(spark, sf_dir)
    return s.groupBy("doc_id", "pattern_id", F.call_function("div", F.col("start"), F.lit(1024).cast("long")).alias("region")).agg(F.min("start").alias("start"))


@query(f"WITH {_SPANS} SELECT least(count(*), 5000) AS live, greatest(count(*) - 5000, 0) AS overflow FROM spans")
def hit_buffer(spark, sf_dir):
    return match.capped(spans(spark, sf_dir), 5000)


@query(f"WITH {_SPANS} SELECT doc_id, pattern_id, count(*) AS hits FROM spans WHERE pattern_id < 3 GROUP BY 1, 2")
def decode_then_scan(spark, sf_dir):
    """Base64 text decoded and scanned in one pass."""
    encoded = raw(spark, sf_dir).select("doc_id", F.base64("raw").alias("b"))
    decoded = encoded.select("doc_id", F.unbase64("b").alias("raw"))
    return match.find_literals(decoded, "doc_id", "raw", PATTERNS[:3]).groupBy("doc_id", "pattern_id").agg(F.count("*").alias("hits"))


@query(f"SELECT doc_id, pattern_id, count(*) AS hits FROM (SELECT doc_id, pattern_id, unnest(regexp_extract_all(text, p)) FROM documents, (SELECT unnest({REGEXES}) AS p, unnest(range({len(REGEXES)})) AS pattern_id)) GROUP BY 1, 2")
def regex_set(spark, sf_dir):
    """Counts of each regex of a set, in the JVM."""
    hits = F.array(*[F.struct(F.lit(k).cast("long").alias("pattern_id"), F.size(F.regexp_extract_all("text", F.lit(r), F.lit(0))).cast("long").alias("hits")) for k, r in enumerate(REGEXES)])
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(hits).alias("e")).select("doc_id", "e.pattern_id", "e.hits").where("hits > 0")


_REGEX_SPANS = f"""pats AS (SELECT unnest({REGEXES}) AS p, unnest(range({len(REGEXES)})) AS pattern_id), cuts AS (SELECT doc_id, pattern_id, regexp_extract_all(text, p) AS hit, regexp_split_to_array(text, p) AS gap FROM documents, pats),
parts AS (SELECT doc_id, pattern_id, unnest(hit) AS h, unnest(gap[:len(hit)]) AS g, unnest(range(len(hit))) AS k FROM cuts),
found AS (SELECT doc_id, pattern_id, k, h, CAST(sum(strlen(g) + strlen(h)) OVER (PARTITION BY doc_id, pattern_id ORDER BY k) AS BIGINT) AS stop FROM parts)"""


@query(f"WITH {_REGEX_SPANS} SELECT doc_id, pattern_id, stop - strlen(h) AS start, stop FROM found")
def regex_ranges(spark, sf_dir):
    """Byte spans of each regex of a set."""
    return match.find_regexes(raw(spark, sf_dir), "doc_id", "raw", [r.encode() for r in REGEXES])


def _windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id")
    w = F.explode(F.array(*[F.struct((F.col("doc_id") % 50 + lo).alias("lo"), (F.col("doc_id") % 50 + hi).alias("hi")) for lo, hi in ((20, 400), (300, 700), (5000, 9000))]))
    return d.select("doc_id", w.alias("w")).select("doc_id", "w.lo", "w.hi")


@query(f"WITH {_SPANS} SELECT doc_id, pattern_id, start, stop FROM spans WHERE (start >= doc_id % 50 + 20 AND stop <= doc_id % 50 + 400) OR (start >= doc_id % 50 + 300 AND stop <= doc_id % 50 + 700) OR (start >= doc_id % 50 + 5000 AND stop <= doc_id % 50 + 9000)")
def aho_corasick_bounded(spark, sf_dir):
    """Occurrences within windows of each text, which overlap."""
    return match.find_within(raw(spark, sf_dir), "doc_id", "raw", _windows(spark, sf_dir), PATTERNS)


for _width in (2, 3):

    @query(f"WITH {_SPANS} SELECT doc_id, pattern_id, count(*) AS hits FROM spans GROUP BY 1, 2", name=f"suffix{_width}_prefilter_counts")
    def _suffix(spark, sf_dir, width=_width):
        """Counts of literals behind a filter on their last bytes."""
        return match.count_by_suffix(raw(spark, sf_dir), "doc_id", "raw", PATTERNS, width)


@query(f"WITH {_SPANS} SELECT doc_id, pattern_id, start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, pattern_id) - 1 AS place FROM spans")
def match_order(spark, sf_dir):
    """Spans of a text in order."""
    return match.ordered(spans(spark, sf_dir), "doc_id")


@query(f"""WITH {_SPANS}, e AS (SELECT doc_id, stop FROM spans WHERE pattern_id IN (0, 1) UNION SELECT doc_id, place FROM (SELECT doc_id, c, CAST(sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS place FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM documents)) WHERE c BETWEEN '0' AND '9')
SELECT doc_id, count(e.stop) AS ends, min(e.stop) AS first FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id""")
def automaton_scan(spark, sf_dir):
    """A set of literals and a set of digits as one table, over which all texts advance together."""
    t = automata.compile_set([b"the ", b"tion", b"[0-9]"])
    return automata.scan(raw(spark, sf_dir), "doc_id", "raw", t)


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), c AS (SELECT doc_id, len(string_split(t, 'the ')) - 1 + len(string_split(t, 'tion')) - 1 AS ends FROM t)
SELECT doc_id, ends FROM c""")
def automaton_ignoring_case(spark, sf_dir):
    t = automata.compile_set([b"the ", b"tion"], ignore_case=True)
    return automata.scan(raw(spark, sf_dir), "doc_id", "raw", t).select("doc_id", "ends")


@query("SELECT s AS state, b AS byte, CASE WHEN b = 97 THEN 1 WHEN s = 1 AND b = 98 THEN 2 ELSE 0 END AS next, s = 1 AND b = 98 AS accept FROM range(3) a(s), range(256) r(b)")
def automaton_table(spark, sf_dir):
    """All transitions of the least table for the literal ab, or its copy as a|b sets: states that behave alike are one."""
    t = automata.compile_set([b"ab", b"a(b|b)", b"[a]b"]).rows(spark)
    return t.select(*[F.col(c).cast("long").alias(c) for c in ("state", "byte", "next")], "accept")


@query("SELECT doc_id, coalesce(regexp_matches(text, '[A-Z][a-z]+ing'), false) AS hit, coalesce(regexp_matches(text, '[0-9]+ ment|tion[a-z]*'), false) AS either FROM documents")
def anchored_regexes(spark, sf_dir):
    """Regexes behind the literals that every match must hold, where there are some."""
    t = table(spark, sf_dir, "documents", "doc_id", "text")
    return t.select("doc_id", automata.prefiltered(F.col("text"), "[A-Z][a-z]+ing").alias("hit"), automata.prefiltered(F.col("text"), "[0-9]+ ment|tion[a-z]*").alias("either"))


@query(f"WITH {_SPANS} SELECT doc_id, pattern_id, count(*) AS hits FROM spans WHERE pattern_id < 3 GROUP BY 1, 2")
def hex_decode_then_scan(spark, sf_dir):
    """Hexadecimal text decoded and scanned in one pass."""
    decoded = raw(spark, sf_dir).select("doc_id", F.hex("raw").alias("h")).select("doc_id", F.unhex("h").alias("raw"))
    return match.find_literals(decoded, "doc_id", "raw", PATTERNS[:3]).groupBy("doc_id", "pattern_id").agg(F.count("*").alias("hits"))


@query(f"""WITH {_SPANS}, m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id, pattern_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM spans),
r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, pattern_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS r FROM m), g AS (SELECT doc_id, pattern_id, min(start) AS start, max(stop) AS stop FROM r GROUP BY doc_id, pattern_id, r),
b AS (SELECT g.*, unnest(regexp_extract_all(substr(hex(encode(text)), 2 * start + 1, 2 * (stop - start)), '..')) AS h FROM g JOIN documents USING (doc_id)), c AS (SELECT doc_id, pattern_id, start, stop, h, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, pattern_id, start, stop, round(-sum(n / (stop - start) * log2(n / (stop - start))) + 0, 6) + 0 AS entropy, round(least(1, (stop - start) / 16) * -sum(n / (stop - start) * log2(n / (stop - start))) / 8, 6) + 0 AS confidence FROM c GROUP BY 1, 2, 3, 4""")
def post_process(spark, sf_dir):
    """Merged spans with entropy and confidence."""
    s = match.score_literals(raw(spark, sf_dir), "doc_id", "raw", PATTERNS)
    return s.select("doc_id", "pattern_id", "start", "stop", F.round("entropy", 6).alias("entropy"), F.round("confidence", 6).alias("confidence"))


def _rules() -> match.Rule:
    many = match.pattern_count_gte(0, 2) & match.pattern_exists(1)
    return (many | match.pattern_count_gt(4, 1)) & match.size_is(operator.lt, 20_000) & ~match.size_is(operator.lt, 40)


@query(f"""WITH {_SPANS}, c AS (SELECT doc_id, count_if(pattern_id = 0) AS a, count_if(pattern_id = 1) AS b, count_if(pattern_id = 4) AS d FROM spans GROUP BY doc_id)
SELECT doc_id, strlen(text) AS size FROM documents LEFT JOIN c USING (doc_id) WHERE ((coalesce(a, 0) >= 2 AND coalesce(b, 0) > 0) OR coalesce(d, 0) > 1) AND strlen(text) < 20000 AND NOT strlen(text) < 40""")
def rule_eval(spark, sf_dir):
    """Which documents trip a rule on pattern counts and size."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    found = match.counts(spans(spark, sf_dir), "doc_id")
    return docs.join(found, "doc_id", "left").where(_rules().column).select("doc_id", "size")


@query("""SELECT doc_id, strlen(text) < 500 AS lt, strlen(text) <= 500 AS lte, strlen(text) > 500 AS gt, strlen(text) >= 500 AS gte, strlen(text) = 500 AS eq, strlen(text) <> 500 AS ne, true AS yes, false AS no,
 regexp_matches(text, '[0-9]{3}') AS regex, contains(text, 'tion') AS has, starts_with(text, 'The') AS prefix, ends_with(text, '.') AS suffix, n_chars BETWEEN 100 AND 900 AS within, lang IN ('de', 'fr') AS member, list_contains([source, 'src1'], source) AS field FROM documents""")
def rule_conditions(spark, sf_dir):
    """Every condition of the rule language as a column."""
    t = table(spark, sf_dir, "documents")
    n, x = F.octet_length("text"), F.col("text")
    made = {"lt": n < 500, "lte": n <= 500, "gt": n > 500, "gte": n >= 500, "eq": n == 500, "ne": n != 500, "yes": F.lit(True), "no": F.lit(False), "regex": x.rlike("[0-9]{3}"), "has": x.contains("tion"), "prefix": x.startswith("The"), "suffix": x.endswith("."), "within": F.col("n_chars").between(100, 900), "member": F.col("lang").isin("de", "fr"), "field": F.array_contains(F.array("source", F.lit("src1")), F.col("source"))}
    return t.select("doc_id", *[c.alias(k) for k, c in made.items()])


@query("""SELECT kind, CAST(state AS BIGINT) AS state, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, CAST(next AS BIGINT) AS next FROM (VALUES ('move', 2, 97, 97, 3), ('move', 4, 48, 57, 5), ('move', 4, 95, 95, 5), ('empty', 0, NULL, NULL, 1), ('empty', 1, NULL, NULL, 2), ('empty', 3, NULL, NULL, 4)) u(kind, state, low, high, next)""")
def automaton_moves(spark, sf_dir):
    """Moves and empty moves of the automaton of a[0-9_], before it is made deterministic."""
    moves, empty, _ = automata.nfa_tables(spark, [b"a[0-9_]"])
    n = F.lit(None).cast("long")
    both = moves.select(F.lit("move").alias("kind"), *[F.col(c).cast("long").alias(c) for c in ("state", "low", "high", "next")])
    return both.unionByName(empty.select(F.lit("empty").alias("kind"), F.col("state").cast("long").alias("state"), n.alias("low"), n.alias("high"), F.col("next").cast("long").alias("next")))


@query(f"WITH {_SPANS} SELECT doc_id, count(DISTINCT stop) AS ends FROM spans GROUP BY doc_id")
def sharded_automata(spark, sf_dir):
    """Patterns dealt to several small tables: at how many places of a text any of them ends."""
    return automata.count_places(raw(spark, sf_dir), "doc_id", "raw", [t for _, t in automata.sharded(PATTERNS, 8)])
