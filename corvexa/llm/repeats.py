"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Every such string ("window") has one
anchor: its substring of GRAMS[0] bytes of the least hash, the leftmost if there are several. Equal windows have equal
anchors, so consecutive windows with one anchor travel together as a run, and only runs whose anchor occurs elsewhere
can repeat:

1. Each text is cut into runs. Copies of a whole run are found by its hash, so that they needn't be gathered: the
   earliest stays, others are repeats (within a batch before the shuffle, so a passage of a third of all documents
   sends one row a batch).
2. Runs that share an anchor but differ are fetched as bytes and gathered into shards by anchor. A shard's suffix
   array is built by induced sorting; permuted common prefixes of at least LENGTH, compared byte by byte, join equal
   windows.
3. The runs of an anchor with more than HEAVY differing ones don't fit a shard: they are cut again by longer anchors,
   of the next length in GRAMS, and go through both steps anew. At the last length an anchor is the window itself.

Hashes have 64 bits and copies must agree in those of the anchor and of the run.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import Workspace, bounded_batches, map_batches, session_of
from .suffix import mix, permuted_lcp, powers, prefix_hash, span_hash, suffix_array

LENGTH = 100
#: Bytes of anchors, level by level.
GRAMS = (32, 64, 96, LENGTH)
#: Bytes of a shard, and differing runs of one anchor that a shard takes.
SHARD, HEAVY = 1 << 19, 2048
#: A text is cut into runs by segments of so many bytes, so that memory stays bounded.
SEGMENT = 1 << 20
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by block-wise running minima."""
    n = len(x)
    padded = np.full(-(-n // w) * w, ~_U(0), dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(raw: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """Of one text: anchor hash, content hash, windows and first window of each run."""
    found = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
        part = raw[at : at + SEGMENT + LENGTH - 1]
        total = prefix_hash(part)
        n = len(part) - gram + 1
        _, down = powers(len(part))
        grams = mix((total[gram:] - total[:n]) * down[:n] + _U(gram))
        keyed = (grams & ~_LOW) | np.arange(n, dtype=np.uint64)
        least = _sliding_min(keyed, LENGTH - gram + 1)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        ends = np.append(starts[1:], len(least))
        anchor = grams[(least[starts] & _LOW).astype(np.int64)]
        found.append((anchor, span_hash(total, starts, ends + LENGTH - 1), ends - starts, starts + at))
    if not found:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before, and at the first row."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _long(x) -> np.ndarray:
    return np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, dtype=np.int64)


_RUN = "f long, h long, n long, k long, r long, i long, p long, again boolean"


def _cut(texts: DataFrame, gram: int) -> DataFrame:
    """Rows of _RUN for texts, or parts of them, (k, r, i, raw); ``p`` is where the part begins, ``again``: an equal run
    of the same batch is earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            if not b.num_rows:
                continue
            for k, r, first, raw in zip(*[c.to_pylist() for c in b.columns[:3]], b.column(3), strict=True):
                f, h, n, i = runs(np.frombuffer(raw.as_buffer(), dtype=np.uint8), gram)
                got.append((f, h, n, np.full(len(f), k), np.full(len(f), r), i + first, np.full(len(f), first)))
            f, h, n, k, r, i, p = (_long(np.concatenate(c)) for c in zip(*got, strict=True))
            o = np.lexsort((i, r, k, n, h, f))
            columns = [c[o] for c in (f, h, n, k, r, i, p)]
            again = ~_changes(*columns[:3])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(again)], names=["f", "h", "n", "k", "r", "i", "p", "again"])

    return texts.select("k", "r", "i", "raw").transform(map_batches, run, _RUN)


def _settle(rows: DataFrame, width: int) -> DataFrame:
    """(kind, f, k, r, i, n, p): kind 0, a run equal to an earlier one; kind 1, the first of several unequal runs of an
    anchor. Rows are sorted and streamed; of what lies before only the last run is held."""
    dealt = rows.where("NOT again").drop("again").repartition(width, "f").sortWithinPartitions("f", "h", "n", "k", "r", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last anchor, its last run, and its first run for as long as no other has come.
        last, alone = None, None
        for b in batches:
            if not b.num_rows:
                continue
            f, h, n, k, r, i, p = (c.to_numpy() for c in b.columns)
            new_f, new_v = _changes(f), _changes(f, h, n)
            if last is not None:
                new_f[0] = f[0] != last[0]
                new_v[0] = (f[0], h[0], n[0]) != last
            # Runs by anchor within this batch: an anchor with two runs sends all its first ones.
            group = np.cumsum(new_f)
            variants = np.bincount(group, weights=new_v, minlength=group[-1] + 1)
            if not new_f[0]:
                variants[0] += 2 if alone is None else 1
            many = new_v & (variants[group] > 1)
            extra = []
            if not new_f[0] and alone is not None and variants[0] > 1:
                extra.append(alone)
                alone = None
            out = [np.concatenate([f[~new_v], f[many]])] + [np.concatenate([c[~new_v], c[many]]) for c in (k, r, i, n, p)]
            kind = np.concatenate([np.zeros((~new_v).sum(), dtype=np.int64), np.ones(many.sum(), dtype=np.int64)])
            if extra:
                out = [np.append(c, e) for c, e in zip(out, extra[0], strict=True)]
                kind = np.append(kind, 1)
            if variants[group[-1]] > 1:
                alone = None
            elif new_f[np.flatnonzero(group == group[-1])[0]] or new_v.any():
                at = np.flatnonzero((group == group[-1]) & new_v)
                if len(at):
                    alone = tuple(c[at[0]] for c in (f, k, r, i, n, p))
            last = (f[-1], h[-1], n[-1])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, out)], names=["kind", "f", "k", "r", "i", "n", "p"])

    return dealt.transform(map_batches, run, "kind long, f long, k long, r long, i long, n long, p long")


def _fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (f, heavy, k, r, i, n, p) with the runs' bytes, from texts or parts of them (k, r, i, raw) that begin at p.
    The wanted runs of a text are one list beside it."""
    lists = wanted.groupBy("k", "r", F.col("p").alias("i")).agg(F.collect_list(F.struct("f", "heavy", F.col("i").alias("at"), "n")).alias("x"))
    both = texts.join(lists.hint("shuffle_hash"), ["k", "r", "i"]).select("k", "r", "i", "raw", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for k, r, first, raw, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for w in x:
                    at = w["at"] - first
                    for c, v in zip(out, (w["f"], w["heavy"], k, r, w["at"], w["n"], raw[at : at + w["n"] + LENGTH - 1]), strict=True):
                        c.append(v)
                    size += w["n"]
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)
                    out, size = [[] for _ in range(7)], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)

    names = ["f", "heavy", "k", "r", "i", "n", "s"]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]
    return both.transform(map_batches, run, "f long, heavy boolean, k long, r long, i long, n long, s binary")


def shard_repeats(strings: list[bytes], n: np.ndarray, k: np.ndarray, r: np.ndarray, i: np.ndarray) -> np.ndarray:
    """(string, first window, last window) of the windows that also start earlier, by one suffix array.

    String s has windows at its first n[s] offsets; window o of it starts at (k[s], r[s], i[s] + o).
    """
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes + 1) - sizes - 1
    t = np.ones(int((sizes + 1).sum()) + 1, dtype=np.uint16)
    t[-1] = 0
    body = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + 2
    of = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    t[np.arange(len(body), dtype=np.int32) + of] = body
    del body, of
    sa = suffix_array(t, 258)
    shared = permuted_lcp(t, sa, LENGTH, least=LENGTH)
    # Suffixes that share LENGTH bytes with the one before them continue its class; classes of one drop out.
    joined = shared[sa] >= LENGTH
    cls = np.cumsum(~joined, dtype=np.int32)
    part = joined | np.append(joined[1:], False)
    p, cls = sa[part], cls[part]
    s = np.searchsorted(starts, p, side="right") - 1
    o = p - starts[s]
    real = o < n[s]
    s, o, cls = s[real], o[real], cls[real]
    order = np.lexsort((i[s] + o, r[s], k[s], cls))
    s, o, cls = s[order], o[order], cls[order]
    later = ~_changes(cls)
    return _ranges(s[later], o[later])


def _ranges(s: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Maximal stretches of consecutive offsets of each string, as rows (string, first, last)."""
    order = np.lexsort((o, s))
    s, o = s[order], o[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)
    last = np.append(first[1:], True)[: len(s)]
    return np.stack([s[first], o[first], o[last]], axis=1) if len(s) else np.zeros((0, 3), dtype=np.int64)


_SPAN = "k long, r long, a long, b long"


def _span_batch(k, r, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_long(c)) for c in (k, r, a, b)], names=["k", "r", "a", "b"])


def _sorted_shards(runs_: DataFrame, width: int) -> DataFrame:
    """Repeated spans among runs (f, k, r, i, n, s): anchors are gathered up to SHARD bytes, a suffix array each."""
    rows = runs_.select("f", "k", "r", "i", "n", "s").repartition(width, "f").sortWithinPartitions("f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        size = 0

        def solve(upto: int) -> pa.RecordBatch:
            part = [c[:upto] for c in held]
            k, r, i, n = (np.array(c, dtype=np.int64) for c in part[1:5])
            d = shard_repeats(part[5], n, k, r, i)
            return _span_batch(k[d[:, 0]], r[d[:, 0]], i[d[:, 0]] + d[:, 1], i[d[:, 0]] + d[:, 2] + LENGTH)

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                # A shard ends only between anchors.
                if size >= SHARD and held[0][-1] != row[0]:
                    yield solve(len(held[0]))
                    held, size = [[] for _ in range(6)], 0
                for c, v in zip(held, row, strict=True):
                    c.append(v)
                size += len(row[5])
        if held[0]:
            yield solve(len(held[0]))

    return rows.transform(map_batches, run, _SPAN)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", as_text: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``spans`` (removed [start, end) byte ranges, in order) and ``kept`` (bytes left).

    Null texts count as empty. Earlier means a smaller id, or an earlier start in one document; null ids come first,
    and rows that share an id are told apart by a row number. Columns of those three names are replaced. With
    ``as_text`` the bytes left are a string, without the rest of a character that a removed span has cut.
    """
    spark = session_of(docs)
    bounded_batches(spark)
    ws = Workspace(spark, "repeats")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_bytes", "spans", "kept", "__k", "__r"}])
    rest = [c for c in docs.columns if c not in (text,)]
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    if docs.select(k.alias("k")).groupBy("k").count().where("count > 1").limit(1).count():
        docs = ws.save(docs.withColumn("__r", F.monotonically_increasing_id()), "rows")
    else:
        docs = docs.withColumn("__r", F.lit(0).cast("long"))
    keyed = docs.withColumn("__k", k)
    texts = keyed.select(F.col("__k").alias("k"), F.col("__r").alias("r"), raw.alias("raw"))
    long_enough = texts.where(F.octet_length("raw") >= LENGTH)

    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # About 400,000 runs, or some shards' bytes, a partition.
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / 35 / 400_000) + 1)
    span = ["k", "r", F.col("i").alias("a"), (F.col("i") + F.col("n") + LENGTH - 1).alias("b")]
    source, found, saved = long_enough.withColumn("i", F.lit(0).cast("long")), [], []
    for gram in GRAMS:
        cut = ws.save(_cut(source, gram), "runs")
        settled = ws.save(_settle(cut, width), "settled")
        heavy = settled.where("kind = 1").groupBy("f").count().where(F.col("count") > HEAVY).select("f", F.lit(True).alias("heavy"))
        heavy = ws.save(heavy, "heavy")
        wanted = settled.where("kind = 1").join(heavy, "f", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))).select("f", "heavy", "k", "r", "i", "n", "p")
        fetched = ws.save(_fetch(source, wanted), "fetched")
        saved += [cut, settled, heavy, fetched]
        found += [cut.where("again").select(*span), settled.where("kind = 0").select(*span), _sorted_shards(fetched.where("NOT heavy"), width)]
        if heavy.isEmpty():
            break
        if gram == LENGTH:
            raise RuntimeError("equal windows differ: a collision of hashes")
        source = fetched.where("heavy").select("k", "r", "i", F.col("s").alias("raw"))
    spans = functools.reduce(DataFrame.unionByName, found)
    spans = ws.save(spans, "spans")
    ws.drop(*saved)
    lists = spans.groupBy("k", "r").agg(F.collect_list(F.struct("a", "b")).alias("__x")).withColumnsRenamed({"k": "__k", "r": "__r"})
    both = keyed.withColumn("__b", raw).join(lists.hint("shuffle_hash"), ["__k", "__r"], "left").select(*rest, "__b", "__x")
    names = [*rest, "n_bytes", "spans", "kept"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, kept = [], [], []
            for body, x in zip(b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist(), strict=True):
                found = merged([(s["a"], s["b"]) for s in x or []])
                n.append(len(body))
                spans.append([{"start": s, "end": e} for s, e in found])
                edges = [0, *[v for s in found for v in s], len(body)]
                left = b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n, type=pa.int64()), pa.array(spans, type=kind), pa.array(kept, type=pa.string() if as_text else pa.binary())], names=names)

    span = StructType().add("start", "long").add("end", "long")
    schema = StructType(both.schema.fields[: len(rest)]).add("n_bytes", "long").add("spans", ArrayType(span)).add("kept", "string" if as_text else "binary")
    return both.transform(map_batches, apply, schema)

