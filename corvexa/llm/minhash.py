"""Near-duplicate groups by HyperMinHash.

Each document's shingle hashes are dealt to 125 buckets; a bucket stores, of its smallest hash, the count of leading
zeros and ten mantissa bits. Empty buckets of small sets borrow from full ones by a fixed probe order. Bands of five
compressed registers propose pairs; the Jaccard estimate, corrected for chance collisions of registers, drops pairs
far below the threshold; the others are confirmed on full shingle sets. At Jaccard 0.85 a pair shares no band with
probability 4e-7, and the estimate errs by more than the margin with one of about 1e-6.

No pairs of a group are listed. Documents of equal shingle sets form one class, whose smallest id stands for it. In
each bucket members are first tied to the smallest one; confirmed ties make components. Only buckets that then still
hold two components are compared member by member: the members outside of the bucket's largest component, WIDE at
most, with all others, in blocks of which each passes on at most a spanning forest of what it confirms.

A bucket with more members outside of its largest component (texts of one mould, say) isn't compared in pairs. Its
members get longer and rarer keys: their shingles are ordered by how often they occur among such members, and two sets
of the wanted similarity share one of their first, that is rarest, |A| - ceil(t |A|) + 1 shingles. This misses no pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, map_batches, session_of
from .graph import components

BUCKETS, MANTISSA, ROWS = 125, 10, 5
BANDS = BUCKETS // ROWS
#: Below the threshold by this much, an estimate rules a pair out: five standard errors of 125 registers.
MARGIN = 0.16
#: Members of a block, members that go with one copy of a leader, and members outside of its largest component that a
#: bucket may have to be compared in pairs.
BLOCK, SPREAD, WIDE = 512, 256, 4096
#: Bits of the table of shingle frequencies that orders shingles: its size is fixed.
SLOTS = 20

_U = np.uint64
_rng = np.random.default_rng(20240611)
_BASE = _U(int(_rng.integers(1 << 62)) * 2 + 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_PROBES = _rng.integers(0, BUCKETS, (96, BUCKETS))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_BOUNDS = (np.arange(BUCKETS, dtype=object) * (1 << 64) // BUCKETS).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    for k, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[k]) <= n:
            p = _powers[k]
            _powers[k] = np.concatenate([p, p * (p[-1:] * base)])
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z lower-cased: differences of one prefix sum of a polynomial."""
    b = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    word = ~_BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(b))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of a shorter text, one of the whole word sequence."""
    w = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(w):
        return w
    k = min(words, len(w))
    s = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        s += w[i : len(w) - k + 1 + i] * _MULT[i]
    s = np.sort(_mix(s + _U(k)))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of non-empty sets, a row each."""
    out = np.zeros((len(sets), BUCKETS), dtype=np.uint16)
    widths = np.diff(np.concatenate([_BOUNDS.astype(object), [1 << 64]])).astype(np.float64)
    for k, s in enumerate(sets):
        at = np.searchsorted(s, _BOUNDS)
        full = np.concatenate([at[1:], [len(s)]]) > at
        rest = (s[at[full]] - _BOUNDS[full]).astype(np.float64) / widths[full]
        m, e = np.frexp(np.maximum(rest, 2.0**-60))  # rest = m * 2**e, m from 0.5 up
        out[k, full] = ((1 - e).astype(np.uint16) << MANTISSA) | ((m - 0.5) * (2 << MANTISSA)).astype(np.uint16)
    empty = out == 0
    was = ~empty
    for probe in _PROBES:
        if not empty.any():
            return out
        take = empty & was[:, probe]
        out = np.where(take, out[:, probe], out)
        empty &= ~take
    for k in np.flatnonzero(empty.any(axis=1)):
        full = np.flatnonzero(was[k])
        out[k, empty[k]] = out[k, full[np.flatnonzero(empty[k]) % len(full)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, without the share of registers that agree by chance.

    That share depends on the ratio of the sets' sizes, which is near 1 for pairs that can reach a threshold; it is that
    of equal sizes.
    """
    chance = 0.1699 * BUCKETS / (1 << MANTISSA)
    return ((a == b).sum(axis=-1) - chance) / (BUCKETS - chance)


def band_keys(r: np.ndarray) -> np.ndarray:
    k = np.zeros((len(r), BANDS), dtype=np.uint64)
    for i in range(ROWS):
        k = _mix(k + r[:, i::ROWS].astype(np.uint64) * _MULT[i] + np.arange(BANDS, dtype=np.uint64) * _MULT[20])
    return k


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _rows(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=dtype) for v in column.to_pylist()]


def _sets(docs: DataFrame, node: Column, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()], type=pa.binary())], names=["node", "v"])

    return docs.select(node.alias("node"), F.col("__t")).transform(map_batches, run, "node long, v binary")


def _against_leaders(pairs: DataFrame, values: DataFrame, test, dtype: str) -> DataFrame:
    """Pairs (a, b) that pass ``test(value of a, [values of b])``. values: (node, v).

    Pairs are grouped by leader a, at most about SPREAD of them with one copy of the leader's value, and streamed:
    a task holds one leader and one batch.
    """
    counts = pairs.groupBy("a").count()
    salted = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / SPREAD)).alias("s"), "b")
    members = salted.join(values, F.col("b") == F.col("node")).select("a", "s", "b", "v")
    spread = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("count") / SPREAD) - 1)).alias("s"))
    leaders = spread.join(values, F.col("a") == F.col("node")).select("a", "s", F.lit(None).cast("long").alias("b"), "v")
    rows = members.unionByName(leaders).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader, fresh = None, [], True
        for batch in batches:
            a, b, v = batch.column(0).to_pylist(), batch.column(2).to_pylist(), _rows(batch.column(3), dtype)
            out = []
            for x, y, value in zip(a, b, v, strict=True):
                if y is None:
                    if x != now or not fresh:
                        now, leader, fresh = x, [], True
                    leader.append(value)
                else:
                    fresh = False
                    if any(test(value, w) for w in leader):
                        out.append((x, y))
            if out:
                p, q = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, type=pa.int64()), pa.array(q, type=pa.int64())], names=["a", "b"])

    return rows.transform(map_batches, run, "a long, b long")


def _sizes(tied: DataFrame) -> DataFrame:
    """tied (key, node, comp) -> (key, most, all, top) of keys with two components: the largest one and numbers of members."""
    each = tied.groupBy("key", "comp").count()
    sizes = each.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("x"), F.sum("count").alias("all")).where("x.count < all")
    return sizes.select("key", F.col("x.comp").alias("most"), F.col("x.count").alias("top"), "all")


def _units(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members (key, node, comp) -> the same with ``big`` and with (i, j) for every two blocks that can hold a pair.

    ``big``: of the bucket's largest component. Its members need no comparison among themselves, so only the others
    go to many blocks: a hot component is dealt out once for each block of what it is compared with.
    """
    sizes = sizes.select("key", "most", F.ceil(F.col("top") / BLOCK).alias("bigs"), F.ceil((F.col("all") - F.col("top")) / BLOCK).alias("smalls"))
    zero, last = F.lit(0).cast("long"), F.col("smalls") - 1
    m = members.join(sizes, "key").withColumn("big", F.col("comp") == F.col("most"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("big"), F.col("bigs")).otherwise(F.col("smalls")))
    own = F.when(F.col("big"), F.col("smalls")).otherwise(zero) + own
    m = m.withColumn("own", own).withColumn("other", F.explode(F.sequence(zero, F.when(F.col("big"), last).otherwise(last + F.col("bigs")))))
    return m.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("most", "bigs", "smalls", "other", "own")


def _sides(comp: np.ndarray, big: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a unit with those that it is compared with: of another component, each pair once."""
    if big.any():
        rest = np.flatnonzero(big)
        for k in np.flatnonzero(~big).tolist():
            yield k, rest
    else:
        for k in range(len(comp) - 1):
            if len(other := np.flatnonzero(comp[k + 1 :] != comp[k]) + k + 1):
                yield k, other


def _by_unit(rows: DataFrame, names: list[str], solve, schema: str) -> DataFrame:
    """Streams rows (key, i, j, names...) and hands each unit's columns to ``solve``, which yields tuples."""
    rows = rows.select("key", "i", "j", *names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done() -> list[tuple]:
            return list(solve(unit, list(zip(*held, strict=True)))) if len(held) > 1 else []

        for batch in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[:3] != unit:
                    out += done()
                    unit, held = r[:3], []
                held.append(r[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=columns)
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=columns)

    return rows.transform(map_batches, run, schema)


def _shared_keys(ws: Workspace, keyed: DataFrame) -> DataFrame:
    """keyed (key, node) -> (key, node, a) of keys with two nodes, a the least; of keys with the same nodes one is enough."""
    n = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")).where("a < z")
    buckets = ws.save(n.groupBy("a", "z", "n", "x").agg(F.min("key").alias("key")).select("key", "a"), "buckets")
    return ws.save(keyed.join(buckets, "key").select("key", "node", "a"), "members")


def _rare_keys(spark: SparkSession, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """texts (node, text) -> (key, node): of each set the rarest shingles, of which two linked sets share one at least."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield b.column(0).to_pylist(), [shingle_set(t, words) for t in b.column(1).to_pylist()]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOTS, dtype=np.int64)
        for _, found in sets(batches):
            for s in found:
                np.add.at(table, (s >> _U(64 - SLOTS)).astype(np.int64), 1)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], names=["slot", "n"])

    counts = texts.transform(map_batches, tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SLOTS, dtype=np.int64)
    table[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(table)  # 2**SLOTS numbers, however large the input is

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, found in sets(batches):
            keys, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for node, s in zip(nodes, found, strict=True):
                often = shared.value[(s >> _U(64 - SLOTS)).astype(np.int64)]
                first = np.lexsort((s, often))[: len(s) + (-percent * len(s)) // 100 + 1]
                first = first[often[first] > 1]  # others have one owner
                keys.append(s[first])
                owners.append(np.full(len(first), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "node"])

    return texts.transform(map_batches, pick, "key long, node long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 85) -> DataFrame:
    """Per row: (key, n_shingles, component_id, kept), linking texts of Jaccard >= percent / 100 on word shingles.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share an id count as one
    document of several texts. Rows of null id are kept and have a null component. Other columns aren't carried.
    """
    spark = session_of(docs)
    bounded_batches(spark)
    ws = Workspace(spark, "minhash")
    docs = docs.select(F.col(key).cast("long").alias("__k"), F.col(text).cast("string").alias("__t"))
    floor = percent / 100 - MARGIN

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                c, v = [None] * len(sets), [None] * len(sets)
                for i, r in zip(some, registers([sets[i] for i in some]), strict=True):
                    c[i], v[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), r.tobytes()
                halves = [[None if x is None else int.from_bytes(x[h : h + 8], "little", signed=True) for x in c] for h in (0, 8)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], type=pa.int64()), *[pa.array(h, type=pa.int64()) for h in halves], pa.array(v, type=pa.binary())], names=["k", "n", "c1", "c2", "v"])

    rows = ws.save(docs.transform(map_batches, sketch, "k long, n long, c1 long, c2 long, v binary"), "sketches")
    with_id = rows.where("c1 IS NOT NULL AND k IS NOT NULL")
    # One class of each shingle set: its smallest id stands for it. Copies are combined before the shuffle.
    classes = ws.save(with_id.groupBy("c1", "c2").agg(F.min(F.struct("k", "v")).alias("x")).select("c1", "c2", F.col("x.k").alias("node"), F.col("x.v").alias("v")), "classes")
    values = classes.select("node", "v")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.stack(_rows(b.column(1), np.uint16))
            keys = band_keys(r).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["key", "node"])

    def texts_of(nodes: DataFrame) -> DataFrame:
        # The side with ids only is the one that is hashed; texts stream past it.
        return docs.join(nodes.hint("shuffle_hash"), F.col("__k") == F.col("node"), "left_semi")

    links, comps, wide = _resolve(ws, _shared_keys(ws, values.transform(map_batches, banded, "key long, node long")), values, texts_of, words, percent, floor, None, WIDE)
    if not wide.isEmpty():
        many = texts_of(wide.select("node").distinct()).select(F.col("__k").alias("node"), "__t")
        rare = ws.save(_rare_keys(spark, many, words, percent).distinct(), "rare")
        links, comps, _ = _resolve(ws, _shared_keys(ws, rare), values, texts_of, words, percent, floor, links, None)
    named = classes.select("c1", "c2", "node").join(comps, "node", "left").select("c1", "c2", F.coalesce("comp", "node").alias("comp"))
    out = with_id.select("k", "n", "c1", "c2").join(named, ["c1", "c2"]).select("k", "n", "comp")
    out = out.unionByName(rows.where("c1 IS NULL OR k IS NULL").select("k", "n", F.col("k").alias("comp")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("k") == F.col("comp"), F.lit(True)).alias("kept"))


def _resolve(ws: Workspace, members: DataFrame, values: DataFrame, texts_of, words: int, percent: int, floor: float, links: DataFrame | None, most: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links among members (key, node, a) of shared keys, added to ``links``; their components; and the members (key,
    node) of keys that are left open because more than ``most`` members lie outside of their largest component."""

    def full_sets(nodes: DataFrame) -> DataFrame:
        return ws.save(_sets(texts_of(nodes), F.col("__k"), words), "sets")

    stars = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    if links is not None:
        # What is tied already needs no comparison.
        known = components(ws, links)
        label = lambda c: known.select(F.col("node").alias(c), F.col("comp").alias(f"__{c}"))
        stars = stars.join(label("a"), "a", "left").join(label("b"), "b", "left").where("NOT coalesce(__a = __b, false)").select("a", "b")
    likely = ws.save(_against_leaders(stars, values, lambda v, w: estimate(v, w) >= floor, "<u2"), "likely")
    wanted = ws.save(likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct(), "nodes")
    sets = full_sets(wanted)
    new = _against_leaders(likely, sets, lambda v, w: linked(w, v, percent), "<u8")
    links = ws.save(new if links is None else links.unionByName(new), "links")
    comps = components(ws, links)

    # Buckets that still hold two components.
    tied = members.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    tied = ws.save(tied, "tied")
    sizes = ws.save(_sizes(tied), "sizes")
    wide = sizes.where(F.lit(False) if most is None else F.col("all") - F.col("top") > most)
    narrow = sizes if most is None else sizes.where(F.col("all") - F.col("top") <= most)
    open_ = ws.save(_units(tied, narrow).join(values, "node"), "open")

    def likely_in_unit(unit, columns) -> Iterator[tuple]:
        node, comp, big, v = columns
        r, found = np.stack([np.frombuffer(x, dtype=np.uint16) for x in v]), set()
        for k, other in _sides(np.array(comp), np.array(big)):
            if (hit := other[estimate(r[other], r[k]) >= floor]).size:
                found |= {k, *hit.tolist()}
        for h in sorted(found):
            yield (*unit, node[h], big[h])

    flagged = ws.save(_by_unit(open_, ["node", "comp", "big", "v"], likely_in_unit, "key long, i long, j long, node long, big boolean").distinct(), "flagged")
    if not flagged.isEmpty():
        more = full_sets(flagged.select("node").distinct().join(wanted, "node", "left_anti"))
        sets = sets.unionByName(more)
        unit_rows = flagged.join(tied, ["key", "node"]).join(sets.withColumnRenamed("v", "full"), "node").join(values, "node")

        def confirm(unit, columns) -> Iterator[tuple]:
            node, comp, big, full, v = columns
            r, full = np.stack([np.frombuffer(x, dtype=np.uint16) for x in v]), [np.frombuffer(x, dtype="<u8") for x in full]
            root = {c: c for c in comp}

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for k, other in _sides(np.array(comp), np.array(big)):
                for h in other[estimate(r[other], r[k]) >= floor].tolist():
                    p, q = top(comp[k]), top(comp[h])
                    if p != q and linked(full[k], full[h], percent):
                        root[p] = q
                        yield node[k], node[h]

        new = _by_unit(unit_rows, ["node", "comp", "big", "full", "v"], confirm, "a long, b long").distinct()
        links = ws.save(links.unionByName(ws.save(new, "more-links")), "all-links")
        comps = components(ws, links)
    left = ws.save(tied.join(wide.select("key"), "key").select("key", "node"), "wide")
    ws.drop(likely, wanted, tied, sizes, open_, flagged)
    return links, comps, left
