"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

A text is cut before runs of spaces; each part is a lattice whose edges are vocabulary pieces, with the bytes of any
character as a dear way out. Forward sums are computed for the distinct parts of a batch, by distance from the part's
start; then all occurrences of all parts are walked back together, each step drawing an edge in proportion to its
share of the forward sum. Random numbers are a hash of (seed, row key, part number, step), so a row's segmentation
depends on nothing else. Spaces are written as the meta symbol; a meta symbol in the text itself goes by its bytes,
so decoding returns the text exactly.

The vocabulary file holds merge ranks and no probabilities: a piece of rank r has weight proportional to
(r + 1) ** -POWER, and a byte BYTE_COST nats less than the rarest piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import bounded_batches, map_batches, session_of
from .suffix import mix

META = "▁"
POWER, BYTE_COST = 1.0, 3.0
_U = np.uint64
_G = _U(0x9E3779B97F4A7C15)
_BASE = _U(0x5851F42D4C957F2D)
_INVERSE = _U(pow(0x5851F42D4C957F2D, -1, 1 << 64))
#: Characters of texts taken at one go.
CHARS = 2 << 20
_models: dict[str, "Pieces"] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Pieces:
    """The vocabulary: sorted hashes of pieces with their ids and log-weights; ids of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = [b""] * sp.get_piece_size()
        self.byte = np.zeros(256, dtype=np.int32)
        words, ids = [], []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                words.append(piece)
                ids.append(i)
                self.text[i] = piece.replace(META, " ").encode()
        self.sizes = np.array([len(t) for t in self.text])
        self.starts, self.body = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.text), dtype=np.uint8)
        rank = np.argsort(np.argsort([-sp.get_score(i) for i in ids], kind="stable"))
        weight = -POWER * np.log1p(rank)
        weight -= np.log(np.exp(weight).sum())
        self.longest = max(map(len, words))
        self.byte_weight = float(weight.min()) - BYTE_COST
        codes = np.array([ord(c) for w in words for c in w], dtype=np.uint64)
        ends = np.cumsum([len(w) for w in words])
        h = spans(codes, ends - [len(w) for w in words], ends)
        o = np.argsort(h)
        self.hashes, self.ids, self.weights = h[o], np.array(ids, dtype=np.int32)[o], weight[o]
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(h & _U((1 << 20) - 1)).astype(np.int64)] = True
        # Hashes of all beginnings of pieces: a position is followed no further than one of them may go on.
        sizes = np.array([len(w) for w in words])
        self.begins = np.zeros(1 << 22, dtype=bool)
        for m in range(1, self.longest + 1):
            a = (ends - sizes)[sizes >= m]
            self.begins[(spans(codes, a, a + m) & _U((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes in the vocabulary, and which of them are pieces."""
        maybe = np.flatnonzero(self.filter[(h & _U((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        return at[hit], maybe[hit]

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all pieces in a row, and where each piece begins (and the last one ends) in them."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.body[at].tobytes(), ends


def spans(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    up, down = _powers(len(codes))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes + _G) * up[: len(codes)], out=total[1:])
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class Lattices:
    """Lattices of distinct parts with their forward sums; nodes are the characters' edges, numbered through."""

    def __init__(self, model: Pieces, parts: list[str]):
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # Node numbers: a part of m characters has m + 1 nodes.
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        char_at = np.cumsum(sizes) - sizes
        node_of_char = np.arange(len(codes)) + np.repeat(np.arange(len(parts)), sizes)
        left = np.repeat(char_at + sizes, sizes) - np.arange(len(codes))
        inner = np.arange(len(codes)) - np.repeat(char_at, sizes)
        # The meta symbol of the text itself has no piece.
        own = codes == ord(META)
        written = np.where(codes == 32, np.uint32(ord(META)), np.where(own, np.uint32(0x110000), codes)).astype(np.uint64)
        up, down = _powers(len(codes))
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix(written + _G) * up[: len(codes)], out=total[1:])
        src, dst, ids, weights = [], [], [], []
        a = np.arange(len(codes))
        for m in range(1, min(model.longest, int(sizes.max(initial=0))) + 1):
            a = a[left[a] >= m]
            h = mix((total[a + m] - total[a]) * down[a] + _U(m))
            on = model.begins[(h & _U((1 << 22) - 1)).astype(np.int64)]
            a, h = a[on], h[on]
            if not len(a):
                break
            at, hit = model.find(h)
            src.append(node_of_char[a[hit]])
            dst.append(src[-1] + m)
            ids.append(model.ids[at])
            weights.append(model.weights[at])
        # Every character's bytes: id -1 - character number.
        utf8 = np.select([codes < 0x80, codes < 0x800, codes < 0x10000], [1, 2, 3], 4)
        src.append(node_of_char)
        dst.append(node_of_char + 1)
        ids.append(-1 - np.arange(len(codes)))
        weights.append(model.byte_weight * utf8)
        self.codes, self.utf8 = codes, utf8
        # Edges by their end's distance from the part's start, then by end: ends are ranked once, and each group of
        # edges, in which an end occurs once, takes the next free place of its ends.
        nodes = int(self.last[-1]) + 1 if len(parts) else 0
        depth = np.zeros(nodes, dtype=np.int64)
        depth[node_of_char + 1] = inner + 1
        count = np.zeros(nodes, dtype=np.int64)
        for d in dst:
            count[d] += 1
        by_depth = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        by_depth = by_depth[count[by_depth] > 0]
        count = count[by_depth]
        new = np.cumsum(count) - count
        free = np.zeros(nodes, dtype=np.int64)
        free[by_depth] = new
        edges = int(count.sum())
        self.src, self.ids, weight = np.empty(edges, dtype=np.int64), np.empty(edges, dtype=np.int64), np.empty(edges)
        for x, d, i, w in zip(src, dst, ids, weights, strict=True):
            at = free[d]
            self.src[at], self.ids[at], weight[at] = x, i, w
            free[d] = at + 1
        weights, forward, share = weight, np.zeros(nodes), np.empty(edges)
        levels = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
        for lo, hi in zip(levels, levels[1:], strict=False):
            a, b = int(new[lo]), int(new[hi]) if hi < len(new) else edges
            value = forward[self.src[a:b]] + weights[a:b]
            heads = new[lo:hi] - a
            top = np.maximum.reduceat(value, heads)
            value = np.exp(value - np.repeat(top, count[lo:hi]))
            sums = np.add.reduceat(value, heads)
            forward[by_depth[lo:hi]] = top + np.log(sums)
            share[a:b] = value / np.repeat(sums, count[lo:hi])
        # Cumulative shares of each end's edges.
        self.rank = np.full(nodes, -1, dtype=np.int64)
        self.rank[by_depth] = np.arange(len(new))
        run = np.cumsum(share)
        run -= np.repeat(np.concatenate([[0.0], run])[new], count)
        self.draw, self.lo, self.hi, self.forward = run, new, new + count - 1, forward

    def sample(self, part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn for occurrences of parts, in text order, and how many each occurrence has."""
        node, who, step = self.last[part].copy(), np.arange(len(part)), 0
        start = self.first[part]
        edges, owners = [], []
        while len(who):
            u = (mix(key[who] + _U((step + 1) * int(_G) % (1 << 64))) >> _U(11)).astype(np.float64) * 2.0**-53
            r = self.rank[node[who]]
            e, top = self.lo[r], self.hi[r]
            more = np.flatnonzero((self.draw[e] <= u) & (e < top))
            while len(more):
                e[more] += 1
                more = more[(self.draw[e[more]] <= u[more]) & (e[more] < top[more])]
            edges.append(e)
            owners.append(who)
            node[who] = self.src[e]
            who = who[node[who] > start[who]]
            step += 1
        n = np.bincount(np.concatenate(owners), minlength=len(part)) if owners else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        for k, (e, w) in enumerate(zip(edges, owners, strict=True)):
            out[ends[w] - 1 - k] = e
        return out, n

    def expand(self, model: Pieces, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge has: a character's bytes are several."""
        ids = self.ids[edges]
        n = np.ones(len(ids), dtype=np.int64)
        raw = np.flatnonzero(ids < 0)
        if not len(raw):
            return ids, n
        chars = -1 - ids[raw]
        n[raw] = self.utf8[chars]
        out = np.repeat(ids, n)
        at = (np.cumsum(n) - n)[raw]
        for p, c in zip(at.tolist(), self.codes[chars].tolist(), strict=True):
            b = chr(c).encode("utf-8", "surrogatepass")
            out[p : p + len(b)] = model.byte[list(b)]
        return out, n


def sample_ids(model: Pieces, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
    """Piece ids of each text, drawn for its row key."""
    some = [i for i, t in enumerate(texts) if t]
    out = [np.zeros(0, dtype=np.int32)] * len(texts)
    if not some:
        return out
    # A part is a run of spaces and what follows up to the next run.
    split = pc.split_pattern(pa.array([texts[i] for i in some], type=pa.large_string()), " ")
    words = split.flatten().dictionary_encode()
    code, bounds = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), split.offsets.to_numpy() - split.offsets.to_numpy()[0]
    # Words after the first carry the space before them; empty words leave theirs to the word after them, if there is one.
    distinct = words.dictionary.to_pylist()
    is_first, is_last = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
    is_first[bounds[:-1]] = is_last[bounds[1:] - 1] = True
    empty = np.array([not w for w in distinct], dtype=bool)
    held = np.flatnonzero(is_first | is_last | ~empty[code])
    spaces = np.where(is_first[held], 0, np.diff(held, prepend=-1))
    part = code[held]
    odd = np.flatnonzero(spaces != 1)
    plain, where = np.unique(spaces[odd] * len(distinct) + part[odd], return_inverse=True)
    parts = [" " + w for w in distinct] + [" " * (p // len(distinct)) + distinct[p % len(distinct)] for p in plain.tolist()]
    part[odd] = len(distinct) + where
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    number = (np.arange(len(code)) - np.repeat(bounds[:-1], np.diff(bounds)))[held]
    whose = np.repeat(np.arange(len(some)), np.diff(bounds))[held]
    key = mix(mix(keys[some] + _U(seed * int(_G) % (1 << 64)))[whose] + number.astype(np.uint64))
    real = lengths[part] > 0
    lattices = Lattices(model, [p or "x" for p in parts])
    edges, n = lattices.sample(part[real], key[real])
    ids, each = lattices.expand(model, edges)
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n)])]
    text_of = whose[real]
    cuts = ends[np.searchsorted(text_of, np.arange(len(some) + 1))]
    ids = ids.astype(np.int32)
    for k, i in enumerate(some):
        out[i] = ids[cuts[k] : cuts[k + 1]]
    return out


def sample_segmentations(docs: DataFrame, model: str, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``pieces`` (array of ids); a column of this name is replaced.

    Null texts give null, empty texts an empty array. Rows with the same key and text get the same pieces; null keys
    count as one key. ``model`` is the path of a SentencePiece file with byte pieces.
    """
    bounded_batches(session_of(docs))
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "pieces"])
    names = docs.columns
    where, which = names.index(text), names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for b in batches:
            texts, keys = b.column(where).to_pylist(), np.array([-(1 << 62) if k is None else int(k) for k in b.column(which).to_pylist()], dtype=np.int64).view(np.uint64)
            got, at = [], 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                got += sample_ids(vocabulary, [t or "" for t in texts[at:to]], keys[at:to], seed)
                at = to
            sizes = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            empty = np.array([t is None for t in texts])
            column = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int32), *got])), mask=pa.array(empty))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*names, "pieces"])

    return docs.transform(map_batches, run, StructType(docs.schema.fields[:]).add("pieces", ArrayType(IntegerType())))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and its offsets into them."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def decode_segmentations(rows: DataFrame, model: str, column: str = "pieces") -> DataFrame:
    """``rows`` with ``decoded``, the text of the pieces; null for null. Pieces that make no UTF-8 are replaced."""
    bounded_batches(session_of(rows))
    rows = rows.drop(*[c for c in rows.columns if c.lower() == "decoded"])
    names, where = rows.columns, rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for b in batches:
            ids, bounds = _lists(b.column(where))
            ids = ids[bounds[0] : bounds[-1]]
            body, ends = vocabulary.decode_all(ids)
            ends = ends[bounds - bounds[0]]
            texts = [body[x:y].decode("utf-8", "replace") if p else None for p, x, y in zip(b.column(where).is_valid().to_pylist(), ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, type=pa.string())], names=[*names, "decoded"])

    return rows.transform(map_batches, run, StructType(rows.schema.fields[:]).add("decoded", "string"))


def with_ids_crc32(rows: DataFrame, column: str = "pieces") -> DataFrame:
    """``rows`` with ``ids_crc32``: the unsigned crc32 of the ids as little-endian unsigned 32-bit numbers (null: of none)."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() == "ids_crc32"])
    names, where = rows.columns, rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bounds = _lists(b.column(where))
            ids = np.ascontiguousarray(ids, dtype="<u4")
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crc, type=pa.int64())], names=[*names, "ids_crc32"])

    return rows.transform(map_batches, run, StructType(rows.schema.fields[:]).add("ids_crc32", "long"))
