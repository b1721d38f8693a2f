"""Hierarchical multi-length packing of token sequences.

Every partition is one stream, so nothing is shuffled and no task holds more than a block of documents. Whole
windows of a long document become sequences of their own; what is left of it, and each shorter document, is routed
to the smallest context tier that holds it. Then each tier is packed into windows of its own length, the longest tier
first: its longest piece opens a window, whose gap is filled best fit first from this tier and the shorter ones, and
where nothing fits a shorter piece is cut to close the gap. What a partition's tiers have left at its end is cut into
sequences of power-of-two lengths, so nothing is padded. The windows of a tier are dealt to step groups of equal
numbers of tokens, each window, the costliest first, to the group of the least attention cost (sum of squared piece
lengths) that has room.

Null texts count as empty and hold the end token alone; null ids are carried along; repeated rows are separate
documents. A retried task reads the same split and so makes the same sequences.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, map_batches, session_of

WINDOW, TIERS = 2048, (256, 512, 1024, 2048)
#: Tokens of a block, and of a step group.
BLOCK, STEP = 1 << 19, 1 << 15
#: Characters of texts encoded at one go.
CHARS = 4 << 20

_FIELDS = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("tier", "int"), ("step_group", "long"), ("ids", "array<int>")]


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) of one partition into sequences."""

    def __init__(self, partition: int, window: int = WINDOW, tiers: tuple[int, ...] = TIERS):
        self.window, self.tiers, self.next = window, tiers, partition << 36
        self.steps = partition << 36
        #: Of each tier the pieces as (length, arrival), sorted, and their tokens; self.pieces: what they are.
        self.pool: dict[int, list[tuple[int, int]]] = {t: [] for t in tiers}
        self.tokens = dict.fromkeys(tiers, 0)
        self.pieces: dict[int, tuple] = {}
        self.arrived = 0
        #: Of each window length the sequences made.
        self.made: dict[int, list[list[tuple]]] = {}

    @property
    def held(self) -> int:
        return sum(self.tokens.values())

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.window:
            self.made.setdefault(self.window, []).append([(doc_id, start, ids[start : start + self.window], n)])
            start += self.window
        if start < n:
            self.put((doc_id, start, ids[start:], n))

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        tier = self.tiers[bisect_left(self.tiers, n)]
        self.pieces[self.arrived] = piece
        insort(self.pool[tier], (n, self.arrived))
        self.tokens[tier] += n
        self.arrived += 1

    def take(self, tier: int, at: int) -> tuple:
        n, k = self.pool[tier].pop(at)
        self.tokens[tier] -= n
        return self.pieces.pop(k)

    def fitting(self, gap: int, tiers: tuple[int, ...]) -> tuple | None:
        """The longest piece that fits the gap, from the highest tier that has one."""
        for tier in reversed(tiers):
            if tier // 2 < gap or tier == self.tiers[0]:
                at = bisect_right(self.pool[tier], (gap, self.arrived)) - 1
                if at >= 0:
                    return self.take(tier, at)
        return None

    def cut(self, size: int, tiers: tuple[int, ...]) -> tuple:
        """The first ``size`` tokens of the shortest piece that is longer."""
        tier = next(t for t in tiers if self.pool[t] and self.pool[t][-1][0] > size)
        doc_id, start, ids, n = self.take(tier, bisect_right(self.pool[tier], (size, self.arrived)))
        self.put((doc_id, start + size, ids[size:], n))
        return doc_id, start, ids[:size], n

    def fill(self, size: int, tiers: tuple[int, ...]) -> None:
        """One window, opened by the longest piece that it holds; the tiers have as many tokens at least."""
        sequence, gap = [], size
        while gap:
            piece = self.fitting(gap, tiers) or self.cut(gap, tiers)
            sequence.append(piece)
            gap -= len(piece[2])
        self.made.setdefault(size, []).append(sequence)

    def pack(self, last: bool = False) -> list[tuple]:
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, upto = self.tiers[k], self.tiers[: k + 1]
            while self.pool[tier] and sum(self.tokens[t] for t in upto) >= tier:
                self.fill(tier, upto)
        while last and (held := self.held):
            self.fill(1 << (held.bit_length() - 1), self.tiers)
        return self.flush()

    def groups(self, sequences: list[list[tuple]], size: int) -> list[int]:
        """A step group for each window: equal numbers of windows, costs as even as the greedy rule makes them."""
        cost = [sum(len(p[2]) ** 2 for p in s) for s in sequences]
        n = max(1, len(cost) * size // STEP)
        room = [len(cost) // n + (g < len(cost) % n) for g in range(n)]
        heap, out = [(0, g) for g in range(n)], [0] * len(cost)
        for s in sorted(range(len(cost)), key=lambda s: (-cost[s], s)):
            load, g = heapq.heappop(heap)
            out[s] = g
            room[g] -= 1
            if room[g]:
                heapq.heappush(heap, (load + cost[s], g))
        return out

    def flush(self) -> list[tuple]:
        """Rows of the sequences made."""
        rows = []
        for size, sequences in sorted(self.made.items(), reverse=True):
            group = self.groups(sequences, size)
            for g, sequence in zip(group, sequences, strict=True):
                offset = 0
                for doc_id, start, ids, n in sequence:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids), n, self.next, offset, size, self.steps + g, ids))
                    offset += len(ids)
                self.next += 1
            self.steps += max(group) + 1
        self.made = {}
        return rows


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", key: str = "doc_id", window: int = WINDOW, tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, its tier and step group, its ids.

    ``tokenizer`` is the path of a byte-level BPE file. Sequences have the length of a tier, or another power of two
    where a partition ends. The columns are this operator's own: others of ``docs`` aren't carried.
    """
    bounded_batches(session_of(docs))
    fields = _FIELDS if with_ids else _FIELDS[:-1]
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns[:9], fields, strict=False)]
        if with_ids:
            flat = np.concatenate(columns[9]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[2])]), type=pa.int32()), pa.array(flat)))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId(), window, tiers)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                for k, ids in zip(keys[at:to], enc.encode([t or "" for t in texts[at:to]]), strict=True):
                    packer.add(k, np.concatenate([ids, end]))
                at = to
                if packer.held >= BLOCK and (rows := packer.pack()):
                    yield batch(rows)
        if rows := packer.pack(last=True):
            yield batch(rows)

    from pyspark.sql import functions as F

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).transform(map_batches, run, ", ".join(f"{n} {k}" for n, k in fields))
