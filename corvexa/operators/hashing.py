"""Block hashes and codecs that Spark has no function for, vectorised over rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvexa.functions.arrow import with_columns

_U = np.uint32
#: Fixed values of BLAKE3: its initial words and the permutation of message words between rounds.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> _U(n)) | (x << _U(32 - n))


def _mix(v: np.ndarray, a, b, c, d, x: np.ndarray, y: np.ndarray) -> None:
    """Four quarter mixes at once: a to d are index lists."""
    v[a] += v[b] + x
    v[d] = _turn(v[d] ^ v[a], 16)
    v[c] += v[d]
    v[b] = _turn(v[b] ^ v[c], 12)
    v[a] += v[b] + y
    v[d] = _turn(v[d] ^ v[a], 8)
    v[c] += v[d]
    v[b] = _turn(v[b] ^ v[c], 7)


def compress(chain: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining words (8 x n) of n blocks: chain 8 x n, block 16 x n, the others n."""
    n = block.shape[1]
    v = np.empty((16, n), dtype=_U)
    v[:8] = chain
    v[8:12] = np.array(IV[:4], dtype=_U)[:, None]
    v[12], v[13] = (counter & np.uint64(0xFFFFFFFF)).astype(_U), (counter >> np.uint64(32)).astype(_U)
    v[14], v[15] = length, flags
    rows = np.arange(4)
    m = block
    for _ in range(7):
        _mix(v, rows, rows + 4, rows + 8, rows + 12, m[0:8:2], m[1:8:2])
        _mix(v, rows, (rows + 1) % 4 + 4, (rows + 2) % 4 + 8, (rows + 3) % 4 + 12, m[8:16:2], m[9:16:2])
        m = m[list(PERMUTATION)]
    return v[:8] ^ v[8:]


def _chunk_chains(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chaining words of the 1 KiB chunks of all values, and how many each value has; all chunks advance together."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // 1024))
    first = np.cumsum(counts) - counts
    body = np.zeros(int(counts.sum()) * 1024, dtype=np.uint8)
    for r, at in zip(raws, (first * 1024).tolist(), strict=True):
        body[at : at + len(r)] = np.frombuffer(r, dtype=np.uint8)
    n = int(counts.sum())
    words = body.view("<u4").reshape(n, 16, 16)
    size = np.full(n, 1024)
    size[first + counts - 1] = sizes - 1024 * (counts - 1)
    blocks = np.maximum(1, -(-size // 64))
    root = np.repeat(np.where(counts == 1, ROOT, 0), counts)
    counter = (np.arange(n) - np.repeat(first, counts)).astype(np.uint64)
    chain = np.repeat(np.array(IV, dtype=_U)[:, None], n, axis=1)
    for k in range(int(blocks.max())):
        live = np.flatnonzero(blocks > k)
        flags = (CHUNK_START * (k == 0) + (blocks[live] == k + 1) * (CHUNK_END + root[live])).astype(_U)
        chain[:, live] = compress(chain[:, live], words[live, k].T.copy(), counter[live], np.minimum(64, size[live] - 64 * k).astype(_U), flags)
    return chain, counts


def blake3(raws: list[bytes]) -> list[bytes]:
    """Digests of values: their chunks, then their trees, level by level, all values at once."""
    if not raws:
        return []
    chain, counts = _chunk_chains(raws)
    while counts.max() > 1:
        first, pairs, odd = np.cumsum(counts) - counts, counts // 2, counts % 2
        inside = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left = np.repeat(first, pairs) + 2 * inside
        flags = np.repeat(np.where(counts == 2, PARENT + ROOT, PARENT), pairs).astype(_U)
        n = len(left)
        new = compress(np.repeat(np.array(IV, dtype=_U)[:, None], n, axis=1), np.concatenate([chain[:, left], chain[:, left + 1]]), np.zeros(n, dtype=np.uint64), np.full(n, 64, dtype=_U), flags)
        kept = pairs + odd
        out, start = np.empty((8, int(kept.sum())), dtype=_U), np.cumsum(kept) - kept
        out[:, np.repeat(start, pairs) + inside] = new
        alone = odd == 1
        out[:, (start + pairs)[alone]] = chain[:, (first + counts - 1)[alone]]
        chain, counts = out, kept
    return [c.tobytes() for c in chain.T.astype("<u4")]


def with_blake3(df: DataFrame, raw: str, into: str = "blake3") -> DataFrame:
    """``df`` with the digest of a binary column as lowercase hex."""

    def digests(values: list) -> list[list]:
        found = iter(blake3([v for v in values if v is not None]))
        return [[None if v is None else next(found).hex() for v in values]]

    return with_columns(df, raw, f"{into} string", digests)


def lz4_decode(raw: bytes) -> bytes:
    """One LZ4 block: literal runs and back references."""
    out, p = bytearray(), 0
    while p < len(raw):
        token, p = raw[p], p + 1
        size = token >> 4
        while size >= 15 and (more := raw[p]) is not None:
            size, p = size + more, p + 1
            if more < 255:
                break
        out += raw[p : p + size]
        p += size
        if p >= len(raw):
            break
        back, p = raw[p] | raw[p + 1] << 8, p + 2
        size = (token & 15) + 4
        while size >= 19 and (more := raw[p]) is not None:
            size, p = size + more, p + 1
            if more < 255:
                break
        if not 0 < back <= len(out):
            raise ValueError("a reference before the start of the block")
        while size > 0:
            part = out[-back:][:size]
            out += part
            size -= len(part)
    return bytes(out)


def lz4_literals(raw: bytes) -> bytes:
    """A block of one literal run."""
    n = len(raw)
    if n < 15:
        return bytes([n << 4]) + raw
    rest = n - 15
    return bytes([15 << 4]) + b"\xff" * (rest // 255) + bytes([rest % 255]) + raw


def with_lz4(df: DataFrame, raw: str, into: str = "plain") -> DataFrame:
    """``df`` with decoded LZ4 blocks; null for a broken block."""

    def one(v):
        try:
            return None if v is None else lz4_decode(v)
        except (ValueError, IndexError):
            return None

    return with_columns(df, raw, f"{into} binary", lambda vs: [[one(v) for v in vs]])


def butterfly(a: Column, b: Column, twiddle: Column, prime: int) -> tuple[Column, Column]:
    """One butterfly of a number-theoretic transform, for primes below 2**31."""
    t = b * twiddle % prime
    return (a + t) % prime, F.pmod(a - t, F.lit(prime))
