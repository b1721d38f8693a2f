"""Suffix arrays of byte shards by induced sorting, vectorised with numpy."""

from __future__ import annotations

import numpy as np

#: Names up to which a reduced string is taken as it is; more are written as two digits each.
NAMES = 4096
_U = np.uint64
_rng = np.random.default_rng(77)
_BASE = _U(int(_rng.integers(1 << 62)) * 2 + 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_VALUES = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash's base and of its inverse, modulo 2**64."""
    for k, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[k]) <= n:
            _powers[k] = np.concatenate([_powers[k], _powers[k] * (_powers[k][-1:] * base)])
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums of the first 0 to n terms of the hash polynomial."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    values = _VALUES[codes] if codes.dtype.itemsize <= 2 else mix(codes.astype(np.uint64) + _BASE)
    np.cumsum(values * up[: len(codes)], out=out[1:])
    return out


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), comparable wherever they lie."""
    _, down = powers(len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last one, the sentinel, is."""
    n = len(t)
    d = np.zeros(n, dtype=np.int8)
    d[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    d[-1] = 1
    at = np.where(d != 0, np.arange(n, dtype=np.int32), np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return d[at] > 0


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from the leftmost S-type ones in theirs: larger ones left to right, smaller ones back.

    A bucket (one first element) is handled at once: waves of entries, each of which puts its predecessors at the next
    free places of their buckets, as the sequential scan would.
    """
    counts = np.bincount(t, minlength=sigma)
    stops = np.cumsum(counts)
    starts = stops - counts
    out = np.empty(len(t), dtype=np.int32)
    order = np.argsort(t[lms], kind="stable")
    seeds, cuts = lms[order], np.searchsorted(t[lms][order], np.arange(sigma + 1)).tolist()

    def deal(p: np.ndarray, free: np.ndarray, step: int) -> None:
        """Entries of ``p``, in order, at the free places of their buckets, upwards or downwards."""
        if len(p) <= 8:
            for x in p.tolist():
                c = t[x]
                at = free[c]
                out[at if step > 0 else at - 1] = x
                free[c] = at + step
            return
        c = t[p]
        o = c.argsort(kind="stable")
        p, c = p[o], c[o]
        new = np.empty(len(p), dtype=bool)
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        edges = new.nonzero()[0]
        sizes = np.empty(len(edges), dtype=np.int64)
        sizes[:-1], sizes[-1] = edges[1:], len(p)
        sizes -= edges
        inner = np.arange(len(p)) - edges.repeat(sizes)
        out[free[c] + inner if step > 0 else free[c] - 1 - inner] = p
        free[c[edges]] += step * sizes

    heads = starts.copy()
    for c in range(sigma):
        done = int(starts[c])
        while done < (to := int(heads[c])):
            wave, done = out[done:to], to
            p = wave[wave > 0] - 1
            deal(p[~small[p]], heads, 1)
        if cuts[c] < cuts[c + 1]:
            p = seeds[cuts[c] : cuts[c + 1]]
            deal(p[p > 0] - 1, heads, 1)
    tails = stops.copy()
    out[0], tails[0] = len(t) - 1, 0
    for c in range(sigma - 1, -1, -1):
        done = int(stops[c])
        while done > (to := int(tails[c])):
            wave, done = out[to:done][::-1], to
            p = wave[wave > 0] - 1
            deal(p[small[p]], tails, -1)
        wave = out[int(starts[c]) : int(heads[c])][::-1]
        p = wave[wave > 0] - 1
        deal(p[small[p]], tails, -1)
    return out


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Order of the suffixes of t, whose elements are below sigma; the last one is the only 0."""
    small = classify(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    first = induce(t, small, lms, sigma)
    is_lms = np.zeros(len(t), dtype=bool)
    is_lms[lms] = True
    by_piece = first[is_lms[first]]
    # Name the substrings from one leftmost S-type position to the next.
    total = prefix_hash(t)
    ends = np.empty(len(t), dtype=np.int32)
    ends[lms] = np.minimum(np.append(lms[1:], len(t) - 1) + 1, len(t))
    h = span_hash(total, by_piece, ends[by_piece])
    names = np.empty(len(t), dtype=np.int32)
    names[by_piece] = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    reduced = names[lms]
    del first, is_lms, total, ends, h, names
    if (distinct := int(reduced.max(initial=0)) + 1) < len(lms):
        by_piece = lms[_sorted_names(reduced, distinct, len(t))]
    return induce(t, small, by_piece, sigma)


def _sorted_names(reduced: np.ndarray, distinct: int, n: int) -> np.ndarray:
    """Order of the suffixes of the reduced string, by recursion.

    A name that occurs once settles every comparison that meets it, so of a run of such names only the first is kept,
    as the end of what comes before it. Buckets are handled one by one, so many names are written as two digits each;
    the suffixes that begin with a first digit are in the order of those of the names. Where that doesn't shorten the
    string, the names are taken as they are.
    """
    once = np.bincount(reduced, minlength=distinct)[reduced] == 1
    kept = ~once
    kept[1:] |= ~once[:-1]
    kept[-1] = True
    places = np.flatnonzero(kept).astype(np.int32)
    names = reduced[places]
    used = np.zeros(distinct, dtype=np.int32)
    used[names] = 1
    names = (np.cumsum(used, dtype=np.int32) - 1)[names]
    order = places[_recursed(names, int(names.max()) + 1, n)]
    # Those left out have names of their own, so names and the order of the kept ones settle all.
    order = np.concatenate([order, np.flatnonzero(~kept).astype(np.int32)])
    return order[reduced[order].argsort(kind="stable")]


def _recursed(names: np.ndarray, distinct: int, n: int) -> np.ndarray:
    if distinct == len(names):
        return names.argsort()
    if distinct <= NAMES or 2 * len(names) > 0.9 * n:
        return suffix_array(names.astype(np.uint16 if distinct < 1 << 16 else np.uint32), distinct)
    base = int(np.ceil(np.sqrt(distinct)))
    digits = np.zeros(2 * len(names) - 1, dtype=np.uint16)
    digits[:-1:2], digits[1::2] = names[:-1] // base + 1, names[:-1] % base + 1
    order = suffix_array(digits, base + 2)
    return order[order % 2 == 0] // 2


def permuted_lcp(t: np.ndarray, sa: np.ndarray, cap: int, least: int = 0) -> np.ndarray:
    """Of each position, how much its suffix shares with the one before it in order, up to ``cap``.

    Lengths under ``least`` may be given as 0; that spares most positions the search.
    """
    total, n = prefix_hash(t), len(t)
    phi = np.empty(n, dtype=np.int32)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    i = np.flatnonzero(phi >= 0).astype(np.int32)
    if least:
        i = i[np.maximum(i, phi[i]) + least <= n]
        i = i[span_hash(total, i, i + least) == span_hash(total, phi[i], phi[i] + least)]
        i = i[_same(t, i, phi[i], least)]
    j, shared = phi[i], np.full(len(i), least, dtype=np.int32)
    step = 1 << (cap.bit_length() - 1)
    while step:
        a, b = i + shared, j + shared
        ok = (np.maximum(a, b) + step <= n) & (shared + step <= cap)
        k = np.flatnonzero(ok)
        k = k[span_hash(total, a[k], a[k] + step) == span_hash(total, b[k], b[k] + step)]
        shared[k] += step
        step >>= 1
    out = np.zeros(n, dtype=np.int32)
    out[i] = shared
    return out


def _same(t: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` elements from i are those from j, compared one by one. i ascends; where both go on by one place
    from the pair before, only the last element is new."""
    if not len(i):
        return np.zeros(0, dtype=bool)
    windows = np.lib.stride_tricks.sliding_window_view(t, size)

    def whole(at: np.ndarray) -> np.ndarray:
        parts = [(windows[i[p]] == windows[j[p]]).all(axis=1) for p in np.array_split(at, len(at) // 8192 + 1)]
        return np.concatenate(parts)

    goes_on = np.concatenate([[False], (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1)])
    out = t[i + size - 1] == t[j + size - 1]
    out[~goes_on] = whole(np.flatnonzero(~goes_on))
    return out if out.all() else whole(np.arange(len(i)))
