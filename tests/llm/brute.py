"""Plain versions of the training-data operators, for small tables."""

import hashlib
import re

import numpy as np


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(docs: dict, percent: int = 85) -> dict:
    """id -> (n_shingles, component) by all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(docs: list[tuple], length: int = 100) -> dict:
    """id -> (n_bytes, n_removed, n_spans, sha256, kept bytes); docs in order of their ids."""
    seen, out = set(), {}
    for i, t in docs:
        raw = (t or "").encode()
        mark = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                mark[k : k + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~mark])
        spans = int((np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])) == 1).sum())
        out[i] = (len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out
