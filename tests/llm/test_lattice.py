"""Sampled segmentations against exact probabilities of the whole lattice."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corvexa.llm import lattice, queries


@pytest.mark.parametrize("text", ["a  b", "  a", "a    b", "a   "])
def test_runs_of_spaces_follow_the_lattice(text):
    """Shares of the segmentations of texts with runs of spaces against exact probabilities of all of them."""
    model = lattice.pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    weight = {int(i): float(w) for i, w in zip(model.ids, model.weights, strict=True)}
    whole_pieces = {model.text[i].decode(): i for i in weight}

    def ways(part):
        if not part:
            yield (), 0.0
        for n in range(1, len(part) + 1):
            i = whole_pieces.get(part[:n])
            firsts = [((i,), weight[i])] if i is not None else []
            if n == 1:
                firsts.append(((int(model.byte[ord(part[0])]),), model.byte_weight))
            for ids, w in firsts:
                for rest, more in ways(part[n:]):
                    yield ids + rest, w + more

    p = {(): 1.0}
    for part in re.findall(r"^[^ ]+| +[^ ]*", text):
        found = Counter()
        for ids, w in ways(part):
            found[ids] += math.exp(w)
        total = sum(found.values())
        p = {a + b: x * y / total for a, x in p.items() for b, y in found.items()}
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in lattice.sample_ids(model, [text] * n, np.arange(n, dtype=np.uint64), 3))
    assert set(got) <= set(p)
    for ids, share in p.items():
        assert abs(got[ids] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3, ids
