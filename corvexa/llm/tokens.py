"""Byte-level BPE ids of whole texts, equal to those of the ``tokenizers`` file, through a cache of words.

A space between two other characters always begins a new pre-token, so a text may be cut there and its parts
encoded apart. Most parts are frequent words: their ids come from a bounded cache.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's cache, at most.
CACHE = 200_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_BLANKS = [chr(i) for i in range(0x3001) if chr(i).isspace() and i != 32]
_SPECIAL = re.compile(r"<\|[a-z]+\|>")
_NONE = np.zeros(0, dtype="<u4")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.fast = None
        if os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
            self.lengths = np.zeros(max(merges.values()) + 1, dtype=np.int64)
            self.lengths[list(merges.values())] = [len(b) for b in merges]

    def _plain(self, text: str) -> bool:
        """Every space stands between two characters that are no white space, so all spaces are cuts."""
        return not (text[0] == " " or text[-1] == " " or "  " in text or "\0" in text or any(b in text and (b + " " in text or " " + b in text) for b in _BLANKS))

    def one(self, s: str) -> bytes:
        return np.array(self.slow.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each whole text; hand over a few MB at a time."""
        plain = [i for i, t in enumerate(texts) if self.fast and t and not ("<|" in t and _SPECIAL.search(t)) and self._plain(t)]
        out = [None if self.fast and t else _NONE for t in texts]
        if not self.fast or len(plain) < len(texts):
            skip = set(plain)
            for i, t in enumerate(texts):
                if t and i not in skip:
                    out[i] = self.by_parts(t)
        if not plain:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in plain], type=pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        uniq, codes = [" " + w for w in words.dictionary.to_pylist()], words.indices.to_numpy(zero_copy_only=False).copy()
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        # The first part of a text has no leading space: it gets an entry of its own.
        firsts = bounds[:-1]
        first_words = [texts[i].split(" ", 1)[0] for i in plain]
        codes[firsts] = len(uniq) + np.arange(len(plain))
        ids = self.words(uniq) + [self.part(w) for w in first_words]
        lengths = (np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4).astype(np.int32)
        flat, starts = np.frombuffer(b"".join(ids), dtype="<u4"), (np.cumsum(lengths) - lengths).astype(np.int32)
        each = lengths[codes]
        ends = np.cumsum(each, dtype=np.int32)
        at = np.repeat(starts[codes] - (ends - each), each)
        at += np.arange(len(at), dtype=np.int32)
        flat = flat[at]
        cuts = np.concatenate([[0], ends])[bounds]
        for k, i in enumerate(plain):
            out[i] = flat[cuts[k] : cuts[k + 1]]
        return out

    def part(self, s: str) -> bytes:
        if (v := self.cache.get(s)) is None:
            v = np.array(self.fast.encode_ordinary(s), dtype="<u4").tobytes()
            if len(s) <= 32 and len(self.cache) < CACHE:
                self.cache[s] = v
        return v

    def by_parts(self, t: str) -> np.ndarray:
        """Of any text: the library's own encoding of its parts."""
        return np.frombuffer(b"".join(self.one(p) for p in _CUT.split(t)), dtype="<u4")

    def words(self, uniq: list[str]) -> list[bytes]:
        """Ids of distinct parts, each with its leading space; those not in the cache are encoded at one go."""
        get = self.cache.get
        found = [get(w) for w in uniq]
        if rest := [w for w, v in zip(uniq, found, strict=True) if v is None]:
            ids = np.asarray(self.fast.encode_to_numpy("".join(rest), disallowed_special=()), dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in rest])) + 1
            blob, a, new = ids.tobytes(), 0, []
            for b in (ends * 4).tolist():
                new.append(blob[a:b])
                a = b
            if (room := CACHE - len(self.cache)) > 0:
                self.cache.update((p, v) for p, v in zip(rest[:room], new[:room], strict=True) if len(p) <= 32)
            new.reverse()
            found = [new.pop() if v is None else v for v in found]
        return found


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
