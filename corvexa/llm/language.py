"""Language identification by blended-spectrum string kernels.

The kernel of two texts counts the character n-grams (n = 1 to 4, over bytes of the lower-cased letters) present in
both, over the geometric mean of their numbers of grams. Landmarks are a bounded sample of the labelled texts; the
Nystrom map K(x, L) K(L, L)^(-1/2) gives each text a vector, and one-versus-rest kernel ridge regression is solved
on a bounded sample of labelled rows. At scoring the map and the ridge weights are folded into one matrix of gram
weights, so that a batch is one sparse presence matrix times a dense matrix; the scores are those of the kernel form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, hash_bound, map_batches, session_of

NGRAMS = (1, 2, 3, 4)
#: Labelled rows used at most, of each language and in all; landmarks of each language.
PER_LANG, IN_ALL, LANDMARKS = 250, 4000, 60
RIDGE, SHARPNESS = 1e-2, 6.0
#: Cells of a presence matrix.
CELLS = 1 << 20
_GAPS = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-gram codes of the whole text; n is part of the code. Empty if there is no letter."""
    body = _GAPS.sub(" ", text.lower()).strip()
    if not body:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(f" {body} ".encode(), dtype=np.uint8).astype(np.uint32)
    found, code = [], b
    for n in NGRAMS:
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :] if len(code) > 1 else code[:0]
        found.append(_distinct(code).astype(np.uint64) | np.uint64(n << 32))
    return np.concatenate(found)


def _distinct(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)
    return code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code


@dataclass
class LanguageModel:
    langs: list[str]
    vocabulary: np.ndarray  # sorted gram codes
    weights: np.ndarray  # a row for each gram, a column for each language
    bias: np.ndarray

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each non-empty gram set and a column for each language: presence matrices times the weights."""
        out = np.zeros((len(sets), len(self.langs)))
        size = max(1, CELLS // len(self.vocabulary))
        for first in range(0, len(sets), size):
            part = sets[first : first + size]
            flat, sizes = np.concatenate(part), np.array([len(s) for s in part])
            at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == flat
            present = np.zeros((len(part), len(self.vocabulary)), dtype=np.float32)
            present[np.repeat(np.arange(len(part)), sizes)[known], at[known]] = 1
            out[first : first + size] = present @ self.weights.astype(np.float32) / np.sqrt(sizes)[:, None] + self.bias
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text; ``und`` and 0.0 if it is null or has no letter."""
        sets = [grams(t) if t else np.zeros(0, dtype=np.uint64) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, s in enumerate(sets) if len(s)]
        if not some or not self.langs:
            return names, scores
        margin = self.margins([sets[i] for i in some])
        z = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        z /= z.sum(axis=1, keepdims=True)
        for i, k, p in zip(some, z.argmax(axis=1).tolist(), z.max(axis=1).tolist(), strict=True):
            names[i], scores[i] = self.langs[k], p
        return names, scores


def fit(sets: list[np.ndarray], labels: list[str]) -> LanguageModel:
    """Nystrom kernel ridge regression on gram sets."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros(1, dtype=np.uint64), np.zeros((1, 0)), np.zeros(0))
    picked: list[int] = []
    for lang in langs:
        picked += [i for i, y in enumerate(labels) if y == lang][:LANDMARKS]
    vocabulary = np.unique(np.concatenate([sets[i] for i in picked]))
    present = np.zeros((len(picked), len(vocabulary)), dtype=np.float32)
    for k, i in enumerate(picked):
        present[k, np.searchsorted(vocabulary, sets[i])] = 1.0
    present /= np.sqrt([len(sets[i]) for i in picked])[:, None]
    base = present.astype(np.float64) @ present.T.astype(np.float64)
    values, vectors = np.linalg.eigh(base)
    keep = values > 1e-8 * values[-1]
    half = vectors[:, keep] / np.sqrt(values[keep])
    cross = np.zeros((len(sets), len(picked)))
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
        cross[i] = present[:, at[vocabulary[at] == s]].sum(axis=1) / np.sqrt(len(s))
    phi = cross @ half
    y = np.where(np.array(labels)[:, None] == np.array(langs), 1.0, -1.0)
    # Rare languages weigh as much as frequent ones.
    w = 1.0 / np.array([labels.count(v) for v in labels])
    w *= len(w) / w.sum()
    mean, bias = (w[:, None] * phi).sum(0) / w.sum(), (w[:, None] * y).sum(0) / w.sum()
    centred = phi - mean
    solved = np.linalg.solve((centred * w[:, None]).T @ centred + RIDGE * len(sets) * np.eye(phi.shape[1]), (centred * w[:, None]).T @ (y - bias))
    return LanguageModel(langs, vocabulary, present.T.astype(np.float64) @ (half @ solved), bias - mean @ solved)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit on labelled rows of ``docs``: of each language the PER_LANG rows whose id hashes least, IN_ALL in all.

    The bound holds for training only. Executors send gram sets, not texts.
    """
    bounded_batches(session_of(docs))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    # The IN_ALL / 2 most frequent languages are learned.
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(IN_ALL // 2).collect()}
    if not counts:
        return fit([], [])
    each = min(PER_LANG, IN_ALL // len(counts))
    # A bound on the hash that about 1.5 * each rows of the language meet; the surplus is cut after sorting.
    bound = {v: min(1.0, (1.5 * each + 20) / n) for v, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for v, p in bound.items() for x in (v, hash_bound(p))])
    sample = rows.where(F.col("h") <= F.try_element_at(limit, F.col("l"))).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [grams(t).view(np.int64).tolist() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("l"), pa.array(sets, type=pa.list_(pa.int64()))], names=["k", "l", "g"])

    got = sorted(((r["l"], r["k"] is None, r["k"] or 0, r["g"]) for r in sample.transform(map_batches, run, "k long, l string, g array<long>").toLocalIterator() if r["g"]), key=lambda r: r[:3])
    chosen, used = [], dict.fromkeys(counts, 0)
    for v, _, _, g in got:
        if used[v] < each:
            used[v] += 1
            chosen.append((v, g))
    return fit([np.array(g, dtype=np.int64).view(np.uint64) for _, g in chosen], [v for v, _ in chosen])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    spark = session_of(docs)
    bounded_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"lang_pred", "score"}])
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    where, columns = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            for at in range(0, b.num_rows, 256):
                n, s = shared.value.score(b.column(where).slice(at, 256).to_pylist())
                names, scores = names + n, scores + s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double")
    return docs.transform(map_batches, run, schema)
