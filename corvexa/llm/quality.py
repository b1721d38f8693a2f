"""Quality scores by Bradley-Terry ranking.

A preference pair is a document labelled 1 and one labelled 0; a linear score is fitted by logistic loss on the
feature differences of pairs (Newton steps with a small ridge). Features are figures of the whole text (lengths, kinds
of characters, repeats), their sizes and squares, and the shares of its distinct words in SLOTS hash slots, whose
weights are learned from the words alone. Scores are then placed so that the quantile of the
training scores at the share of label 0 becomes 0.5: a threshold by score quantile.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .common import bounded_batches, hash_bound, map_batches, session_of

#: Labelled documents used at most, and preference pairs drawn from them.
LABELLED, PAIRS = 6000, 30_000
RIDGE, WORD_RIDGE, STEPS = 1e-3, 2e-2, 25
#: Figures of a text, and hash slots of its words.
FIGURES, SLOTS = 14, 128
N_RAW = FIGURES + SLOTS
_KIND = np.zeros(256, dtype=np.int64)
for _a, _b, _k in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (128, 255, 4)):
    _KIND[_a : _b + 1] = _k
for _c in b" \t\n\r\v\f":
    _KIND[_c] = 5
for _c in b".,;:'\"?-()":
    _KIND[_c] = 6


def features(text: str | None) -> np.ndarray:
    """Raw features of the whole text; null and empty texts have those of no words."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = len(words), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[4])
    share = counts[counts > 0] / m
    seen = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    figures = np.array(
        [
            math.log1p(n), len(raw) / max(1, n), kinds[1] / letters, letters / m, kinds[3] / m, kinds[0] / m, kinds[6] / m, kinds[5] / m,
            math.log1p(len(seen)) / math.log(2 + n), max(seen.values(), default=0) / max(1, n), repeats / max(1, n),
            math.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), -float(share @ np.log2(share)) if raw else 0.0,
        ]
    )
    slots = np.bincount(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % SLOTS for w in seen), dtype=np.int64, count=len(seen)), minlength=SLOTS)
    return np.concatenate([figures, slots / max(1, len(seen))])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def expand(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.scale, -8, 8)
        f = z[:, :FIGURES]
        return np.hstack([f, np.abs(f), np.minimum(f * f, 16), z[:, FIGURES:]])

    def score(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(raw), 0.5)
        s = (self.expand(raw) @ self.weights - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def newton(pairs: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w.x)) over the pairs plus the sum of ridge w^2 / 2."""
    w = np.zeros(pairs.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(pairs @ w, -30, 30)))
        step = np.linalg.solve((pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + np.diag(ridge), pairs.T @ p / len(pairs) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(raw: np.ndarray, labels: np.ndarray, seed: int = 7) -> QualityModel:
    """Bradley-Terry fit; with one label only, every score is 0.5."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(N_RAW), np.ones(N_RAW), np.zeros(0), 0.0, 1.0)
    # Slots that hardly vary in the sample don't get a large scale.
    floor = np.concatenate([np.full(FIGURES, 1e-6), np.full(SLOTS, 1e-3)])
    model = QualityModel(raw.mean(0), raw.std(0) + floor, np.zeros(0), 0.0, 1.0)
    x = model.expand(raw)
    rng = np.random.default_rng(seed)
    ridge = np.concatenate([np.full(3 * FIGURES, RIDGE), np.full(SLOTS, WORD_RIDGE)])
    model.weights = newton(x[rng.choice(good, PAIRS)] - x[rng.choice(bad, PAIRS)], ridge)
    s = x @ model.weights
    model.threshold = float(np.quantile(s, len(bad) / len(labels)))
    # The spread of the lower half of label-1 scores makes the logistic scale.
    model.spread = float(max(1e-3, np.median(s[good]) - model.threshold) / 3)
    return model


def _features(docs: DataFrame, text: str, *kept: Column) -> DataFrame:
    rows = docs.select(*kept, F.col(text).cast("string").alias("__t"))
    schema = StructType(rows.drop("__t").schema.fields[:]).add("__f", ArrayType(DoubleType()))
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t) for t in b.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f, type=pa.list_(pa.float64()))], names=columns)

    return rows.transform(map_batches, run, schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> QualityModel:
    """Fit on rows of ``labels`` (key, label 0 or 1) that meet ``docs``; at most about LABELLED, those whose key
    hashes least. The bound holds for training only. Null keys and labels are left out; repeated labels count once."""
    spark = session_of(docs)
    bounded_batches(spark)
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("__k"), F.col(label).cast("int").alias("__y")).distinct()
    n = rows.count()
    # Both labels are drawn alike, so the quantile of label 0 is that of the labels.
    if n > LABELLED:
        rows = rows.where(F.xxhash64(F.col("__k").cast("string")) <= hash_bound(LABELLED / n))
    texts = docs.select(F.col(key).cast("long").alias("__k"), F.col(text).alias("__t0"))
    # Bounded by LABELLED rows of two numbers.
    joined = texts.join(F.broadcast(rows), "__k")
    got = sorted(((r["__k"], r["__y"], r["__f"]) for r in _features(joined, "__t0", F.col("__k"), F.col("__y")).toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    return fit(np.array([r[2] for r in got]).reshape(-1, N_RAW), np.array([r[1] for r in got]))


def predict(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); columns of these names are replaced."""
    bounded_batches(session_of(docs))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"score", "predicted"}])
    where, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array([features(t) for t in b.column(where).to_pylist()]).reshape(-1, N_RAW))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.transform(map_batches, run, StructType(docs.schema.fields[:]).add("score", DoubleType()).add("predicted", IntegerType()))
