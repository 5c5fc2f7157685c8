"""Linear scorer over hashed word and character n-grams.

A text's features are the shares of its words (lower-cased A-Z) and of its four-byte character
n-grams that fall into each of 2**15 buckets.  The score is thus a mean of weights over words plus
one over n-grams, and needs no sorting.  Training takes a bounded number of labelled texts and of their
features, in one task; three quarters fit the weights, the rest calibrates the probability (a logistic
curve over the scores).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.llm import words as W

HALF = 1 << 15
STEPS, RATE, DECAY = 150, 3.0, 1e-5
MOST = 12_000_000  # features that a fit takes: 72 MB
LEAST = 100        # texts that it takes however long they are
RUN = 1 << 19      # features that are worked on at a time


def _word_buckets(lowered: W.Words) -> np.ndarray:
    return (lowered.buckets() & np.uint64(HALF - 1)).astype(np.int64)


def _gram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all four-byte n-grams inside texts, and the texts' bounds among them."""
    if len(data) < 4:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    d = data.astype(np.uint32)
    grams = d[:-3] | (d[1:-2] << np.uint32(8)) | (d[2:-1] << np.uint32(16)) | (d[3:] << np.uint32(24))
    lengths = np.maximum(np.diff(bounds) - 3, 0)
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], lengths)
    return (grams[at] * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64) + HALF, first


@dataclass
class Model:
    weights: np.ndarray  # of 2 * HALF buckets
    bias: float
    slope: float         # calibration
    shift: float

    def probability(self, w: W.Words, lowered: W.Words) -> np.ndarray:
        words = W.per_text(self.weights[_word_buckets(lowered)], lowered.first)
        gram, first = _gram_buckets(w.data, w.bounds)
        grams = W.per_text(self.weights[gram], first)
        z = self.bias + words / np.maximum(lowered.counts(), 1) + grams / np.maximum(np.diff(first), 1)
        return _logistic(self.slope * z + self.shift)

    def to_bytes(self) -> bytes:
        return np.array([self.bias, self.slope, self.shift], np.float64).tobytes() + self.weights.astype(np.float32).tobytes()

    @classmethod
    def of_bytes(cls, data: bytes) -> Model:
        bias, slope, shift = np.frombuffer(data[:24], np.float64)
        return cls(np.frombuffer(data[24:], np.float32).astype(np.float64), float(bias), float(slope), float(shift))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Features:
    """Texts as rows of (bucket, share)."""

    first: np.ndarray   # bounds of the rows
    bucket: np.ndarray
    share: np.ndarray
    aside: np.ndarray   # texts that calibrate

    def runs(self) -> Iterator[tuple[slice, slice]]:
        """Rows, and their features, in runs of about `RUN` features."""
        at, n = 0, len(self.first) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + RUN, "right")) - 1)
            yield slice(at, to), slice(int(self.first[at]), int(self.first[to]))
            at = to

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The sum of weight * share of every row."""
        return np.concatenate([W.per_text(weights[self.bucket[f]] * self.share[f], self.first[r.start:r.stop + 1] - f.start)
                               for r, f in self.runs()] or [np.zeros(0)])

    def backward(self, error: np.ndarray) -> np.ndarray:
        """The sum of error * share of every bucket."""
        out = np.zeros(2 * HALF)
        for r, f in self.runs():
            counts = np.diff(self.first[r.start:r.stop + 1])
            out += np.bincount(self.bucket[f], np.repeat(error[r], counts) * self.share[f], 2 * HALF)
        return out


def features(texts: pa.Array) -> Features:
    lowered, w = W.split(texts, lower=True), W.split(texts)
    gram, first = _gram_buckets(w.data, w.bounds)
    owner = np.concatenate([lowered.text_of(), np.repeat(np.arange(len(texts)), np.diff(first))])
    bucket = np.concatenate([_word_buckets(lowered), gram])
    total = np.concatenate([lowered.counts(), np.diff(first)])
    key, count = np.unique(owner * (2 * HALF) + bucket, return_counts=True)
    owner, bucket = key // (2 * HALF), key % (2 * HALF)
    share = count / total[owner + len(texts) * (bucket >= HALF)]
    at = w.bounds.tolist()
    body = w.data.tobytes()
    aside = np.array([zlib.crc32(body[a:b]) % 4 == 3 for a, b in zip(at[:-1], at[1:])], bool)
    return Features(np.searchsorted(owner, np.arange(len(texts) + 1)), bucket.astype(np.uint16), share.astype(np.float32), aside)


def joined(parts: list[Features]) -> Features:
    sizes = W.sums(np.array([len(p.bucket) for p in parts], np.int64))
    return Features(
        np.concatenate([[0], *[p.first[1:] + s for p, s in zip(parts, sizes)]]).astype(np.int64),
        *[np.concatenate([getattr(p, k) for p in parts] or [np.zeros(0, t)]) for k, t in (("bucket", np.uint16), ("share", np.float32), ("aside", bool))])


def fit(texts: list[str | None], labels: np.ndarray, importance: np.ndarray) -> Model:
    return fit_features(joined([features(pa.array(texts[i:i + 64], pa.string())) for i in range(0, len(texts), 64)]), labels, importance)


def fit_features(x: Features, labels: np.ndarray, importance: np.ndarray) -> Model:
    """Weights by gradient steps with adaptive rates, then the calibration by Newton steps."""
    n = len(labels)
    if not n or labels.max() == labels.min():  # nothing to tell apart
        p = float(labels.mean()) if n else 1.0
        return Model(np.zeros(2 * HALF), 0.0, 1.0, float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    aside = x.aside.copy()
    if aside.all() or labels[aside].size < 20:
        aside[:] = False
    rate = np.where(aside, 0.0, importance)
    rate /= rate.sum()
    weights, bias = np.zeros(2 * HALF), 0.0
    mean, square = np.zeros(2 * HALF + 1), np.zeros(2 * HALF + 1)
    for step in range(1, STEPS + 1):
        error = (_logistic(bias + x.scores(weights)) - labels) * rate
        slope = np.append(x.backward(error) + DECAY * weights / n, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        move = RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-7)
        weights, bias = weights - move[:-1], bias - 0.05 * move[-1]
    z = bias + x.scores(weights)
    use = aside if aside.any() and labels[aside].max() > labels[aside].min() else ~aside
    z, y, m = z[use], labels[use], importance[use] / importance[use].mean()
    # targets a little inside 0 and 1, as few texts are at hand
    y = (y * y.sum() + 1 * y) / (y.sum() + 2) + (1 - y) / ((1 - y).sum() + 2)
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _logistic(a * z + b)
        v = m * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(m * (p - y) * z).sum() + 1e-3 * (a - 1), (m * (p - y)).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    return Model(weights, bias, float(max(a, 1e-3)), float(b))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features instead of texts."""
    for part in W.slices(batches, "text", size=W.SLICE_BYTES // 8):
        x = features(part.column("text"))
        yield pa.RecordBatch.from_arrays([
            part.column("doc"), part.column("label"), part.column("importance"), pa.array(x.aside),
            W.binaries(x.bucket, 2 * x.first), W.binaries(x.share, 4 * x.first),
        ], ["doc", "label", "importance", "aside", "bucket", "share"])


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.release()
    parts, labels, importance, n = [], [], [], 0
    for batch in batches:
        for row in batch.to_pylist():  # in the order of a hash of the id
            n += len(row["bucket"]) // 2
            if n > MOST and len(parts) >= LEAST:
                break
            bucket = np.frombuffer(row["bucket"], np.uint16)
            parts.append(Features(np.array([0, len(bucket)]), bucket, np.frombuffer(row["share"], np.float32), np.array([row["aside"]])))
            labels.append(row["label"])
            importance.append(row["importance"])
    model = fit_features(joined(parts), np.array(labels, np.float64), np.array(importance, np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])


def trained(sample: DataFrame) -> Model:
    """Fit on a bounded sample: doc, text, label (0 to 1), importance.  One small row comes back.

    Many tasks turn texts into features (at most 2 * HALF of a text, six bytes each); one task fits, on
    the texts in the order of a hash of their ids, up to `MOST` features.
    """
    rows = sample.select("doc", "text", F.col("label").cast("double").alias("label"), F.col("importance").cast("double").alias("importance"))
    packed = rows.mapInArrow(_packed, "doc long, label double, importance double, aside boolean, bucket binary, share binary")
    ordered = packed.withColumn("spot", F.xxhash64("doc", F.lit(3))).repartition(1).sortWithinPartitions("spot", "doc", "bucket")
    models = ordered.mapInArrow(_fit_all, "model binary").collect()
    return Model.of_bytes(models[0].model) if models else fit([], np.zeros(0), np.zeros(0))
