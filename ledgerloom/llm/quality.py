"""Quality classifier: a factorisation machine.

Features of a text are its different words, hashed into ``WORDS`` buckets and
weighted so that all words of a text weigh one together, and structure
statistics of the whole text (letter case, signs, line and word shape,
repetition, length), each one-hot in fixed intervals.  The score is
``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pair term is
computed in linear time as half of ``|sum v_i x_i|^2 - sum |v_i|^2 x_i^2``.

The machine is fitted on at most ``SAMPLE`` labelled rows, taken in hash order
of the id; every text is scored.

Defined cases: null and empty texts are scored by their statistics.  Null
labels and ids are never learnt from.  Without labels, or with one label
only, the score is the share of label 1 (a half without any).  Repeated rows
score alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, pieces_of, sample_ids, split_words, texts

SAMPLE = 12_000
WORDS = 1 << 14
FACTORS = 8
BINS = 12
EPOCHS = 12
_EDGES = np.linspace(0, 1, BINS + 1)[1:-1]

_KIND = np.zeros(256, dtype=np.int64)  # 0 other signs
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[[0x20, 0x09]] = 4
_KIND[[0x0A, 0x0D]] = 5
_KIND[[0x2C, 0x2E]] = 6
_KIND[0x80:] = 7


def statistics(text: bytes, words: list[bytes], different: int) -> np.ndarray:
    """Structure statistics, each between 0 and 1."""
    n, kinds = max(1, len(text)), np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)
    count = max(1, len(words))
    lines = text.split(b"\n")
    letters = max(1, kinds[1] + kinds[2] + kinds[7])
    return np.array([
        np.log1p(len(text)) / 16, np.log1p(len(words)) / 14, min(1.0, (n / count) / 16), kinds[2] / letters, 3 * kinds[0] / n,
        5 * kinds[3] / n, 20 * kinds[5] / n, 10 * kinds[6] / n, kinds[7] / n, different / count,
        len(set(lines)) / len(lines), sum(a == b for a, b in zip(words, words[1:])) / count, text.count(b"|") / count,
        np.log1p(max(map(len, lines))) / 14,
    ]).clip(0, 1)


STATISTICS = len(statistics(b"", [], 0))
FEATURES = WORDS + STATISTICS * BINS


def features(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values."""
    text = text or b""
    words = split_words(text)
    buckets = np.unique(hashes.of(words) >> np.uint64(50)).astype(np.int64)
    shape = statistics(text, words, len(set(words)))
    bins = WORDS + np.arange(STATISTICS) * BINS + np.searchsorted(_EDGES, shape, side="right")
    values = np.concatenate([np.full(len(buckets), 1 / np.sqrt(max(1, len(buckets)))), np.full(STATISTICS, 0.5)])
    return np.concatenate([buckets, bins]), values


class Machine:
    """``w0``, ``w`` and the factors ``v`` of a factorisation machine."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        own = self.v[index] * value[:, None]
        total = own.sum(axis=0)
        logit = self.w0 + float(self.w[index] @ value) + 0.5 * float(total @ total - (own * own).sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int = FEATURES, factors: int = FACTORS,
        epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5, batch: int = 256, seed: int = 5) -> Machine:
    """Logistic loss, Adam steps over small batches."""
    share = float(labels.mean()) if len(labels) else 0.5
    rng = np.random.default_rng(seed)
    start = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3)))
    if len(labels) == 0 or share in (0.0, 1.0):
        return Machine(start, np.zeros(size), np.zeros((size, factors)))
    weights = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.02, (size, factors))], axis=1)
    w0, first, second, step = start, np.zeros_like(weights), np.zeros_like(weights), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            sizes = np.array([len(rows[i][0]) for i in chosen])
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            own = weights[index] * value[:, None]
            total = np.add.reduceat(own, starts, axis=0)
            squares = np.add.reduceat(own[:, 1:] ** 2, starts, axis=0).sum(axis=1)
            logit = w0 + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[chosen]) / len(chosen)
            each = np.repeat(error, sizes) * value
            slope = np.empty_like(own)
            slope[:, 0] = each
            slope[:, 1:] = each[:, None] * (np.repeat(total[:, 1:], sizes, axis=0) - own[:, 1:])
            used, place = np.unique(index, return_inverse=True)
            gradient = np.stack([np.bincount(place, weights=slope[:, j]) for j in range(slope.shape[1])], axis=1)
            gradient += decay * weights[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * gradient
            second[used] = 0.99 * second[used] + 0.01 * gradient**2
            weights[used] -= rate * first[used] / (np.sqrt(second[used]) + 1e-8)
            w0 -= rate * float(error.sum())
    return Machine(w0, weights[:, 0].copy(), weights[:, 1:].copy())


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled rows; ``labels`` holds only rows to learn from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IN (0, 1)"
    )
    chosen = F.broadcast(sample_ids(known.dropDuplicates(["doc_id"]), rows))  # at most `rows` pairs of numbers
    return texts(docs).join(chosen, "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine:
    """Fit on labelled documents (``doc_id, quality``); the driver gets feature numbers, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces_of(batches):
            found = [features(t, hashes) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                 pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))],
                ["doc_id", "label", "number", "value"],
            )

    sample = labelled(docs, labels, "quality", rows)
    got = sample.mapInArrow(run, "doc_id long, label int, number array<int>, value array<float>").toArrow().combine_chunks()
    got = got.sort_by("doc_id")
    own = [(np.asarray(n.values), np.asarray(v.values, dtype=np.float64)) for n, v in zip(got.column("number"), got.column("value"))]
    return fit(own, got.column("label").to_numpy().astype(float))


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = shipped.value, WordHashes()
        for batch in pieces_of(batches):
            found = [own.score(*features(t, hashes)) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")
