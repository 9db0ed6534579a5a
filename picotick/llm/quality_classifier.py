"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are word n-grams hashed into ``2**BITS`` slots: words and word pairs, word shapes
(letters, digits and runs folded) alone, in pairs and threes, and whether a word repeats one
of the three before it. A feature's value is its count divided by the number of words, so a
score is one gather and one sum per document: a sparse dot product.

``train`` fits on at most ``MAX_TRAIN`` labelled rows, taken by a hash of their id; that bound
is the operator's only one, everything is scored. Training runs in one task on that sample;
the weights (4 MB at most) go back to every task as a bounded broadcast. Null or empty texts
have no features and score the bias; rows without labels, null labels and null ids do not
train; repeated labels of an id train once, by their maximum; other columns are ignored;
without any labelled row every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import Chunk, U, chunks, mix

BITS = 18
MAX_TRAIN = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.5
SCALE = 10.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the chunk, slot, words of each document) for every n-gram of the chunk."""
    chunk.words()
    n = len(chunk.ws)
    owner = np.repeat(np.arange(len(chunk.start)), chunk.last - chunk.first)
    word = chunk.word_hashes()
    folded = _SHAPE[chunk.data]
    folded = folded[np.concatenate(([True], folded[1:] != folded[:-1]))]
    plain = Chunk([folded.tobytes()])
    plain.words()
    shape = plain.word_hashes()
    docs, slots = [], []

    def add(kind: int, values: np.ndarray, width: int) -> None:
        ends = np.arange(width - 1, n)
        same = owner[ends] == owner[ends - width + 1]
        docs.append(owner[ends[same]])
        slots.append((mix(values[same] + U(kind)) >> U(64 - BITS)).astype(np.int64))

    if n:
        add(1, word, 1)
        add(2, shape, 1)
    if n > 1:
        add(3, mix(word[:-1]) + word[1:], 2)
        pair = mix(shape[:-1]) + shape[1:]
        add(4, pair, 2)
    if n > 2:
        add(5, mix(pair[:-1]) + shape[2:], 3)
    for back in (1, 2, 3):
        if n > back:
            add(5 + back, (word[back:] == word[:-back]).astype(U), back + 1)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *docs]), np.concatenate([none, *slots]), chunk.last - chunk.first


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss (slot 2**BITS: bias)."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def _examples(chunk: Chunk):
    doc, slot, words = features(chunk)
    cut = np.searchsorted(np.sort(doc), np.arange(len(words) + 1))
    slot = slot[np.argsort(doc, kind="stable")]
    for i, n in enumerate(words):
        at, count = np.unique(slot[cut[i] : cut[i + 1]], return_counts=True)
        yield np.append(at, 1 << BITS), np.append(count * (SCALE / max(1, n)), 1.0)


def _fit(batches):
    model, seen = Ftrl((1 << BITS) + 1), []
    for b in batches:
        labels = b.column("label").to_pylist()
        for part, chunk in chunks(labels, b.column("text").to_pylist()):
            seen += list(zip(_examples(chunk), labels[part], strict=True))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(seen)):
            (slots, values), label = seen[i]
            model.learn(slots, values, label)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()])], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from the labelled documents (``labels`` already without held-out rows)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "label", "text")  # at most max_train ids are broadcast
    # one task learns from the bounded sample, in an order that does not depend on the files
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id").select("label", "text").mapInArrow(_fit, "weights binary").collect()
    return np.frombuffer(bytes(found[0]["weights"]), dtype="<f8") if found else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (probability of label 1) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        w = shared.value
        for b in batches:
            out = [np.zeros(0)]
            texts = b.column(1).to_pylist()
            for _, chunk in chunks(texts, texts):
                doc, slot, words = features(chunk)
                sums = np.bincount(doc, weights=w[slot], minlength=len(words)) * (SCALE / np.maximum(words, 1)) + w[1 << BITS]
                out.append(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], names=["_id", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return given.mapInArrow(run, "_id long, score double").withColumnRenamed("_id", id_col)
