"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

A word's vector is the sum of the index vectors of its neighbours over the whole corpus; index
vectors are sparse, of +1 and -1, and follow from a hash. Words are hashed to ``words`` rows, so
the table's size is fixed. A document is the mean and the spread of its words' vectors. A network
of two layers gives a logit, and a temperature fitted on rows it was not trained on makes it a
probability.

Defined edge cases: null, empty and blank texts have a zero vector and get the network's score for
it; repeated rows are scored alike; a corpus without usable labels scores everything 0.5; an
empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import WordHasher, grouped, mixed, table_of

HASHER = WordHasher(table_of(lambda c: c != 32 and not 9 <= c <= 13, lower=False))


@dataclass(frozen=True)
class Settings:
    words: int = 1 << 14
    size: int = 32
    nonzero: int = 4
    reach: int = 2
    hidden: int = 32
    #: The network is fitted on at most so many labelled rows, those with the smallest hashes of their doc_id.
    max_rows: int = 20_000
    epochs: int = 60
    seed: int = 11


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each word's index vector."""
    h = mixed(np.arange(s.words * s.nonzero, dtype=np.uint64) + np.uint64(s.seed << 32)).reshape(s.words, s.nonzero)
    return (h % np.uint64(s.size)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def rows_of(texts: list[bytes], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ranges of texts: the row of each word, and where each text's words begin, with the end."""
    for i, j in grouped(texts):
        clean, starts, ends = HASHER.split(b"\n".join(texts[i:j]))
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts[i:j]), np.int64, j - i) + 1)))
        yield (HASHER.hashes(clean, starts, ends) % np.uint64(s.words)).astype(np.int64), np.searchsorted(starts, offsets)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_vectors(docs: DataFrame, s: Settings = Settings(), fan_in: int = 4) -> np.ndarray:
    """The table of word vectors over all of ``docs``, each of length 1: words x size numbers, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors(s)
        total = np.zeros(s.words * s.size, np.int64)
        for batch in batches:
            for row, first in rows_of(_bytes(batch.column(0)), s):
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for gap in range(1, s.reach + 1):
                    same = doc[gap:] == doc[:-gap]
                    a, b = row[:-gap][same], row[gap:][same]
                    for x, y in ((a, b), (b, a)):
                        at = (x * s.size)[:, None] + places[y]
                        total += np.bincount(at.ravel(), signs[y].ravel(), len(total)).astype(np.int64)
        yield _partial(total)

    def _partial(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.words * s.size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield _partial(total)

    parts = written(docs.select("text").mapInArrow(count, "part binary"), "parts")
    n = parts.count()
    while n > 1:  # a tree of sums, each of at most fan_in parts at a time
        n = -(-n // fan_in)
        parts = written(parts.repartition(n).mapInArrow(add, "part binary"), "parts")
    rows = parts.collect()  # one, or none where the input is empty
    total = sum((np.frombuffer(bytes(r[0]), np.int64) for r in rows), np.zeros(s.words * s.size, np.int64))
    vectors = total.reshape(s.words, s.size).astype(np.float64)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, s: Settings) -> np.ndarray:
    """The mean of each text's word vectors, and their spread about it."""
    out = []
    for row, first in rows_of(texts, s):
        n = np.diff(first)
        x = np.zeros((len(n), 2 * s.size))
        some = np.flatnonzero(n)
        if len(some):
            v = vectors[row]
            x[some, : s.size] = np.add.reduceat(v, first[some], axis=0, dtype=np.float64) / n[some, None]
            square = np.add.reduceat(v * v, first[some], axis=0, dtype=np.float64) / n[some, None]
            x[some, s.size :] = np.sqrt(np.maximum(square - x[some, : s.size] ** 2, 0))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 2 * s.size))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """Two layers, a rectifier between them, and a temperature."""

    def __init__(self, size: int, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.shift, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0
        self.p = [rng.normal(0, (2 / size) ** 0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.shift) / self.scale
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, decay: float = 1e-4, rate: float = 3e-3, size: int = 256) -> None:
        """Adam on the log loss; every eighth row is left out, for the temperature."""
        rng = np.random.default_rng(seed)
        out = np.arange(len(x)) % 8 == 7 if len(x) >= 64 else np.zeros(len(x), bool)
        vx, vy, x, y = x[out], y[out], x[~out], y[~out]
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.shift) / self.scale
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), size):
                a, b = z[order[i : i + size]], y[order[i : i + size]]
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                d = (sigmoid(h @ self.p[2] + self.p[3][0]) - b) / len(a)
                dh = np.outer(d, self.p[2]) * (h > 0)
                t += 1
                for k, g in enumerate((a.T @ dh + decay * self.p[0], dh.sum(0), h.T @ d + decay * self.p[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if len(vx):
            logits, grid = self.logits(vx), np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(vy == 1, -logits, logits) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def chosen(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows, those with the smallest hashes of their doc_id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def score_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and ``score`` of every row of ``docs``; ``labels`` (doc_id, label 0 or 1) are those to learn from."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, s))  # words x size numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(_bytes(batch.column(1)), vectors.value, s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["doc_id", "label", "x"])

    some = chosen(labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), s.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).select(F.col("doc_id").cast("long"), "text", "label")
    got = sorted((tuple(r) for r in rows.mapInArrow(features, "doc_id long, label int, x binary").collect()), key=lambda r: (r[0], r[1]))
    network = None
    if {r[1] for r in got} == {0, 1}:
        # rows in an order that doesn't follow the corpus
        order = np.argsort(mixed(np.array([r[0] for r in got]).astype(np.uint64)), kind="stable")
        network = Network(2 * s.size, s.hidden, s.seed)
        x = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(len(got), -1).astype(np.float64)
        network.fit(x[order], np.array([r[1] for r in got], float)[order], s.epochs, s.seed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = network.score(pooled(_bytes(batch.column(1)), vectors.value, s)) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
