"""A quality classifier: logistic regression on hashed word n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm import textarrays as T

#: bytes by kind: 0 white space, 1 letters, digits and all beyond ASCII, 2 other signs
_KIND = np.full(256, 2, np.uint8)
_KIND[np.frombuffer(T.SPACES, np.uint8)] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_REPEAT = np.uint64(0x51ED270B9F1A4E2D)


def features(chunk: T.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each row and their bounds.

    Words are runs of letters or of other signs, in their own case. The n-grams are single
    words, pairs of neighbours (equal neighbours are one feature, whatever the word) and
    triples of word shapes.
    """
    data, n = chunk.data, chunk.n
    if not len(data):
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    inner = chunk.bounds[1:-1]
    new[inner[inner < len(data)]] = True
    edges = np.append(np.flatnonzero(new), len(data))
    starts, ends = edges[:-1], edges[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    hashes = T.ShortRolling(data).spans(starts, ends)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    ups, size = upper[ends] - upper[starts], ends - starts
    title = _UPPER[data[starts]]
    shape = np.where(ups == 0, 0, np.where((ups == size) & (size > 1), 1, np.where((title == 1) & (ups == 1), 2, 3)))
    shape = shape + 4 * (digit[ends] > digit[starts])
    shape = np.where(kind[starts] == 2, hashes, T.mix(shape.astype(np.uint64) + np.uint64(77)))
    row = np.searchsorted(chunk.bounds, starts, "right") - 1
    pair = np.where(hashes[1:] == hashes[:-1], _REPEAT, T.mix(hashes[1:] * np.uint64(3) ^ hashes[:-1]))[row[1:] == row[:-1]]
    triple = T.mix(shape[2:] * np.uint64(5) ^ T.mix(shape[1:-1] * np.uint64(3) ^ shape[:-2]))[row[2:] == row[:-2]]
    all_rows = np.concatenate([row, row[1:][row[1:] == row[:-1]], row[2:][row[2:] == row[:-2]]])
    place = (np.concatenate([hashes, pair, triple]) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(all_rows, kind="stable")
    return place[order], np.searchsorted(all_rows[order], np.arange(n + 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int
    scale: float

    def score(self, chunk: T.Chunk) -> np.ndarray:
        """The sparse dot product of each row: mean weight of its features, scaled."""
        place, bounds = features(chunk, self.bits)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[place], dtype=np.float64)])
        size = np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.scale * np.diff(sums[bounds]) / size, -30, 30)))


class Ftrl:
    """Follow the regularised leader with a rate per weight (alpha, beta) and L1 and L2 terms."""

    def __init__(self, bits: int, scale: float, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.bits, self.scale = bits, scale
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        out = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, out)

    def update(self, at: np.ndarray, count: np.ndarray, label: int) -> None:
        x = np.append(self.scale * count / max(1, count.sum()), 1.0)
        at = np.append(at, 1 << self.bits)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g

    def model(self) -> Model:
        w = self.weights(np.arange((1 << self.bits) + 1))
        return Model(w[:-1].astype(np.float32), float(w[-1]), self.bits, self.scale)


def _train(bits: int, scale: float, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            labels = batch.column("quality").to_numpy()
            for chunk in T.chunks(batch.column("text")):
                place, bounds = features(chunk, bits)
                for r in range(chunk.n):
                    at, count = np.unique(place[bounds[r]:bounds[r + 1]], return_counts=True)
                    rows.append((at.astype(np.int32), count.astype(np.int32), int(labels[chunk.first + r])))
        learner = Ftrl(bits, scale)
        for _ in range(epochs):
            for at, count, label in rows:
                learner.update(at, count, label)
        model = learner.model()
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])
    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, bits: int = 18, scale: float = 16.0, epochs: int = 2) -> Model:
    """Train on at most ``sample`` labelled rows, those with the lowest hashes of their ids.

    The bound makes training one task's work and the model ``2 ** bits`` numbers, so both may
    pass through one place. Labels other than 0 and 1 and ids with differing labels are left out.
    """
    chosen = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
              .where("quality = other").select("doc_id", "quality", F.xxhash64("doc_id").alias("order"))
              .orderBy("order", "doc_id").limit(sample))
    # at most ``sample`` rows of three numbers
    rows = (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))
    found = rows.repartition(1).sortWithinPartitions("order", "doc_id").mapInArrow(_train(bits, scale, epochs), "weights binary, bias double").first()
    if found is None:
        return Model(np.zeros(1 << bits, np.float32), 0.0, bits, scale)
    return Model(np.frombuffer(found.weights, np.float32), found.bias, bits, scale)


def _scored(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(chunk) for chunk in T.chunks(batch.column("text"))]
            scores = np.concatenate(scores) if scores else np.empty(0)
            out = batch.drop_columns(["text"]) if "text" in batch.schema.names else batch
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                             [*out.schema.names, "score", "predicted"])
    return run


def _kept(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(chunk) >= threshold for chunk in T.chunks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.empty(0, bool)))
    return run


def held_out(column: str = "doc_id"):
    """The rows that no training may see: a quarter of the ids, by CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score every text: ``doc_id, held_out, score, predicted``.

    Scores depend on the text alone. Null and empty texts have the bias as their score; rows
    without a ``doc_id`` are scored and not held out; repeated rows have the same score. Without
    usable labels every score is one half. Other columns are ignored.
    """
    model = fit(docs, labels.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(_scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that reach the threshold; all of them if no label can be used."""
    model = fit(docs, labels.where(~held_out()))
    return docs if model.bias == 0 and not model.weights.any() else docs.mapInArrow(_kept(model, threshold), docs.schema)
