"""Repeated passages of words: seeds on winnowed anchors, extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm import anchors as A
from supplylens.llm import textarrays as T
from supplylens.llm.store import Workspace

LETTERS = T.separators(T.SPACES)
_LAST = 2**63 - 1


class Passages:
    """The words of a chunk and the hashes of any run of them."""

    def __init__(self, chunk: T.Chunk, seed: int, length: int):
        self.words = T.words(chunk, LETTERS)
        self.row = self.words.row()
        self.length = length
        self.rolling = T.Rolling(T.of_bytes(chunk.data).spans(self.words.starts, self.words.ends))
        self.grams = self.rolling.windows(seed)
        self.blocks = A.blocks(self.grams, self.row, seed, length)

    def seeds(self) -> np.ndarray:
        return self.grams[self.blocks.anchor]

    def extents(self) -> np.ndarray:
        """The identity of each seed's whole extent: its words and the seed's place in them."""
        b = self.blocks
        return T.mix(self.rolling.spans(b.first, b.last + self.length) + (b.anchor - b.first).astype(np.uint64))


def _joined_words(chunk: T.Chunk, words: T.Words, keep: np.ndarray) -> Iterator[str]:
    """SHA-256 of each row's kept words joined by one space."""
    starts, ends = words.starts[keep], words.ends[keep]
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    place = np.arange(len(out)) - np.repeat(at, size)
    inside = place < np.repeat(size - 1, size)
    out[inside] = chunk.data[(np.repeat(starts, size) + place)[inside]]
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    edges = np.append(at, len(out))
    raw = memoryview(out)
    for a, b in zip(edges[first[:-1]], edges[first[1:]], strict=True):
        yield hashlib.sha256(raw[a:max(a, b - 1)]).hexdigest()


def _long_lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def list_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of longs as all values and the bounds of each list; null is empty."""
    size = np.array([0 if v is None else v for v in column.value_lengths().to_pylist()], np.int64)
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64), bounds


def _scan(seed: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("text")):
                part = slice(chunk.first, chunk.first + chunk.n)
                p = Passages(chunk, seed, length)
                seeds, extents, row = p.seeds(), p.extents(), p.blocks.row
                # a passage that a document has several times counts once
                _, once = np.unique(extents ^ T.mix(row.astype(np.uint64)), return_index=True)
                once.sort()
                bounds = np.searchsorted(row[once], np.arange(chunk.n + 1))
                digests = list(_joined_words(chunk, p.words, np.ones(len(p.words.starts), bool)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], batch.column("doc")[part], batch.column("h")[part],
                     pa.array(np.diff(p.words.first)), pa.array(digests),
                     _long_lists(bounds, seeds[once]), _long_lists(bounds, extents[once])],
                    ["doc_id", "doc", "h", "n_words", "digest", "seeds", "extents"])
    return run


def _windows(seed: int, length: int):
    """The windows of extents that other documents share in part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list_sets(batch.column("open"))
            docs = batch.column("doc").to_numpy()
            for chunk in T.chunks(batch.column("text")):
                p = Passages(chunk, seed, length)
                b = p.blocks
                some = A.own(p.extents(), chunk.first + b.row, sets)
                size = (b.last - b.first + 1)[some]
                start = np.repeat(b.first[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row = np.repeat(b.row[some], size)
                hashes = p.rolling.spans(start, start + length)
                _, once = np.unique(hashes ^ T.mix(row.astype(np.uint64)), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[once].view(np.int64)), pa.array(docs[chunk.first + row[once]])], ["w", "doc"])
    return run


def _cut(seed: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, single = list_sets(batch.column("whole")), list_sets(batch.column("single"))
            for chunk in T.chunks(batch.column("text")):
                part = slice(chunk.first, chunk.first + chunk.n)
                p = Passages(chunk, seed, length)
                b = p.blocks
                some = A.own(p.extents(), chunk.first + b.row, whole)
                windows = p.rolling.windows(length)
                row = p.row[:len(windows)]
                inside = np.flatnonzero(row == p.row[length - 1:])
                at = inside[A.own(windows[inside], chunk.first + row[inside], single)]
                gone = A.covered(len(p.row), np.concatenate([b.first[some], at]),
                                 np.concatenate([b.last[some] + length, at + length]))
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[p.words.first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc")[part], batch.column("h")[part], pa.array(removed),
                     pa.array(list(_joined_words(chunk, p.words, ~gone)))], ["doc", "h", "n_removed", "kept"])
    return run


def repeated_passages(spark: SparkSession, docs: DataFrame, length: int = 50, seed: int = 18) -> DataFrame:
    """Remove the words of passages that a document with a smaller id has as well.

    A word goes if it lies in a window of ``length`` words whose sequence also starts in a
    document with a smaller ``doc_id``. Returns one row per input row: ``doc_id, n_words,
    n_removed, kept_sha256``.

    * Seed: every window stands on its least ``seed``-gram; documents meet on these anchors
      (about one in 17 words). Anchors that one document alone has end here.
    * Extend: the windows that stand on an anchor are extended both ways to one extent. Equal
      extents of several documents are repeats as a whole: all but the smallest document's go.
      Neighbouring extents grow into maximal repeats when spans are merged.
    * Edges: where the extents on one anchor differ, one of each kind goes on and is compared
      window by window; this is where a repeat ends inside an extent.

    Each step groups by a hash with a minimum, combined before the shuffle, so a passage in very
    many documents is never gathered, and the work grows with the text. Texts are moved once.

    Null texts have no words. Rows without a ``doc_id`` come after all others and do not remove
    words from each other. Rows that repeat an id are parts of one document: they remove nothing
    from each other. Other columns are ignored.
    """
    work = Workspace(spark, "passages")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
                       F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    rows = work.keep(docs.mapInArrow(_scan(seed, length), "doc_id long, doc long, h long, n_words long, digest string, "
                                     "seeds array<long>, extents array<long>"))
    pairs = rows.select("doc", F.explode(F.arrays_zip("seeds", "extents")).alias("x")).select(
        "doc", F.col("x.seeds").alias("s"), F.col("x.extents").alias("e"))
    met = work.keep(pairs.groupBy("s").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("e").alias("e1"),
                                  F.max("e").alias("e2"))
           .where("lo < hi").select("s", (F.col("e1") < F.col("e2")).alias("differ")))
    seeds = work.keep(pairs.join(met, "s").select("doc", "e", "differ"))
    least = work.keep(seeds.groupBy("e").agg(F.min("doc").alias("lo")))
    marks = (seeds.join(least, "e").groupBy("doc").agg(
        F.collect_set(F.when(F.col("doc") > F.col("lo"), F.col("e"))).alias("whole"),
        F.collect_set(F.when((F.col("doc") == F.col("lo")) & F.col("differ"), F.col("e"))).alias("open")))
    texts = work.keep(docs.drop("doc_id").join(marks, "doc"))
    windows = work.keep(texts.where(F.size("open") > 0).mapInArrow(_windows(seed, length), "w long, doc long"))
    least = work.keep(windows.groupBy("w").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi"))
    single = (windows.join(least, "w").where("doc > lo").groupBy("doc").agg(F.collect_set("w").alias("single")))
    cut = (texts.select("doc", "h", "text", "whole").join(single, "doc", "left")
           .where((F.size("whole") > 0) | F.col("single").isNotNull())
           .withColumn("single", F.coalesce("single", F.array().cast("array<long>")))
           .mapInArrow(_cut(seed, length), "doc long, h long, n_removed long, kept string")
           .dropDuplicates(["doc", "h"]))
    return (rows.select("doc_id", "doc", "h", "n_words", "digest").join(work.keep(cut), ["doc", "h"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.coalesce("kept", "digest").alias("kept_sha256")))
