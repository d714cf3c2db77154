"""Repeated byte strings: sampled suffixes in buckets, refined by buckets of later offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm import anchors as A
from supplylens.llm import textarrays as T
from supplylens.llm.store import Workspace
from supplylens.llm.substrings import list_sets

_LAST = 2**63 - 1
STRIDE = 16
#: bytes that a task looks at together: it holds some ten numbers for each
SHARE = 512 << 10


def _all(*parts: np.ndarray) -> np.ndarray:
    """One identifier from several."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = T.mix(out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
    return out


class Suffixes:
    """Bucket identifiers of a chunk: the hash of the ``q`` bytes at each offset, and what refines it.

    A bucket of longer strings is named by the buckets of its q-grams at later offsets, the
    last one overlapping, so no level reads bytes again.
    """

    def __init__(self, chunk: T.Chunk, q: int, length: int):
        self.q, self.length = q, length
        self.row = np.repeat(np.arange(chunk.n), np.diff(chunk.bounds))
        self.bounds = chunk.bounds
        self.bucket = T.ShortRolling(chunk.data).windows(q)
        self.blocks = A.blocks(self.bucket, self.row, q, length)

    def span(self, start: np.ndarray, size: int) -> np.ndarray:
        """The bucket of the ``size`` bytes (``q`` at least) from each start."""
        later = [*range(0, size - self.q, self.q), size - self.q]
        return _all(*(self.bucket[start + d] for d in later))

    def initial(self) -> np.ndarray:
        return self.bucket[self.blocks.anchor]

    def extents(self) -> np.ndarray:
        """The bucket of all windows on an anchor together; they differ by less than a window."""
        b = self.blocks
        return _all(self.span(b.first, self.length), self.span(b.last, self.length), b.last - b.first, b.anchor - b.first)

    def pieces(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of ``STRIDE`` windows, at fixed distances from the anchor, that some blocks touch.

        Returns the start of each (each place once), its row, the bucket of what all its windows
        have in common, the bucket of all of them, and whether the piece goes over the ends of
        the row. There is no bucket of all (0) where it does.
        """
        b = self.blocks
        anchor = b.anchor[some]
        low, high = (b.first[some] - anchor) // STRIDE, (b.last[some] - anchor) // STRIDE
        size = high - low + 1
        step = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start, once = np.unique(np.repeat(anchor, size) + step * STRIDE, return_index=True)
        row = np.repeat(b.row[some], size)[once]
        common = self.span(start + STRIDE - 1, self.length - STRIDE + 1)
        over = (start < self.bounds[row]) | (start + STRIDE - 1 + self.length > self.bounds[row + 1])
        fits = np.flatnonzero(~over)
        union = np.zeros(len(start), np.uint64)
        union[fits] = self.span(start[fits], self.length + STRIDE - 1)
        return start, row, common, union, over

    def windows_of(self, start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.unique((start[:, None] + np.arange(STRIDE)).ravel())
        row = self.row[np.clip(at, 0, len(self.row) - 1)]
        last = at + self.length - 1
        inside = (at >= 0) & (last < len(self.row))
        inside[inside] &= self.row[last[inside]] == row[inside]
        return at[inside], row[inside]


def _counted(hashes: np.ndarray, row: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct hashes with the number of their places."""
    _, once, times = np.unique(hashes ^ T.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    order = np.argsort(row[once], kind="stable")
    once, times = once[order], times[order]
    return [hashes[once], row[once], times, *(m[once] for m in more)]


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _scan(q: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column("text"), SHARE):
                part = slice(chunk.first, chunk.first + chunk.n)
                s = Suffixes(chunk, q, length)
                extents, row, times, initial = _counted(s.extents(), s.blocks.row, s.initial())
                bounds = np.searchsorted(row, np.arange(chunk.n + 1))
                raw, at = memoryview(np.ascontiguousarray(chunk.data)), chunk.bounds
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], batch.column("doc")[part], batch.column("h")[part],
                     pa.array(np.diff(at)), pa.array(digests), _lists(bounds, initial.view(np.int64)),
                     _lists(bounds, extents.view(np.int64)), _lists(bounds, times.astype(np.int32))],
                    ["doc_id", "doc", "h", "n_bytes", "digest", "initial", "extents", "times"])
    return run


def _open_pieces(q: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            sets, docs = list_sets(batch.column("open")), batch.column("doc").to_numpy()
            for chunk in T.chunks(batch.column("text"), SHARE):
                s = Suffixes(chunk, q, length)
                some = A.own(s.extents(), chunk.first + s.blocks.row, sets)
                _, row, common, union, over = s.pieces(some)
                # over an end: unlike any other, and never looked up again
                ends = np.flatnonzero(over)
                union[ends] = _all(np.full(len(ends), task), made + np.arange(len(ends)))
                made += len(ends)
                union, row, times, common = _counted(union, row, common)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(common.view(np.int64)), pa.array(union.view(np.int64)),
                     pa.array(docs[chunk.first + row]), pa.array(times.astype(np.int32))], ["s", "e", "doc", "times"])
    return run


def _open_windows(q: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, docs = list_sets(batch.column("open")), batch.column("doc").to_numpy()
            pieces = list_sets(batch.column("open_pieces"))
            for chunk in T.chunks(batch.column("text"), SHARE):
                s = Suffixes(chunk, q, length)
                some = A.own(s.extents(), chunk.first + s.blocks.row, sets)
                start, row, _, union, over = s.pieces(some)
                wanted = over | A.own(union, chunk.first + row, pieces)
                at, row = s.windows_of(start[wanted], row[wanted])
                hashes, row, times = _counted(s.span(at, length), row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(docs[chunk.first + row]), pa.array(times.astype(np.int32))],
                    ["w", "doc", "times"])
    return run


def _cut(q: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            whole, opened, pieces, single = (list_sets(batch.column(c)) for c in ("whole", "open", "whole_pieces", "single"))
            for chunk in T.chunks(batch.column("text"), SHARE):
                part = slice(chunk.first, chunk.first + chunk.n)
                s = Suffixes(chunk, q, length)
                b, extents = s.blocks, s.extents()
                some = A.own(extents, chunk.first + b.row, whole)
                start, row, _, union, over = s.pieces(A.own(extents, chunk.first + b.row, opened))
                hit = A.own(union, chunk.first + row, pieces) & ~over
                at, row = s.windows_of(start, row)
                one = A.own(s.span(at, length), chunk.first + row, single)
                gone = A.covered(len(s.row), np.concatenate([b.first[some], start[hit], at[one]]), np.concatenate(
                    [b.last[some] + length, start[hit] + STRIDE - 1 + length, at[one] + length]))
                total = np.concatenate([[0], np.cumsum(gone)])[chunk.bounds]
                new = gone.copy()
                new[1:] &= ~gone[:-1] | (s.row[1:] != s.row[:-1])
                spans = np.concatenate([[0], np.cumsum(new)])[chunk.bounds]
                kept, left = np.ascontiguousarray(chunk.data[~gone]), chunk.bounds - total
                raw = memoryview(kept)
                digests = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(left[:-1], left[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc")[part], batch.column("h")[part], pa.array(np.diff(total)), pa.array(np.diff(spans)),
                     pa.array(digests)], ["doc", "h", "n_removed", "n_spans", "kept"])
    return run


def _refined(rows: DataFrame, work: Workspace, names: tuple[str, str]) -> DataFrame:
    """One refinement: buckets ``s`` that hold several places are split by the identifier ``e``.

    Identifiers with several places are repeats as a whole. Where a bucket has more than one
    identifier, one document of each goes on to the next, finer level. Returns per document the
    identifiers to remove and those to go on with.
    """
    met = work.keep(rows.groupBy("s").agg(F.sum("times").alias("n"), F.min("e").alias("e1"), F.max("e").alias("e2"))
           .where("n > 1").select("s", (F.col("e1") < F.col("e2")).alias("differ")))
    members = work.keep(rows.join(met, "s").select("doc", "e", "times", "differ"))
    size = work.keep(members.groupBy("e").agg(F.sum("times").alias("n"), F.min("doc").alias("lo")))
    joined = members.join(size, "e")
    return joined.groupBy("doc").agg(
        F.collect_set(F.when(F.col("n") > 1, F.col("e"))).alias(names[0]),
        F.collect_set(F.when((F.col("doc") == F.col("lo")) & F.col("differ"), F.col("e"))).alias(names[1]))


def repeated_strings(spark: SparkSession, docs: DataFrame, length: int = 200, q: int = 96) -> DataFrame:
    """Remove every byte of strings of ``length`` bytes that start in more than one place.

    Places count across all documents and within one; all copies go, the first as well. Returns
    one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A suffix array of all offsets would be many times the text. Here the suffixes are sampled:
    each window stands on its least q-gram, about one offset in 50. These suffixes are put into
    buckets by their q-gram. Buckets with one suffix are done; the others are refined by the
    identifiers of the buckets at later offsets, as bucket-pointer refinement does, on three
    levels: all windows on an anchor, pieces of 16 windows, single windows. Each level reuses the
    identifiers of the one before and works only on what that left open. Only equality counts
    here, so identifiers are hashes of the bucket's bytes and buckets need no order among them.

    Every level is a sum per identifier, combined before the shuffle, and a join back, so a
    string with very many copies is never gathered. A third level piece is dropped early when
    what all its windows have in common occurs once. A piece over an end of its text has no
    identifier that another could share; the windows of such pieces are always counted.

    Null texts are empty. Rows that repeat an id, and repeated rows, count as places of their own.
    Other columns are ignored.
    """
    work = Workspace(spark, "strings")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
                       F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    rows = work.keep(docs.mapInArrow(_scan(q, length), "doc_id long, doc long, h long, n_bytes long, digest string, "
                                     "initial array<long>, extents array<long>, times array<int>"))
    first = rows.select("doc", F.explode(F.arrays_zip("initial", "extents", "times")).alias("x")).select(
        "doc", F.col("x.initial").alias("s"), F.col("x.extents").alias("e"), F.col("x.times").alias("times"))
    texts = work.keep(docs.drop("doc_id").join(_refined(first, work, ("whole", "open")), "doc"))
    opened = texts.where(F.size("open") > 0)
    pieces = work.keep(opened.mapInArrow(_open_pieces(q, length), "s long, e long, doc long, times int"))
    second = work.keep(_refined(pieces, work, ("whole_pieces", "open_pieces")))
    windows = work.keep(opened.join(second.where(F.size("open_pieces") > 0), "doc")
                        .select("doc", "text", "open", "open_pieces")
                        .mapInArrow(_open_windows(q, length), "w long, doc long, times int"))
    repeated = work.keep(windows.groupBy("w").agg(F.sum("times").alias("n")).where("n > 1").select("w"))
    single = windows.join(repeated, "w").groupBy("doc").agg(F.collect_set("w").alias("single"))
    none = F.array().cast("array<long>")
    cut = (texts.join(second.select("doc", "whole_pieces"), "doc", "left").join(single, "doc", "left")
           .select("doc", "h", "text", "whole", "open", F.coalesce("whole_pieces", none).alias("whole_pieces"),
                   F.coalesce("single", none).alias("single"))
           .where("size(whole) + size(whole_pieces) + size(single) > 0")
           .mapInArrow(_cut(q, length), "doc long, h long, n_removed long, n_spans long, kept string")
           .dropDuplicates(["doc", "h"]))
    zero = F.lit(0).cast("long")
    return (rows.select("doc_id", "doc", "h", "n_bytes", "digest").join(work.keep(cut), ["doc", "h"], "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                    F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "digest").alias("kept_sha256")))
