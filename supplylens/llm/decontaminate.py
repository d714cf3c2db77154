"""Benchmark decontamination: an FM-index per shard of training documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from supplylens.llm import textarrays as T
from supplylens.llm.anchors import covered
from supplylens.llm.fmindex import FMIndex
from supplylens.llm.substrings import list_sets

#: words are runs of digits, letters and all bytes beyond ASCII
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
SHARD_BYTES = 2 << 20
_TABLE_BITS = 20


@dataclass
class Phrases:
    """The windows of a block of items: word numbers from 2 up, right-aligned, and their items."""
    vocabulary: np.ndarray
    table: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    window: np.ndarray
    item: np.ndarray


def _words(chunk: T.Chunk) -> tuple[T.Words, np.ndarray]:
    chunk.data = T.lower(chunk.data)
    words = T.words(chunk, LETTERS)
    return words, T.of_bytes(chunk.data).spans(words.starts, words.ends)


def phrases(items: list[tuple[int, str]], width: int) -> Phrases:
    """All windows of the items; items without words have none."""
    rows, found = [], []
    for chunk in T.chunks(pa.array([text for _, text in items], pa.string())):
        words, hashes = _words(chunk)
        for r in range(chunk.n):
            own = hashes[words.first[r]:words.first[r + 1]]
            size = min(width, len(own))
            for start in range(len(own) - size + 1 if size else 0):
                row = np.zeros(width, np.uint64)
                row[width - size:] = own[start:start + size]
                found.append((row, size))
                rows.append(items[chunk.first + r][0])
    if not found:
        empty = np.empty(0, np.int64)
        return Phrases(np.empty(0, np.uint64), np.zeros(1 << _TABLE_BITS, bool), np.empty((0, width), np.int64), empty, empty, empty)
    raw = np.stack([row for row, _ in found])
    lengths = np.array([size for _, size in found])
    vocabulary = np.unique(raw[np.arange(width) >= width - lengths[:, None]])
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[vocabulary >> np.uint64(64 - _TABLE_BITS)] = True
    patterns, window = np.unique(np.column_stack([np.searchsorted(vocabulary, raw) + 2, lengths]), axis=0, return_inverse=True)
    return Phrases(vocabulary, table, patterns[:, :-1], patterns[:, -1], window.ravel(), np.array(rows, np.int64))


def _occurrences(hashes: np.ndarray, row: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Each place (word number in the chunk) where a window of the items occurs, and the window.

    A word that no item has ends every match, so the index keeps only the stretches of known
    words that are as long as the shortest window, each closed by symbol 1.
    """
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(p.lengths) or not len(hashes):
        return nothing
    known = np.flatnonzero(p.table[hashes >> np.uint64(64 - _TABLE_BITS)])
    number = np.searchsorted(p.vocabulary, hashes[known])
    number[number == len(p.vocabulary)] = 0
    real = p.vocabulary[number] == hashes[known]
    known, number = known[real], number[real]
    if not len(known):
        return nothing
    new = np.ones(len(known), bool)
    new[1:] = (np.diff(known) > 1) | (row[known[1:]] != row[known[:-1]])
    stretch = np.cumsum(new) - 1
    long = np.bincount(stretch)[stretch] >= p.lengths.min()
    known, number, stretch = known[long], number[long], stretch[long]
    if not len(known):
        return nothing
    place = np.arange(len(known)) + np.concatenate([[0], np.cumsum(stretch[1:] != stretch[:-1])])
    symbols = np.ones(place[-1] + 2, np.int64)
    symbols[place] = number + 2
    word = np.zeros(len(symbols), np.int64)
    word[place] = known
    index = FMIndex(symbols)
    low, high = index.search(p.patterns, p.lengths)
    size = high - low
    window = np.repeat(np.arange(len(size)), size)
    places = np.repeat(low, size) + np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
    return word[index.locate(places)], window


def _items_of(window: np.ndarray, row: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, item) pairs of the windows that occur in rows."""
    pairs = np.unique(np.column_stack([row, window]), axis=0)
    order = np.argsort(p.window, kind="stable")
    bounds = np.searchsorted(p.window[order], np.arange(len(p.lengths) + 1))
    size = (bounds[1:] - bounds[:-1])[pairs[:, 1]]
    at = np.repeat(bounds[pairs[:, 1]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    both = np.unique(np.column_stack([np.repeat(pairs[:, 0], size), p.item[order[at]]]), axis=0)
    return both[:, 0], both[:, 1]


def _marked(block: Phrases, first: bool, last: bool, columns: list[str], clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            earlier = None if first else (list_sets(batch.column("_hits")), list_sets(batch.column("_items")))
            for chunk in T.chunks(batch.column("text"), SHARD_BYTES):
                part = slice(chunk.first, chunk.first + chunk.n)
                words, hashes = _words(chunk)
                row = words.row()
                start, window = _occurrences(hashes, row, block)
                hit = covered(len(row), start, start + block.lengths[window])
                rows, items = _items_of(window, row[start], block)
                if earlier:
                    (hits, hit_at), (old, old_at) = earlier
                    size = np.diff(hit_at)[part]
                    hit[np.repeat(words.first[:-1], size) + hits[hit_at[chunk.first]:hit_at[chunk.first + chunk.n]]] = True
                    again = np.column_stack([np.repeat(np.arange(chunk.n), np.diff(old_at)[part]),
                                             old[old_at[chunk.first]:old_at[chunk.first + chunk.n]]])
                    both = np.unique(np.concatenate([np.column_stack([rows, items]), again]), axis=0)
                    rows, items = both[:, 0], both[:, 1]
                item_at = np.searchsorted(rows, np.arange(chunk.n + 1))
                hit_row = np.flatnonzero(hit)
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c)[part] for c in columns),
                         pa.ListArray.from_arrays(pa.array(np.searchsorted(row[hit_row], np.arange(chunk.n + 1)).astype(np.int32)),
                                                  pa.array(hit_row - words.first[row[hit_row]])),
                         pa.ListArray.from_arrays(pa.array(item_at.astype(np.int32)), pa.array(items))],
                        [*columns, "_hits", "_items"])
                    continue
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
                if clean:
                    yield batch.select(columns).slice(chunk.first, chunk.n).filter(pa.array(n_hit == 0))
                    continue
                none = hashlib.sha256(b"").hexdigest()
                digest = [none] * chunk.n
                for r in np.unique(rows):
                    names = sorted(map(str, items[item_at[r]:item_at[r + 1]].tolist()))
                    digest[r] = hashlib.sha256(",".join(names).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array(np.diff(words.first)), pa.array(n_hit), pa.array(np.diff(item_at)),
                     pa.array(digest), pa.array(n_hit > 0)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; only one is on the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10,
                  block_bytes: int = 4 << 20) -> DataFrame:
    """Words of documents that lie in an occurrence of ``width`` consecutive words of an item.

    Returns one row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated``. An item with fewer words, but not none, is one window.

    Documents never move: each task turns a shard of its documents into an FM-index (suffix array
    of the word sequence, its Burrows-Wheeler transform in a wavelet tree), searches all windows
    backwards at once, locates the occurrences from sampled suffix positions and merges their
    spans. The items are the stated query set; they go to the tasks in blocks of ``block_bytes``,
    one pass of the documents for each.

    Null and empty texts have no words; items with a null id or text are ignored; repeated rows
    have the same result; items that share an id count once. Other columns are ignored.
    """
    return _passes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, width, block_bytes, False)


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10,
                         block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs.

    Each row is judged by its own text where it stands, whatever its id: rows with a null id or
    one that others share are kept or go like all others.
    """
    return _passes(docs, benchmark, width, block_bytes, True)


def _passes(out: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, clean: bool) -> DataFrame:
    """One pass over the documents for each block of items; the last one gives verdicts or the clean rows."""
    own = out.schema
    verdicts = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    between = StructType([*own.fields, StructField("_hits", ArrayType(LongType())), StructField("_items", ArrayType(LongType()))])
    blocks, first = _blocks(benchmark, block_bytes), True
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        schema = between if after is not None else own if clean else verdicts
        out = out.mapInArrow(_marked(phrases(block, width), first, after is None, own.names, clean), schema)
        block, first = after, False
    return out
