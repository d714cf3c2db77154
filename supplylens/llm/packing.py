"""Packing of token sequences: minimum bin slack on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm import textarrays as T
from supplylens.llm.pieces import ByteLevel, Memory, after_letters, distinct
from supplylens.llm.store import Workspace

CAPACITY = 2048
END = 0
CHUNK_BYTES = 2 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_tokenizers: dict[str, "Pieces"] = {}


class Pieces:
    """Token ids of texts, piece by piece.

    A byte-level tokenizer never joins a blank with the word before it. So a text may be cut
    before every blank that follows a word, and each distinct piece is encoded once while its
    worker remembers it. Pieces are told apart by their bytes.
    """

    def __init__(self, path: str):
        self.tokenizer = ByteLevel(path, plain=False)
        self.memory = Memory(self._ids, 1 << 19)

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        ids, bounds = self.tokenizer.encode(pieces)
        raw, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        return [raw[i:j] for i, j in zip(at[:-1], at[1:])]

    def encode(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk and their bounds by row."""
        data, n = chunk.data, chunk.n
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        cut = _BREAK[data] & after_letters(data)
        cut[chunk.bounds[:-1][chunk.bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        pieces, which = distinct(data, starts)
        found = self.memory.values(pieces)
        size = np.array([len(x) >> 2 for x in found], np.int64)
        first = np.cumsum(size) - size
        size = size[which]
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(first[which] - total[:-1], size) + np.arange(total[-1])
        return np.frombuffer(b"".join(found), "<u4")[place], total[np.searchsorted(starts, chunk.bounds)]


def _tokenizer(path: str) -> Pieces:
    if path not in _tokenizers:
        _tokenizers[path] = Pieces(path)
    return _tokenizers[path]


def _tokenized(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tokenizer(path)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for chunk in T.chunks(batch.column("text"), CHUNK_BYTES):
                ids, bounds = pieces.encode(chunk)
                doc, number, start, length, crc = [], [], [], [], []
                for r in range(chunk.n):
                    own = np.append(ids[bounds[r]:bounds[r + 1]], np.uint32(END)).astype("<u4")
                    raw = memoryview(own.view(np.uint8))
                    size = (len(own) - 1) % capacity + 1
                    at, k = 0, 0
                    while at < len(own):
                        doc.append(ids_of[chunk.first + r])
                        number.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                        at, k, size = at + size, k + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def fullest(available: dict[int, int], room: int) -> list[int]:
    """Lengths with the greatest sum within ``room``, each no oftener than available."""
    reach, steps = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        for _ in range(min(available[length], room // length)):
            grown = reach | reach << length & (1 << room + 1) - 1
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            out.append(length)
            total -= length
    return out


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins) for all items of the histogram.

    Each bin takes the longest item left and the fullest combination beside it, found by a
    bitset of reachable sums; the combination is taken as often as its lengths last.
    """
    left, bins = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest({k: v for k, v in left.items() if v}, capacity - longest)]
        left[longest] += 1
        times = min(left[x] // chosen.count(x) for x in set(chosen))
        for x in set(chosen):
            left[x] -= times * chosen.count(x)
            if not left[x]:
                del left[x]
        bins.append((chosen, times))
    return bins


def _placed(bins: list[tuple[list[int], int]]):
    """Give the piece with rank r among those of its length its bin and place."""
    key, sequence, place, many, lengths = [], [], [], [], []
    used: dict[int, int] = {}
    number = 0
    for chosen, times in bins:
        at = 0
        for length in sorted(set(chosen), reverse=True):
            m = chosen.count(length)
            key.append((length << 40) + used.get(length, 0))
            used[length] = used.get(length, 0) + m * times
            sequence.append(number)
            place.append(at)
            many.append(m)
            at += m * length
        number += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    key, sequence, place, many = (np.array(x, np.int64)[order] for x in (key, sequence, place, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            e = np.searchsorted(key, (length << 40) + rank, "right") - 1
            within = rank - (key[e] & ((1 << 40) - 1))
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[e] + within // many[e]), pa.array(place[e] + within % many[e] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def packed_sequences(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                     slice_rows: int = 5000) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    A document is its ids and one 0; a longer one is cut so that all but its first piece are full.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, where minimum
    bin slack turns it into patterns, at most about one for each length. A piece finds its place
    by its rank among the pieces of its length. Ranks are counted in slices of about
    ``slice_rows`` rows, so a length that very many pieces share is not gathered.

    Null and empty texts are one piece, the 0. Repeated rows are packed each for itself. Other
    columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    work = Workspace(spark, "packing")
    pieces = work.keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _tokenized(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slices = max(1, -(-sum(histogram.values()) // slice_rows))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    before = (sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).drop("n"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (sliced.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "slice"])
              .withColumn("rank", (F.col("rank") + F.col("before")).cast("long")))
    return ranked.mapInArrow(_placed(minimum_slack(histogram, capacity)),
                             "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
