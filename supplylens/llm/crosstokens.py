"""Alignment of two tokenizers over whole texts: groups between common ends, links, and corpus-wide counts of id pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm import textarrays as T
from supplylens.llm.pieces import ByteLevel, Memory, after_letters, distinct
from supplylens.llm.store import Workspace

CHUNK_BYTES = 2 << 20
_SPACE = "▁"
_workers: dict[tuple[str, str], "Tokenizers"] = {}

_CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, groups array<string>, segments binary, segment_bounds binary, links binary, "
          "link_sizes binary, pairs array<long>, times array<long>")
_ROW = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")


def common_slices(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end in the first and in the second list of cumulative ends.

    Dictionaries lead from an end to its place; the ends that both hold, sorted, cut both lists.
    """
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return np.array([a_at[end] for end in common], np.int64), np.array([b_at[end] for end in common], np.int64)


def slice_links(a_ends: np.ndarray, b_ends: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens whose byte ranges overlap, slice after slice."""
    a_size, b_size = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    single = (a_size == 1) & (b_size == 1)
    rest = np.flatnonzero(~single)
    # within the other slices each token of A meets the run of B tokens from its first to its last byte
    i = _flat(to_a[rest] - a_size[rest], a_size[rest])
    begin = np.concatenate([[0], a_ends])[i]
    first, last = np.searchsorted(b_ends, begin, "right"), np.searchsorted(b_ends, a_ends[i], "left")
    many = last - first + 1
    a, b = np.concatenate([to_a[single] - 1, np.repeat(i, many)]), np.concatenate([to_b[single] - 1, _flat(first, many)])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


class Tokenizers:
    """Both tokenizers and the bytes of their tokens.

    Tokenizer A never joins a blank with the word before it, and no piece of B has a blank
    behind another sign (else nothing is cut). So a text is cut before each blank that follows
    such a sign, and what one distinct piece gives is worked out once.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        self.a = ByteLevel(a_path, plain=True)
        self.b = SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(_SPACE, " ").encode() for i, name in enumerate(names)]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.cuts = not any(_SPACE in name.lstrip(_SPACE) for name in names)
        # the decimal names of all ids of A, then of B, each with room for one sign
        texts = [f"{i} ".encode() for n in (len(self.a.bytes), len(names)) for i in range(n)]
        self.names = np.frombuffer(b"".join(texts), np.uint8)
        self.name_sizes = np.array([len(x) - 1 for x in texts], np.int64)
        self.name_starts = np.cumsum(self.name_sizes + 1) - self.name_sizes - 1
        self.memory = Memory(self._aligned)

    def _aligned(self, pieces: list[bytes]) -> list[tuple | bool]:
        """For each piece its counts, its groups as text and its linked ids; False where the tokens are not its bytes."""
        a, a_bounds = self.a.encode(pieces)
        lists = self.b.encode([p.decode("utf-8", "replace")[1:] for p in pieces], num_threads=1)
        flat = [i for x in lists for i in x]
        whole = b"".join(pieces)
        if b"".join([self.b_bytes[i] for i in flat]) == whole and b"".join([self.a.bytes[i] for i in a.tolist()]) == whole:
            return self._all(pieces, a, a_bounds, np.array(flat, np.int64), np.cumsum([0, *map(len, lists)]))
        good = [b"".join([self.b_bytes[j] for j in lists[i]]) == p and b"".join([self.a.bytes[j] for j in a[a_bounds[i]:a_bounds[i + 1]].tolist()]) == p
                for i, p in enumerate(pieces)]
        right = iter(self._aligned([p for p, g in zip(pieces, good) if g]) if any(good) else ())
        return [next(right) if g else False for g in good]

    def _all(self, pieces: list[bytes], a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> list[tuple]:
        """Pieces laid one after another: both token lists cover the same bytes, and no group crosses a piece's end."""
        a_ends, b_ends = np.cumsum(self.a.sizes[a]), np.cumsum(self.b_sizes[b])
        to_a, to_b = common_slices(a_ends.tolist(), b_ends.tolist())
        text, text_ends = self._group_texts(a, b, to_a, to_b)
        i, j = slice_links(a_ends, b_ends, to_a, to_b)
        pairs = (a[i].astype(np.int64) << 32 | b[j]).tobytes()
        groups = np.concatenate([[0], np.searchsorted(to_a, a_bounds[1:], "left") + 1])
        cuts = np.concatenate([[0], text_ends])[groups].tolist()
        linked = (8 * np.searchsorted(i, a_bounds)).tolist()
        counts = (np.diff(a_bounds).tolist(), np.diff(b_bounds).tolist(), np.diff(groups).tolist())
        return [(n_a, n_b, n, text[at:to - 1], pairs[x:y]) for n_a, n_b, n, at, to, x, y in zip(
            *counts, cuts[:-1], cuts[1:], linked[:-1], linked[1:])]

    def _group_texts(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;``, one after another, and where each ends."""
        # ids in the order they are written: the A ids of a group, then its B ids
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(to_b - n_b, n_a)] = a
        order[np.arange(len(b)) + np.repeat(to_a, n_b)] = b + len(self.a.bytes)
        sign = np.full(len(order), ord(","), np.uint8)
        sign[to_a + to_b - n_b - 1], sign[to_a + to_b - 1] = ord("|"), ord(";")
        size = self.name_sizes[order] + 1
        ends = np.cumsum(size)
        out = self.names[_flat(self.name_starts[order], size)]
        out[ends - 1] = sign
        return out.tobytes(), ends[to_a + to_b - 1]


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _workers:
        _workers[a_path, b_path] = Tokenizers(a_path, b_path)
    return _workers[a_path, b_path]


def _spaced(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A blank before each text that is not empty, and the new bounds."""
    size = np.diff(chunk.bounds)
    bounds = np.concatenate([[0], np.cumsum(size + (size > 0))])
    own = np.ones(bounds[-1], bool)
    own[bounds[:-1][size > 0]] = False
    data = np.full(bounds[-1], 0x20, np.uint8)
    data[own] = chunk.data
    return data, bounds


def _total(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between bounds."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _planes(numbers: np.ndarray) -> bytes:
    """How many bytes the largest number takes, then all lowest bytes, all next ones and so on.

    Pieces and pairs are numbered so that small numbers are common; higher bytes are mostly alike.
    """
    n = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([n]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return sum(parts[k].astype(np.int64) << 8 * k for k in range(raw[0]))


def _flat(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _chunks(a_path: str, b_path: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in T.chunks(batch.column("text"), CHUNK_BYTES):
                yield _chunk(both, number, batch.column("doc_id").slice(chunk.first, chunk.n), *_spaced(chunk), with_groups)
                number += 1
    return run


def _chunk(both: Tokenizers, number: int, ids: pa.Array, data: np.ndarray, bounds: np.ndarray, with_groups: bool) -> pa.RecordBatch:
    """One row for a chunk of documents: their counts, their pieces, and the linked ids of each distinct piece."""
    n = len(bounds) - 1
    cut = (data == 0x20) & after_letters(data) if both.cuts else np.zeros(len(data), bool)
    full = np.flatnonzero(np.diff(bounds))
    cut[bounds[full + 1] - 1] = False  # a blank alone would lose the one that B adds
    cut[bounds[full]] = True
    starts = np.flatnonzero(cut)
    pieces, which = distinct(data, starts)
    at = np.searchsorted(starts, bounds)
    found = both.memory.values(pieces)
    good = np.array([v is not False for v in found], bool)
    wrong = np.flatnonzero(_total(~good[which], at)) if not good.all() else np.empty(0, np.int64)
    whole = [data[bounds[r]:bounds[r + 1]].tobytes() for r in wrong]  # a whole text decides where its pieces fail
    found = [v or (0, 0, 0, b"", b"") for v in found + both.memory.values(whole)]
    if len(wrong):
        runs = [which[at[r]:at[r + 1]] for r in range(n)]
        for k, r in enumerate(wrong):
            runs[r] = np.array([len(pieces) + k] if found[len(pieces) + k][0] else [], np.int64)
        at = np.concatenate([[0], np.cumsum([len(x) for x in runs])])
        used, which = np.unique(np.concatenate(runs).astype(np.int64), return_inverse=True)
        found = [found[i] for i in used]
    counts = [np.array([v[i] for v in found], np.int64)[which] for i in range(3)]
    texts = [v[3] for v in found]
    groups = [b";".join([texts[i] for i in which[at[r]:at[r + 1]].tolist()]) for r in range(n)]
    linked = np.frombuffer(b"".join(v[4] for v in found), np.int64)
    n_links = np.array([len(v[4]) >> 3 for v in found], np.int64)
    pairs, local = np.unique(linked, return_inverse=True)
    often = np.bincount(which, minlength=len(found))
    times = np.bincount(local, np.repeat(often, n_links), len(pairs)).astype(np.int64)  # exact: far below 2**53
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())),
        *(pa.array([_total(x, at).tolist()], pa.list_(pa.int64())) for x in (*counts, n_links[which])),
        pa.array([[hashlib.sha256(g).hexdigest() if g else "" for g in groups]], pa.list_(pa.string())),
        pa.array([[g.decode() for g in groups] if with_groups else None], pa.list_(pa.string())),
        *(pa.array([_planes(x)], pa.binary()) for x in (which, at, local, n_links)),
        pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([times.tolist()], pa.list_(pa.int64()))],
        [c.split()[0] for c in _CHUNK.split(", ")])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from chunks that know the corpus-wide counts of their pairs, in the order of the pairs."""
    for batch in batches:
        for row in batch.to_pylist():
            looked = row["looked"] or []
            total = np.array([x["total"] for x in looked], np.int64)
            best = np.array([x["best"] for x in looked], bool)
            which, at, local, sizes = (_from_planes(row[c]) for c in ("segments", "segment_bounds", "links", "link_sizes"))
            link_bounds = np.concatenate([[0], np.cumsum(sizes)])
            sums = [_total(_total(x[local].astype(np.int64), link_bounds)[which], at) if len(which) else np.zeros(len(at) - 1, np.int64) for x in (best, total)]
            yield pa.RecordBatch.from_arrays([
                *(pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *(pa.array(x) for x in sums),
                pa.array(row["groups_sha256"], pa.string()), pa.array(row["groups"] or [None] * len(row["doc_id"]), pa.string())],
                [c.split()[0] for c in _ROW.split(", ")])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair`` (first id times 2**32 plus second), ``total`` links, ``best``: no pair of its second id has more."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("total"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    top = each.groupBy(second.alias("second")).agg(F.max("total").alias("top"))
    return each.join(top, second == F.col("second")).select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def aligned_documents(spark: SparkSession, docs: DataFrame, a_path: str | None = None, b_path: str | None = None,
                      with_groups: bool = False) -> DataFrame:
    """Token alignment of each text between a byte-level tokenizer (A) and a piece tokenizer (B).

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups``.
    A encodes a blank and the text, B the text, to which it adds a blank. Ends of tokens that
    both share cut them into groups; all A-B occurrences with overlapping bytes are links.
    ``groups`` (``a1,a2|b1;a3|b2,b3``) is null unless ``with_groups``.

    Texts are read in chunks of about 2 MB. A chunk keeps its distinct pieces once; the counts of
    id pairs are summed first within chunks, so even a pair that every document holds has one row
    per chunk, and each chunk gets the counts of its own pairs back. Nothing comes to the driver.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for byte
    (B writes U+2581 for a blank), have zeros and ''. Repeated rows are each counted. Texts of any
    length are read whole. Other columns are ignored.
    """
    if a_path is None or b_path is None:
        import public_tokenizers
        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    work = Workspace(spark, "crosstokens")
    chunks = work.keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _chunks(a_path, b_path, with_groups), _CHUNK))
    totals = work.keep(pair_counts(chunks))
    looked = (chunks.select("chunk", F.explode("pairs").alias("pair")).join(totals, "pair")
              .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "total", "best"))).alias("looked")))
    return chunks.drop("pairs", "times").join(work.keep(looked), "chunk", "left").mapInArrow(_documents, _ROW)
