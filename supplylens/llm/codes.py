"""Compression of vectors to codes of parts: integer k-means with dictionaries of the values of each dimension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.intvectors import integer_vectors, matrix
from supplylens.llm.store import Workspace

#: rows of a block; a dictionary has at most as many values
BLOCK = 8192
_LONG = (1 << 63) - 1


@dataclass
class Codebooks:
    """The entries of all parts: ``entries[e]`` is a whole vector, part p of it is cut at ``bounds[p]``."""
    entries: list[list[int]]
    bounds: list[int]

    @property
    def parts(self) -> int:
        return len(self.bounds) - 1

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, joined by commas."""
        values = (str(x) for p in range(self.parts) for e in self.entries for x in e[self.bounds[p]:self.bounds[p + 1]])
        return hashlib.sha256(",".join(values).encode()).hexdigest()


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: for each dimension its distinct integers, for each component its place among them."""
    for part in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
        dim = part.column("dim")[0].as_py()
        x = matrix(part.column("v"), dim)
        pairs = [np.unique(x[:, i], return_inverse=True) for i in range(dim)]
        codes = np.array([code for _, code in pairs], np.uint16).reshape(dim, len(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.column(c).to_pylist()]) if c != "label" else pa.array([part.column(c).to_pylist()], pa.list_(pa.string())) for c in ("vec_id", "label")]
            + [pa.array([b"".join(values.tobytes() for values, _ in pairs)], pa.binary()),
               pa.array([[len(values) for values, _ in pairs]], pa.list_(pa.int32())), pa.array([codes.tobytes()], pa.binary())],
            ["vec_id", "label", "values", "sizes", "codes"])


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Each block's row of columns, the values of each dimension and the codes (dimension by row)."""
    for batch in batches:
        for r in range(batch.num_rows):
            sizes = batch.column("sizes")[r].as_py()
            values = np.split(np.frombuffer(batch.column("values")[r].as_py(), np.int64), np.cumsum(sizes)[:-1]) if sizes else []
            n = len(batch.column("vec_id")[r])
            yield batch, r, values, np.frombuffer(batch.column("codes")[r].as_py(), np.uint16).reshape(len(sizes), n)


def _nearest(books: Codebooks, values: list[np.ndarray], codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By part: each row's nearest entry (ties to the lower) and its squared distance.

    The squared difference of every value of a dimension to all entries is worked out once;
    a row's distance is then gathered by its codes and added up. Where squares could pass a
    long, Python integers do the same.
    """
    largest = max((abs(int(x)) for v in values for x in (v[:1], v[-1:]) if len(x)), default=0)
    largest += max((abs(x) for e in books.entries for x in e), default=0)
    kind = np.int64 if largest ** 2 * max(1, len(values)) < _LONG else object
    for p in range(books.parts):
        total = np.zeros((codes.shape[1], len(books.entries)), kind)
        for i in range(books.bounds[p], books.bounds[p + 1]):
            own = np.array([e[i] for e in books.entries], kind)
            total += ((values[i].astype(kind)[:, None] - own) ** 2)[codes[i]]
        nearest = total.argmin(axis=1)
        yield nearest, total[np.arange(len(total)), nearest]


def _sums(books: Codebooks):
    """Of the rows of one task: how many parts are nearest to each entry, and their sums by position.

    A sum is given in two longs, ``high * 2**32 + low``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = len(books.entries), books.bounds[-1]
        high, low, n = np.zeros((dim, k), np.int64), np.zeros((dim, k), np.int64), np.zeros((dim, k), np.int64)
        for _, _, values, codes in _blocks(batches):
            for p, (nearest, _) in enumerate(_nearest(books, values, codes)):
                for i in range(books.bounds[p], books.bounds[p + 1]):
                    # how often each value meets each entry
                    met = np.bincount(codes[i].astype(np.int64) * k + nearest, minlength=len(values[i]) * k).reshape(-1, k)
                    high[i] += (met * (values[i] >> 32)[:, None]).sum(axis=0)
                    low[i] += (met * (values[i] & 0xFFFFFFFF)[:, None]).sum(axis=0)
                    n[i] += met.sum(axis=0)
        i, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[i, e]), pa.array(high[i, e]), pa.array(low[i, e])],
            ["i", "e", "n", "high", "low"])
    return run


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, r, values, codes in _blocks(batches):
            found = list(_nearest(books, values, codes))
            marks = np.array([nearest for nearest, _ in found], np.uint8).T
            error = sum((d for _, d in found), np.zeros(codes.shape[1], np.int64))
            if error.dtype == object:
                error = np.array([min(int(x), _LONG) for x in error], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("vec_id")[r].as_py(), pa.int64()), pa.array(batch.column("label")[r].as_py(), pa.string()),
                 pa.array([bytes(row).hex() for row in marks], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
    return run


def compressed_vectors(spark: SparkSession, vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6,
                       scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, ``vec_id, label, code, error``, and the codebooks that decode them.

    Components become ``floor(scale * x)``. Vectors are cut into ``parts`` equal parts; each
    part position has a codebook that begins with the parts of the rows with the smallest ids
    and is refined in ``rounds`` rounds of integer k-means. Rows are kept in blocks with a
    dictionary of the distinct integers of each dimension, written once and read by each round.
    A round sends the driver one sum per entry and position: as many numbers as the codebooks
    have, whatever the number of rows. ``code`` has two hex digits for each part.

    Null vectors and those with null or non-finite components are dropped, as are vectors of
    another length than the commonest (of equally common ones the shortest). Where ``parts``
    does not divide the length, part p ends at ``length * (p + 1) // parts``; empty parts have
    index 0. Fewer rows than ``entries`` make smaller codebooks. Rows with one id start the
    codebooks in the order of their packed vectors; a null id comes last. Components beyond
    +-2**61 are held to that, errors to the largest long. Repeated rows are coded each; an
    empty table gives no rows. ``label`` is null where the table has none; others are ignored.
    """
    if "label" not in vectors.columns:
        vectors = vectors.withColumn("label", F.lit(None).cast("string"))
    work = Workspace(spark, "codes")
    rows = work.keep(integer_vectors(vectors, scale, "label"))
    commonest = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = commonest.dim if commonest else 0
    rows = rows.where(F.col("dim") == dim)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = Codebooks([np.frombuffer(r.v, np.int64).tolist() for r in first], [dim * p // parts for p in range(parts + 1)])
    blocks = work.keep(rows.mapInArrow(_dictionaries, "vec_id array<long>, label array<string>, values binary, sizes array<int>, codes binary"))
    for _ in range(rounds):
        sums = (blocks.mapInArrow(_sums(books), "i int, e int, n long, high long, low long")
                .groupBy("i", "e").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")))
        new = [list(e) for e in books.entries]
        for r in sums.collect():
            new[r.e][r.i] = ((r.high << 32) + r.low) // r.n
        books = Codebooks(new, books.bounds)
    return blocks.mapInArrow(_coded(books), "vec_id long, label string, code string, error long"), books


def label_errors(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows with an equal label (nulls together) added up."""
    work = Workspace(spark, "codes")
    coded = work.keep(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    totals = work.keep(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
