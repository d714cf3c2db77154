"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm.intvectors import LARGEST, integer_vectors, matrix
from supplylens.llm.store import Workspace

BUCKETS = 256
#: rows of a block; a task holds the vectors of two blocks and scores them in slices
BLOCK = 4096
_SLICE = 512
#: below this, whole numbers and their sums are exact in doubles
_EXACT = float(1 << 53)


def _scores(q: np.ndarray, c: np.ndarray, norms: float) -> np.ndarray:
    """All inner products, exact: as doubles where those hold them, else as Python integers held to +-2**61."""
    if norms < _EXACT / 4:
        return q.astype(np.float64) @ c.astype(np.float64).T
    return np.clip(q.astype(object) @ c.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


def _slices(asked: pa.Table, held: pa.Table):
    """Scores of a block's queries with ever new rows of the other block; a query's own row is masked."""
    dim = asked.column("dim")[0].as_py()
    q, c = matrix(asked.column("v"), dim), matrix(held.column("v"), dim)
    rows, others = asked.column("row").to_numpy(), held.column("row").to_numpy()
    norms = max(asked.column("norm").to_numpy()) * max(held.column("norm").to_numpy())
    order = np.argsort(rows)
    for at in range(0, len(c), _SLICE):
        s = _scores(q, c[at:at + _SLICE], norms)
        own = others[at:at + _SLICE]
        i = np.searchsorted(rows, own, sorter=order).clip(max=len(rows) - 1)
        same = np.flatnonzero(rows[order[i]] == own)
        yield at, s, (order[i[same]], same)


def _histogram(span: int, width: int):
    """Counts of a cell's scores by query and bucket, over ``span`` scores from the query's ``low``; buckets that this cell alone shows to be too low are left out."""
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        low, need = asked.column("low").to_numpy(), asked.column("need").to_numpy()
        counts = np.zeros(asked.num_rows * BUCKETS, np.int64)
        for _, s, own in _slices(asked, held):
            if max(-low.min(), low.max()) + span > _EXACT / 4:
                s = s.astype(np.int64)
            s -= low.astype(s.dtype)[:, None]
            inside = (s >= 0) & (s < span)
            inside[own] = False
            # whole numbers below 2**53 divide to the right whole part in doubles
            bucket = (s[inside] // width if s.dtype == np.int64 else s[inside] / width).astype(np.int64)
            counts += np.bincount(np.nonzero(inside)[0] * BUCKETS + bucket, minlength=len(counts))
        counts = counts.reshape(-1, BUCKETS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        i, bucket = np.nonzero((counts > 0) & (above < need[:, None]))
        return pa.table([asked.column("row").to_numpy()[i], bucket.astype(np.int32), counts[i, bucket]], schema=schema)
    return run


def _reached(asked: pa.Table, held: pa.Table) -> pa.Table:
    """What exceeds its query's kth score, and of equal scores the smallest ids, as many as can be needed."""
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
    if not asked.num_rows or not held.num_rows:
        return schema.empty_table()
    held = held.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    low, need = asked.column("low").to_numpy(), asked.column("need").to_numpy()
    left = need.copy()
    rows, ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
    others, names = held.column("row").to_numpy(), held.column("vec_id").combine_chunks()
    out = []
    for at, s, own in _slices(asked, held):
        limit = low.astype(s.dtype)[:, None]
        above, ties = s > limit, s == limit
        above[own] = ties[own] = False
        i, j = np.nonzero(ties)
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        fits = rank < left[i]
        i, j = i[fits], j[fits]
        left -= np.bincount(i, minlength=len(left))
        k, m = np.nonzero(above)
        i, j = np.concatenate([i, k]), np.concatenate([j, m])
        out.append(pa.table([rows[i], ids[i], names.take(pa.array(j + at)), others[j + at], s[i, j].astype(np.int64)], schema=schema))
    return pa.concat_tables(out)


def exact_top_k(spark: SparkSession, vectors: DataFrame, k: int = 20, scale: int = 64, queries: Column | None = None,
                block: int = BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; queries are the rows that ``queries`` selects
    (ids divisible by 20 unless given). Returns ``query_id, rank, vec_id, score``; fewer than
    ``k`` rows where there are fewer others. Equal scores go to the smaller ``vec_id``, null last.

    Queries and rows are dealt into blocks of about ``block``, and a task scores one block of
    queries with one of rows. Each query begins with a range that holds all its scores. A round
    cuts the range in 256 buckets, sums the counts of all cells, and keeps the bucket with the
    kth score; after rounds down to single scores the kth score is known. A last pass keeps what
    exceeds it and the smallest ids that equal it. Nothing but one bound and two counts per
    vector length comes to the driver, and a cell passes on at most about ``k`` rows per query.

    Vectors that are null or hold null or non-finite components take no part; only vectors of
    one length are compared (two empty ones have score 0). Repeated ids and rows are rows of
    their own. Components and scores beyond +-2**61 are held to that. Other columns are ignored.
    """
    work = Workspace(spark, "topk")
    rows = work.keep(integer_vectors(vectors, scale))
    chosen = F.col("vec_id") % 20 == 0 if queries is None else queries
    rows = rows.withColumn("asked", F.coalesce(chosen, F.lit(False)))
    # distinct lengths: at most the square root of twice the number of all components
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asked").alias("m"), F.max("norm").alias("top"))
    sizes = work.keep(sizes.where("m > 0").select("dim", *(F.ceil(F.col(c) / block).cast("int").alias(b) for c, b in (("n", "cells"), ("m", "lists"))), "top"))
    top = sizes.agg(F.max("top")).first()[0]
    reach = min(LARGEST, int((top or 0.0) ** 2 * (1 + 1e-9)) + 2)
    dealt = rows.join(F.broadcast(sizes.drop("top")), "dim")
    cells = dealt.withColumn("cell", F.pmod(F.xxhash64("row"), "cells").cast("int"))
    held = cells.select("row", "vec_id", "dim", "v", "norm", "cell", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    lists = work.keep(dealt.where("asked").select("row", "vec_id", "dim", "v", "norm", "cells",
                                                  F.pmod(F.xxhash64("row", F.lit(1)), "lists").cast("int").alias("list")))
    state = lists.select("row", F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("done"))

    def in_cells(function, schema: str, state: DataFrame) -> DataFrame:
        asked = (lists.join(state, "row").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells"))
        keys = ("dim", "list", "cell")
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(function, schema)

    span = 2 * reach + 1
    while span > 1:
        width = -(-span // BUCKETS)
        counts = in_cells(_histogram(span, width), "row long, bucket int, n long", state.where("not done")).groupBy("row", "bucket").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("row").orderBy(F.desc("bucket"))
        found = (counts.withColumn("sum", F.sum("n").over(from_top)).join(state.select("row", "need"), "row")
                 .where("sum >= need and sum - n < need")
                 .select("row", (F.col("bucket") * F.lit(width).cast("long")).alias("up"), (F.col("sum") - F.col("n")).alias("before")))
        missed = F.col("up").isNull() & ~F.col("done")
        state = work.keep(state.join(found, "row", "left").select(
            "row", F.when(missed, F.lit(-LARGEST - 1)).when(F.col("done"), F.col("low")).otherwise(F.col("low") + F.col("up")).alias("low"),
            F.when(F.col("done") | missed, F.col("need")).otherwise(F.col("need") - F.col("before")).alias("need"),
            (F.col("done") | missed).alias("done")))
        span = width
    reached = in_cells(_reached, "row long, query_id long, vec_id long, other long, score long", state)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return (reached.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
