"""Embedding near-duplicates by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.graph import components
from supplylens.llm.store import Workspace

BLOCK = 64
WIDE = 256
#: block of the comparison of everything, where the lists did not reach the target
WIDEST = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of packed doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can be compared, packed; the others as null."""
    for batch in batches:
        packed = []
        for v in batch.column("embedding").to_pylist():
            good = v is not None and len(v) > 0 and None not in v
            x = np.array(v, np.float32) if good else None
            packed.append(x.tobytes() if good and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "v"])


def _codes(tables: int, bits: int, seed: int):
    """Random-hyperplane codes: the first lists come from vectors with equal codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for part in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
            whole, dims = part, np.array([len(v) // 4 for v in part.column("v").to_pylist()])
            for d in np.unique(dims):
                part = whole.filter(pa.array(dims == d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * bits))
                side = (_matrix(part.column("v")) @ planes[d] > 0).reshape(-1, tables, bits)
                code = side @ (1 << np.arange(bits)) + (np.arange(tables) << 32) + (int(d) << 44)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), tables)),
                                                  pa.array(code.ravel().astype(np.int64))], ["id", "g"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by ``keys``, however it is cut into batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
            new[0] |= not held or held[-1].column(k)[-1].as_py() != v[0]
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(batch)
            continue
        if starts[0] > 0:
            held.append(batch.slice(0, starts[0]))
        if held:
            yield pa.Table.from_batches(held)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _local_join(k: int, threshold: float):
    """Compare the members of each group; report what improves a member's list.

    A member with more than ``k`` partners at the threshold also reports the one with the least
    id, so that dense neighbourhoods hang together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, s, waiting = [], [], [], 0
        for group in _groups(batches, ["g", "part"]):
            ids = group.column("id").to_numpy()
            ids, once = np.unique(ids, return_index=True)
            n = len(ids)
            if n < 2:
                continue
            least = group.column("least").to_numpy()[once]
            x = _unit(_matrix(group.column("v"))[once])
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            top = np.argpartition(-sims, min(k, n - 1) - 1, axis=1)[:, :min(k, n - 1)]
            row = np.repeat(np.arange(n), top.shape[1])
            col = top.ravel()
            good = sims[row, col] > least[row]
            close = sims >= threshold
            dense = np.flatnonzero(close.sum(1) > k)
            row, col = np.concatenate([row[good], dense]), np.concatenate([col[good], close[dense].argmax(1)])
            a.append(ids[row])
            b.append(ids[col])
            s.append(sims[row, col])
            waiting += len(row)
            if waiting > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], ["a", "b", "s"])
                a, b, s, waiting = [], [], [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], ["a", "b", "s"])
    return run


def _counted(threshold: float):
    """Links of each member within a block, or across the two sides of a pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, waiting = [], [], 0
        for group in _groups(batches, ["g", "x", "y"]):
            own, size = group.column("id").to_numpy(), group.column("size").to_numpy()
            x, side = _unit(_matrix(group.column("v"))), group.column("side").to_numpy()
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(q):
                close = x[p] @ x[q].T >= threshold
                found = [(own[p], close @ size[q]), (own[q], size[p] @ close)]
            else:
                close = x @ x.T >= threshold
                np.fill_diagonal(close, False)
                found = [(own, close @ size)]
            for i, c in found:
                ids.append(i)
                sums.append(c)
                waiting += len(i)
            if waiting > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sums))], ["id", "n"])
                ids, sums, waiting = [], [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sums))], ["id", "n"])
    return run


def _crossing(threshold: float):
    """One link for each two components that are linked within a block or across a pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["g", "x", "y"]):
            own, label = group.column("id").to_numpy(), group.column("c").to_numpy()
            x, side = _unit(_matrix(group.column("v"))), group.column("side").to_numpy()
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            q = q if len(q) else p
            i, j = np.nonzero((x[p] @ x[q].T >= threshold) & (label[p][:, None] != label[q]))
            i, j = p[i], q[j]
            pair = np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])])
            _, once = np.unique(pair, axis=1, return_index=True)
            if len(once):
                yield pa.RecordBatch.from_arrays([pa.array(own[i[once]]), pa.array(own[j[once]])], ["a", "b"])
    return run


def _in_blocks(members: DataFrame, size: int, *more: str) -> DataFrame:
    """Each member of a group ``g`` once for each pair of blocks (``x``, ``y``) that its block is in."""
    blocks = members.groupBy("g").agg(F.ceil(F.count("*") / size).alias("m"))
    member = members.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("m")))
    member = member.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    member = member.select("g", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "id", "size", "v",
                           (F.col("own") > F.col("with")).cast("int").alias("side"), *more)
    return _spread(member, ["g", "x", "y"])


def _parted(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Split groups with more than ``size`` rows into parts by hash; no row is lost."""
    count = rows.groupBy(group).agg(F.count("*").alias("m")).where("m > 1")
    return rows.join(count, group).withColumn("part", F.pmod(F.xxhash64(group, "id"), F.ceil(F.col("m") / size)))


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each id, from pairs in either direction."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "s").union(pairs.select("b", "a", "s"))
    best = both.groupBy("id", "other").agg(F.max("s").alias("s"))
    return best.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "other")), asc=False), 1, k).alias("list"))


def _audit(vectors: DataFrame, found: DataFrame, threshold: float, queries: int) -> float:
    """Share of its true links that has been counted, as the mean of those of ``queries`` vectors that have links.

    Each vector counts once, so a large cluster does not hide what small groups and lone pairs
    miss. The queries are bounded.
    """
    asked = vectors.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    by_dim: dict[int, list] = {}
    for r in asked:
        by_dim.setdefault(len(r.v), []).append(r)
    wanted = {d: (np.array([r.id for r in own]), _unit(np.stack([np.frombuffer(r.v, np.float32) for r in own]))) for d, own in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("v").to_pylist()])
            for d in np.unique(dims):
                if d not in wanted:
                    continue
                part = batch.filter(pa.array(dims == d))
                ids, x = wanted[d]
                close = _unit(_matrix(part.column("v"))) @ x.T >= threshold
                close &= part.column("id").to_numpy()[:, None] != ids
                for i, n in zip(ids.tolist(), (part.column("size").to_numpy() @ close).tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])
    true = vectors.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("links")).where("links > 0")
    r = true.join(found, "id", "left").agg(F.avg(F.least("links", F.coalesce("n", F.lit(0))) / F.col("links")).alias("share")).first()
    return 1.0 if r.share is None else r.share


def _tables(least: int, bits: int, threshold: float, sure: float = 0.99) -> int:
    """How many tables let a pair at the threshold have equal codes in one of them with ``sure``."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return least if same >= 1 else max(least, min(4095, int(np.ceil(np.log(1 - sure) / np.log1p(-same)))))


def _totals(points: DataFrame, links: DataFrame, threshold: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The components of the links, and each member's number of links within its component."""
    joined = work.keep(components(links, work))
    members = points.join(joined.toDF("id", "g"), "id").select("id", "size", "v", "g")
    counted = _in_blocks(members, WIDE).mapInArrow(_counted(threshold), "id long, n long")
    return joined, work.keep(counted.groupBy("id").agg(F.sum("n").alias("n")))


def embedding_neighbours(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, k: int = 10, tables: int = 10,
                         rounds: int = 2, most_rounds: int = 6, target: float = 0.98, queries: int = 512) -> DataFrame:
    """Links of vectors with a cosine of at least ``threshold``, in double precision.

    Returns one row per input row: ``vec_id, n_links, component_id, kept``.

    * Equal vectors are one class with a size.
    * Lists of ``k`` neighbours start from groups with equal random-hyperplane codes and are
      refined: all neighbours and reverse neighbours of a vector are compared with each other.
      Groups are split by hash where they are large, so a hub is not gathered and loses no row.
    * A list that is full of links is saturated; it is enlarged to its whole component, whose
      members are compared block by block and counted, not listed. So any number of links is
      exact within a component, in memory bounded by the block.
    * There are as many tables (``tables`` at least) as let a lone pair at the threshold meet in
      one of them with 99 %: the codes get longer with the rows.
    * The recall is audited on ``queries`` vectors against all, each vector with links counting
      once. While it is below ``target``, fresh tables and a further round are added; if
      ``most_rounds`` do not suffice, all vectors are compared block by block, which is exact
      and costs the square of the rows.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, nor
    do vectors of different lengths. Rows without a ``vec_id`` have no component. Rows that
    repeat an id with the same vector are links of each other. Other columns are ignored.
    """
    work = Workspace(spark, "vectors")
    rows = work.keep(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(
        _usable, "vec_id long, v binary").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), "v")}))
    classes = work.keep(rows.where("v is not null and vec_id is not null").groupBy("k1", "k2")
                        .agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v").alias("v")))
    # an id that is repeated with several vectors stands for each of them by its least key
    points = work.keep(classes.groupBy("id").agg(F.min(F.struct("k1", "k2", "size", "v")).alias("c"))
                       .select("id", "c.size", "c.v", "c.k1", "c.k2"))
    n = points.count()
    bits = max(1, min(30, int(np.ceil(np.log2(max(2, n) / 32)))))
    tables = _tables(tables, bits, threshold)
    coded = points.mapInArrow(_codes(tables, bits, 1), "id long, g long")
    floor = F.lit(-1.5)
    side = points.select("id", "v")
    start = _parted(coded, "g", BLOCK).select("g", "part", "id").join(side, "id").withColumn("least", floor)
    pairs = work.keep(_spread(start, ["g", "part"]).mapInArrow(_local_join(k, threshold), "a long, b long, s double"))
    links, turn = pairs.where(F.col("s") >= threshold).select("a", "b"), 0
    lists = work.keep(_lists(pairs, k))
    while True:
        for _ in range(rounds if turn == 0 else 1):
            turn += 1
            near = lists.select("id", F.explode("list").alias("x")).select("id", F.col("x.other").alias("other"))
            spokes = near.select(F.col("id").alias("g"), F.col("other").alias("id")).union(
                near.select(F.col("other").alias("g"), "id")).union(lists.select(F.col("id").alias("g"), "id")).distinct()
            worst = lists.select("id", F.when(F.size("list") >= k, F.col("list")[k - 1]["s"]).otherwise(floor).alias("least"))
            group = _parted(spokes, "g", BLOCK).select("g", "part", "id").join(side.join(worst, "id"), "id")
            if turn > rounds:  # the audit asked for more: fresh tables; their codes are apart from ids by their part
                fresh = _parted(points.mapInArrow(_codes(tables, bits, turn), "id long, g long"), "g", BLOCK)
                group = group.union(fresh.select("g", (-1 - F.col("part")).alias("part"), "id")
                                    .join(side.join(worst, "id", "left").withColumn("least", F.coalesce("least", floor)), "id")
                                    .select(*group.columns))
            pairs = work.keep(_spread(group, ["g", "part"]).mapInArrow(_local_join(k, threshold), "a long, b long, s double"))
            links = links.union(pairs.where(F.col("s") >= threshold).select("a", "b"))
            old = lists.select(F.col("id").alias("a"), F.explode("list").alias("x")).select("a", F.col("x.other").alias("b"), F.col("x.s").alias("s"))
            lists = work.keep(_lists(pairs.union(old), k))
        joined, counted = _totals(points, links, threshold, work)
        if _audit(points, counted, threshold, queries) >= target:
            break
        if turn >= most_rounds:
            labels = (points.join(joined.toDF("id", "c"), "id", "left")
                      .select(F.length("v").alias("g"), "id", "size", "v", F.coalesce("c", "id").alias("c")))
            links = links.union(_in_blocks(labels, WIDEST, "c").mapInArrow(_crossing(threshold), "a long, b long"))
            joined, counted = _totals(points, links, threshold, work)
            break
    known = (points.join(counted, "id", "left").join(joined.toDF("id", "c"), "id", "left")
             .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("c", "id").alias("c")))
    return (rows.select("vec_id", "k1", "k2", (F.col("v").isNotNull() & F.col("vec_id").isNotNull()).alias("usable")).join(known, ["k1", "k2"], "left")
            .select("vec_id", F.when(F.col("usable"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("usable"), F.coalesce("c", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


