"""K-d tree sharding: recursive splits at weighted medians, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm.store import Workspace

BINS = 4096
#: a cut ends where what is left to part is this share of the weight wanted below it
FINE = 0.0005


@dataclass
class Node:
    """A box of the tree that still holds ``leaves`` leaves, numbered from ``first``."""
    first: int
    leaves: int


def _spread(rows: DataFrame, nodes: list[Node], dims: list[str]) -> dict[int, dict]:
    out = rows.where(F.col("leaf").isin([x.first for x in nodes])).groupBy("leaf").agg(
        F.sum("weight").alias("weight"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))))
    return {r.leaf: r.asDict() for r in out.collect()}


def _cuts(rows: DataFrame, asked: dict[int, tuple[list[str], float]]) -> dict[int, list[tuple[str, int]]]:
    """For each box the exact cut of its weight in the order of its dimensions.

    ``asked`` has per box the dimensions, the second and later ones for ties, and the weight
    wanted below the cut. A cut is found by histograms of at most ``BINS`` sums: each pass goes
    into the bin that holds the median, until the bin is one value; then the next dimension is
    cut within that value. A bin with one row, or at most ``FINE`` of the weight wanted, is
    not parted.
    """
    found: dict[int, list[tuple[str, int]]] = {k: [] for k in asked}
    inside: dict[int, Column] = {k: F.col("leaf") == k for k in asked}
    below = {k: 0.0 for k in asked}
    dims = {k: list(v[0]) for k, v in asked.items()}
    while any(dims.values()):
        live = [k for k in asked if dims[k]]
        spread = {}
        picked = F.lit(None).cast("long")
        for k in live:
            picked = F.when(inside[k], F.col(dims[k][0])).otherwise(picked)
        held = rows.withColumn("v", picked).where(F.coalesce(*(F.when(inside[k], F.lit(True)) for k in live)))
        spread = {r.leaf: (r.lo, r.hi) for r in held.groupBy("leaf").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        open_ = dict(spread)
        while open_:
            step = {k: max(1, -(-(hi - lo + 1) // BINS)) for k, (lo, hi) in open_.items()}
            bin_ = F.lit(None).cast("long")
            for k, (lo, hi) in open_.items():
                bin_ = F.when((F.col("leaf") == k) & F.col("v").between(lo, hi),
                              F.expr(f"(v - ({lo}L)) div {step[k]}L")).otherwise(bin_)
            sums: dict[int, list] = {k: [] for k in open_}
            for r in held.withColumn("bin", bin_).where("bin is not null").groupBy("leaf", "bin").agg(
                    F.sum("weight").alias("w"), F.count("*").alias("n")).collect():
                sums[r.leaf].append((int(r.bin), float(r.w), r.n))
            after = {}
            for k, own in sums.items():
                (lo, hi), goal = open_[k], asked[k][1]
                for b, w, n in sorted(own):
                    if below[k] + w >= goal or b == max(own)[0]:
                        low, high = lo + b * step[k], min(hi, lo + (b + 1) * step[k] - 1)
                        break
                    below[k] += w
                if n == 1 or w <= FINE * goal:
                    found[k].append((dims[k][0], high))
                    dims[k] = []
                elif low == high:
                    found[k].append((dims[k].pop(0), low))
                    inside[k] = inside[k] & (F.col(found[k][-1][0]) == low)
                else:
                    after[k] = (low, high)
            open_ = after
    return found


def _is_below(cut: list[tuple[str, int]]) -> Column:
    """Rows at or before the cut in the order of its dimensions."""
    out = F.lit(True)
    for dim, value in reversed(cut):
        out = (F.col(dim) < value) | ((F.col(dim) == value) & out)
    return out


def kd_leaves(rows: DataFrame, work: Workspace, dims: list[str], ties: list[str], leaves: int) -> DataFrame:
    """Add ``leaf`` to rows with a ``weight``: boxes of near equal weight.

    All dimensions are longs without nulls. Each level splits every box at the weighted median
    of the dimension that is widest in it, as a share of that dimension's width over all rows.
    Equal values are parted by ``ties``, so one value with very many rows can be split. Only
    bounded histograms reach the driver.
    """
    rows = rows.withColumn("leaf", F.lit(0))
    nodes = [Node(0, leaves)]
    whole = None
    while any(x.leaves > 1 for x in nodes):
        split = [x for x in nodes if x.leaves > 1]
        spread = _spread(rows, split, dims)
        whole = whole or spread.get(0)
        split = [x for x in split if x.first in spread]
        if not split:
            break
        asked = {}
        for x in split:
            own = spread[x.first]
            width = {d: (own[f"hi_{d}"] - own[f"lo_{d}"]) / max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"]) for d in dims}
            widest = max(dims, key=lambda d: (width[d], -dims.index(d)))
            asked[x.first] = ([widest, *(t for t in ties if t != widest)], float(own["weight"]) * (x.leaves // 2) / x.leaves)
        cuts = _cuts(rows, asked)
        leaf, nodes = F.col("leaf"), [x for x in nodes if x not in split]
        for x in split:
            half = x.leaves // 2
            leaf = F.when((F.col("leaf") == x.first) & ~_is_below(cuts[x.first]), F.lit(x.first + half)).otherwise(leaf)
            nodes += [Node(x.first, half), Node(x.first + half, x.leaves - half)]
        rows = rows.withColumn("leaf", leaf)
    return rows


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 8, slice_rows: int = 5000,
            together: float = 0.01) -> DataFrame:
    """Put all documents into ``shards`` shards of near equal bytes.

    Returns one row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    The law is ``bytes``: a document weighs its UTF-8 bytes plus 1, and the tree is split until a
    leaf holds the total over ``shards``. The metadata dimensions are source, language, size and
    id; ties fall to the checksum of the text, then the id. Equal texts share the least metadata
    among them and stay together, unless they weigh more than ``together`` of a shard: such a
    group is split like other rows, so it cannot make shards uneven. Slots number the rows of a
    shard from 0 without gaps; they are counted in slices of about ``slice_rows`` rows.

    Null texts have no bytes and checksum 0; null ids and other null metadata come first in
    their dimension. Rows alike in everything fall on one side of a cut. A table without
    ``source`` or ``lang`` has those dimensions constant.
    """
    work = Workspace(spark, "shards")
    names = set(docs.columns)
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in names else F.lit(0).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = work.keep(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("weight"), F.crc32(text).alias("crc"),
        code("source").alias("source"), code("lang").alias("lang"), # two bits less, so that differences of any two values are longs
        F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 2), F.lit(-2**61 - 1)).alias("id"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text), 2).alias("h"), F.xxhash64(text).alias("t")))
    most = (rows.agg(F.sum("weight").alias("w")).first().w or 0) * together / shards
    point = ["source", "lang", "id", "h"]
    # written, so that the join is free to split the rows of a large group
    groups = work.keep(rows.groupBy("crc", "t").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), *(F.min(c).alias(f"g_{c}") for c in point))
              .where((F.col("n") > 1) & (F.col("w") <= most)).drop("n", "w"))
    rows = work.keep(rows.join(groups, ["crc", "t"], "left").select(
        "doc_id", "weight", F.col("weight").alias("size"), "crc", F.col("h").alias("row"),
        *(F.coalesce(f"g_{c}", c).alias(c) for c in point)))
    leaves = work.keep(kd_leaves(rows, work, ["source", "lang", "size", "id"], ["crc", "id", "h"], shards))
    total = leaves.count()
    slices = max(1, -(-total // slice_rows))
    sliced = leaves.withColumn("slice", F.pmod(F.col("row"), F.lit(slices)))
    before = (sliced.groupBy("leaf", "slice").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("leaf").orderBy("slice")) - F.col("n")).drop("n"))
    own = Window.partitionBy("leaf", "slice").orderBy("row")
    return (sliced.withColumn("k", F.row_number().over(own)).join(before, ["leaf", "slice"])
            .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("leaf").alias("shard"),
                    (F.col("k") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
