"""Ordered computations that no single task has to hold: running totals, exact quantiles.

A global window would pull all rows into one partition. Here Spark sorts the rows into ranges
of bounded size, however large the table is, the sorted rows are written so that the ranges
stay fixed, and each range works on its own rows plus a carry from the ranges before it. The
carry table has one row per range and group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.session import kept, stored

#: what the rows of one range weigh about, before compression; small tables are still dealt over all cores
RANGE_BYTES, LEAST_RANGE_BYTES = 32 << 20, 1 << 20


def _sorted(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """The rows sorted in ranges, and the number of ranges: it follows the measured size of the rows."""
    rows = df if stored(df) else kept(df)
    loose = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in rows.schema.fields
             if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    count, text = rows.agg(F.count("*"), F.coalesce(F.sum(sum(loose, F.lit(0)).cast("bigint")), F.lit(0))).first()
    size = count * (16 + 8 * len(rows.columns)) + text
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil(size / RANGE_BYTES), min(cores, math.ceil(size / LEAST_RANGE_BYTES)))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order), n


def _written(ranges: DataFrame) -> DataFrame:
    return kept(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str],
                   group: list[str] | None = None) -> DataFrame:
    """Add ``name`` (total up to and including the row) and ``name_total`` per group.

    ``order`` has to be unique within a group for a repeatable result; ``sums`` maps new
    names to numeric columns; ``group`` columns must not be NULL.
    """
    group = group or []
    ranges, pieces = _sorted(df, [F.col(c) for c in group] + order)
    rows, keys = _written(ranges), [*group, "_range"]
    parts = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*group).orderBy("_range")
    whole = Window.partitionBy(*group)
    carry = parts.select(
        *keys,
        *[F.coalesce(F.sum(f"_{n}").over(ahead.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"_{n}_carry") for n in sums],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in sums])
    inside = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.repartition(pieces, *keys).join(carry, keys)
    for name, column in sums.items():
        joined = joined.withColumn(name, F.col(f"_{name}_carry") + F.coalesce(
            F.sum(column).over(inside), F.lit(0)))
    return joined.drop("_range", "_place", *[f"_{n}_carry" for n in sums])


def _last_seen(column: str, kind: T.DataType) -> Column:
    """For each row of a task's stream the last value so far that is not NULL."""
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:  # sent by value: it names nothing of this package
        last = None
        for array in arrays:
            array = pa.concat_arrays([pa.nulls(1, array.type) if last is None else last, array])
            filled = np.asarray(array.is_valid())
            seen = array.take(pa.array(np.maximum.accumulate(np.where(filled, np.arange(len(array)), 0))))
            last = seen.slice(len(seen) - 1)
            yield seen.slice(1)

    return F.arrow_udf(run, kind).asNondeterministic()(column)


def carry_forward(df: DataFrame, order: list[Column], columns: dict[str, Column]) -> DataFrame:
    """Add, under each name, the last non-NULL value of the Column up to the row.

    The values run along with the sorted rows of a range, which no window has to hold; only
    the rows before the first value of a range look up the carry, one row per range.
    """
    named = {f"_c{i}": (name, column) for i, (name, column) in enumerate(columns.items())}
    ranges = _sorted(df, order)[0].withColumns({c: spec[1] for c, spec in named.items()})
    rows = _written(ranges.withColumns({c: _last_seen(c, ranges.schema[c].dataType) for c in named}))
    ends = rows.groupBy("_range").agg(F.max("_place").alias("_place")).select("_place")
    last = rows.select("_range", "_place", *named).join(F.broadcast(ends), "_place", "left_semi")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = kept(last.select("_range", *[F.last(c, ignorenulls=True).over(ahead).alias(f"{c}_carry") for c in named]))
    joined = rows.join(F.broadcast(carry), "_range")
    for c, (name, _) in named.items():
        joined = joined.withColumn(name, F.coalesce(c, f"{c}_carry"))
    return joined.drop("_range", "_place", *named, *[f"{c}_carry" for c in named])


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Add a gapless 1-based number over the whole table in the given order."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"})
    return counted.drop("_one", f"{name}_total")


def value_counts(df: DataFrame, value: str, group: list[str], weight: str | None = None) -> DataFrame:
    """Distinct values with their weights: the pre-aggregate all ordered statistics use."""
    amount = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(amount.alias("_weight"))


def quantiles(df: DataFrame, value: str, points: dict[str, float], group: list[str] | None = None,
              weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, with ``n`` values counted.

    Equal values are merged first, so a hot value costs one row; a hot group is spread
    over as many ranges as its values need.
    """
    group = group or []
    counted = value_counts(df, value, group, weight)
    placed = running_totals(counted, [F.col(value)], {"_end": "_weight"}, group)
    size, end = F.col("_end_total"), F.col("_end")
    start = end - F.col("_weight")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < end), F.col(value)))

    parts = []
    for name, point in points.items():
        spot = (size - 1) * F.lit(float(point))
        parts += [at(F.floor(spot)).alias(f"_{name}_low"), at(F.ceil(spot)).alias(f"_{name}_high")]
    found = placed.groupBy(*group).agg(F.max(size).alias("n"), *parts)
    out = [*group, F.col("n")]
    for name, point in points.items():
        spot = (F.col("n") - 1) * F.lit(float(point))
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return found.select(*out)


#: rows of a range that are brought to the driver at last, and of all ranges together where there are many
FEW, FEW_IN_ALL = 500, 200_000


def narrowed_quantiles(df: DataFrame, value: str, points: dict[str, float], group: str, weight: str | None = None,
                       buckets: int = 4096) -> DataFrame:
    """The same quantiles for few groups (columns of a table), without sorting any value.

    Each wanted place of a group begins with the range of all its values. A round counts the
    values of every range in ``buckets`` equal parts, combined before they are shuffled, and goes
    on with the part in which the place lies, from its least to its greatest value, until one
    value or few rows are left. A range of very uneven width (its parts stay full) is left to
    ``quantiles`` after eight rounds. The state, one row per group and place, and at last at most
    ``FEW`` rows for each, fewer for many groups, are on the driver. ``df`` is read in each round:
    have it written.
    """
    spark, amount = df.sparkSession, F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"), amount.cast("bigint").alias("_w"))
    kind = df.schema[group].dataType.simpleString()

    def local(data: list[tuple], *names: str) -> DataFrame:
        columns = list(zip(*data)) if data else [[] for _ in names]
        types = {"rank": "bigint", "place": "bigint", "n": "bigint", group: kind}
        made = spark.createDataFrame(pa.table({n: pa.array(c, None if data else pa.null()) for n, c in zip(names, columns)}))
        return made.select(*[F.col(f"`{n}`").cast(types.get(n, "double")) for n in names])

    sizes, found = {}, {}
    state = []  # group, place, rank within the range, least and greatest value, rows
    for r in rows.groupBy(group).agg(F.sum("_w").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("c")).collect():
        sizes[r[group]] = r.n
        state += [(r[group], place, place, r.low, r.high, r.c) for place in {f((r.n - 1) * p) for p in points.values() for f in (math.floor, math.ceil)}]
    inside = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    few = max(20, min(FEW, FEW_IN_ALL // max(1, len(state))))
    buckets = max(16, min(buckets, 2_000_000 // max(1, len(sizes))))
    for turn in range(9):
        found |= {s[:2]: s[3] for s in state if s[3] == s[4]}
        state = [s for s in state if s[3] != s[4]]
        small = [s for s in state if s[5] <= few]
        if small:
            spans = local([*{(s[0], s[3], s[4]) for s in small}], group, "low", "high")
            values: dict[tuple, list] = {}
            for r in rows.join(F.broadcast(spans), group).where(inside).groupBy(group, "low", "high", "_v").agg(F.sum("_w").alias("n")).collect():
                values.setdefault((r[group], r.low, r.high), []).append((r["_v"], r.n))
            for g, place, rank, low, high, _ in small:
                for v, n in sorted(values[g, low, high]):
                    rank -= n
                    if rank < 0:
                        found[g, place] = v
                        break
            state = [s for s in state if s[5] > few]
        if not state or turn == 8:
            break
        ranges = local([s[:5] for s in state], group, "place", "rank", "low", "high")
        # halves, so that the width of the range of all doubles is finite
        part = F.least(F.lit(buckets - 1), F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * buckets)).cast("int")
        counts = (rows.join(F.broadcast(ranges.select(group, "low", "high").distinct()), group).where(inside).groupBy(group, "low", "high", part.alias("_part"))
                  .agg(F.sum("_w").alias("n"), F.min("_v").alias("from"), F.max("_v").alias("to"), F.count("*").alias("c")))
        order = Window.partitionBy(group, "low", "high").orderBy("_part")
        placed = counts.withColumn("end", F.sum("n").over(order)).withColumn("start", F.col("end") - F.col("n"))
        chosen = placed.join(F.broadcast(ranges), [group, "low", "high"]).where((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("end")))
        state = [(r[group], r.place, r["rank"] - r.start, r["from"], r.to, r.c) for r in chosen.select(group, "place", "rank", "start", "from", "to", "c").collect()]
    rest, out = {s[0] for s in state}, []
    for g, n in sizes.items():
        if g not in rest:
            spots = [(n - 1) * p for p in points.values()]
            ends = [(found[g, math.floor(x)], found[g, math.ceil(x)], x - math.floor(x)) for x in spots]
            out.append((g, n, *(low + (high - low) * share for low, high, share in ends)))
    done = local(out, group, "n", *points)
    if not rest:
        return done
    uneven = df.where(F.col(group).isin(list(rest)))
    return done.unionByName(quantiles(uneven, value, points, [group], weight).withColumn("n", F.col("n").cast("bigint")))


def average_ranks(df: DataFrame, value: str, weight: str | None = None,
                  group: list[str] | None = None) -> DataFrame:
    """One row per distinct value: its average rank among all (weighted) rows."""
    group = group or []
    counted = value_counts(df, value, group, weight)
    placed = running_totals(counted, [F.col(value)], {"_end": "_weight"}, group)
    return placed.select(*group, value, F.col("_weight").alias("n"),
                         (F.col("_end") - F.col("_weight") + (F.col("_weight") + 1) / 2).alias("avg_rank"))


#: A lookup table up to this many bytes as text is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(table: DataFrame) -> bool:
    """Measure a materialized table: True if it is small enough to broadcast."""
    size = table.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return size <= BROADCAST_BYTES


def attach(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left",
           slices: int = 64) -> DataFrame:
    """Join a one-row-per-key table to rows whose keys may be very uneven.

    The table is written and measured. A small one is broadcast. Otherwise adaptive execution
    splits a key with very many rows. Where that is off, the rows of a key are spread over
    ``slices`` by a hash of their content, and the table is repeated only for slices that
    occur; that reads and shuffles the rows twice.
    """
    table = kept(table)
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), keys, how)
    conf = rows.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{s}", "true") == "true" for s in ("enabled", "skewJoin.enabled")):
        return rows.join(table, keys, how)
    return attach_sliced(rows, table, keys, how, slices)


def attach_sliced(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left",
                  slices: int = 64) -> DataFrame:
    content = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*content), F.lit(slices)))
    present = sliced.select(*keys, "_slice").distinct()
    spread = present.join(table, keys)
    return sliced.join(spread, [*keys, "_slice"], how).drop("_slice")
