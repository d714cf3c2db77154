"""Ordered runs are cut by the size of their rows, not by a number of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from supplylens.operators import transform
from supplylens.plans import ordered


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_BYTES", 2_000)


def test_ranges_grow_with_the_rows(spark, small_ranges):
    def largest(n):
        rows = spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("v"))
        written = ordered._written(ordered._sorted(rows, [F.col("k")])[0])
        return written.groupBy("_range").count().agg(F.max("count")).first()[0]
    few, many = largest(500), largest(5_000)
    assert many < 2 * few < 500


def test_fill_needs_no_window_over_the_rows(spark, small_ranges):
    df = spark.range(400).select("id", F.when(F.col("id") % 150 == 3, F.col("id").cast("string")).alias("v"))
    done = transform.fill(df, "v", ["id"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert [r.v for r in done.orderBy("id").collect()] == [None if i < 3 else str((i - 3) // 150 * 150 + 3) for i in range(400)]


@pytest.mark.parametrize("up", [False, True])
@pytest.mark.parametrize("within", [None, ["g"]])
def test_fill_over_many_ranges(rows, small_ranges, up, within):
    rng = random.Random(5)
    data = [(k, rng.choice(["a", "b", None]) if k < 300 else "hot", "" if rng.random() < 0.97 else f"v{k}") for k in range(900)]
    want, last = {}, {}
    for k, g, v in sorted(data, reverse=up):
        key = g if within else 0
        last[key] = v or last.get(key)
        want[k] = last[key] or ""
    done = transform.fill(rows(data, "k int, g string, v string"), "v", ["k"], up, within)
    assert done.columns == ["k", "g", "v"] and {r.k: r.v for r in done.collect()} == want


def test_values_of_any_type_are_carried(rows, small_ranges):
    data = [(k, [k, None] if k % 70 == 5 else None) for k in range(300)]
    done = ordered.carry_forward(rows(data, "k int, a array<int>"), [F.col("k")], {
        "last": F.col("a"), "both": F.struct(F.col("k").alias("k"), F.timestamp_seconds("k").alias("t"), F.col("k").cast("decimal(9,2)").alias("d"))})
    for r in done.collect():
        assert r["last"] == (None if r.k < 5 else [(r.k - 5) // 70 * 70 + 5, None])
        assert r.both.k == r.k == r.both.d and r.both.t.timestamp() == r.k


def test_totals_over_many_ranges(rows, small_ranges):
    data = [("a" if k % 3 else "b", k, k % 7) for k in range(800)]
    done = ordered.running_totals(rows(data, "g string, k int, w int"), [F.col("k")], {"end": "w"}, ["g"])
    sums, want = {}, {}
    for g, k, w in data:
        want[k] = sums[g] = sums.get(g, 0) + w
    assert {r.k: r.end for r in done.collect()} == want and {(r.g, r.end_total) for r in done.collect()} == set(sums.items())
    assert [r.row_number for r in ordered.row_numbers(rows(data, "g string, k int, w int"), [F.col("k")]).orderBy("k").collect()] == list(range(1, 801))


def test_step_counts_over_many_ranges(rows, small_ranges):
    data = [(k, "" if k % 90 != 40 else "ab") for k in range(600)]
    steps = [("upper", "v"), ("fill-down", "v"), ("replace", "v", "A", "Z")]
    got = [r.affected for r in transform.affected_counts(rows(data, "k int, v string"), steps, ["k"]).orderBy("step").collect()]
    assert got == [7, 600 - 40 - 7, 560]
