"""The analysis reads its source once, and few groups need no sort."""

from pyspark.sql import functions as F

from supplylens.operators import profile, stats


def test_bounds_of_few_groups_need_no_sort(rows, monkeypatch):
    data = [("m", g, float(v)) for g, values in (("a", range(9)), ("b", [1, 1, 2, 50]), ("few", [1, 2])) for v in values]
    values = rows([*data, ("m", "a", None)], "measure string, _group string, value double")
    group = ["measure", "_group"]
    monkeypatch.setattr(stats, "NARROWED_GROUPS", 0)
    by_sort = stats.robust_bounds(values, group).select(*group, "n", "q1", "median", "q3", "iqr", "mad", "lower", "upper").collect()
    monkeypatch.undo()
    monkeypatch.setattr(stats, "quantiles", None)
    got = stats.robust_bounds(values, group).select(*group, "n", "q1", "median", "q3", "iqr", "mad", "lower", "upper").collect()
    assert sorted(got) == sorted(by_sort) and {r["_group"]: (r.n, r.median, r.mad) for r in got} == {"a": (9, 4.0, 2.0), "b": (4, 1.5, 0.5)}


def test_sums_of_periods_are_not_sorted(rows):
    df = rows([(1, "2024-01-05", 2.0, 7.0), (2, "2024-01-09", 3.0, 8.0), (3, "2024-02-01", 4.0, 9.0)], "id int, day string, qty double, level double")
    sums = stats.series(df, "day", {"qty": "sum"}, sequence=["id"])
    assert "SortAggregate" not in sums._jdf.queryExecution().executedPlan().toString()
    both = stats.series(df, "day", {"qty": "average", "level": "latest"}, sequence=["id"])
    assert {(r.measure, r.period): (r.value, r.records) for r in both.collect()} == {
        ("qty", "2024-01"): (2.5, 2), ("qty", "2024-02"): (4.0, 1), ("level", "2024-01"): (8.0, 2), ("level", "2024-02"): (9.0, 1)}


def test_cells_are_counted_by_column(spark):
    df = spark.range(6).select((F.col("id") % 2).cast("double").alias("d"), F.when(F.col("id") < 4, " ").otherwise("x").alias("t"), F.col("id").alias("i"))
    values = profile.value_table(df)
    assert "Generate" not in values._jdf.queryExecution().executedPlan().toString()
    got = {(r.column, r.native, r.value, r.number): r.n for r in values.collect()}
    assert got[("d", "number", "0", 0.0)] == 3 and got[("t", "text", None, None)] == 4 and got[("i", "number", "5", 5.0)] == 1 and len(got) == 10
