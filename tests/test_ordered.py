import math
import random

from pyspark.sql import functions as F

from supplylens.plans import ordered
from supplylens.plans.ordered import attach_sliced


def test_sliced_lookup_equals_a_plain_join_for_a_hot_key(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    rows = spark.range(10_000).select(key.alias("k"), "id")
    table = rows.groupBy("k").agg(F.max("id").alias("m")).where("k != '1'")
    sliced, plain = attach_sliced(rows, table, ["k"]), rows.join(table, "k", "left")
    assert sliced.count() == 10_000
    assert sliced.exceptAll(plain.select(sliced.columns)).count() == 0
    assert plain.select(sliced.columns).exceptAll(sliced).count() == 0


def test_narrowed_quantiles_equal_sorted_ones(spark):
    rng = random.Random(2)
    data = [("even", rng.uniform(-5, 5), rng.randrange(1, 4)) for _ in range(3000)]
    data += [("hot", 7.0 if k % 3 else float(k), 1) for k in range(2000)]
    data += [("uneven", rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) * rng.random(), 1) for _ in range(1500)]
    data += [("one", 3.5, 5), ("two", -1.0, 1), ("two", 1e308, 1), ("none", None, 3), ("wide", -1.7e308, 1), ("wide", 1.7e308, 2)]
    df = spark.createDataFrame(data, "g string, v double, w int")
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in ordered.narrowed_quantiles(df, "v", points, "g", "w", buckets=16).collect()}
    for group in {"even", "hot", "uneven", "one", "two", "wide"}:
        values = sorted(v for g, v, w in data if g == group and v is not None for _ in range(w))
        assert got[group].n == len(values)
        for name, p in points.items():
            spot = (len(values) - 1) * p
            low, high = values[math.floor(spot)], values[math.ceil(spot)]
            assert got[group][name] == low + (high - low) * (spot - math.floor(spot)) if low != high else got[group][name] == low
    assert set(got) == {"even", "hot", "uneven", "one", "two", "wide"}
    assert ordered.narrowed_quantiles(df.limit(0), "v", points, "g").collect() == []
