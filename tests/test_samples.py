"""Samples of whole rows without a key, and published tables."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from supplylens.operators.filters import sample_rows
from supplylens.sources import published, sinks


def _drawn(df, n):
    return sorted(sample_rows(df, n).collect(), key=repr)


def test_the_same_rows_for_any_partitioning(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    first = _drawn(df, 200)
    assert len(first) == len({r.id for r in first}) == 200
    for parts in (1, 7, 40):
        assert _drawn(df.repartition(parts), 200) == first
    assert _drawn(df.orderBy(F.desc("id")), 200) == first
    assert len(_drawn(df, 5000)) == 3000 and _drawn(df.limit(0), 5) == []


def test_equal_rows_keep_their_share(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 50)).alias("v"))
    sizes, drawn = Counter(r.v for r in df.collect()), Counter(r.v for r in _drawn(df, 600))
    assert sum(drawn.values()) == 600
    assert all(abs(drawn[v] - n * 600 / 9000) <= 1 for v, n in sizes.items())


def test_null_places_tell_rows_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)] * 500, "x string, y string")
    assert Counter(tuple(r) for r in _drawn(df, 10)) == {(None, "a"): 5, ("a", None): 5}


def test_published_tables(spark, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    df = rows([(i, f'a;"{i}"\nb' if i % 2 else None) for i in range(50)], "i int, t string")
    said = published.publish(df.repartition(3), path)
    assert said["rows"] == 50 and said["version"] == 1
    assert sorted(published.read_published(spark, path).collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="already"):
        published.publish(df, path)
    # a dead writer's files are not part of the table
    df.write.parquet(f"{path}/data-dead")
    assert published.read_published(spark, path).count() == 50
    old = said["folder"]
    assert published.publish(df.limit(7), path, "csv", write=sinks.write_csv, mode="overwrite")["version"] == 2
    back = {(r.i, r.t) for r in published.read_published(spark, path).collect()}
    assert back == {(str(r.i), r.t or "") for r in df.limit(7).collect()}
    assert published.discard_old(spark, path) == sorted(["data-dead", old])
    file = next(Path(tmp_path, "t").glob("data-*/part-*"))
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(ValueError, match="missing or changed"):
        published.read_published(spark, path)
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, f"file://{tmp_path}/none")


def test_an_empty_table_is_published_too(spark, rows, tmp_path):
    path = f"file://{tmp_path}/e"
    published.publish(rows([], "i int, t string"), path, "csv", write=sinks.write_csv)
    assert published.read_published(spark, path).collect() == []
