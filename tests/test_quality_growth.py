"""Keys and whole rows are counted without texts of every row."""

from pyspark.sql import functions as F

from supplylens.operators import clean, profile, quality


def test_rows_are_counted_by_their_values(rows):
    data = [(1, "a", 0.0), (1, "a", 0.0), (1, "a", -0.0), (1, None, 0.0), (None, "1", 0.0), (1, None, 0.0), (2, "x" * 80, None), (2, "x" * 80, None),
            (2, "x" * 79 + "y", None), (3, "", float("nan")), (3, "", float("nan"))]
    df = rows(data, "i bigint, t string, d double").withColumn("s", F.struct("i"))
    plan = clean.count_duplicates(df.drop("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "structstojson" not in plan.lower()
    for part in (df.drop("s"), df):
        assert tuple(clean.count_duplicates(part).first()) == (11, 4, 4)
    wide = df.select("*", *[F.lit(k).alias(f"w{k}") for k in range(8)])
    assert tuple(clean.count_duplicates(wide).first()) == (11, 4, 4)


def test_keys_are_counted_from_the_profile(rows, monkeypatch):
    data = [(k % 30, f"c{k % 40}" if k % 11 else " ", float(k)) for k in range(60)]
    df = rows(data, "id bigint, code string, d double")
    values = profile.profile(df).parsed
    names = ["id", "code", "d"]
    want = sorted(quality.key_duplicates(df, names).collect())
    assert sorted(quality.key_duplicates(df, names, values).collect()) == want and {r["column"] for r in want} == {"id", "code"}
    monkeypatch.setattr(quality, "cell_text", None)  # no second pass over the cells
    roles = rows([("id", True)], "column string, expected_unique boolean")
    roles = roles.select("*", F.lit("identifier").alias("semantic_role"), F.lit(0.5).alias("unique_ratio"), F.lit(60).alias("non_null_count"),
                         *[F.lit(0).alias(c) for c in ("missing_count", "partial_date_count", "type_errors", "negative_count")],
                         F.lit(0.0).alias("missing_ratio"), F.lit("number").alias("physical_type"), F.lit(False).alias("is_constant"), F.lit(False).alias("is_almost_constant"))
    found = {r.id: r["count"] for r in quality.quality_audit(df, roles, values=values).collect()}
    assert found == {"business-key-id": 30}


def test_whole_numbers_are_keyed_as_they_are(spark):
    df = spark.range(40).select((F.col("id") % 4 * 9007199254740993).alias("n"))
    values = profile.value_table(df)
    assert sorted((r.value, r.number, r.n) for r in values.collect()) == sorted((str(k * 9007199254740993), float(k * 9007199254740993), 10) for k in range(4))
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [n#" in plan
