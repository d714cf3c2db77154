"""Work that grew with every reading of the rows, and lookups of spellings."""

from pyspark.sql import functions as F

from supplylens.operators import clean, identity
from supplylens.plans import ordered
from supplylens.session import kept


def test_valid_and_rejected_rows_come_from_one_written_table(rows, monkeypatch):
    data = [(i, "" if i % 5 == 0 else "2001-01-02", "Folia", "1,5", f"R{i % 7}") for i in range(40)]
    df = rows(data, "row int, date string, material string, quantity string, record_id string")
    source = ["date", "material", "quantity", "record_id"]
    checked = clean.checked_rows(df, source)
    good, bad = clean.split_valid(checked)
    for part in (good, bad):
        assert "parquet" in part._jdf.queryExecution().executedPlan().toString().lower()
    written = []
    monkeypatch.setattr(clean, "kept", lambda d: written.append(d.columns) or kept(d))
    first, again = clean.dedupe(good, None, ["row"])
    assert sum("record_id" in c for c in written) == 0  # the rows are not written a second time
    plain, plain_again = clean.dedupe(good.drop("duplicate_key"), source, ["row"])
    assert sorted(first.select("row").collect()) == sorted(plain.select("row").collect())
    assert sorted(again.select("row", "duplicate_of").collect()) == sorted(plain_again.select("row", "duplicate_of").collect())
    assert bad.count() == 8 and first.count() == 7 and again.count() == 25


def test_identities_are_looked_up_as_written(rows):
    used = rows([("Folia A", "k1"), ("FOLIA  a", " K1"), ("Karton", "k2"), (None, "k3")], "material string, material_code string")
    aliases = identity.build_alias_map(used, "material_code")
    asked = rows([(1, "folia-x", "k 1"), (2, "KARTON", None), (3, "Nowy", ""), (4, None, None), (5, None, "K3")], "n int, material string, material_code string")
    found = {r.n: r.material_key for r in identity.resolve_identity(asked, aliases, "material_code").collect()}
    assert found == {1: "K1", 2: "K2", 3: "nowy", 4: None, 5: "K3"}
    assert identity.resolve_identity(asked.select("n"), aliases, "material_code").where("material_key IS NULL").count() == 5


def test_large_lookup_reads_its_rows_once(spark, monkeypatch):
    monkeypatch.setattr(ordered, "fits_broadcast", lambda table: False)
    table = spark.range(0, 50, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    left = spark.range(300).select(F.when(F.col("id") < 200, 4).otherwise(F.col("id") % 50).alias("k"), "id")
    joined = ordered.attach(left, table, ["k"])
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 300") == 1
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        sliced = ordered.attach(left, table, ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert joined.count() == 300 and joined.exceptAll(sliced.select(joined.columns)).count() == 0
