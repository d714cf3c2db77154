import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplylens.operators import clean, mapping, transform
from supplylens.sources import grid, readers, sinks


def test_unique_headers():
    assert grid.unique_headers(["A", "", "a ", None]) == ["A", "Kolumna 2", "a (2)", "Kolumna 4"]


def test_csv_keeps_source_rows_and_finds_the_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿Raport;;\nArticle;QTY Ordered;Supplier;\nA-1;10;"X; Y"\n\nA-2;20;Z\n', encoding="utf-8")
    cells, columns = readers.read_csv_grid(spark, str(path))
    table = grid.table_from_grid(cells, "source_row", columns)
    assert table.columns == ["Article", "QTY Ordered", "Supplier", "source_row"]
    assert [tuple(r) for r in table.orderBy("source_row").collect()] == [("A-1", "10", "X; Y", 3), ("A-2", "20", "Z", 5)]


def test_source_rows_over_many_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{i}\n" for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = readers.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() >= 1
        assert lines.where(F.col("value").cast("bigint") != F.col("source_row")).count() == 0
        assert lines.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ghost_columns_and_types(rows):
    g = rows([(1, "Data", "Ile", None, None), (2, "2024-01-01", "5", None, None), (3, "2024-01-02", "x", "k", None),
              (4, None, None, None, None), (5, "2024-01-03", "7", "l", None)], "n int, c0 string, c1 string, c2 string, c3 string")
    assert grid.kept_columns(g, "n", ["c0", "c1", "c2", "c3"], 1) == ["c0", "c1", "c2"]
    t = grid.table_from_grid(g, "n", ["c0", "c1", "c2", "c3"], header_row=0)
    assert t.columns == ["Data", "Ile", "Kolumna 3", "source_row"] and t.count() == 3
    kinds = {r.column: r.type for r in grid.infer_types(t, ["Data", "Ile", "Kolumna 3"]).collect()}
    assert kinds == {"Data": "date", "Ile": "mixed", "Kolumna 3": "text"}


def test_read_stock(rows):
    df = rows([("Folia", "10", "2024-01-01", "-3"), ("", "1", "2024-01-01", "1"), ("A", "-1", "2024-01-01", "1"),
               ("B", "x", "2024-01-01", "1"), ("C", "1", "kiedyś", "1")], "m string, s string, d string, l string")
    got = readers.read_stock(df, {"material": "m", "stock_level": "s", "date": "d", "lead_time_days": "l"}, "2024-02-02")
    assert [(r.material, r.stock_level, r.lead_time_days, r.safety_stock) for r in got.collect()] == [("Folia", 10.0, 0.0, None)]


def test_match_columns(rows):
    headers = rows([("t", i, h, k) for i, (h, k) in enumerate([
        ("Data zużycia", "date"), ("Material Name", "text"), ("Ilość", "number"), ("Zmiana", "text"), ("Kod", "text")])],
        "name string, position int, header string, type string")
    got = {r.field: r.header for r in mapping.match_columns(headers, ["name"]).collect()}
    assert got == {"date": "Data zużycia", "material": "Material Name", "quantity": "Ilość", "shift": "Zmiana", "material_code": "Kod"}
    roles = {r.field: r.header for r in mapping.match_role_columns(headers, ["name"], "usage").collect()}
    assert roles["date"] == "Data zużycia" and roles["quantity"] == "Ilość" and roles["material"] == "Material Name"


def test_mapping_checks(rows):
    df = rows([("2024-01-01", "A", "1")], "d string, m string, q string")
    assert mapping.apply_mapping(df, {"date": "d", "material": "m", "quantity": "q"}).first().sku is None
    for bad in ({"date": "d", "material": "m"}, {"date": "d", "material": "d", "quantity": "q"},
                {"date": "d", "material": "m", "quantity": "zz"}):
        with pytest.raises(ValueError):
            mapping.apply_mapping(df, bad)
    with pytest.raises(ValueError):
        mapping.check_role_mapping(["m", "s"], "stock", {"material": "m", "stock_level": "s"}, "opening")


DATA = [(1, "2024-01-01", "Folia", "10", "R1"), (2, "", "Folia", "5", "R2"), (3, "2024-13-01", "", "x", "R3"),
        (4, "2024-01-02", "folia", "-1", "R4"), (5, "2024-01-02", "FOLIA", "0", "r1"), (6, "2024-01-03", "Folia", "0", ""),
        (7, "2024-01-03", "Folia", "0", ""), (8, "2024-01-03", "Folia", None, "R8")]


def raw(rows):
    return rows(DATA, "source_row int, date string, material string, quantity string, record_id string").withColumn(
        "unit", F.lit("PCS")).withColumn("operator", F.lit("Jan"))


def test_validate_and_dedupe(rows):
    df = raw(rows)
    columns = ["date", "material", "quantity", "record_id"]
    checked = clean.validate(df)
    codes = {r.source_row: (r.errors, r.warnings) for r in checked.collect()}
    assert codes[2][0] == ["missing_date"] and codes[3][0] == ["invalid_date", "missing_material", "invalid_quantity"]
    assert codes[4][0] == ["negative_quantity"] and codes[8][0] == ["missing_quantity"] and codes[6] == ([], ["zero_quantity"])
    valid, rejected = clean.process_dataset(df, columns, ["source_row"])
    assert {r.source_row for r in valid.collect()} == {1, 6}
    row = valid.where("source_row = 1").first()
    assert (row.date, row.quantity, row.unit, row.year, row.original_values) == (dt.date(2024, 1, 1), 10.0, "szt.", 2024, {"unit": "PCS"})
    reasons = {r.source_row: (r.errors, r.duplicate_of) for r in rejected.collect()}
    assert reasons[5] == (["duplicate_record"], '{"source_row":1}') and reasons[7][1] == '{"source_row":6}'
    tagged = clean.tag_duplicates(checked.where("size(errors) = 0"), clean.duplicate_key(checked, columns), ["source_row"])
    summary = {(r.kind, r.code): r.rows for r in clean.validation_summary(
        tagged.unionByName(checked.where("size(errors) > 0"), allowMissingColumns=True)).collect()}
    assert summary[("total", "all")] == 8 and summary[("total", "valid")] == 2 and summary[("total", "duplicate")] == 2
    fixed = df.where("source_row IN (2, 4)").withColumn("date", F.lit("2024-02-02")).withColumn("quantity", F.lit("3"))
    fixed = fixed.withColumn("record_id", F.when(F.col("source_row") == 4, "R1").otherwise(F.col("record_id")))
    accepted, rest = clean.revalidate(fixed, valid, columns, ["source_row"])
    assert [r.source_row for r in accepted.collect()] == [2] and [r.source_row for r in rest.collect()] == [4]
    same = fixed.withColumn("record_id", F.lit("R77"))  # two fixed rows of one key: the first wins
    accepted, rest = clean.revalidate(same, valid, columns, ["source_row"])
    assert [r.source_row for r in accepted.collect()] == [2]
    assert [(r.source_row, r.errors) for r in rest.collect()] == [(4, ["duplicate_record"])]


def test_canonical_spelling(rows):
    df = rows([(1, "Folia"), (2, "FOLIA"), (3, "folia "), (4, "Folia"), (5, "H&M"), (6, "h m")], "source_row int, brand string")
    got = {r.source_row: r.brand for r in clean.canonicalize(df, "brand").collect()}
    assert got == {1: "Folia", 2: "Folia", 3: "Folia", 4: "Folia", 5: "H&M", 6: "H&M"}
    first = {r.source_row: r.brand for r in clean.canonicalize_first(df, "brand", ["source_row"]).collect()}
    assert first[6] == "H&M" and first[3] == "Folia"
    audit = {r.original: (r.normalized, r.changed, r.rows) for r in clean.normalization_audit(df, "brand").collect()}
    assert audit["FOLIA"] == ("Folia", True, 1) and audit["Folia"] == ("Folia", False, 2)


def test_transformations(rows):
    df = rows([(1, "a.b.a", " x ", "-12,50"), (2, None, "ann-mary lee", "zz"), (3, " ", "y", "2.5"), (4, "c", None, "1")],
              "source_row int, t string, u string, v string")
    c = F.col
    got = df.orderBy("source_row").select(
        transform.replace(c("t"), ".", "-"), transform.replace(c("t"), "/a/g", "b"), transform.replace(c("t"), "/A/i", "b"),
        transform.proper(c("u")), transform.absolute(df, "v"), transform.round_to(df, "v"), transform.trim(c("u"))).collect()
    assert tuple(got[0]) == ("a-b-a", "b.b.b", "b.b.a", " X ", "12.5", "-13", "x")
    assert got[1][3] == "Ann-Mary Lee" and got[1][4] == "zz" and got[2][5] == "3"
    down = [r.t for r in transform.fill(df, "t", ["source_row"]).orderBy("source_row").collect()]
    up = [r.t for r in transform.fill(df, "t", ["source_row"], up=True).orderBy("source_row").collect()]
    assert down == ["a.b.a", "a.b.a", "a.b.a", "c"] and up == ["a.b.a", "c", "c", "c"]
    keyed = rows([(1, "p", "a"), (2, "p", None), (3, "q", None), (4, "q", "b")], "source_row int, k string, t string")
    got = {r.source_row: r.t for r in transform.fill(keyed, "t", ["source_row"], within=["k"]).collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: "b"}
    counts = [r.affected for r in transform.affected_counts(df, [("trim", "u"), ("fill-down", "t"), ("remove-empty", "u")],
                                                            ["source_row"]).orderBy("step").collect()]
    assert counts == [2, 2, 1]  # trimming also turns the missing text into an empty one
    twice = df.unionByName(df.withColumn("source_row", c("source_row") + 10))
    assert {r.source_row for r in transform.remove_duplicates(twice, ["source_row"]).collect()} == {1, 2, 3, 4}


def test_patches_and_upsert(rows):
    df = rows([(1, "a", 1.0), (2, "b", 2.0)], "id int, t string, n double")
    patches = rows([(1, "t", "x", 1), (1, "t", "y", 2), (2, "n", "9", 3), (2, "t", None, 4)], "id int, field string, value string, sequence int")
    got = {r.id: (r.t, r.n) for r in transform.apply_patches(df, patches, "id", ["t", "n"]).collect()}
    assert got == {1: ("y", 1.0), 2: (None, 9.0)}
    stock = rows([("s1", "Folia", 5.0, dt.date(2024, 1, 1))], "id string, material string, stock_level double, date date")
    manual = rows([("s1", "Folia", 7.0, dt.date(2024, 1, 2)), ("s2", "Karton", 1.0, dt.date(2024, 1, 2)),
                   ("s3", "X", -1.0, dt.date(2024, 1, 2))], "id string, material string, stock_level double, date date")
    assert {r.id: r.stock_level for r in transform.upsert_stock(stock, manual).collect()} == {"s1": 7.0, "s2": 1.0}


def test_column_editing(rows):
    df = rows([(1, 2)], "a int, b int")
    renamed, reads = transform.rename_column(df, "a", "x", {"calc": ["a", "b"]})
    assert renamed.columns == ["x", "b"] and reads == {"calc": ["x", "b"]}
    with pytest.raises(ValueError):
        transform.drop_column(df, "a", {"calc": ["a"]})
    assert transform.reorder_columns(df, ["b"]).columns == ["b", "a"]
    assert transform.hide_columns(df, ["b"]).columns == ["a"]


def test_sinks(spark, rows, tmp_path):
    df = rows([("=HYPERLINK(\"x\")", -5.0, True, dt.date(2024, 1, 2), "a;b", "-5", "-x")],
              "t string, n double, b boolean, d date, s string, m string, k string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode("utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "﻿t;n;b;d;s;m;k\r\n\"'=HYPERLINK(\"\"x\"\")\";-5;Tak;2024-01-02;\"a;b\";-5;'-x\r\n"
    assert sinks.export_columns(df, forecast=True).first().m == "'-5"
    sinks.write_tables({"usage": df}, str(tmp_path / "roles"))
    assert spark.read.parquet(str(tmp_path / "roles" / "usage")).count() == 1
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().n == -5.0
    back = readers.read_many(spark, [str(tmp_path / "roles" / "usage")])
    assert back.first().source_row == 1 and back.first().n == "-5.0"
    assert readers.raw_dataset(back, ["source_file", "source_row", "source_sheet"]).columns[:2] == ["source__0", "source__1"]


def test_error_report(rows):
    df = rows([(3, ["missing_date", "zero_quantity"], "x")], "source_row int, errors array<string>, material string")
    assert sinks.error_report(df).first().errors == "Brak daty.; Ilość wynosi zero."


def test_mapping_takes_each_field_and_header_once_in_many_tables(rows, monkeypatch):
    """Against a plain greedy choice; tables are not handed to Python one by one, and a spelling is scored once."""
    from supplylens.vocab import MATCH_THRESHOLD, ROLE_MATCH_THRESHOLD
    names = ["Data", "date", "Data", "Ilość", "Quantity", "Qty used", "Material", "Material name", "Item", None, "", "Kod", "Item code", "x"]
    kinds = ["date", "number", "text", None]
    data = [(t, p, names[(t * 5 + p * (1 + t % 3)) % len(names)], kinds[(t + p) % 4]) for t in range(40) for p in range(9)]
    headers = rows([(None if t == 39 else t, *rest) for t, *rest in data], "name int, position int, header string, type string")

    def greedy(scored, threshold):
        found = {}
        for r in sorted((r for r in scored.collect() if r.score >= threshold), key=lambda r: (-r.score, r.place, r.position)):
            mine = found.setdefault(r.name, {})
            if r.field not in mine and r.header not in [h for h, _ in mine.values()]:
                mine[r.field] = (r.header, r.score)
        return {(t, f, *x) for t, mine in found.items() for f, x in mine.items()}

    want = greedy(mapping.score_headers(headers), MATCH_THRESHOLD)
    got = mapping.match_columns(headers, ["name"])
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "Pandas" not in got._jdf.queryExecution().toString()
    fields = {}
    for role in ("usage", "stock"):
        want = greedy(mapping.score_role_headers(headers, role), ROLE_MATCH_THRESHOLD)
        assert {tuple(r) for r in mapping.match_role_columns(headers, ["name"], role).collect()} == want
        fields |= {(t, role): {f for n, f, *_ in want if n == t} for t, *_ in want}
    for r in mapping.role_fields(headers, ["name"], ["usage", "stock"]).collect():
        assert set(r.usage) == fields.get((r.name, "usage"), set()) and set(r.stock) == fields.get((r.name, "stock"), set())
