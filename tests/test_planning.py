import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplylens.operators import filters, identity, inventory, pivot, tables
from supplylens.plans import planning

USAGE = "source_row int, date date, material string, material_code string, sku string, quantity double, unit string"


def day(text):
    return dt.date.fromisoformat(text)


def usage(rows, data):
    return rows([(i, day(d), m, c, None, float(q), u) for i, (d, m, c, q, u) in enumerate(data, 1)], USAGE)


def model(rows, mode="opening", strategy="auto"):
    used = usage(rows, [("2026-01-01", "Folia", "MAT-A", 10, "szt."), ("2026-01-03", "Folia", "MAT-A", 20, "szt."),
                        ("2026-01-04", "Karton", "MAT-B", 5, "szt.")])
    stock = rows([(1, day("2026-01-01"), "Folia", "MAT-A", 100.0, "szt", mode), (2, day("2026-01-01"), "Karton", "MAT-B", 50.0, "szt.", mode),
                  (3, day("2026-01-05"), "Folia", "mat-a ", 90.0, "szt.", "snapshot"), (4, day("2026-01-01"), "Obcy", "X-9", 1.0, "kg", mode)],
                 "source_row int, date date, material string, material_code string, stock_level double, unit string, stock_mode string")
    receipts = rows([(1, day("2026-01-03"), None, "MAT-A", 5.0), (2, None, None, "MAT-A", 7.0)],
                    "source_row int, date date, material string, material_code string, quantity double")
    orders = rows([(1, None, "MAT-A", 20.0, "S1"), (2, None, "MAT-A", -3.0, "S2")],
                  "source_row int, material string, material_code string, open_orders double, supplier string")
    master = rows([(1, "Folia", None, 14.0, 15.0, 40.0, 10.0)],
                  "source_row int, material string, material_code string, lead_time_days double, safety_stock double, "
                  "minimum_order_quantity double, order_multiple double")
    order = ["source_row"]
    return planning.build_model(used, stock, receipts, orders, master, order, order, strategy)


def test_opening_stock_and_enrichment(rows):
    m = model(rows)
    assert m.field == "material_code"
    got = {r.material_key: r for r in m.inventory("2026-01-04").collect()}
    assert got["MAT-A"].stock == 75.0 and got["MAT-A"].usage_since == 30.0 and got["MAT-A"].receipts_since == 5.0
    assert got["MAT-B"].stock == 45.0 and "X-9" not in got
    a = got["MAT-A"]  # the master row has a name only
    assert (a.lead_time_days, a.safety_stock, a.open_orders, a.minimum_order_quantity, a.order_multiple, a.supplier) == (14.0, 15.0, 20.0, 40.0, 10.0, "S1")
    assert m.warnings["receipts"].count() == 1
    newest = {r.material_key: r.stock for r in m.inventory("2026-01-05").collect()}
    assert newest == {"MAT-A": 90.0, "MAT-B": 45.0}
    assert {r.material_key for r in m.inventory("2025-12-31").collect()} == set()


def test_join_audit(rows):
    facts = {r.metric: r.value for r in model(rows).audit().collect()}
    assert facts["usage_materials"] == 2 and facts["stock_materials"] == 3 and facts["matched_materials"] == 2
    assert facts["unmatched_stock"] == 1 and facts["unit_mismatches"] == 0 and facts["receipt_rows"] == 1


def test_ambiguous_names_are_no_aliases(rows):
    used = usage(rows, [("2026-01-01", "Folia", "A", 1, None), ("2026-01-01", "Folia", "B", 1, None), ("2026-01-01", "Taśma", "C", 1, None)])
    aliases = {r.alias: r.material_key for r in identity.build_alias_map(used, "material_code").collect()}
    assert aliases == {"A": "A", "B": "B", "C": "C", "tasma": "C"}
    assert [r.alias for r in identity.ambiguous_aliases(used, "material_code").collect()] == ["folia"]
    other = rows([(None, "TAŚMA"), ("a ", "Taśma"), (None, "Folia"), (None, None)], "material_code string, material string")
    found = identity.resolve_identity(other, identity.build_alias_map(used, "material_code"), "material_code")
    assert {(r.material_code, r.material): r.material_key for r in found.collect()} == {
        (None, "TAŚMA"): "C", ("a ", "Taśma"): "A", (None, "Folia"): "folia", (None, None): None}


def covered(rows):
    data = [(f"2026-03-{d:02d}", "taśma", None, 70, "szt.") for d in range(1, 11)]
    data += [(f"2026-03-{d:02d}", "folia", None, 10, "szt.") for d in range(1, 5)]
    data += [(f"2026-03-{d:02d}", "karton", None, 10, "szt.") for d in range(1, 3)]
    used = usage(rows, data).withColumn("material_key", F.col("material"))
    stock = rows([("taśma", "taśma", 300.0, "szt."), ("folia", "folia", 300.0, "szt"), ("karton", "karton", 200.0, "szt.")],
                 "material_key string, material string, stock double, unit string")
    return used, stock


def test_coverage_reliability_and_kpis(rows):
    used, stock = covered(rows)
    table = inventory.coverage(used, stock, ["source_row"])
    got = {r.material_key: r for r in table.collect()}
    assert got["taśma"].reliability == "high" and round(got["taśma"].coverage_days, 2) == 4.29 and got["taśma"].at_risk
    assert got["folia"].reliability == "medium" and got["folia"].coverage_days == 30.0
    assert got["karton"].reliability == "insufficient" and got["karton"].coverage_days is None
    row = inventory.kpis(used, table, ["source_row"]).first()
    assert (row.used, row.materials, row.top_material, row.at_risk, row.lowest_material) == (760.0, 3, "taśma", 1, "taśma")
    assert row.mixed_units and row.stock is None  # 'szt' and 'szt.' are different labels here
    assert row.trend == "malejący"


def test_unit_issues_block_coverage(rows):
    used, stock = covered(rows)
    other = {r.material_key: r.data_issue for r in inventory.coverage(used, stock.withColumn("unit", F.lit("kg")), ["source_row"]).collect()}
    assert set(other.values()) == {"Jednostka zapasu nie zgadza się z zużyciem"}
    mixed = used.withColumn("unit", F.when(F.col("source_row") == 1, "kg").otherwise(F.col("unit")))
    got = {r.material_key: r.data_issue for r in inventory.coverage(mixed, stock, ["source_row"]).collect()}
    assert got["taśma"] == "Niejednolite jednostki zużycia" and got["folia"] is None


def test_pareto_and_abc(rows):
    used = usage(rows, [("2026-01-01", "a", None, 80, None), ("2026-01-01", "b", None, 15, None), ("2026-01-01", "c", None, 5, None)])
    used = used.withColumn("material_key", F.col("material"))
    assert [(r.material, r.classification) for r in inventory.abc(used, ["source_row"]).orderBy("cumulative_share").collect()] == [("a", "A"), ("b", "B"), ("c", "C")]
    ranked = inventory.pareto(used, ["source_row"]).orderBy("cumulative_share").collect()
    assert [r.needed_for_80 for r in ranked] == [True, False, False] and ranked[2].cumulative_share == 100.0


def plan_stock(rows, **change):
    row = {"material_key": "folia", "stock": 1010.0, "unit": "szt.", "supplier": "S", "lead_time_days": None, "minimum_order_quantity": 25.0,
           "order_multiple": 20.0, "safety_stock": None, "open_orders": None, **change}
    return rows([tuple(row.values())], "material_key string, stock double, unit string, supplier string, lead_time_days double, "
                "minimum_order_quantity double, order_multiple double, safety_stock double, open_orders double")


def test_order_plan(rows):
    used = usage(rows, [(d, "Folia", None, 10, "szt.") for d in ("2024-12-30", "2024-12-31", "2026-01-01", "2026-01-02")])
    used = used.withColumn("material_key", F.lit("folia"))
    plan = inventory.order_plan(used, plan_stock(rows), ["source_row"], "Zima").first()
    assert (plan.calendar_days, plan.observed_days, plan.average_daily, plan.to_order) == (4, 4, 10.0, 40.0)
    assert round(plan.raw_to_order, 6) == 25.0
    long = inventory.order_plan(used, plan_stock(rows, lead_time_days=120.0), ["source_row"], "Zima").first()
    assert long.planning_days == 120.0 and long.to_order % 20 == 0
    conflict = inventory.order_plan(used, plan_stock(rows, unit="kg"), ["source_row"], "Zima").first()
    assert conflict.to_order == 0.0 and conflict.data_issue
    assert inventory.order_plan(used, plan_stock(rows), ["source_row"], "Lato").count() == 0
    assert inventory.next_season("2026-01-15") == "Wiosna" and inventory.next_season("2026-11-01") == "Zima"
    assert inventory.next_season("2026-12-01") == "Wiosna"


def test_as_of_rules(rows):
    stock = rows([(1, day("2026-01-01"), 1.0, "k"), (2, day("2026-01-01"), 2.0, "k"), (3, None, 3.0, "k"), (4, day("2026-02-01"), 4.0, "k")],
                 "source_row int, date date, stock_level double, material_key string")
    assert inventory.stock_as_of(stock, "2026-01-15", ["source_row"]).first().stock_level == 2.0
    assert inventory.stock_as_of(stock, "2026-01-15", ["source_row"], explicit=False).first().stock_level == 3.0
    assert inventory.latest_stock_simple(stock, ["source_row"]).first().stock == 4.0
    assert str(inventory.as_of_date([stock], None, "2020-01-01").first().as_of) == "2026-02-01"
    assert str(inventory.as_of_date([stock], "2025-05-05").first().as_of) == "2025-05-05"


SAMPLE = [("A", "2026-01", "10", "2026-01-01", "100", 0), ("A", "2026-01", "20", "2026-01-02", "90", 1), ("A", "2026-02", "30", "2026-02-01", "80", 2),
          ("A", "2026-02", "40", "2026-02-01", "70", 3), ("B", "2026-01", "5", "2026-01-01", "50", 4), ("B", "2026-01", "", "2026-01-02", "45", 5),
          ("B", "2026-02", "15", "2026-02-01", "40", 6)]


def test_summary_pivots(rows):
    df = rows(SAMPLE, "Material string, Month string, Usage string, SnapshotDate string, Stock string, seq long")
    def cells(*args, **kw):
        return {(r.row_key, r.column_key): (r.value, r.total_value) for r in pivot.long_pivot_top(df, *args, **kw).collect()}
    avg = cells("Material", "Month", "Usage", "average")
    assert avg[("A", "2026-01")] == (15.0, 25.0)
    count = cells("Material", "Month", "Usage", "count")
    assert count[("B", "2026-01")] == (1.0, 2.0)
    last = cells("Material", None, "Stock", "latest", order_by="SnapshotDate", sequence=["seq"])
    assert last == {("A", "Wartość"): (70.0, 70.0), ("B", "Wartość"): (40.0, 40.0)}
    with pytest.raises(ValueError):
        pivot.long_pivot_top(df, "Material", None, "Stock", "latest")
    wide = pivot.long_to_wide(pivot.summary_cells(df, "Material", "Month", "Usage", "sum")).orderBy("row_key").collect()
    assert [tuple(r) for r in wide] == [("A", 100.0, 30.0, 70.0), ("B", 20.0, 5.0, 15.0)]


def test_pivot_with_totals(rows):
    df = rows([("a", "x", 1.0, 10.0), ("a", "y", 2.0, None), ("a", " ", None, 5.0), ("b", "x", -7.0, 1.0)], "m string, c string, q double, p double")
    got = {(r.level, r.m, r.c): (r.q, r.p, r.combined, r.records) for r in pivot.pivot(df, ["m"], ["c"], ["q", "p"]).collect()}
    assert got[("cell", "a", None)] == (0.0, 5.0, 5.0, 1) and got[("row_total", "a", None)] == (3.0, 15.0, 18.0, 3)
    assert got[("column_total", None, "x")] == (-6.0, 11.0, 5.0, 2) and got[("grand_total", None, None)] == (-4.0, 16.0, 12.0, 4)
    avg = {(r.level, r.m): r.combined for r in pivot.pivot(df, ["m"], [], ["q", "p"], "avg").collect()}
    assert avg[("cell", "a")] == 18.0 / 4 and ("row_total", "a") not in avg
    mins = {(r.level, r.m): (r.q, r.combined) for r in pivot.pivot(df, ["m"], [], ["q", "p"], "min").collect()}
    assert mins[("cell", "b")] == (-7.0, -7.0) and mins[("grand_total", None)] == (-7.0, -7.0)
    table = [tuple(r) for r in pivot.pivot_table(df, ["m"], "c", "q").collect()]
    assert table[-1][0] == "Razem" and len(table) == 3
    long = pivot.pivot(df, ["m"], ["c"], ["q"])
    assert {r.m for r in pivot.chart_series(long, ["m"], "q", "bar", 1).collect()} == {"b"}
    assert {r.m for r in pivot.chart_series(long, ["m"], "q", "line", 1).collect()} == {"a"}
    stats = {r.field: (r["count"], r.total, r.minimum, r.maximum) for r in pivot.source_statistics(df, ["m"], ["q", "p"]).collect()}
    assert stats == {"q": (3, -4.0, -7.0, 2.0), "p": (3, 16.0, 1.0, 10.0), "*": (6, 12.0, -7.0, 10.0)}


def test_filters_and_sorting(rows):
    df = rows([(1, "Łódź", 5.0, day("2024-01-01")), (2, "lodz", None, None), (3, "", 2.0, day("2024-02-01")), (4, "item 10", 1.0, None), (5, "item 9", 9.0, None)],
              "source_row int, t string, n double, d date")
    def ids(x):
        return [r.source_row for r in x.orderBy("source_row").collect()]
    assert ids(filters.filter_dates(df, "2024-01-01", "2024-01-31", "d")) == [1]
    assert ids(filters.filter_values(df, {"t": "LODZ"})) == [1, 2] and ids(filters.filter_values(df, {"t": filters.EMPTY})) == [3]
    assert ids(filters.filter_ops(df, [("n", ">", "1"), ("n", "<=", "5")])) == [1, 3]
    assert ids(filters.filter_ops(df, [("t", "starts-with", "ITEM")])) == [4, 5] and ids(filters.filter_ops(df, [("t", "is-empty", None)])) == [3]
    assert ids(filters.filter_ops(df, [("d", ">=", "15.01.2024")])) == [3] and ids(filters.search(df, "óDź", ["t"])) == [1, 2]
    assert [r.source_row for r in filters.sort_rows(df, [("n", "asc")], ["source_row"]).collect()] == [2, 4, 3, 1, 5]
    assert [r.source_row for r in df.where("source_row > 2").orderBy(*filters.pivot_order(df, "t")).collect()][-2:] == [5, 4]
    options = filters.filter_options(df, "t").collect()
    assert options[-1].is_blank and len(options) == 5
    once, again = (sorted(r.source_row for r in filters.sample_rows(df, 3).collect()) for _ in range(2))
    assert once == again and len(once) == 3


def test_templates(rows):
    df = rows([("a", 2.0), ("a", 3.0)], "material string, quantity double")
    assert pivot.available_templates(df) == ["material"]
    assert pivot.template(df).where("level = 'cell'").first().quantity == 5.0
    with pytest.raises(ValueError):
        pivot.template(df, "brand")


def test_combine(rows):
    a, b = rows([(1, "f")], "x int, source_file string"), rows([(2, "g")], "x int, source_file string")
    assert identity.combine([a, b]).count() == 2
    with pytest.raises(ValueError):
        identity.combine([a, a.withColumnRenamed("x", "y")])
    extra = identity.union_role([a.withColumn("quantity", F.lit("q")), b.withColumn("z", F.lit(1))], ["x", "quantity"])
    assert set(extra.columns) == {"x", "source_file", "quantity", "z"}
    both = identity.union_role([a.toDF("x", "Źródło: x"), b.toDF("x", "x")], ["x"], [{1}, {1}])
    assert both.columns == ["x", "Źródło: x", "Źródło: x (2)"] and both.where("x = 2").first()[2] == "g"
    assert identity.source_labels(["x", "Źródło: x"], ["x"]) == {"x": "Źródło: x", "Źródło: x": "Źródło: Źródło: x"}


def test_overlap_reads_all_columns(rows):
    names = [f"c{i}" for i in range(14)]
    schema = ", ".join(f"{c} string" for c in names)
    a, b = (rows([tuple("v" * 13 + end)], schema) for end in "xy")
    assert tables.overlap(a, b, names, names).first().common == 0
