import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from supplylens.operators import domain, profile, quality, stats, tables
from supplylens.plans import ordered
from supplylens.plans.analyze import analyze

FIELDS = ["record_id", "day", "material", "line", "supplier", "quantity", "price"]
MATERIALS = ["Granulat PP", "Etykieta 40x60", "Klej", "Paleta EUR"]
SPIKE, COPIES = 4200.0, (10, 20, 21)


@pytest.fixture(scope="module")
def entries():
    """One entry every six days for 14 months: rising usage with noise, one spike, repeated entries, blank suppliers."""
    rng, rows = random.Random(11), []
    for k in range(70):
        day = datetime.date(2023, 2, 3) + datetime.timedelta(days=6 * k)
        quantity = SPIKE if k == 41 else round(60 + 2.5 * k + rng.gauss(0, 3), 1)
        rows.append((f"E{k:03d}/{day.year}", day.isoformat(), MATERIALS[rng.randrange(4)], f"L{rng.randrange(1, 4)}",
                     None if k % 6 == 0 else rng.choice(["Hurt Pol", "Odra", "Baltic"]), quantity, round(quantity * 3.4 + rng.uniform(0, 9), 2)))
    return [*rows, *(rows[k] for k in COPIES)]


@pytest.fixture(scope="module")
def result(spark, entries):
    schema = "source_row int, record_id string, day string, material string, line string, supplier string, quantity double, price double"
    return analyze(spark.createDataFrame([(n, *row) for n, row in enumerate(entries)], schema), ["source_row"], FIELDS)


def test_profile_and_roles(result, entries):
    got = {r.column: r for r in result["profile"].collect()}
    assert got["day"].physical_type == "date" and got["quantity"].physical_type == "number"
    blank = sum(row[4] is None for row in entries)
    assert got["supplier"].missing_count == blank and got["supplier"].missing_ratio == blank / len(entries)
    assert (got["quantity"].semantic_role, got["price"].semantic_role) == ("quantity", "price")
    assert got["material"].analytical_role == "dimension" and got["record_id"].analytical_role == "identifier"
    q, values = got["quantity"], sorted(row[5] for row in entries)
    assert q.numeric_count == len(values) and q.maximum == SPIKE and q.iqr == q.q3 - q.q1
    assert q.median == pytest.approx(statistics.median(values)) and q.sum == pytest.approx(sum(values))


def test_outlier_correlation_duplicate(result, entries):
    found = result["outliers"].where("measure = 'quantity'").collect()
    assert any(r.value == SPIKE and r.severity == "high" for r in found)
    pair = result["correlations"].first()
    assert pair.n == len(entries)
    assert pair.pearson == pytest.approx(statistics.correlation([r[5] for r in entries], [r[6] for r in entries]))
    issues = {r.id: r for r in result["issues"].collect()}
    assert issues["duplicate-rows"]["count"] == len(COPIES) and "missing-supplier" in issues
    assert result["quality"].first().grade in "ABC"


def test_trends_and_insights(result, entries):
    assert {r.measure for r in result["trends"].collect()} == {"quantity", "price"}
    month = [row[6] for row in entries if row[1].startswith("2023-05")]
    aggs = result["series"].where("measure = 'price' AND period = '2023-05'").first()
    assert aggs.value == pytest.approx(sum(month) / len(month)) and aggs.records == len(month)
    kinds = {r.type for r in result["insights"].collect()}
    assert {"quality", "anomaly", "correlation"} <= kinds
    assert result["contributors"].count() > 0 and result["charts"].count() > 0
    assert all(r.passed for r in result["checks"].collect())
    assert result["pivot-primary-dimension"].count() == len({row[2] for row in entries})


def test_series_aggregations(rows):
    df = rows([("2026-01-01", 100.0, 10.0, 10.0), ("2026-01-31", 80.0, 20.0, 20.0), ("2026-01-15", 90.0, None, None)],
              "d string, stock double, price double, quantity double")
    got = {r.measure: r.value for r in stats.series(df, "d", {"stock": "latest", "price": "average", "quantity": "sum"}).collect()}
    assert got == {"stock": 80.0, "price": 15.0, "quantity": 30.0}


def test_types_and_errors(rows):
    df = rows([(str(i),) for i in range(60)] + [(f"x{i}",) for i in range(40)], "v string")
    p = profile.profile(df, declared={"v": "number"})
    row = p.columns.first()
    assert row.physical_type == "number" and row.type_errors == 40
    assert p.type_error_examples(5).count() == 5
    assert profile.profile(df).columns.first().physical_type == "mixed"


def test_quick_profile_scales_missing(rows):
    df = rows([(i, None if i % 2 else "a") for i in range(100)], "i int, v string")
    row = profile.profile(df, ["i", "v"], "quick", 20).columns.where("column = 'v'").first()
    assert row.row_count == 100 and row.analyzed_rows == 20
    half = rows([(None if i < 50 else float(i),) for i in range(100)], "v double")
    row = profile.profile(half, ["v"], "quick", 20).columns.first()
    assert abs(row.missing_ratio - 0.5) <= 0.1 and 40 <= row.missing_count <= 60
    few = rows([("abc"[i % 3] if i % 4 else None,) for i in range(4000)], "v string")
    row = profile.profile(few, ["v"], "quick", 400).columns.first()
    assert abs(row.missing_ratio - 0.25) <= 0.1 and row.unique_count == 3


def test_reported_associations_need_eight_values(rows):
    few = rows([(str(i % 2), float(i)) for i in range(7)], "k string, a double")
    assert stats.reported(stats.eta_squared(few, ["k"], ["a"]), "eta_squared").count() == 0
    more = rows([(str(i % 2), float(i % 2)) for i in range(8)], "k string, a double")
    row = stats.reported(stats.eta_squared(more, ["k"], ["a"]), "eta_squared").first()
    assert row.strength == pytest.approx(1.0) and row.confidence == pytest.approx(0.758)


def test_row_accounting_finds_a_lost_row(rows):
    df = rows([(i,) for i in range(6)], "i int")
    columns = rows([("i",)], "column string")
    found = {r["check"]: r for r in quality.row_accounting(df, df.where("i > 2"), columns, df.where("i < 2")).collect()}
    assert not found["rows"].passed and found["rows"].right == 5 and found["columns"].passed
    assert all(r.passed for r in quality.row_accounting(df, df, columns).collect())


def test_histogram_and_quantiles(rows):
    df = rows([(float(i % 7),) for i in range(70)] + [(6.0,)], "x double")
    bins = profile.profile(df).histogram().orderBy("bin").collect()
    assert len(bins) == 9 and sum(b["count"] for b in bins) == 71 and bins[-1]["count"] == 11
    got = ordered.quantiles(df, "x", {"q1": 0.25, "m": 0.5}).first()
    data = sorted([float(i % 7) for i in range(70)] + [6.0])
    assert got.m == data[35] and got.q1 == data[17] + (data[18] - data[17]) * 0.5
    ranks = {r.x: r.avg_rank for r in ordered.average_ranks(df, "x").collect()}
    assert ranks[0.0] == 5.5 and ranks[6.0] == 66.0
    numbers = [r.row_number for r in ordered.row_numbers(df.withColumn("k", F.monotonically_increasing_id()), [F.col("x"), F.col("k")]).orderBy("x", "k").collect()]
    assert numbers == list(range(1, 72))


def test_associations_against_plain_python(rows):
    data = [(float(i % 5), float((i * 7) % 11), 3.0, "ab"[i % 2], "xyz"[(i // 2) % 3]) for i in range(60)]
    df = rows(data, "a double, b double, c double, k string, l string")
    def corr(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        top = sum((p - mx) * (q - my) for p, q in zip(x, y))
        low = math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
        return top / low if low else None
    def rank(x):
        return [sum(v < p for v in x) + (sum(v == p for v in x) + 1) / 2 for p in x]
    a, b = [r[0] for r in data], [r[1] for r in data]
    got = {(r.left_field, r.right_field): r for r in stats.numeric_associations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")].pearson == pytest.approx(corr(a, b)) and got[("a", "b")].spearman == pytest.approx(corr(rank(a), rank(b)))
    assert got[("a", "c")].pearson is None and got[("a", "c")].spearman is None
    eta = {(r.category_field, r.measure_field): r.eta_squared for r in stats.eta_squared(df, ["k", "l"], ["a", "c"]).collect()}
    groups = {g: [r[0] for r in data if r[4] == g] for g in "xyz"}
    mean = sum(a) / len(a)
    between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in groups.values())
    assert eta[("l", "a")] == pytest.approx(between / sum((v - mean) ** 2 for v in a)) and eta[("k", "c")] is None
    v = stats.cramers_v(df, ["k", "l"]).first()
    assert v.cramers_v == pytest.approx(0.0, abs=1e-6) and (v.rows, v["columns"], v.n) == (2, 3, 60)
    sparse = rows([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y")], "k string, l string")
    assert stats.cramers_v(sparse, ["k", "l"]).first().cramers_v == pytest.approx(1.0)


DELIVERY = ["Article", "Brand", "QTY Ordered", "Amount of PLT", "Delivery Date", "ORD/REQ Number", "Rozładowana ilość pallet",
            "QTY", "Pozostała ilość pallet", "Pozostała ilość QTY", "Supplier", "Numer WZ"]


def test_delivery_register(rows):
    data = [("ART-001", "H&M", "1000", "10", "2/23/2026", "ORD-001", "6", "600", "4", "400", "Supplier A", "WZ-001", 1),
            ("ART-002", "COS", "500", "5", "2/24/2026", "ORD-002", "3", "300", "2", "200", "Supplier B", "", 2),
            ("ART-002", "COS", "70 (66)", "1", "2/24/2026", "ORD-002", "1", "66", "0", "4", "Supplier B", "", 3)]
    df = rows(data, ", ".join(f"`{c}` string" for c in DELIVERY) + ", source_row int")
    result = analyze(df, ["source_row"], DELIVERY)
    roles = {r.column: r for r in result["profile"].collect()}
    assert roles["Delivery Date"].date_convention == "mdy" and roles["QTY"].business_role == "delivered_quantity"
    assert roles["Pozostała ilość QTY"].business_role == "remaining_quantity"
    assert result["domain"].first().domain == "delivery_tracking"
    kpis = result["domain_kpis"].first()
    assert (kpis.invalid_numbers, kpis.missing_documents, kpis.orders) == (1, 2, 2)
    assert kpis.completion == pytest.approx(966 / 1500)
    assert not {"trend", "period_change"} & {r.type for r in result["insights"].collect()}


def test_procurement_plan(rows):
    names = ["Article", "Planning category", "Language code", "Store Placement Code", "QTY Ordered", "ORD/REQ Number", "Transport Date", "On site date", "Supplier"]
    data = [("ART-001", "Launch", "PL", "A01", "1000", "ORD-001", "01.02.2026", "23.02.2026", "Supplier A", 1),
            ("ART-002", "Replenishment", "EN", "B02", "500", "ORD-002", "10.02.2026", "24.02.2026", "Supplier B", 2),
            ("ART-002", "Replenishment", "EN", "B02", "70", "ORD-002", "15.08.2026", "week 35", "Supplier B", 3)]
    df = rows(data, ", ".join(f"`{c}` string" for c in names) + ", source_row int")
    result = analyze(df, ["source_row"], names)
    roles = {r.column: r.business_role for r in result["profile"].collect()}
    assert (roles["Planning category"], roles["Language code"], roles["Store Placement Code"]) == ("planning_category", "language", "placement_code")
    kpis = result["domain_kpis"].first()
    assert result["domain"].first().domain == "procurement_plan"
    assert (kpis.week_only, kpis.lead_count, kpis.lead_mean, kpis.products) == (1, 2, 18.0, 2)
    assert "type-On site date" not in {r.id for r in result["issues"].collect()}


def test_hierarchy(rows):
    names = ["Article", "Brand", "QTY Ordered", "Delivery Date", "ORD/REQ Number", "QTY", "Pozostała ilość QTY", "Supplier", "Numer WZ"]
    data = [("ART-H1", "H&M", "100", "02.03.2026", "ORD-H1", "40", "60", "Supplier H", "WZ-H1", 1), ("", "H&M", "50", "03.03.2026", "ORD-H1", "20", "30", "Supplier H", "WZ-H2", 2),
            ("", "", "150", "", "", "60", "90", "", "SUMA", 3), ("ART-H2", "COS", "80", "04.03.2026", "ORD-H2", "50", "30", "Supplier C", "WZ-H3", 4),
            ("", "COS", "20", "05.03.2026", "ORD-H2", "10", "10", "Supplier C", "WZ-H4", 5), ("", "", "100", "", "", "60", "40", "", "SUMA", 6)]
    df = rows(data, ", ".join(f"`{c}` string" for c in names) + ", source_row int")
    raw = domain.classify_raw(df, names)
    assert raw["domain"] == "hierarchical_delivery_plan" and raw["subtotals"] == 2
    done = domain.prepare_hierarchy(df, "Article", ["source_row"], names)
    facts = domain.hierarchy_summary(df, done).first()
    assert (facts.excluded_subtotal_rows, facts.filled_down_values, facts.analyzed_rows) == (2, 2, 4)
    assert {r.source_row: r.Article for r in done.collect()} == {1: "ART-H1", 2: "ART-H1", 4: "ART-H2", 5: "ART-H2"}


def test_table_catalogue(rows):
    catalog = rows([
        ("Ewidencja dostaw", 0, DELIVERY, 3, 0, 0.95, 0.0), ("(old)Arkusz1", 1, DELIVERY[:11], 3, 0, 0.95, 0.0),
        ("planowane dostawy", 2, ["Article", "Planning category", "QTY Ordered", "ORD/REQ Number", "Transport Date", "On site date", "Supplier"], 3, 0, 1.0, 0.0),
        ("Sheet1", 3, ["Brand", "Sum of QTY Ordered"], 3, 0, 1.0, 0.0), ("na potrzeby ułożenia na HR", 4, DELIVERY, 1, 0, 1.0, 0.0)],
        "name string, position int, headers array<string>, row_count long, header_row int, density double, blank_first double")
    got = {r.name: r for r in tables.classify_tables(catalog).collect()}
    assert [got[n].type for n in ("Ewidencja dostaw", "(old)Arkusz1", "planowane dostawy", "Sheet1")] == ["delivery_tracking", "archive", "procurement_plan", "summary"]
    assert tables.recommended_table(tables.classify_tables(catalog)).first().name == "Ewidencja dostaw"


def test_relations_and_overlap(rows):
    a = rows([("ORD-1", "x"), ("ORD-2", "y")], "`ORD/REQ Number` string, q string")
    b = rows([("ord 1", "x"), ("ORD-2", "y"), ("ORD-2", "z")], "`ORD/REQ Number` string, q string")
    assert tables.related_columns(a.columns, b.columns) == [("ORD/REQ Number", "ORD/REQ Number", "order")]
    row = tables.key_coverage(a, b, "ORD/REQ Number", "ORD/REQ Number", "procurement_plan", "delivery_tracking").first()
    assert (row.common_values, row.coverage, row.relation_type) == (2, 1.0, "planned_vs_actual")
    both = tables.overlap(a, b, a.columns, b.columns).first()
    assert (both.common, both.overlap, both.header_similarity, both.similar) == (1, 0.5, 1.0, True)


def test_roles_of_tables(rows):
    lists = {"Zużycie 2026": ["Data", "Kod materiału", "Zużycie"], "Stan magazynu": ["Kod materiału", "Stan zapasu", "Jednostka"],
             "Przyjęcia": ["Data przyjęcia", "Kod materiału", "Ilość przyjęta"], "Otwarte zamówienia": ["Kod materiału", "Ilość otwarta", "Otwarte zamówienia"],
             "Kartoteka": ["Kod materiału", "Materiał", "Jednostka", "Dostawca", "Lead time"], "Zużycie luty": ["Data", "Kod materiału", "Zużycie"]}
    kinds = {"Data": "date", "Data przyjęcia": "date", "Zużycie": "number", "Stan zapasu": "number", "Ilość przyjęta": "number", "Otwarte zamówienia": "number"}
    headers = rows([(n, i, h, kinds.get(h, "text")) for n, hs in lists.items() for i, h in enumerate(hs)], "name string, position int, header string, type string")
    catalog = rows([(n, i) for i, n in enumerate(lists)], "name string, position int")
    got = {r.name: r.role for r in tables.assign_roles(tables.role_scores(catalog, headers)).collect()}
    assert got["Zużycie 2026"] == "usage" and got["Stan magazynu"] == "stock" and got["Przyjęcia"] == "receipts"
    assert got["Otwarte zamówienia"] == "orders" and got["Kartoteka"] == "master" and got["Zużycie luty"] == "usage"


def test_quality_table_and_fingerprint(rows):
    df = rows([("Łódź", 1.0), ("lodz", 3.0), ("", None)], "t string, n double")
    got = {r.column: r for r in quality.quality_table(df).collect()}
    assert (got["t"].empty, got["t"].different, got["t"].filled_percent) == (1, 1, 67) and got["n"]["mean"] == 2.0
    one = profile.fingerprint(df).first().fingerprint
    assert one == profile.fingerprint(df.orderBy(F.desc("n"))).first().fingerprint
    assert one != profile.fingerprint(df.withColumn("n", F.col("n") + 1)).first().fingerprint
    row = df.select(stats.score_confidence(F.lit(1000), F.lit(1.0), F.lit(0.5), F.lit(0.5)).alias("s")).first()
    assert row.s == 0.75


def test_rank_correlations_with_gaps_against_pandas(spark):
    rng = random.Random(4)
    data = [tuple(None if rng.random() < gap else float(rng.randrange(many)) for many, gap in ((5, 0), (90, 0), (40, 0.2), (7, 0.5), (1, 0), (9, 1))) for _ in range(300)]
    names = list("abcdef")
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names))
    frame = df.toPandas()
    for method, found in (("pearson", stats.pearson(df, names)), ("spearman", stats.spearman(df, names))):
        want, rows = frame.corr(method=method), found.collect()
        assert {(r.left_field, r.right_field) for r in rows} == {(a, b) for i, a in enumerate("abcde") for b in "abcde"[i + 1:]}
        for r in rows:
            value = want.loc[r.left_field, r.right_field]
            assert r.n == len(frame[[r.left_field, r.right_field]].dropna())
            assert (r[method] is None) if math.isnan(value) else r[method] == pytest.approx(value)
