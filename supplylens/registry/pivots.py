"""Pivots, summaries and series for charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.functions.dates import derive_date_fields
from supplylens.operators import domain, inventory, pivot, profile
from supplylens.plans.analyze import auto_pivots
from supplylens.registry import query, rounded
from supplylens.registry.views import ORDER, delivery, table, usage, with_views

PIVOT = """ SELECT CASE grouping(category) * 2 + grouping(unit) WHEN 0 THEN 'cell' WHEN 1 THEN 'row_total' WHEN 2 THEN 'column_total' ELSE 'grand_total' END AS level,
    category, unit, {q} AS quantity, {v} AS value, {c} AS combined, count(*) AS records FROM usage
    GROUP BY GROUPING SETS ((category, unit), (category), (unit), ())"""


def _pivot(agg: str):
    def run(spark, folder):
        return rounded(pivot.pivot(usage(spark, folder), ["category"], ["unit"], ["quantity", "value"], agg), 2)
    return run


for _name, _q, _v, _c in (
        ("sum", "sum(quantity)", "round(sum(value), 2)", "round(sum(quantity) + sum(value), 2)"),
        ("avg", "round(avg(quantity), 2)", "round(avg(value), 2)", "round((sum(quantity) + sum(value)) / (2 * count(*)), 2)"),
        ("min", "min(quantity)", "min(value)", "least(min(quantity), min(value))"),
        ("max", "max(quantity)", "max(value)", "greatest(max(quantity), max(value))"),
        ("count", "CAST(count(*) AS DOUBLE)", "CAST(count(*) AS DOUBLE)", "CAST(count(*) AS DOUBLE)")):
    query(with_views("usage") + PIVOT.format(q=_q, v=_v, c=_c), name=f"pivot_{_name}")(_pivot(_name))


@query(with_views("usage") + """, c AS (SELECT category, sum(quantity) FILTER (WHERE unit = 'kg') AS kg, sum(quantity) FILTER (WHERE unit = 'szt.') AS "szt." FROM usage GROUP BY category)
    SELECT * FROM c UNION ALL SELECT 'Razem', sum(kg), sum("szt.") FROM c""")
def pivot_table(spark, folder):
    return pivot.pivot_table(usage(spark, folder), ["category"], "unit", "quantity")


@query(with_views("usage") + """ SELECT 'quantity' AS field, count(quantity) AS count, sum(quantity) AS total, round(avg(quantity), 2) AS average, min(quantity) AS minimum, max(quantity) AS maximum FROM usage
    UNION ALL SELECT 'value', count(value), round(sum(value), 2), round(avg(value), 2), min(value), max(value) FROM usage
    UNION ALL SELECT '*', 2 * count(*), round(sum(quantity) + sum(value), 2), round((sum(quantity) + sum(value)) / (2 * count(*)), 2), least(min(quantity), min(value)), greatest(max(quantity), max(value)) FROM usage""")
def source_statistics(spark, folder):
    return rounded(pivot.source_statistics(usage(spark, folder), ["category"], ["quantity", "value"]), 2)


_SEASON = """CASE WHEN month(date) = 12 THEN 'Zima ' || year(date) || '/' || (year(date) + 1) WHEN month(date) <= 2 THEN 'Zima ' || (year(date) - 1) || '/' || year(date)
    WHEN month(date) <= 5 THEN 'Wiosna ' || year(date) WHEN month(date) <= 8 THEN 'Lato ' || year(date) ELSE 'Jesień ' || year(date) END"""
_PRESETS = {"brand": "brand", "material": "material", "month": "strftime(date, '%Y-%m')", "season": _SEASON, "line": "CASE WHEN record_id % 10 < 7 THEN 'L' || record_id % 10 END"}


@query(with_views("usage") + " UNION ALL ".join(f" SELECT '{n}' AS template, 'cell' AS level, {key} AS key, sum(quantity) AS quantity, count(*) AS records FROM usage GROUP BY 3"
                                                for n, key in _PRESETS.items())
       + " UNION ALL SELECT NULL, 'grand_total', NULL, sum(quantity), count(*) FROM usage")
def template_pivots(spark, folder):
    """All five presets with their total, from one aggregate."""
    u, line = derive_date_fields(usage(spark, folder)), F.col("record_id") % 10
    return rounded(pivot.templates(u.withColumn("line", F.when(line < 7, F.concat(F.lit("L"), line.cast("string"))))))


@query(with_views("usage") + """, t AS (SELECT material, round(avg(quantity), 6) AS total_value FROM usage GROUP BY 1 ORDER BY abs(avg(quantity)) DESC, material LIMIT 20)
    SELECT material AS row_key, strftime(date, '%Y-%m') AS column_key, round(avg(quantity), 6) AS value, max(t.total_value) AS total_value
    FROM usage JOIN t USING (material) GROUP BY 1, 2""")
def pivot_summary_average(spark, folder):
    return rounded(pivot.pivot_summary(usage(spark, folder), "material", "date", "quantity", "average", 20, granularity="month"), 6)


@query(with_views("usage") + """ SELECT coalesce(CASE WHEN unit <> 'kg' THEN brand END, '(brak)') AS row_key, category AS column_key, CAST(count(*) AS DOUBLE) AS value,
    max(n) AS total_value FROM (SELECT *, CAST(count(*) OVER (PARTITION BY CASE WHEN unit <> 'kg' THEN brand END) AS DOUBLE) AS n FROM usage) GROUP BY 1, 2""")
def pivot_summary_count(spark, folder):
    rows = usage(spark, folder).withColumn("brand", F.when(F.col("unit") == "kg", " ").otherwise(F.col("brand")))
    return pivot.summary_cells(rows, "brand", "category", "quantity", "count")


@query("""SELECT event_type AS row_key, strftime(ts, '%Y-%m-%d') AS column_key, arg_max(value, (ts, event_id)) AS value, max(t) AS total_value FROM (
    SELECT *, last_value(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM events) GROUP BY 1, 2""")
def pivot_latest(spark, folder):
    return pivot.summary_cells(table(spark, folder, "events"), "event_type", "ts", "value", "latest", granularity="day", order_by="ts", sequence=["event_id"])


@query(with_views("usage") + """ SELECT material_code AS row_key, 'Wartość' AS column_key, sum(quantity) AS value, sum(quantity) AS total_value FROM usage
    GROUP BY 1 ORDER BY abs(sum(quantity)) DESC, material_code LIMIT 500""")
def pivot_long_top(spark, folder):
    return pivot.long_pivot_top(usage(spark, folder), "material_code", None, "quantity", "sum", 500)


@query("""SELECT o_orderpriority AS row_key, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS "F",
    round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY 1""")
def long_to_wide(spark, folder):
    cells = pivot.summary_cells(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "sum")
    return rounded(pivot.long_to_wide(cells), 2)


@query(with_views("usage") + """, g AS (SELECT material FROM usage GROUP BY 1 ORDER BY sum(abs(quantity)) DESC, material LIMIT 10)
    SELECT material, category, sum(quantity) AS quantity FROM usage WHERE material IN (SELECT material FROM g) GROUP BY ALL""")
def chart_bars(spark, folder):
    long = pivot.pivot(usage(spark, folder), ["material"], ["category"], ["quantity"])
    return pivot.chart_series(long, ["material"], "quantity", "bar", 10).select("material", "category", "quantity")


@query(with_views("usage") + " SELECT strftime(date, '%Y-%m') AS month_key, sum(quantity) AS quantity FROM usage GROUP BY 1 ORDER BY 1 LIMIT 24")
def chart_line(spark, folder):
    long = pivot.pivot(derive_date_fields(usage(spark, folder)), ["month_key"], [], ["quantity"])
    return pivot.chart_series(long, ["month_key"], "quantity", "line", 24).select("month_key", "quantity")


@query(with_views("usage") + " SELECT brand, sum(quantity) AS quantity FROM usage GROUP BY 1 ORDER BY sum(quantity) DESC, brand LIMIT 5")
def chart_pie(spark, folder):
    long = pivot.pivot(usage(spark, folder), ["brand"], ["category"], ["quantity"])
    shown = pivot.chart_series(long, ["brand"], "quantity", "pie", 5)
    return shown.groupBy("brand").agg(F.sum("quantity").alias("quantity"))


@query(with_views("usage") + """ SELECT count(*) AS rows, count(quantity) AS quantities, sum(quantity) AS quantity_sum, round(avg(quantity), 4) AS quantity_avg,
    min(quantity) AS quantity_min, max(quantity) AS quantity_max, min(date) AS date_min, max(date) AS date_max FROM usage""")
def dataset_statistics(spark, folder):
    return rounded(pivot.dataset_statistics(usage(spark, folder)))


@query(with_views("usage") + " SELECT material_code AS material_key, min(material) AS material, sum(quantity) AS used FROM usage GROUP BY 1")
def usage_by_material(spark, folder):
    return inventory.usage_by_material(usage(spark, folder).withColumn("material_key", F.col("material_code")), ORDER)


@query(with_views("usage") + " SELECT date, sum(quantity) AS used FROM usage GROUP BY 1")
def daily_usage(spark, folder):
    return inventory.daily_usage(usage(spark, folder))


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def value_frequency(spark, folder):
    return profile.frequency(table(spark, folder, "orders"), "o_orderpriority", 3)


@query("SELECT count(DISTINCT CASE WHEN p_size > 5 THEN p_name END) AS unique_count FROM part")
def unique_count(spark, folder):
    rows = table(spark, folder, "part").withColumn("n", F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(" "))
    return profile.unique_count(rows, "n")


@query(with_views("delivery") + " SELECT material_code AS label, sum(ordered) AS value FROM delivery GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_groups(spark, folder):
    return domain.top_groups(delivery(spark, folder), "material_code", "ordered")


@query(with_views("delivery") + """ SELECT 'ordered' AS field, sum(ordered) AS total, count(*) AS valid, 0 AS invalid FROM delivery
    UNION ALL SELECT 'text', sum(ordered) FILTER (WHERE line > 2), count(*) FILTER (WHERE line > 2), count(*) FILTER (WHERE line = 1) FROM delivery""")
def sum_field(spark, folder):
    text = F.when(F.col("line") == 1, "70 (66)").when(F.col("line") == 2, " ").otherwise(F.col("ordered").cast("string"))
    return domain.sum_field(delivery(spark, folder).withColumn("text", text), ["ordered", "text"])


@query(with_views("usage") + """ SELECT 'pivot-primary-dimension' AS id, brand AS row_key, sum(quantity) AS value FROM usage GROUP BY brand
    UNION ALL SELECT 'pivot-dimension-2', category, sum(quantity) FROM usage GROUP BY category""")
def auto_pivot_tables(spark, folder):
    u = usage(spark, folder)
    roles = profile.semantic_roles(profile.profile(u, ["brand", "category", "quantity"]).columns)
    rows = sorted((r.asDict() for r in roles.collect()), key=lambda r: r["position"])  # one row per column
    # category comes before brand in the ranking of dimensions; the ids here follow the table above
    specs = auto_pivots(rows, None, "quantity")
    names = {"brand": "pivot-primary-dimension", "category": "pivot-dimension-2"}
    parts = [pivot.pivot_summary(u, s["row"], None, s["value"], s["agg"]).select(
        F.lit(names[s["row"]]).alias("id"), "row_key", "value") for s in specs]
    return parts[0].unionByName(parts[1])
