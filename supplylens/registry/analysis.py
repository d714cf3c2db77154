"""Domain figures, findings and the whole automatic analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.operators import domain, stats
from supplylens.operators.pivot import summary_cells
from supplylens.plans import findings
from supplylens.plans.analyze import analyze
from supplylens.registry import query, rounded
from supplylens.registry.statistics import events, issues, points
from supplylens.registry.views import ORDER, delivery, procurement, usage, with_views
from supplylens.session import kept

DELIVERY = {"ordered": "ordered", "delivered": "delivered", "remaining": "remaining", "order": "order_id", "document": "document_id"}
PROCUREMENT = {"ordered": "ordered", "order": "order_id", "product": "product", "supplier": "supplier", "transport": "transport_date", "on_site": "on_site_date"}


@query(with_views("delivery") + """ SELECT count(*) AS rows, sum(ordered) AS ordered, sum(delivered) AS delivered, sum(remaining) AS remaining, count(DISTINCT order_id) AS orders,
    count(*) FILTER (WHERE remaining > 0 OR delivered < ordered) AS incomplete, count(*) FILTER (WHERE delivered > ordered) AS over_delivered, 0 AS inconsistent,
    count(*) FILTER (WHERE delivered > 0 AND document_id IS NULL) AS missing_documents, 0 AS invalid_numbers, round(sum(delivered) / sum(ordered), 6) AS completion FROM delivery""")
def delivery_kpis(spark, folder):
    return rounded(domain.delivery_kpis(delivery(spark, folder), DELIVERY), 6)


@query(with_views("delivery") + """ SELECT order_id, line, material_code, ordered, delivered, remaining, delivered > ordered AS over_delivered, ordered - delivered - remaining AS delta
    FROM (SELECT order_id, line, material_code, ordered, CASE WHEN line = 7 THEN ordered + 2 ELSE delivered END AS delivered, remaining FROM delivery)
    WHERE abs(ordered - delivered - remaining) > greatest(1, abs(ordered) * 0.001)""")
def delivery_inconsistencies(spark, folder):
    rows = delivery(spark, folder).withColumn("delivered", F.when(F.col("line") == 7, F.col("ordered") + 2).otherwise(F.col("delivered")))
    found = domain.delivery_rows(rows, DELIVERY).where("inconsistent")
    return rounded(found.select("order_id", "line", "material_code", "ordered", "delivered", "remaining", "over_delivered", "delta"))


@query(with_views("procurement") + """, d AS (SELECT *, date_diff('day', transport_date, on_site_date) AS l FROM procurement)
    SELECT sum(ordered) AS ordered, 0 AS invalid_numbers, count(DISTINCT order_id) AS orders, count(DISTINCT product) AS products, count(DISTINCT supplier) AS suppliers, count(*) AS lead_count,
    round(avg(l), 4) AS lead_mean, quantile_cont(l, 0.5) AS lead_median, min(l) AS lead_min, max(l) AS lead_max, count(*) FILTER (WHERE l < 0) AS lead_negative, 0 AS week_only FROM d""")
def procurement_kpis(spark, folder):
    return rounded(domain.procurement_kpis(procurement(spark, folder), PROCUREMENT))


def plan_grid(spark, folder):
    """A delivery plan per order: the first line names the material, a SUMA row ends it."""
    rows = delivery(spark, folder).groupBy("order_id", "line").agg(F.sum("ordered").alias("qty"), F.min("material_code").alias("m"))
    first = rows.groupBy("order_id").agg(F.min("line").alias("f"))
    lines = rows.join(first, "order_id").select(
        "order_id", "line", F.when(F.col("line") == F.col("f"), F.col("m")).otherwise("").alias("Article"),
        F.col("qty").cast("string").alias("QTY Ordered"), F.lit("").alias("Numer WZ"), F.lit("01.02.2026").alias("Delivery Date"))
    totals = rows.groupBy("order_id").agg(F.sum("qty").alias("qty")).select(
        "order_id", F.lit(99).alias("line"), F.lit("").alias("Article"), F.col("qty").cast("string").alias("QTY Ordered"),
        F.lit("SUMA").alias("Numer WZ"), F.lit("").alias("Delivery Date"))
    return lines.unionByName(totals)


NAMES = ["Article", "QTY Ordered", "Numer WZ", "Delivery Date"]
GRID = """, g AS (SELECT order_id, line, sum(ordered) AS qty, min(material_code) AS m FROM delivery GROUP BY ALL) """


@query(with_views("delivery") + GRID + "SELECT order_id, line, first_value(m) OVER (PARTITION BY order_id ORDER BY line) AS article, qty FROM g")
def fill_hierarchy(spark, folder):
    done = domain.prepare_hierarchy(plan_grid(spark, folder), "Article", ["order_id", "line"], NAMES)
    return rounded(done.select("order_id", "line", F.col("Article").alias("article"), F.col("QTY Ordered").cast("double").alias("qty")))


@query(with_views("delivery") + GRID + """SELECT (SELECT count(*) FROM g) + (SELECT count(DISTINCT order_id) FROM g) AS source_rows, (SELECT count(*) FROM g) AS analyzed_rows,
    (SELECT count(DISTINCT order_id) FROM g) AS excluded_subtotal_rows, (SELECT count(*) FROM g) - (SELECT count(DISTINCT order_id) FROM g) AS filled_down_values""")
def hierarchy_summary(spark, folder):
    rows = plan_grid(spark, folder)
    return domain.hierarchy_summary(rows, domain.prepare_hierarchy(rows, "Article", ["order_id", "line"], NAMES))


@query(with_views("delivery") + GRID + """SELECT (SELECT count(*) FROM g) + (SELECT count(DISTINCT order_id) FROM g) AS rows, (SELECT count(*) FROM g) AS missing_material,
    (SELECT count(DISTINCT order_id) FROM g) AS subtotals""")
def domain_facts(spark, folder):
    return domain.domain_facts(plan_grid(spark, folder), NAMES)


@query("SELECT 'hierarchical_delivery_plan' AS domain, 'plan' AS t, 0.94::DOUBLE AS confidence FROM (SELECT count(*) FROM lineitem) UNION ALL SELECT 'consumption', 'usage', 0.93::DOUBLE FROM (SELECT count(*) FROM lineitem)")
def classify_domain(spark, folder):
    plan = plan_grid(spark, folder)
    used = usage(spark, folder).select("date", "material", F.col("quantity").alias("usage quantity"))
    one = domain.classify_raw(plan, NAMES)
    two = domain.classify_raw(used)
    rows = [(plan, one, "plan"), (used, two, "usage")]
    parts = [df.agg(F.lit(r["domain"]).alias("domain"), F.lit(t).alias("t"), F.lit(r["confidence"]).alias("confidence")) for df, r, t in rows]
    return parts[0].unionByName(parts[1])


def _ranked(view: str, groups: dict[str, str], k: int) -> str:
    parts = [f"SELECT '{n}' AS ranking, CAST({c} AS VARCHAR) AS label, sum(ordered) AS value FROM {view} GROUP BY 2" for n, c in groups.items()]
    return f", r AS ({' UNION ALL '.join(parts)}) SELECT ranking, row_number() OVER (PARTITION BY ranking ORDER BY value DESC, label) AS place, label, value FROM r QUALIFY place <= {k}"


@query(with_views("delivery") + _ranked("delivery", {"materials": "material_code", "suppliers": "supplier_id", "documents": "coalesce(document_id, '(brak)')"}, 8))
def delivery_rankings(spark, folder):
    groups = {"materials": "material_code", "suppliers": "supplier_id", "documents": "document_id"}
    return rounded(domain.rankings(delivery(spark, folder), groups, "ordered"))


@query(with_views("procurement") + _ranked("procurement", {"suppliers": "supplier", "products": "product"}, 12))
def procurement_rankings(spark, folder):
    return rounded(domain.rankings(procurement(spark, folder), {"suppliers": "supplier", "products": "product"}, "ordered", 12))


@query(with_views("delivery") + """, f AS (SELECT order_id, line, material_code, supplier_id, ordered, CASE WHEN line = 7 THEN ordered + 2 ELSE delivered END AS delivered, remaining FROM delivery),
    k AS (SELECT 'incomplete' AS kind, *, remaining AS amount FROM f WHERE remaining > 0 OR delivered < ordered
        UNION ALL SELECT 'inconsistent', *, ordered - delivered - remaining FROM f WHERE abs(ordered - delivered - remaining) > greatest(1, abs(ordered) * 0.001)
        UNION ALL SELECT 'over_delivered', *, delivered - ordered FROM f WHERE delivered > ordered)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY order_id, line, material_code, supplier_id, ordered) AS place, order_id, line, material_code, supplier_id, ordered,
        CAST(order_id AS VARCHAR) AS order_name, ordered AS ordered_amount,
        delivered AS delivered_amount, remaining AS remaining_amount, amount FROM k QUALIFY place <= 100""")
def delivery_details(spark, folder):
    rows = delivery(spark, folder).withColumn("delivered", F.when(F.col("line") == 7, F.col("ordered") + 2).otherwise(F.col("delivered")))
    return rounded(domain.delivery_details(rows, DELIVERY, ["order_id", "line", "material_code", "supplier_id", "ordered"]))


@query(with_views("procurement") + """, t AS (SELECT order_id, product, supplier, ordered, transport_date, CASE WHEN product % 9 = 0 THEN 'week 35' ELSE strftime(on_site_date, '%Y-%m-%d') END AS due,
        CASE WHEN product % 9 > 0 THEN date_diff('day', transport_date, on_site_date) END AS days FROM procurement),
    k AS (SELECT 'week_only' AS kind, *, due AS period FROM t WHERE product % 9 = 0 UNION ALL SELECT 'negative', *, NULL FROM t WHERE days < 0)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY order_id, product, supplier, ordered) AS place, order_id, product, supplier, ordered, period, days AS lead_days FROM k QUALIFY place <= 100""")
def procurement_details(spark, folder):
    late = F.when(F.col("product") % 9 == 0, F.lit("week 35")).otherwise(F.date_format("on_site_date", "yyyy-MM-dd"))
    return rounded(domain.procurement_details(procurement(spark, folder).withColumn("on_site_date", late), PROCUREMENT, ["order_id", "product", "supplier", "ordered"]))


@query(with_views("delivery") + """, k AS (SELECT sum(delivered) / sum(ordered) AS c, count(*) FILTER (WHERE delivered > 0 AND document_id IS NULL) AS m FROM delivery)
    SELECT 'domain-delivery-completion' AS id, 'delivery' AS type, CASE WHEN c < 0.8 THEN 'high' WHEN c < 0.98 THEN 'medium' ELSE 'low' END AS severity, 'completion' AS subject, round(c, 6) AS value, 0.96::DOUBLE AS confidence FROM k
    UNION ALL SELECT 'domain-delivery-warning-0', 'delivery_control', 'medium', 'missing_documents', m, 0.95::DOUBLE FROM k WHERE m > 0""")
def delivery_findings(spark, folder):
    return rounded(findings.delivery_findings(domain.delivery_kpis(delivery(spark, folder), DELIVERY)), 6)


@query(with_views("procurement") + """, k AS (SELECT count(DISTINCT order_id) AS o, count(*) FILTER (WHERE on_site_date < transport_date) AS n FROM procurement)
    SELECT 'domain-procurement-scope' AS id, 'low' AS severity, 'orders' AS subject, CAST(o AS DOUBLE) AS value FROM k
    UNION ALL SELECT 'domain-procurement-warning-0', 'medium', 'lead_negative', n FROM k WHERE n > 0""")
def procurement_findings(spark, folder):
    return findings.procurement_findings(domain.procurement_kpis(procurement(spark, folder), PROCUREMENT)).select("id", "severity", "subject", "value")


@query()
def findings_of_usage(spark, folder):
    line = points(spark, folder)
    trend = stats.trends(line)
    compared = stats.previous_period(line).join(trend.select("measure", F.col("confidence").alias("trend_confidence")), "measure")
    compared = compared.withColumn("confidence", stats.compare_confidence(F.col("trend_confidence")))
    pairs = stats.numeric_associations(usage(spark, folder), ["quantity", "value"])
    return rounded(findings.insights([findings.trend_findings(trend), findings.period_findings(compared), findings.correlation_findings(pairs)]))


@query()
def findings_of_quality(spark, folder):
    from supplylens.operators.quality import quality_score
    rows, found = issues(spark, folder)
    found = kept(found)  # a few rows, read three times
    return rounded(findings.insights([findings.quality_findings(quality_score(found, rows.count(), 4), found)]))


@query("""WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, greatest(3, least(30, ceil(sqrt(count(*))))) AS b FROM events GROUP BY ALL),
    a AS (SELECT min(lo) AS lo, max(hi) AS hi, (SELECT greatest(3, least(30, ceil(sqrt(count(*))))) FROM events) AS b FROM s),
    n AS (SELECT least(floor((value - lo) / ((hi - lo) / b)), b - 1) AS bin, count(*) AS n FROM events, a GROUP BY 1)
    SELECT 'chart-distribution' AS chart, 'histogram' AS kind, CAST(i + 1 AS INTEGER) AS place, round(lo + (hi - lo) / b * i, 4) AS x, CAST(coalesce(n, 0) AS DOUBLE) AS y
    FROM a, range(CAST(b AS BIGINT)) r(i) LEFT JOIN n ON bin = i""")
def chart_distribution(spark, folder):
    from supplylens.operators import profile
    bins = profile.histograms(profile.parsed_values(profile.value_table(events(spark, folder), ["value"])))
    return rounded(findings.chart_datasets(histogram=bins).drop("label")).withColumn("place", F.col("place").cast("int"))


@query(with_views("usage") + """, c AS (SELECT brand, sum(quantity) AS y FROM usage GROUP BY brand)
    SELECT 'chart-primary-ranking' AS chart, 'bar-horizontal' AS kind, row_number() OVER (ORDER BY y DESC, brand) AS place, brand AS label, CAST(NULL AS DOUBLE) AS x, y FROM c QUALIFY place <= 20""")
def chart_ranking(spark, folder):
    cells = summary_cells(usage(spark, folder), "brand", None, "quantity", "sum")
    return rounded(findings.chart_datasets(ranking=cells.select("row_key", "total_value")))


@query(with_views("usage") + """, s AS (SELECT quantity AS x, value AS y, min(quantity) OVER () AS lx, max(quantity) OVER () AS hx, min(value) OVER () AS ly, max(value) OVER () AS hy FROM usage),
    d AS (SELECT x, y, lower(hex(CAST(least(15, floor((x - lx) / (hx - lx) * 16)) AS BIGINT))) AS a, lower(hex(CAST(least(15, floor((y - ly) / (hy - ly) * 16)) AS BIGINT))) AS b FROM s),
    c AS (SELECT x, y, right(a, 1) || right(b, 1) || md5(x || '|' || y) AS h, count(*) AS n FROM d GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS before, sum(n) OVER () AS total FROM c)
    SELECT 'chart-correlation' AS chart, 'scatter' AS kind, x, y FROM (SELECT *, unnest(range(((500 * (before + n) + total - 1) // (2 * total) - (500 * before + total - 1) // (2 * total))::BIGINT)) FROM t)""")
def chart_correlation(spark, folder):
    rows = usage(spark, folder).select("quantity", "value")
    pairs = rows.agg(F.lit("quantity").alias("left_field"), F.lit("value").alias("right_field"), F.lit(1.0).alias("strength"))
    found = findings.chart_datasets(pairs=pairs, scatter=stats.pair_rows(rows, ["quantity", "value"]))
    return found.select("chart", "kind", "x", "y")


@query("""SELECT 'profile' AS result, 5 AS n FROM (SELECT count(*) FROM events) UNION ALL SELECT 'issues', 0 FROM (SELECT count(*) FROM events)
    UNION ALL SELECT 'series', count(DISTINCT ts::DATE) FROM events""")
def automatic_analysis(spark, folder):
    """The whole analysis of the events table; the row counts of three of its results."""
    results = analyze(events(spark, folder), ["event_id"], ["event_id", "ts", "user_id", "event_type", "value"])
    parts = [results["profile"].agg(F.lit("profile").alias("result"), F.count("*").alias("n")),
             results["issues"].agg(F.lit("issues").alias("result"), F.count("*").alias("n")),
             results["series"].agg(F.lit("series").alias("result"), F.count_distinct("period").alias("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def automatic_insights(spark, folder):
    """The findings of the whole analysis of usage rows."""
    rows = usage(spark, folder).select(*ORDER, "date", "material", "quantity", "brand", "category", "unit")
    results = analyze(rows, ORDER, ["date", "material", "quantity", "value", "brand", "category", "supplier", "unit"])
    return rounded(results["insights"])
