"""Coverage, risk, Pareto, ABC and order quantities on the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.operators import inventory
from supplylens.plans.planning import build_model
from supplylens.registry import query, rounded
from supplylens.registry.joins import EFFECTIVE, effective, keyed
from supplylens.registry.views import (
    AS_OF, ORDER, master, open_orders, receipts, stock, usage, with_views,
)
from supplylens.sources import sinks

RANKED = """, t AS (SELECT material_code AS material_key, sum(quantity) AS used FROM usage GROUP BY 1),
    r AS (SELECT *, sum(used) OVER (ORDER BY used DESC, material_key ROWS UNBOUNDED PRECEDING) AS running, sum(used) OVER () AS total FROM t)"""


@query(with_views("usage") + RANKED + """ SELECT material_key, used, round(100 * used / total, 6) AS share, round(100 * running / total, 6) AS cumulative_share,
    CASE WHEN round(100 * running / total, 9) <= 80 THEN 'A' WHEN round(100 * running / total, 9) <= 95 THEN 'B' ELSE 'C' END AS classification FROM r""")
def abc_classes(spark, folder):
    return rounded(inventory.abc(keyed(usage(spark, folder)), ORDER).drop("material"), 6)


@query(with_views("usage") + RANKED + """ SELECT material_key, used, round(100 * (running - used) / total, 6) AS share_before,
    round(100 * running / total, 6) AS cumulative_share, 100 * (running - used) / total < 80 AS needed_for_80 FROM r""")
def pareto(spark, folder):
    return rounded(inventory.pareto(keyed(usage(spark, folder)), ORDER).drop("material", "share"), 6)


@query(with_views("usage") + """, d AS (SELECT date, sum(quantity) AS u, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS c FROM usage GROUP BY date),
    h AS (SELECT max(c) AS days, avg(u) FILTER (WHERE n <= c // 2) AS a, avg(u) FILTER (WHERE n > c // 2) AS b FROM d)
    SELECT days, round(a, 4) AS first_mean, round(b, 4) AS second_mean, round(100 * (b - a) / a, 4) AS change,
    CASE WHEN 100 * (b - a) / a > 10 THEN 'rosnący' WHEN 100 * (b - a) / a < -10 THEN 'malejący' ELSE 'stabilny' END AS trend FROM h""")
def half_trend(spark, folder):
    return rounded(inventory.half_trend(usage(spark, folder)))


@query(with_views("usage", "stock", "receipts") + " SELECT greatest((SELECT max(date) FROM usage), (SELECT max(date) FROM stock), (SELECT max(date) FROM receipts)) AS as_of")
def as_of_date(spark, folder):
    return inventory.as_of_date([usage(spark, folder), stock(spark, folder), receipts(spark, folder)])


COVERAGE = f""", f AS (SELECT * FROM usage WHERE date BETWEEN DATE '2001-01-01' AND DATE '{AS_OF}'),
    c AS (SELECT material_code AS material_key, sum(quantity) AS total, count(DISTINCT date) AS observed, date_diff('day', min(date), max(date)) + 1 AS calendar,
        count(DISTINCT unit) AS units, min(unit) AS unit FROM f GROUP BY 1),
    k AS (SELECT e.material_key, e.stock, coalesce(c.observed, 0) AS observed_days, coalesce(c.calendar, 1) AS calendar_days,
        coalesce(c.total, 0) / coalesce(c.calendar, 1) AS average_daily,
        CASE WHEN c.units > 1 THEN 'Niejednolite jednostki zużycia' WHEN c.unit <> e.unit THEN 'Jednostka zapasu nie zgadza się z zużyciem' END AS data_issue
        FROM eff e LEFT JOIN c USING (material_key)),
    v AS (SELECT *, CASE WHEN data_issue IS NOT NULL OR observed_days < 3 THEN 'insufficient' WHEN observed_days / calendar_days < 0.1 THEN 'low'
        WHEN observed_days < 7 OR observed_days / calendar_days < 0.3 THEN 'medium' ELSE 'high' END AS reliability FROM k),
    w AS (SELECT *, CASE WHEN reliability <> 'insufficient' AND average_daily > 0 THEN greatest(stock, 0) / average_daily END AS coverage_days FROM v)"""


def covered(spark, folder):
    shown = keyed(usage(spark, folder)).where(f"date BETWEEN DATE '2001-01-01' AND DATE '{AS_OF}'")
    return shown, inventory.coverage(shown, effective(spark, folder), ORDER)


@query(with_views("usage", "stock", "receipts") + EFFECTIVE + COVERAGE + """ SELECT material_key, stock, observed_days, calendar_days, round(average_daily, 6) AS average_daily,
    data_issue, reliability, round(coverage_days, 6) AS coverage_days, coalesce(coverage_days < 7, false) AS at_risk FROM w""")
def coverage(spark, folder):
    _, table = covered(spark, folder)
    return rounded(table.select("material_key", "stock", "observed_days", "calendar_days", "average_daily", "data_issue", "reliability", "coverage_days", "at_risk"), 6)


@query(with_views("usage", "stock", "receipts") + EFFECTIVE + COVERAGE + """ SELECT reliability, coalesce(coverage_days < 7, false) AS at_risk, count(*) AS n FROM w GROUP BY ALL""")
def risk_by_reliability(spark, folder):
    _, table = covered(spark, folder)
    return table.groupBy("reliability", "at_risk").agg(F.count("*").alias("n"))


@query(with_views("usage", "stock", "receipts") + EFFECTIVE + COVERAGE + """, d AS (SELECT date, sum(quantity) AS u, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS c FROM f GROUP BY date),
    h AS (SELECT avg(u) FILTER (WHERE n <= c // 2) AS a, avg(u) FILTER (WHERE n > c // 2) AS b FROM d),
    t AS (SELECT material_code, sum(quantity) AS u, min(material) AS m FROM f GROUP BY 1)
    SELECT (SELECT sum(quantity) FROM f) AS used, (SELECT count(*) FROM t) AS materials, (SELECT round(100 * max(u) / sum(u), 6) FROM t) AS top_share,
    (SELECT count(*) FROM w WHERE coverage_days < 7) AS at_risk, round((SELECT min(coverage_days) FROM w), 6) AS lowest_coverage,
    (SELECT count(DISTINCT unit) > 1 FROM eff) AS mixed_units, round((SELECT 100 * (b - a) / a FROM h), 6) AS trend_change""")
def planning_kpis(spark, folder):
    shown, table = covered(spark, folder)
    row = inventory.kpis(shown, table, ORDER)
    return rounded(row.select("used", "materials", "top_share", "at_risk", "lowest_coverage", "mixed_units", "trend_change"), 6)


PLAN = """, z AS (SELECT *, CASE WHEN month(date) = 12 THEN year(date) ELSE year(date) - 1 END AS p FROM usage WHERE month(date) IN (12, 1, 2)),
    pp AS (SELECT material_code AS material_key, p, sum(quantity) AS used, count(DISTINCT date) AS o, date_diff('day', min(date), max(date)) + 1 AS c,
        count(DISTINCT unit) AS units, min(unit) AS unit FROM z GROUP BY 1, 2),
    n AS (SELECT material_key, sum(used) AS used, CAST(sum(o) AS BIGINT) AS observed_days, CAST(sum(c) AS BIGINT) AS calendar_days, max(units) AS units, min(unit) AS unit FROM pp GROUP BY 1),
    oo AS (SELECT material_code AS material_key, sum(open_orders) AS open_orders FROM open_orders GROUP BY 1),
    j AS (SELECT n.*, greatest(coalesce(e.stock, 0), 0) AS stock, coalesce(m.lead_time_days, 0) AS lead, CASE WHEN e.material_key IS NULL THEN 0 ELSE coalesce(m.minimum_order_quantity, 0) END AS moq,
        CASE WHEN e.material_key IS NULL THEN 0 ELSE coalesce(m.order_multiple, 0) END AS mult, CASE WHEN e.material_key IS NULL THEN 0 ELSE coalesce(m.safety_stock, 0) END AS safety,
        CASE WHEN e.material_key IS NULL THEN 0 ELSE coalesce(oo.open_orders, 0) END AS open_orders, CASE WHEN e.material_key IS NULL THEN 0 ELSE coalesce(m.lead_time_days, 0) END AS lead_time_days,
        CASE WHEN units > 1 THEN 'Niejednolite jednostki zużycia' WHEN n.unit <> e.unit THEN 'Jednostka zapasu nie zgadza się z zużyciem' END AS data_issue
        FROM n LEFT JOIN eff e USING (material_key) LEFT JOIN master m ON m.material_code = n.material_key LEFT JOIN oo USING (material_key)),
    q AS (SELECT *, used / calendar_days AS average_daily, greatest(90.0, lead_time_days) AS planning_days,
        CASE WHEN data_issue IS NOT NULL OR observed_days < 3 THEN 'insufficient' WHEN observed_days / calendar_days < 0.1 THEN 'low'
        WHEN observed_days < 7 OR observed_days / calendar_days < 0.3 THEN 'medium' ELSE 'high' END AS reliability FROM j),
    w AS (SELECT *, CASE WHEN reliability = 'insufficient' THEN 0 ELSE greatest(0, average_daily * planning_days * 1.15 + safety - stock - open_orders) END AS raw FROM q),
    x AS (SELECT *, CASE WHEN raw <= 0 THEN 0.0 WHEN mult > 0 THEN ceil(round(greatest(raw, moq) / mult, 9)) * mult ELSE greatest(raw, moq) END AS to_order FROM w)"""


def planned(spark, folder, **options):
    from supplylens.operators import identity
    m = keyed(master(spark, folder)).drop("material_code", "unit")
    o = identity.order_totals(keyed(open_orders(spark, folder)).drop("material_code"), ["date", "open_orders"])
    have = identity.enrich_stock(keyed(stock(spark, folder)), m, o)
    have = inventory.effective_stock(inventory.stock_as_of(have, AS_OF, ["material_code"]), keyed(usage(spark, folder)), keyed(receipts(spark, folder)), AS_OF)
    return inventory.order_plan(keyed(usage(spark, folder)), have, ORDER, "Zima", **options)


@query(with_views("usage", "stock", "receipts", "master", "open_orders") + EFFECTIVE + PLAN + """ SELECT material_key, observed_days, calendar_days, round(average_daily, 6) AS average_daily,
    data_issue, reliability, planning_days, round(raw, 4) AS raw_to_order, round(to_order, 4) AS to_order FROM x""")
def order_plan(spark, folder):
    got = planned(spark, folder)
    return rounded(got.select("material_key", "observed_days", "calendar_days", "average_daily", "data_issue", "reliability", "planning_days", "raw_to_order", "to_order"), 4, average_daily=6)


@query(with_views("usage", "stock", "receipts", "master", "open_orders") + EFFECTIVE + PLAN + """ SELECT 'Zima' AS "Sezon", reliability AS "Wiarygodność", count(*) AS n, sum(observed_days)::BIGINT AS "Dni obserwacji",
    round(sum(to_order), 2) AS total FROM x GROUP BY reliability""")
def forecast_export(spark, folder):
    report = sinks.forecast_report(planned(spark, folder), "Zima", 90, 0.15)
    return rounded(report.groupBy("Sezon", "Wiarygodność").agg(F.count("*").alias("n"), F.sum("Dni obserwacji").alias("Dni obserwacji"),
                                                              F.sum("Do zamówienia po regułach").alias("total")), 2)


@query(with_views("usage", "stock", "receipts") + EFFECTIVE + """ SELECT material_key, stock, usage_since, receipts_since FROM eff""")
def role_model_inventory(spark, folder):
    s = stock(spark, folder)
    model = build_model(usage(spark, folder), s, receipts(spark, folder), open_orders(spark, folder), master(spark, folder), ORDER, ["material_code"],
                        "material_code", orders_order=["date", "open_orders"], master_order=["material_code"])
    return rounded(model.inventory(AS_OF).select("material_key", "stock", "usage_since", "receipts_since"))
