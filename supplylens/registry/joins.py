"""Material identity, enrichment and join checks on the role tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.operators import identity, inventory, tables
from supplylens.registry import query, rounded
from supplylens.registry.views import (
    AS_OF, ORDER, delivery, master, open_orders, procurement, receipts, stock, table, usage, with_views,
)


def keyed(df):
    return df.withColumn("material_key", F.col("material_code"))


@query(with_views("usage", "stock") + """, u AS (SELECT DISTINCT material_code, material FROM usage), s AS (SELECT DISTINCT material_code, material FROM stock)
    SELECT 'material_code' AS field, (SELECT count(DISTINCT material_code) FROM u) AS usage_keys, (SELECT count(DISTINCT material_code) FROM s) AS stock_keys,
        (SELECT count(DISTINCT material_code) FROM u WHERE material_code IN (SELECT material_code FROM s)) AS shared
    UNION ALL SELECT 'material', (SELECT count(DISTINCT material) FROM u), (SELECT count(DISTINCT material) FROM s),
        (SELECT count(DISTINCT material) FROM u WHERE material IN (SELECT material FROM s))""")
def key_overlap(spark, folder):
    got = identity.key_overlap(usage(spark, folder), stock(spark, folder))
    return rounded(got.select("field", "usage_keys", "stock_keys", "shared"))


@query(with_views("usage") + """ SELECT alias, min(k) AS material_key FROM (
    SELECT material_code AS alias, material_code AS k FROM usage UNION ALL SELECT material, material_code FROM usage) GROUP BY alias HAVING min(k) = max(k)""")
def build_alias_map(spark, folder):
    return identity.build_alias_map(usage(spark, folder), "material_code")


@query(with_views("usage") + """ SELECT alias FROM (SELECT material_code AS alias, material_code AS k FROM usage UNION ALL
    SELECT material, material_code FROM usage) GROUP BY alias HAVING min(k) <> max(k)""")
def ambiguous_aliases(spark, folder):
    return identity.ambiguous_aliases(usage(spark, folder), "material_code")


@query(with_views("usage") + """ SELECT material_code AS material_key, way, count(*) AS n, sum(quantity) AS quantity FROM (
    SELECT *, record_id % 3 AS way FROM usage) GROUP BY ALL""")
def resolve_identity(spark, folder):
    u = usage(spark, folder).withColumn("material", F.concat_ws(" ", "brand", "category", "material_code"))
    aliases = identity.build_alias_map(u, "material_code")
    way = F.col("record_id") % 3
    rows = u.select(way.alias("way"), "quantity", F.when(way == 1, F.concat(F.lit(" "), "material_code")).when(way == 2, F.col("material_code")).alias("material_code"),
                    F.when(way != 2, F.upper("material")).alias("material"))
    done = identity.resolve_identity(rows, aliases, "material_code")
    return rounded(done.groupBy("material_key", "way").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")))


@query(with_views("receipts") + """ SELECT 'kept' AS side, count(*) AS n, sum(quantity) AS quantity FROM receipts WHERE quantity > 5
    UNION ALL SELECT 'incomplete_receipt', count(*), NULL FROM receipts WHERE quantity <= 5""")
def attach_keys(spark, folder):
    rows = receipts(spark, folder).withColumn("quantity", F.when(F.col("quantity") > 5, F.col("quantity")))
    aliases = identity.build_alias_map(usage(spark, folder), "material_code")
    kept, rest = identity.attach_keys(rows, aliases, "material_code", "receipts")
    return kept.agg(F.lit("kept").alias("side"), F.count("*").alias("n"), F.sum("quantity").alias("quantity")).unionByName(
        rest.groupBy(F.col("warning").alias("side")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")))


@query(with_views("open_orders") + """ SELECT material_code AS material_key, sum(greatest(open_orders - 10, 0.0)) AS open_orders,
    arg_min(strftime(date, '%Y-%m-%d'), (date, open_orders)) AS supplier FROM open_orders GROUP BY 1""")
def order_totals(spark, folder):
    rows = keyed(open_orders(spark, folder)).withColumn("supplier", F.date_format("date", "yyyy-MM-dd"))
    place = ["date", "was"]
    rows = rows.withColumn("was", F.col("open_orders")).withColumn("open_orders", F.col("open_orders") - 10)
    return identity.order_totals(rows, place).select("material_key", "open_orders", "supplier")


@query("""SELECT CAST(user_id AS VARCHAR) AS material_key, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::DATE AS day FROM events GROUP BY 1""")
def latest_by_key(spark, folder):
    rows = table(spark, folder, "events").withColumn("material_key", F.col("user_id").cast("string"))
    got = identity.latest_by_key(rows, ["event_id"], "ts")
    return got.select("material_key", "event_type", F.col("ts").cast("date").alias("day"))


@query(with_views("stock", "master", "open_orders") + """, o AS (SELECT material_code, sum(open_orders) AS open_orders FROM open_orders GROUP BY 1)
    SELECT s.material_code AS material_key, s.material, s.stock_level, s.unit, m.lead_time_days, m.minimum_order_quantity, m.order_multiple, m.safety_stock,
    coalesce(o.open_orders, 0.0) AS open_orders FROM stock s LEFT JOIN master m USING (material_code) LEFT JOIN o USING (material_code)""")
def enrich_stock(spark, folder):
    m = keyed(master(spark, folder)).drop("material_code")
    o = identity.order_totals(keyed(open_orders(spark, folder)).drop("material_code"), ["date", "open_orders"])
    got = identity.enrich_stock(keyed(stock(spark, folder)), m, o)
    return got.select("material_key", "material", "stock_level", "unit", "lead_time_days", "minimum_order_quantity", "order_multiple", "safety_stock", "open_orders")


@query("""SELECT CAST(user_id AS VARCHAR) AS material_key, arg_max(value, (ts, event_id)) AS stock_level, max(ts)::DATE AS date FROM events
    WHERE ts::DATE <= DATE '2024-01-15' GROUP BY 1""")
def stock_as_of(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("material_key"), F.col("ts").cast("date").alias("date"), "ts", "event_id",
                                                 F.col("value").alias("stock_level"))
    return inventory.stock_as_of(rows, "2024-01-15", ["ts", "event_id"]).select("material_key", "stock_level", "date")


@query("""SELECT CAST(user_id AS VARCHAR) AS material_key, arg_max(value, (ts::DATE, event_id)) AS stock FROM events WHERE value >= 5 GROUP BY 1""")
def latest_stock_simple(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("material_key"), F.col("ts").cast("date").alias("date"), "event_id",
                                                 (F.col("value") - 5).alias("stock_level"))
    return rounded(inventory.latest_stock_simple(rows, ["event_id"]).select("material_key", (F.col("stock") + 5).alias("stock")))


EFFECTIVE = f""", e AS (SELECT s.material_code AS material_key, s.stock_mode, s.date, s.unit, s.material, s.stock_level,
        CASE WHEN s.stock_mode = 'opening' THEN coalesce((SELECT sum(quantity) FROM usage u WHERE u.material_code = s.material_code
            AND u.date BETWEEN s.date AND DATE '{AS_OF}'), 0) ELSE 0 END AS usage_since,
        CASE WHEN s.stock_mode = 'opening' THEN coalesce((SELECT sum(quantity) FROM receipts r WHERE r.material_code = s.material_code
            AND r.date BETWEEN s.date AND DATE '{AS_OF}'), 0) ELSE 0 END AS receipts_since FROM stock s
        WHERE s.date <= DATE '{AS_OF}'),
    eff AS (SELECT *, stock_level + receipts_since - usage_since AS stock, date_diff('day', date, DATE '{AS_OF}') AS stale_days FROM e)"""


def effective(spark, folder):
    latest = inventory.stock_as_of(keyed(stock(spark, folder)), AS_OF, ["material_code"])
    return inventory.effective_stock(latest, keyed(usage(spark, folder)), keyed(receipts(spark, folder)), AS_OF)


@query(with_views("usage", "stock", "receipts") + EFFECTIVE + " SELECT material_key, stock_mode, stock, usage_since, receipts_since, stale_days FROM eff")
def effective_stock(spark, folder):
    return rounded(effective(spark, folder).select("material_key", "stock_mode", "stock", "usage_since", "receipts_since", "stale_days"))


@query(with_views("usage", "stock") + """ SELECT material_code AS material_key, stock_level FROM stock
    WHERE material_code IN (SELECT material_code FROM usage WHERE date >= DATE '2001-10-25')""")
def visible_stock(spark, folder):
    shown = keyed(usage(spark, folder)).where("date >= DATE '2001-10-25'")
    return inventory.visible_stock(keyed(stock(spark, folder)), shown).select("material_key", "stock_level")


@query(with_views("usage", "stock") + """ SELECT 'usage' AS side, material_code AS material_key, min(material) AS material FROM usage
    WHERE material_code NOT IN (SELECT material_code FROM stock) GROUP BY ALL
    UNION ALL SELECT 'stock', material_code, material FROM stock WHERE material_code NOT IN (SELECT material_code FROM usage WHERE date < DATE '1995-06-01')""")
def unmatched_materials(spark, folder):
    u, s = keyed(usage(spark, folder)), keyed(stock(spark, folder))
    a = inventory.unmatched(u, s).withColumn("side", F.lit("usage"))
    return a.unionByName(inventory.unmatched(s, u.where("date < DATE '1995-06-01'")).withColumn("side", F.lit("stock")))


@query(with_views("usage", "stock") + """ SELECT u.material_code AS material_key, u.unit AS usage_unit, s.unit AS stock_unit
    FROM (SELECT material_code, min(unit) AS unit FROM usage GROUP BY 1) u JOIN stock s USING (material_code) WHERE u.unit <> s.unit""")
def unit_mismatch(spark, folder):
    return inventory.unit_mismatch(keyed(usage(spark, folder)), keyed(stock(spark, folder)), ORDER)


@query(with_views("usage", "stock", "receipts") + """ SELECT metric, CAST(value AS BIGINT) AS value FROM (
    SELECT 'usage_rows' AS metric, count(*) AS value FROM usage UNION ALL SELECT 'stock_rows', count(*) FROM stock
    UNION ALL SELECT 'negative_stock', count(*) FROM stock WHERE stock_level < 0
    UNION ALL SELECT 'usage_materials', count(DISTINCT material_code) FROM usage UNION ALL SELECT 'stock_materials', count(DISTINCT material_code) FROM stock
    UNION ALL SELECT 'matched_materials', count(*) FROM (SELECT DISTINCT material_code FROM usage INTERSECT SELECT material_code FROM stock)
    UNION ALL SELECT 'unmatched_usage', count(*) FROM (SELECT DISTINCT material_code FROM usage EXCEPT SELECT material_code FROM stock)
    UNION ALL SELECT 'unmatched_stock', count(*) FROM (SELECT material_code FROM stock EXCEPT SELECT material_code FROM usage)
    UNION ALL SELECT 'duplicate_snapshots', count(*) FROM (SELECT 1 FROM stock GROUP BY material_code, date HAVING count(*) > 1)
    UNION ALL SELECT 'unit_mismatches', count(*) FROM (SELECT material_code, min(unit) AS unit FROM usage GROUP BY 1) u JOIN stock s USING (material_code) WHERE u.unit <> s.unit
    UNION ALL SELECT 'receipt_rows', count(*) FROM receipts)""")
def join_audit(spark, folder):
    return inventory.join_audit(keyed(usage(spark, folder)), keyed(stock(spark, folder)), ORDER, ["material_code"], {"receipt": receipts(spark, folder)})


@query(with_views("delivery", "procurement") + """, c AS (SELECT (SELECT count(DISTINCT order_id) FROM delivery) AS l, (SELECT count(DISTINCT order_id) FROM procurement) AS r,
    (SELECT count(*) FROM (SELECT order_id FROM delivery INTERSECT SELECT order_id FROM procurement)) AS m)
    SELECT l AS left_values, r AS right_values, m AS common_values, round(m / least(l, r), 6) AS coverage, 'planned_vs_actual' AS relation_type,
    round(least(0.98, 0.65 + m / least(l, r) * 0.25 + least(0.08, m / 100)), 6) AS confidence FROM c""")
def key_coverage(spark, folder):
    got = tables.key_coverage(delivery(spark, folder), procurement(spark, folder), "order_id", "order_id", "delivery_tracking", "procurement_plan")
    return rounded(got, 6)


@query("""WITH a AS (SELECT DISTINCT o_orderstatus, o_orderpriority, o_orderdate::DATE AS d FROM orders WHERE o_totalprice < 300000),
    b AS (SELECT DISTINCT o_orderstatus, o_orderpriority, o_orderdate::DATE AS d FROM orders WHERE o_totalprice >= 150000)
    SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common,
    round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS overlap, 1.0 AS header_similarity, true AS similar""")
def table_overlap(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    names = ["o_orderstatus", "o_orderpriority", "d"]
    return rounded(tables.overlap(rows.where("o_totalprice < 300000"), rows.where("o_totalprice >= 150000"), names, names), 6)
