"""Sinks on the shared tables: written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from supplylens.registry import query, rounded
from supplylens.registry.views import master, open_orders, receipts, stock, table, usage, with_views
from supplylens.session import shared_folder
from supplylens.sources import published, readers, sinks


def _place(spark) -> str:
    return f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"


_NAMES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || '; "' || p_brand || '"' WHEN 1 THEN p_name || chr(10) || p_type
    WHEN 2 THEN '"' || p_name WHEN 3 THEN p_size || '" ' || p_name WHEN 4 THEN p_type || chr(10) || '"";' || chr(10) || p_name
    ELSE p_name END AS name, p_size FROM part"""


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS c0, name AS c1, CAST(p_size AS VARCHAR) AS c2, false AS heading FROM ({_NAMES})
    UNION ALL SELECT 'p_partkey', 'name', 'p_size', true""")
def read_csv_grid(spark, folder):
    """Cells with separators, quotes and line breaks, through the CSV sink and back."""
    part, path = table(spark, folder, "part"), f"{_place(spark)}/parts"
    n, q, name = F.lit("\n"), F.lit('"'), F.col("p_name")
    shape = [F.concat(name, F.lit('; "'), "p_brand", q), F.concat(name, n, "p_type"), F.concat(q, name),
             F.concat(F.col("p_size").cast("string"), F.lit('" '), name), F.concat("p_type", n, F.lit('"";'), n, name)]
    text = name
    for k, other in enumerate(shape):
        text = F.when(F.col("p_partkey") % 6 == k, other).otherwise(text)
    rows = part.select("p_partkey", text.alias("name"), "p_size")
    sinks.write_csv(rows, path)
    cells, columns = readers.read_csv_grid(spark, path)
    heading = F.col("c0") == "p_partkey"
    # every file of the export has a heading of its own
    data, heads = cells.where(~heading), cells.where(heading).select(*columns).distinct()
    return data.select(*columns, F.lit(False).alias("heading")).unionByName(heads.withColumn("heading", F.lit(True)))


@query(with_views("usage") + """ SELECT strftime(date, '%Y-%m-%d') AS date, material, CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS quantity,
    CASE WHEN quantity > 25 THEN 'Tak' ELSE 'Nie' END AS large, CAST(record_id AS VARCHAR) AS record_id FROM usage""")
def write_clean(spark, folder):
    """Clean data published as CSV and read back by its manifest."""
    rows = usage(spark, folder).select("date", "material", "quantity", (F.col("quantity") > 25).alias("large"), "record_id")
    path = f"{_place(spark)}/clean"
    published.publish(rows, path, "csv", write=sinks.write_clean)
    return published.read_published(spark, path)


@query(with_views("usage", "stock", "receipts", "open_orders", "master") + """
    SELECT 'usage' AS name, count(*) AS n, sum(quantity) AS total FROM usage
    UNION ALL SELECT 'stock', count(*), sum(stock_level) FROM stock
    UNION ALL SELECT 'receipts', count(*), sum(quantity) FROM receipts
    UNION ALL SELECT 'open_orders', count(*), sum(open_orders) FROM open_orders
    UNION ALL SELECT 'master', count(*), sum(safety_stock) FROM master""")
def write_role_tables(spark, folder):
    views = {"usage": usage(spark, folder), "stock": stock(spark, folder), "receipts": receipts(spark, folder),
             "open_orders": open_orders(spark, folder), "master": master(spark, folder)}
    place = _place(spark)
    published.publish_tables(views, place)
    value = {"stock": "stock_level", "open_orders": "open_orders", "master": "safety_stock"}
    parts = [published.read_published(spark, f"{place}/{name}").agg(F.count("*").alias("n"), F.sum(value.get(name, "quantity")).alias("total"))
             .select(F.lit(name).alias("name"), "n", "total") for name in views]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@query(with_views("usage") + """ SELECT material_code, material, sum(quantity) AS quantity, count(*) AS records FROM usage GROUP BY material_code, material""")
def write_json(spark, folder):
    rows = usage(spark, folder).groupBy("material_code", "material").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("records"))
    path = f"{_place(spark)}/usage"
    published.publish(rows, path, "json")
    return rounded(published.read_published(spark, path))
