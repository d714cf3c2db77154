"""The role tables, derived from the shared test tables by fixed arithmetic.

Each Spark view has the same definition as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["record_id", "material_code", "supplier", "value"]  # tells any two usage rows apart
AS_OF = "2001-06-30"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_key(name: str) -> F.Column:
    return F.col(name).cast("string")


def usage(spark: SparkSession, folder: str) -> DataFrame:
    line, part, supplier = (table(spark, folder, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return joined.select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("p_name").alias("material"),
        text_key("p_partkey").alias("material_code"), F.col("l_quantity").alias("quantity"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("s_name").alias("supplier"),
        F.when(F.col("p_size") % 10 == 0, "kg").otherwise("szt.").alias("unit"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.col("l_extendedprice").alias("value"))


def stock(spark: SparkSession, folder: str) -> DataFrame:
    part, even = table(spark, folder, "part"), F.col("p_partkey") % 2 == 0
    return part.where(F.col("p_partkey") % 13 != 0).select(
        text_key("p_partkey").alias("material_code"), F.col("p_name").alias("material"),
        (F.col("p_size") * 40).cast("double").alias("stock_level"),
        F.when(even, "opening").otherwise("snapshot").alias("stock_mode"),
        F.when(even, "2000-01-01").otherwise("2001-06-30").cast("date").alias("date"),
        F.when(F.col("p_partkey") % 17 == 0, "kg").otherwise("szt.").alias("unit"))


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        text_key("l_partkey").alias("material_code"), F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").cast("date").alias("date"))


def open_orders(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    late = F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp_ntz")
    return line.where((F.col("l_linestatus") == "O") & late).select(
        text_key("l_partkey").alias("material_code"), F.col("l_quantity").alias("open_orders"),
        F.col("l_shipdate").cast("date").alias("date"))


def master(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        text_key("p_partkey").alias("material_code"), F.col("p_name").alias("material"),
        (F.col("p_size") % 30).cast("double").alias("lead_time_days"),
        (F.col("p_size") * 2).cast("double").alias("minimum_order_quantity"),
        (1 + F.col("p_size") % 5).cast("double").alias("order_multiple"),
        F.col("p_size").cast("double").alias("safety_stock"), F.col("p_brand").alias("category"))


def delivery(spark: SparkSession, folder: str) -> DataFrame:
    done = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.floor(F.col("l_quantity") * 0.6))
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        text_key("l_partkey").alias("material_code"), F.col("l_quantity").alias("ordered"),
        done.cast("double").alias("delivered"), (F.col("l_quantity") - done).cast("double").alias("remaining"),
        F.when(F.col("l_returnflag") != "N", "WZ").alias("document_id"), F.col("l_suppkey").alias("supplier_id"))


def procurement(spark: SparkSession, folder: str) -> DataFrame:
    orders, line = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return orders.join(line, orders.o_orderkey == line.l_orderkey).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("transport_date"),
        F.col("l_shipdate").cast("date").alias("on_site_date"), F.col("l_quantity").alias("ordered"),
        F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("supplier"))


CTE = {
    "usage": """SELECT CAST(l.l_shipdate AS DATE) AS date, p.p_name AS material,
        CAST(p.p_partkey AS VARCHAR) AS material_code, l.l_quantity AS quantity, p.p_brand AS brand,
        p.p_type AS category, s.s_name AS supplier, CASE WHEN p.p_size % 10 = 0 THEN 'kg' ELSE 'szt.' END AS unit,
        l.l_orderkey * 10 + l.l_linenumber AS record_id, l.l_extendedprice AS value
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "stock": """SELECT CAST(p_partkey AS VARCHAR) AS material_code, p_name AS material,
        CAST(p_size * 40 AS DOUBLE) AS stock_level,
        CASE WHEN p_partkey % 2 = 0 THEN 'opening' ELSE 'snapshot' END AS stock_mode,
        CASE WHEN p_partkey % 2 = 0 THEN DATE '2000-01-01' ELSE DATE '2001-06-30' END AS date,
        CASE WHEN p_partkey % 17 = 0 THEN 'kg' ELSE 'szt.' END AS unit FROM part WHERE p_partkey % 13 <> 0""",
    "receipts": """SELECT CAST(l_partkey AS VARCHAR) AS material_code, l_quantity AS quantity,
        CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_returnflag = 'R'""",
    "open_orders": """SELECT CAST(l_partkey AS VARCHAR) AS material_code, l_quantity AS open_orders,
        CAST(l_shipdate AS DATE) AS date FROM lineitem
        WHERE l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '2001-10-01 00:00:00'""",
    "master": """SELECT CAST(p_partkey AS VARCHAR) AS material_code, p_name AS material,
        CAST(p_size % 30 AS DOUBLE) AS lead_time_days, CAST(p_size * 2 AS DOUBLE) AS minimum_order_quantity,
        CAST(1 + p_size % 5 AS DOUBLE) AS order_multiple, CAST(p_size AS DOUBLE) AS safety_stock,
        p_brand AS category FROM part""",
    "delivery": """SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_partkey AS VARCHAR) AS material_code,
        l_quantity AS ordered, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE floor(l_quantity * 0.6) END AS delivered,
        CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity - floor(l_quantity * 0.6) END AS remaining,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'WZ' END AS document_id, l_suppkey AS supplier_id FROM lineitem""",
    "procurement": """SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS transport_date,
        CAST(l.l_shipdate AS DATE) AS on_site_date, l.l_quantity AS ordered, l.l_partkey AS product,
        l.l_suppkey AS supplier FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
}


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views."""
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names)
