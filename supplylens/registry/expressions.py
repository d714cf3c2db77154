"""Functions of calculated columns on the shared tables, and plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.functions.exprs import Expressions, calculate
from supplylens.registry import query, rounded
from supplylens.registry.views import table, usage, with_views


@query("""SELECT event_id, CASE WHEN event_type IN ('error') THEN 'no' ELSE event_type END AS t,
    CASE WHEN event_id % 4 = 0 THEN 'B' ELSE 'A' END AS picked, event_id % 4 <> 0 AS truth, NOT (event_id % 4 <> 0) AS negated FROM events""")
def if_and_truth(spark, folder):
    word = F.when(F.col("event_id") % 4 == 0, "Fałsz").otherwise("ok")
    rows = table(spark, folder, "events").select("event_id", "event_type", word.alias("word"))
    e = Expressions(rows)
    return rows.select("event_id", e.if_(e.compare(F.col("event_type"), "=", "ERROR"), "no", F.col("event_type")).alias("t"),
                       e.if_(F.col("word"), "A", "B").alias("picked"), e.and_(F.col("word"), F.lit(1)).alias("truth"), e.not_(F.col("word")).alias("negated"))


@query("""SELECT p_partkey, round(coalesce(p_retailprice / nullif(p_size - 10, 0), -1.0), 4) AS ratio, round(p_retailprice - p_size * 2.0, 4) AS gap,
    p_name || CAST(p_size AS VARCHAR) AS joined, CAST(pow(p_size, 2.0) AS DOUBLE) AS square, -CAST(p_size AS DOUBLE) AS negative,
    round(abs(p_size - 25.0), 4) AS away FROM part""")
def arithmetic(spark, folder):
    rows = table(spark, folder, "part")
    e, c = Expressions(rows), F.col
    return rounded(rows.select(
        "p_partkey", e.iferror(e.div(c("p_retailprice"), e.sub(c("p_size"), 10)), -1.0).alias("ratio"),
        e.sub(c("p_retailprice"), e.mul(c("p_size"), 2)).alias("gap"), e.add(c("p_name"), c("p_size")).alias("joined"),
        e.pow(c("p_size"), 2).alias("square"), e.neg(c("p_size")).alias("negative"), e.abs(e.sub(c("p_size"), 25)).alias("away")))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END, p_type) AS first_filled, upper(p_name) AS up, lower(p_type) AS low,
    CAST(length(p_name) AS BIGINT) AS len, CAST(least(p_size, 20) AS DOUBLE) AS small, CAST(greatest(p_size, 20) AS DOUBLE) AS large,
    p_size % 3 = 0 AS blank, p_brand || '-' || p_type AS text FROM part""")
def text_and_extremes(spark, folder):
    rows = table(spark, folder, "part").withColumn("gap", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")))
    e, c = Expressions(rows), F.col
    return rounded(rows.select(
        "p_partkey", e.coalesce(c("gap"), c("p_type")).alias("first_filled"), e.upper(c("p_name")).alias("up"), e.lower(c("p_type")).alias("low"),
        e.len(c("p_name")).alias("len"), e.min(c("p_size"), F.lit("20"), F.lit("x")).alias("small"), e.max(c("p_size"), 20).alias("large"),
        e.isblank(c("gap")).alias("blank"), e.concat(c("p_brand"), "-", F.lit(None).cast("string"), c("p_type")).alias("text")))


@query("""SELECT l_linenumber AS line, sum(CAST(round(l_extendedprice / 3 + 0.0001) AS DOUBLE)) AS whole, CAST(sum(date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01')) AS BIGINT) AS days,
    count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-05-01') AS late, count(*) FILTER (WHERE l_quantity < 10) AS small FROM lineitem GROUP BY 1""")
def rounding_and_dates(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("third", F.col("l_extendedprice") / 3 + 0.0001)
    e, c = Expressions(rows), F.col
    done = rows.select(c("l_linenumber").alias("line"), e.round(c("third")).alias("w"), e.date_diff_days("2002-01-01", c("l_shipdate")).alias("d"),
                       e.compare(c("l_shipdate"), ">=", "01.05.1998").alias("late"), e.compare(c("l_quantity"), "<", "10").alias("small"))
    return rounded(done.groupBy("line").agg(F.sum("w").alias("whole"), F.sum("d").alias("days"), F.count_if("late").alias("late"), F.count_if("small").alias("small")))


@query(with_views("usage") + """ SELECT record_id, material_code, value, quantity * 2 AS a, quantity * 2 + 1 AS b,
    CASE WHEN quantity * 2 + 1 > 50 THEN 'duże' ELSE 'małe' END AS size FROM usage""")
def calculated_columns(spark, folder):
    rows = usage(spark, folder).select("record_id", "material_code", "value", "quantity")
    done = calculate(rows, {
        "size": (["b"], lambda e: e.if_(e.compare(F.col("b"), ">", 50), "duże", "małe"), "text"),
        "b": (["a"], lambda e: e.add(F.col("a"), 1), "number"),
        "a": (["quantity"], lambda e: e.mul(F.col("quantity"), 2), "number")})
    return done.drop("quantity")


FREE = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM {t} WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus"


@query(FREE.format(t="lineitem"))
def free_sql(spark, folder):
    table(spark, folder, "lineitem").createOrReplaceTempView("supplylens_lineitem")
    return spark.sql(FREE.format(t="supplylens_lineitem"))
