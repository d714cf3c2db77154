"""Reading, header detection, mapping and writing on the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from supplylens.operators import identity, mapping, tables
from supplylens.registry import query, rounded
from supplylens.registry.texts import _pick, number_texts
from supplylens.registry.views import table, usage, with_views
from supplylens.sources import grid, readers, sinks


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
    'part.parquet' AS file, p_partkey + 1 AS source_row FROM part""")
def read_raw(spark, folder):
    df = readers.read_raw(spark, f"{folder}/part.parquet").withColumn("file", F.regexp_extract("source_file", "[^/]+$", 0))
    return df.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "file", "source_row")


@query("""SELECT 'lineitem' AS source_sheet, count(*) AS n, 1 AS first, count(*) AS last FROM lineitem
    UNION ALL SELECT 'orders', count(*), 1, count(*) FROM orders""")
def read_many(spark, folder):
    parts = [readers.read_many(spark, [f"{folder}/{t}.parquet"]).select("source_sheet", "source_row") for t in ("lineitem", "orders")]
    return rounded(parts[0].unionByName(parts[1]).groupBy("source_sheet").agg(
        F.count("*").alias("n"), F.min("source_row").alias("first"), F.max("source_row").alias("last")))


@query("""SELECT 'part' AS source_name, p_partkey AS source__0, p_name AS source__1, p_size AS source__2, 'raw' AS validation_status FROM part""")
def raw_dataset(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_size", F.lit("part").alias("source_name"))
    return rounded(readers.raw_dataset(rows, ["source_name"]))


def event_grids(spark, folder):
    """One small report per user: 0 to 2 title lines, a heading, then the user's events."""
    rows = table(spark, folder, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    data = rows.select("user_id", (place + F.col("user_id") % 3).alias("row"), F.col("event_id").cast("string").alias("c0"),
                       F.date_format("ts", "yyyy-MM-dd").alias("c1"), F.col("value").cast("string").alias("c2"), F.col("event_type").alias("c3"))
    users = rows.select("user_id").distinct()
    head = users.select("user_id", (F.col("user_id") % 3).alias("row"), F.lit("Order number").alias("c0"), F.lit("Delivery date").alias("c1"),
                        F.lit("Quantity").alias("c2"), F.lit("Status").alias("c3"))
    title = users.where("user_id % 3 > 0").select("user_id", F.explode(F.sequence(F.lit(0), F.col("user_id") % 3 - 1)).alias("row"),
                                                  F.lit("Raport").alias("c0"), *[F.lit("").alias(f"c{i}") for i in (1, 2, 3)])
    return title.unionByName(head).unionByName(data)


@query("SELECT DISTINCT user_id, user_id % 3 AS header_row FROM events")
def detect_header_rows(spark, folder):
    cells = grid.to_cells(event_grids(spark, folder), "row", ["c0", "c1", "c2", "c3"], ["user_id"])
    return rounded(grid.detect_header_rows(cells, ["user_id"]).select("user_id", "header_row"))


@query("""WITH g AS (SELECT l_linenumber, l_returnflag, CASE WHEN l_quantity >= 50 THEN 'x' END AS rare FROM lineitem)
    SELECT c AS "column" FROM (SELECT unnest(['number', 'flag', 'rare', 'void']) AS c, unnest([true, true,
    (SELECT count(rare) >= 2 OR count(rare) >= 0.1 * count(*) FROM g), false]) AS kept) WHERE kept""")
def prune_ghost_columns(spark, folder):
    g = table(spark, folder, "lineitem").select(
        F.lit(1).alias("row"), F.col("l_linenumber").cast("string").alias("number"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_quantity") >= 50, "x").alias("rare"), F.lit(None).cast("string").alias("void"))
    kept = grid.kept_columns(g, "row", ["number", "flag", "rare", "void"], 0)
    # one row per column of the table that is left, also where it has no rows
    counts = g.select(*kept).agg(*[F.count(c).alias(c) for c in kept])
    return counts.select(F.explode(F.array(*[F.lit(c) for c in counts.columns])).alias("column"))


@query("""SELECT count(*) FILTER (WHERE event_id % 7 = 3) AS empty_rows, count(*) AS rows,
    count(*) FILTER (WHERE event_id % 7 <> 3) AS kept FROM events""")
def drop_empty_rows(spark, folder):
    gone = F.col("event_id") % 7 == 3
    rows = table(spark, folder, "events").select(*[F.when(gone, F.lit(" ")).otherwise(F.col(c).cast("string")).alias(c)
                                                  for c in ("event_type", "value", "props")])
    kept = grid.drop_empty_rows(rows, rows.columns).agg(F.count("*").alias("kept"), F.lit(1).alias("_one"))
    return grid.count_empty_rows(rows, rows.columns).withColumn("_one", F.lit(1)).join(kept, "_one").drop("_one")


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS even,
        count(*) FILTER (WHERE l_returnflag = 'N') AS no FROM lineitem)
    SELECT 'day' AS "column", 'date' AS type, 0 AS text, 0 AS number, n AS date, 0 AS boolean FROM n
    UNION ALL SELECT 'price', 'number', 0, n, 0, 0 FROM n
    UNION ALL SELECT 'half', CASE WHEN least(even, n - even) / greatest(even, n - even) > 0.35 THEN 'mixed' ELSE 'number' END,
        even, n - even, 0, 0 FROM n
    UNION ALL SELECT 'flag', 'boolean', 0, 0, 0, n FROM n
    UNION ALL SELECT 'void', 'empty', 0, 0, 0, 0 FROM n""")
def infer_types(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "dd.MM.yyyy").alias("day"), F.format_number("l_extendedprice", 2).alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, "abc").otherwise("12,5").alias("half"),
        F.when(F.col("l_returnflag") == "N", "nie").otherwise("tak").alias("flag"), F.lit("").alias("void"))
    return grid.infer_types(rows)


@query("""SELECT p_name AS material, CAST(p_size * 40 AS DOUBLE) AS stock_level, DATE '2001-06-30' AS date,
    'szt.' AS unit, greatest(0.0, CAST(20 - p_size AS DOUBLE)) AS lead_time_days FROM part WHERE p_size % 5 < 3""")
def read_stock(spark, folder):
    size = F.col("p_size") % 5
    raw = table(spark, folder, "part").select(
        F.concat(F.lit(" "), F.col("p_name")).alias("Materiał"),
        F.when(size == 3, F.lit("-1")).when(size == 4, F.lit("brak")).otherwise((F.col("p_size") * 40).cast("string")).alias("Zapas"),
        F.lit("30.06.2001").alias("Data"), F.lit("szt.").alias("Jm"), (20 - F.col("p_size")).cast("string").alias("Lead time"))
    fields = {"material": "Materiał", "stock_level": "Zapas", "date": "Data", "unit": "Jm", "lead_time_days": "Lead time"}
    return readers.read_stock(raw, fields, "2001-12-31").select("material", "stock_level", "date", "unit", "lead_time_days")


@query(with_views("usage") + """ SELECT date, material, quantity, CAST(NULL AS VARCHAR) AS stock_level, brand, category,
    material_code FROM usage""")
def apply_mapping(spark, folder):
    rows = usage(spark, folder).select(F.col("date").alias("Data"), F.col("material").alias("Nazwa"), F.col("quantity").alias("Ilość"),
                                       F.col("brand").alias("Marka"), F.col("category").alias("Grupa"), F.col("material_code").alias("Kod"))
    fields = {"date": "Data", "material": "Nazwa", "quantity": "Ilość", "brand": "Marka", "category": "Grupa", "material_code": "Kod"}
    return mapping.apply_mapping(rows, fields).select("date", "material", "quantity", "stock_level", "brand", "category", "material_code")


HEADERS = [("Data zużycia", "Usage date", "Timestamp"), ("Nazwa materiału", "Pack material", "Material name"), ("Zużycie", "Qty", "Consumption"),
           ("Marka", "Brand name", "Client brand"), ("Linia", "Workstation", "Obszar"), ("Jednostka", "UOM", "Unit of measure")]
KINDS = ["date", "text", "number", "text", "text", "text"]
FIELDS = ["date", "material", "quantity", "brand", "line", "unit"]


def supplier_headers(spark, folder):
    """The columns of one imagined table per supplier, in one of three languages."""
    way = F.col("s_suppkey") % 3
    columns = [F.struct(F.lit(i).alias("position"), _pick(way, *map(F.lit, words)).alias("header"), F.lit(kind).alias("type"))
               for i, (words, kind) in enumerate(zip(HEADERS, KINDS))]
    columns.append(F.struct(F.lit(9).alias("position"), F.col("s_name").alias("header"), F.lit("text").alias("type")))
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("name"), F.inline(F.array(*columns)))


def _expected_headers() -> str:
    parts = [f"SELECT {i} AS position, ['{a}', '{b}', '{c}'] AS words, '{f}' AS field" for i, ((a, b, c), f) in enumerate(zip(HEADERS, FIELDS))]
    return f"SELECT s_suppkey AS name, field, words[1 + s_suppkey % 3] AS header, 1.0::DOUBLE AS score FROM supplier, ({' UNION ALL '.join(parts)})"


@query(_expected_headers())
def match_columns(spark, folder):
    return rounded(mapping.match_columns(supplier_headers(spark, folder), ["name"]))


@query("""WITH h AS (SELECT DISTINCT p_type AS header, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS f FROM part
        UNION SELECT DISTINCT p_name, lower(p_name) FROM part),
    a AS (SELECT unnest(['kategoria', 'category', 'group', 'grupa', 'family']) AS w),
    s AS (SELECT header, max(greatest(1 - levenshtein(f, w) / greatest(length(f), length(w)),
        len(list_intersect(str_split(f, ' '), str_split(w, ' '))) / len(list_distinct(str_split(f, ' ') || str_split(w, ' '))))) AS near FROM h, a GROUP BY header)
    SELECT header, 'category' AS field, round(least(1.0, near + 0.08), 6) AS score FROM s""")
def header_scores(spark, folder):
    rows = table(spark, folder, "part").select(F.explode(F.array("p_type", "p_name")).alias("header")).distinct()
    rows = rows.select("header", F.lit(0).alias("position"), F.lit("text").alias("type"))
    scores = mapping.score_headers(rows).where("field = 'category'")
    return rounded(scores.select("header", "field", "score"), 6)


ROLE_WORDS = {"date": ("data stanu", "snapshot date", "stock date"), "material_code": ("kod materiału", "article code", "item code"),
              "stock_level": ("stan zapasu", "on hand", "saldo"), "lead_time_days": ("czas dostawy", "lead time", "lead time days")}


@query("SELECT s_suppkey AS name, field, words[1 + s_suppkey % 3] AS header FROM supplier, (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, {list(w)} AS words" for f, w in ROLE_WORDS.items()) + ")")
def match_role_columns(spark, folder):
    way = F.col("s_suppkey") % 3
    kinds = {"date": "date", "stock_level": "number", "lead_time_days": "number"}
    columns = [F.struct(F.lit(i).alias("position"), _pick(way, *map(F.lit, words)).alias("header"), F.lit(kinds.get(f, "text")).alias("type"))
               for i, (f, words) in enumerate(ROLE_WORDS.items())]
    headers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("name"), F.inline(F.array(*columns)))
    return mapping.match_role_columns(headers, ["name"], "stock").select("name", "field", "header")


@query("SELECT user_id, 'delivery_tracking' AS type, count(*) AS row_count FROM events GROUP BY user_id")
def classify_tables(spark, folder):
    names = ["Article", "QTY Ordered", "Delivery Date", "ORD/REQ Number", "QTY", "Supplier"]
    catalog = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("row_count"), F.avg("value").alias("_v")).select(
        F.col("user_id"), F.concat(F.lit("Dostawy "), F.col("user_id")).alias("name"), F.col("user_id").alias("position"),
        F.array(*[F.lit(n) for n in names]).alias("headers"), "row_count", F.lit(0).alias("header_row"), F.lit(1.0).alias("density"),
        F.lit(0.0).alias("blank_first"))
    return tables.classify_tables(catalog).select("user_id", "type", "row_count")


@query("""SELECT CAST(user_id AS VARCHAR) AS book, unnest(['Zużycie', 'Zapas', 'Przyjęcia', 'Zamówienia', 'Kartoteka', 'Notatki']) AS name,
    unnest(['usage', 'stock', 'receipts', 'orders', 'master', 'ignore']) AS role FROM (SELECT DISTINCT user_id FROM events)""")
def assign_roles(spark, folder):
    lists = {"Zużycie": ["Data", "Kod materiału", "Zużycie"], "Zapas": ["Kod materiału", "Stan zapasu"],
             "Przyjęcia": ["Data przyjęcia", "Kod materiału", "Ilość przyjęta"], "Zamówienia": ["Kod materiału", "Otwarte zamówienia"],
             "Kartoteka": ["Kod materiału", "Jednostka", "Dostawca"], "Notatki": ["Komentarz"]}
    kinds = {"Data": "date", "Data przyjęcia": "date", "Zużycie": "number", "Stan zapasu": "number", "Ilość przyjęta": "number", "Otwarte zamówienia": "number"}
    books = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("book")).distinct()
    cells = [(i, name, j, h, kinds.get(h, "text")) for i, (name, hs) in enumerate(lists.items()) for j, h in enumerate(hs)]
    headers = books.select("book", F.inline(F.array(*[F.struct(
        F.lit(n).alias("sheet"), F.lit(j).alias("position"), F.lit(h).alias("header"), F.lit(k).alias("type")) for _, n, j, h, k in cells])))
    headers = headers.withColumn("name", F.concat_ws("|", "book", "sheet"))
    catalog = books.select("book", F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("sheet")) for i, n in enumerate(lists)])))
    catalog = catalog.withColumn("name", F.concat_ws("|", "book", "sheet"))
    scores = tables.role_scores(catalog, headers).withColumn("book", F.split("name", r"\|")[0])
    return tables.assign_roles(scores, ["book"]).select("book", F.split("name", r"\|")[1].alias("name"), "role")


@query("""SELECT event_type, CASE WHEN event_id % 6 IN (0, 1, 2, 4) THEN '''' ELSE '' END AS mark, count(*) AS n FROM events GROUP BY ALL""")
def neutralize_formulas(spark, folder):
    lead = _pick(F.col("event_id") % 6, *map(F.lit, ("=", "+", "@", "-5", "-x", "a")))
    # a lone negative number passes in this export; other text after '-' does not
    cell = F.when(F.col("event_id") % 6 == 3, lead).otherwise(F.concat(lead, F.col("props")))
    rows = table(spark, folder, "events").select("event_type", sinks.neutralize(cell).alias("cell"))
    return rows.groupBy("event_type", F.when(F.col("cell").startswith("'"), "'").otherwise("").alias("mark")).agg(F.count("*").alias("n"))


@query(with_views("usage") + """ SELECT strftime(date, '%Y-%m-%d') AS date, material, CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS quantity,
    CASE WHEN quantity > 25 THEN 'Tak' ELSE 'Nie' END AS large, CAST(record_id AS VARCHAR) AS record_id FROM usage""")
def clean_export(spark, folder):
    rows = usage(spark, folder).select("date", "material", "quantity", (F.col("quantity") > 25).alias("large"), "record_id",
                                       F.lit("valid").alias("validation_status"))
    return sinks.export_columns(sinks.clean_data(rows))


@query("""SELECT shape AS source_row, 'Nieprawidłowa ilość.; Brak daty.' AS errors, count(*) AS n FROM (
    SELECT (l_orderkey + l_linenumber) % 10 AS shape FROM lineitem) GROUP BY shape""")
def error_export(spark, folder):
    rejected = number_texts(spark, folder).select(F.col("shape").alias("source_row"),
                                                  F.array(F.lit("invalid_quantity"), F.lit("missing_date")).alias("errors"))
    return sinks.error_report(rejected).groupBy("source_row", "errors").agg(F.count("*").alias("n"))


@query("""SELECT 'in' AS side, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'out', o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def combine_tables(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    parts = [orders.where("status = 'F'").withColumn("source_sheet", F.lit("in")), orders.where("status <> 'F'").withColumn("source_sheet", F.lit("out"))]
    return identity.combine(parts).withColumnRenamed("source_sheet", "side")


@query("""SELECT 'a' AS t, l_orderkey AS record, l_quantity AS quantity, l_tax AS "Źródło: quantity", NULL AS "Źródło: quantity (2)" FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT 'b', l_orderkey, l_discount, NULL, l_quantity FROM lineitem WHERE l_returnflag <> 'A'""")
def union_role_tables(spark, folder):
    line = table(spark, folder, "lineitem")
    a = line.where("l_returnflag = 'A'").select(F.lit("a").alias("t"), F.col("l_orderkey").alias("record"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("Źródło: quantity"))
    b = line.where("l_returnflag <> 'A'").select(F.lit("b").alias("t"), F.col("l_orderkey").alias("record"), F.col("l_discount").alias("quantity"), F.col("l_quantity").alias("quantity"))
    return rounded(identity.union_role([a, b], ["t", "record", "quantity"], [{3}, {3}]))


@query(with_views("usage") + """ SELECT count(*) AS n, count(DISTINCT material_code) AS codes, sum(quantity) AS quantity,
    count(*) FILTER (WHERE material IS NULL) AS unnamed FROM usage""")
def normalize_role_table(spark, folder):
    rows = usage(spark, folder).select(
        F.date_format("date", "dd.MM.yyyy").alias("date"), F.when(F.col("quantity") > 0, F.lit("")).alias("material"),
        F.concat(F.lit(" "), F.col("material_code")).alias("material_code"), F.regexp_replace(F.col("quantity").cast("string"), r"\.", ",").alias("quantity"))
    done = identity.normalize_role_table(rows, "usage")
    return done.agg(F.count("*").alias("n"), F.count_distinct("material_code").alias("codes"), F.sum("quantity").alias("quantity"),
                    F.count_if(F.col("material").isNull()).alias("unnamed"))

