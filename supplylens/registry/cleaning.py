"""Validation, duplicates, canonical values, transformations and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.operators import clean, filters, pivot, transform
from supplylens.registry import query, rounded
from supplylens.registry.texts import _pick
from supplylens.registry.views import CTE, ORDER, table, usage, with_views


def raw_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage rows as text with planted faults, by rules on keys that the SQL repeats."""
    u = usage(spark, folder)
    key, code = F.col("record_id"), F.col("material_code").cast("bigint")
    day = F.date_format("date", "dd.MM.yyyy")
    return u.select(
        F.when(key % 101 == 0, F.lit("")).when(key % 103 == 0, F.lit("31.02.2001")).otherwise(day).alias("date"),
        F.when(key % 107 == 0, F.lit("  ")).when(code % 3 == 0, F.upper("material")).when(code % 3 == 1, F.concat(F.lit(" "), "material"))
        .otherwise(F.col("material")).alias("material"),
        F.when(key % 109 == 0, F.lit(None)).when(key % 113 == 0, F.lit("dużo")).when(key % 127 == 0, F.concat(F.lit("-"), F.col("quantity").cast("string")))
        .when(key % 131 == 0, F.lit("0")).otherwise(F.replace(F.col("quantity").cast("string"), F.lit("."), F.lit(","))).alias("quantity"),
        F.concat(F.lit("r"), key.cast("string")).alias("record_id"), F.col("material_code"), "supplier", "value",
        _pick(code % 3, F.lit("PCS"), F.lit("szt"), F.lit("kilogram")).alias("unit"), F.col("brand"))


RAW = """SELECT *, CASE WHEN record_id % 101 = 0 THEN NULL WHEN record_id % 103 = 0 THEN NULL ELSE date END AS d,
    CASE WHEN record_id % 109 = 0 THEN NULL WHEN record_id % 113 = 0 THEN NULL WHEN record_id % 127 = 0 THEN -quantity
         WHEN record_id % 131 = 0 THEN 0 ELSE quantity END AS q,
    list_filter([CASE WHEN record_id % 101 = 0 THEN 'missing_date' WHEN record_id % 103 = 0 THEN 'invalid_date' END,
        CASE WHEN record_id % 107 = 0 THEN 'missing_material' END,
        CASE WHEN record_id % 109 = 0 THEN 'missing_quantity' WHEN record_id % 113 = 0 THEN 'invalid_quantity'
             WHEN record_id % 127 = 0 THEN 'negative_quantity' END], lambda x: x IS NOT NULL) AS errors,
    record_id % 109 <> 0 AND record_id % 113 <> 0 AND record_id % 127 <> 0 AND record_id % 131 = 0 AS zero FROM usage"""
KEPT = """SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY material_code, supplier, value) AS place,
    first_value(material_code) OVER (PARTITION BY record_id ORDER BY material_code, supplier, value) AS first_code
    FROM raw WHERE len(errors) = 0"""
CLEAN = f"WITH usage AS ({CTE['usage']}), raw AS ({RAW}), kept AS ({KEPT}) "
SOURCE = ["date", "material", "quantity", "record_id", "material_code", "supplier", "value", "unit", "brand"]


@query(CLEAN + "SELECT array_to_string(errors, ',') AS errors, zero AS warned, count(*) AS n FROM raw GROUP BY ALL")
def validate_rows(spark, folder):
    checked = clean.validate(raw_usage(spark, folder))
    return checked.groupBy(F.array_join("errors", ",").alias("errors"), (F.size("warnings") > 0).alias("warned")).agg(F.count("*").alias("n"))


@query(CLEAN + """SELECT kind, code, CAST(rows AS BIGINT) AS rows FROM (
    SELECT 'error' AS kind, e AS code, count(*) AS rows FROM (SELECT unnest(errors) AS e FROM raw) GROUP BY e
    UNION ALL SELECT 'warning', 'zero_quantity', count(*) FROM raw WHERE zero
    UNION ALL SELECT 'total', 'all', count(*) FROM raw
    UNION ALL SELECT 'total', 'invalid', count(*) FROM raw WHERE len(errors) > 0
    UNION ALL SELECT 'total', 'valid', count(*) FROM kept WHERE place = 1
    UNION ALL SELECT 'total', 'duplicate', count(*) FROM kept WHERE place > 1
    UNION ALL SELECT 'total', 'warning', count(*) FROM kept WHERE place = 1 AND zero) WHERE rows > 0""")
def validation_summary(spark, folder):
    good, bad = clean.split_valid(clean.checked_rows(raw_usage(spark, folder), SOURCE))
    tagged = clean.tag_duplicates(good, None, ORDER)
    return clean.validation_summary(tagged.unionByName(bad, allowMissingColumns=True))


@query(CLEAN + """SELECT record_id, material_code, supplier, value, place = 1 AS kept,
    CASE WHEN place > 1 THEN first_code END AS duplicate_of FROM kept""")
def dedupe_rows(spark, folder):
    good, _ = clean.split_valid(clean.validate(raw_usage(spark, folder)))
    tagged = clean.tag_duplicates(good, clean.duplicate_key(good, SOURCE), ORDER)
    return tagged.select(F.substring("record_id", 2, 20).cast("bigint").alias("record_id"), "material_code", "supplier", "value",
                         F.col("duplicate_of").isNull().alias("kept"), F.col("duplicate_of.material_code").alias("duplicate_of"))


@query(CLEAN + """SELECT CAST(record_id AS VARCHAR) AS record_id, d AS date, q AS quantity, CAST(year(d) AS BIGINT) AS year,
    strftime(d, '%Y-%m') AS month_key, CASE WHEN CAST(material_code AS BIGINT) % 3 = 2 THEN 'kg' ELSE 'szt.' END AS unit,
    lower(material) AS material, CASE WHEN zero THEN 'warning' ELSE 'valid' END AS validation_status FROM kept WHERE place = 1""")
def process_dataset(spark, folder):
    valid, _ = clean.process_dataset(raw_usage(spark, folder), SOURCE, ORDER)
    return rounded(valid.select(F.substring("record_id", 2, 20).alias("record_id"), "date", "quantity", "year", "month_key", "unit",
                                F.lower("material").alias("material"), "validation_status"))


@query(CLEAN + """SELECT (SELECT count(*) FROM raw) AS source_rows, count(*) AS valid_rows, (SELECT count(*) FROM raw WHERE len(errors) > 0) AS invalid_rows,
    (SELECT count(*) FROM kept WHERE place > 1) AS duplicate_rows, round(sum(q), 4) AS quantity_sum, round(avg(q), 4) AS quantity_avg, min(q) AS quantity_min, max(q) AS quantity_max,
    min(d) AS date_min, max(d) AS date_max FROM kept WHERE place = 1""")
def class_statistics(spark, folder):
    return rounded(pivot.class_statistics(*clean.process_dataset(raw_usage(spark, folder), SOURCE, ORDER)))


@query(CLEAN + """SELECT unnest(['accepted', 'duplicate_record']) AS outcome, unnest([accepted, fixed - accepted]) AS n FROM (
    SELECT count(*) AS fixed, count(DISTINCT CASE WHEN NOT EXISTS (
        SELECT 1 FROM kept k WHERE k.place = 1 AND k.record_id = r.record_id) THEN r.record_id END) AS accepted
    FROM raw r WHERE len(errors) > 0)""")
def revalidate_rows(spark, folder):
    good, bad = clean.split_valid(clean.checked_rows(raw_usage(spark, folder), SOURCE))
    kept, _ = clean.dedupe(good, None, ORDER)
    fixed = bad.withColumns({"date": F.lit("2001-01-01"), "material": F.lit("x"), "quantity": F.lit("1")})
    accepted, rest = clean.revalidate(fixed, kept, SOURCE, ORDER)
    counts = [accepted.agg(F.lit("accepted").alias("outcome"), F.count("*").alias("n")),
              rest.agg(F.lit("duplicate_record").alias("outcome"), F.count("*").alias("n"))]
    return counts[0].unionByName(counts[1])


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total FROM (
    SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)""")
def count_duplicates(spark, folder):
    got = clean.count_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])
    return rounded(got.select((F.col("rows") - F.col("duplicate_rows")).alias("rows"), "groups", "duplicate_rows", F.col("rows").alias("total")))


# ---- canonical values -------------------------------------------------------------------

def spelled_brands(spark, folder):
    """Brand names in several spellings; which one is frequent depends on the brand."""
    way = F.col("l_linenumber") % 3
    u = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    text = F.when(way == 0, F.col("p_brand")).when(way == 1, F.upper("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("&")))
    return u.select(text.alias("brand"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))


SPELLED = """WITH s AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) ELSE replace(p_brand, '#', '&') END AS v,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT v, lower(regexp_replace(v, '[#&]', ' ')) AS k, count(*) AS n,
        min((l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS seen FROM s GROUP BY v),
    best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(regexp_replace(v, '[^&+@]', '', 'g')) DESC, length(v),
        length(regexp_replace(v, '[^A-Z]', '', 'g')) DESC, v) AS place, row_number() OVER (PARTITION BY k ORDER BY seen) AS first FROM c) """


@query(SPELLED + "SELECT b.v AS brand, CAST(sum(c.n) AS BIGINT) AS n FROM c JOIN best b ON b.k = c.k AND b.place = 1 GROUP BY b.v")
def canonicalize_values(spark, folder):
    return clean.canonicalize(spelled_brands(spark, folder), "brand").groupBy("brand").agg(F.count("*").alias("n"))


@query(SPELLED + "SELECT b.v AS brand, CAST(sum(c.n) AS BIGINT) AS n FROM c JOIN best b ON b.k = c.k AND b.first = 1 GROUP BY b.v")
def canonicalize_first_seen(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return clean.canonicalize_first(spelled_brands(spark, folder), "brand", order).groupBy("brand").agg(F.count("*").alias("n"))


@query(SPELLED + """SELECT c.v AS original, b.v AS normalized, c.v <> b.v AS changed, c.n AS rows FROM c JOIN best b ON b.k = c.k AND b.place = 1""")
def normalization_audit(spark, folder):
    return clean.normalization_audit(spelled_brands(spark, folder), "brand")


# ---- transformations --------------------------------------------------------------------

@query("""SELECT doc_id, replace(text, 'e', '#') AS literal, regexp_replace(text, '[aeiou]+', '*', 'g') AS pattern,
    regexp_replace(text, 'th', '<>', 'i') AS first_only, upper(lang) AS upper, lower(upper(source)) AS lower FROM documents""")
def replace_text(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", transform.replace(t, "e", "#").alias("literal"), transform.replace(t, "/[aeiou]+/g", "*").alias("pattern"),
        transform.replace(t, "/th/i", "<>").alias("first_only"), transform.upper(F.col("lang")).alias("upper"),
        transform.lower(F.upper("source")).alias("lower"))


@query("""SELECT p_partkey, upper(p_name[1]) || substr(replace(p_name, ' ', '-'), 2, length(str_split(p_name, ' ')[1])) ||
    upper(str_split(p_name, ' ')[2][1]) || substr(str_split(p_name, ' ')[2], 2) AS proper, '  ' || p_name || 'x' AS cleaned, p_name AS trimmed FROM part""")
def proper_trim_clean(spark, folder):
    name = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey", transform.proper(F.replace(name, F.lit(" "), F.lit("-"))).alias("proper"),
        transform.clean(F.concat(F.lit("\t\x01  "), name, F.lit("\x7fx"))).alias("cleaned"),
        transform.trim(F.concat(F.lit(" \t"), name, F.lit("\n "))).alias("trimmed"))


@query("""SELECT l_linenumber AS line, sum(round(l_quantity / 8 + 0.0001)) AS whole, round(sum(round(l_extendedprice / 7, -1)), 2) AS tens,
    round(sum(l_extendedprice), 2) AS positive FROM lineitem GROUP BY 1""")
def round_and_abs(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("line"), (F.col("l_quantity") / 8 + 0.0001).alias("a"), (F.col("l_extendedprice") / 7).alias("b"),
        (-F.col("l_extendedprice")).alias("c"))
    done = rows.select("line", transform.round_to(rows, "a", 0).alias("a"), transform.round_to(rows, "b", -1).alias("b"), transform.absolute(rows, "c").alias("c"))
    return rounded(done.groupBy("line").agg(F.sum("a").alias("whole"), F.sum("b").alias("tens"), F.sum("c").alias("positive")), 2)


@query("""SELECT o_orderkey % 10 AS shape, CASE WHEN o_orderkey % 10 IN (7, 9) THEN 'kept' ELSE 'iso' END AS form, count(*) AS n FROM orders GROUP BY ALL""")
def to_date_text(spark, folder):
    from supplylens.registry.texts import date_texts
    rows = date_texts(spark, folder)
    done = rows.select("shape", "raw", transform.to_date(rows, "raw").alias("d"))
    form = F.when(F.col("d") == F.col("raw"), F.when(F.col("shape") == 0, "iso").otherwise("kept")).otherwise("iso")
    return done.groupBy("shape", form.alias("form")).agg(F.count("*").alias("n"))


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINES = ", ".join(LINE)


def gappy(spark, folder):
    return table(spark, folder, "lineitem").select(*LINE, F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("flag"))


@query(f"""SELECT {LINES}, last_value(CASE WHEN l_linenumber = 1 THEN l_returnflag END IGNORE NULLS) OVER (ORDER BY {LINES}
    ROWS UNBOUNDED PRECEDING) AS flag FROM lineitem""")
def fill_down(spark, folder):
    return rounded(transform.fill(gappy(spark, folder), "flag", LINE))


@query(f"""SELECT {LINES}, first_value(CASE WHEN l_linenumber = 1 THEN l_returnflag END IGNORE NULLS) OVER (ORDER BY {LINES}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS flag FROM lineitem""")
def fill_up(spark, folder):
    return rounded(transform.fill(gappy(spark, folder), "flag", LINE, up=True))


@query(f"""SELECT {LINES}, last_value(CASE WHEN l_linenumber = 1 THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY {LINES}
    ROWS UNBOUNDED PRECEDING) AS flag FROM lineitem""")
def fill_down_within(spark, folder):
    return rounded(transform.fill(gappy(spark, folder), "flag", LINE, within=["l_suppkey"]))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL""")
def remove_empty(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("flag", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).otherwise(" "))
    return rounded(transform.remove_empty(rows, "flag").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")))


@query("""SELECT l_orderkey, l_linenumber, min((l_partkey, l_suppkey)).l_partkey AS l_partkey FROM (
    SELECT l_orderkey, l_linenumber, {'l_partkey': l_partkey, 'l_suppkey': l_suppkey} AS p, l_partkey, l_suppkey FROM lineitem) GROUP BY ALL""".replace(
    "min((l_partkey, l_suppkey)).l_partkey", "min(p).l_partkey"))
def remove_duplicates(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kept = transform.remove_duplicates(rows, ["l_partkey", "l_suppkey", "l_extendedprice"], ["l_orderkey", "l_linenumber"])
    return rounded(kept.select("l_orderkey", "l_linenumber", "l_partkey"))


@query("""SELECT 1 AS step, 'upper' AS operation, 'flag' AS field, count(*) FILTER (WHERE l_linenumber <> 2) AS affected FROM lineitem
    UNION ALL SELECT 2, 'fill-down', 'flag', count(*) FILTER (WHERE l_linenumber = 2 AND seen > 0) FROM (SELECT l_linenumber,
        count(CASE WHEN l_linenumber <> 2 THEN 1 END) OVER (ORDER BY """ + LINES + """ ROWS UNBOUNDED PRECEDING) AS seen FROM lineitem)
    UNION ALL SELECT 3, 'replace', 'flag', count(*) FILTER (WHERE f = 'A') FROM (SELECT last_value(CASE WHEN l_linenumber <> 2 THEN l_returnflag END IGNORE NULLS)
        OVER (ORDER BY """ + LINES + """ ROWS UNBOUNDED PRECEDING) AS f FROM lineitem)""")
def transformation_steps(spark, folder):
    rows = table(spark, folder, "lineitem").select(*LINE, F.when(F.col("l_linenumber") != 2, F.lower("l_returnflag")).otherwise("").alias("flag"))
    return rounded(transform.affected_counts(rows, [("upper", "flag"), ("fill-down", "flag"), ("replace", "flag", "A", "Z")], LINE))


@query("""WITH p AS (SELECT e.user_id * 3 AS p_partkey, e.event_type, e.event_id FROM events e)
    SELECT p_partkey, coalesce((SELECT arg_max(event_type, event_id) FROM p WHERE p.p_partkey = part.p_partkey), p_name) AS p_name, p_brand FROM part""")
def apply_patches(spark, folder):
    patches = table(spark, folder, "events").select((F.col("user_id") * 3).alias("p_partkey"), F.lit("p_name").alias("field"),
                                                    F.col("event_type").alias("value"), F.col("event_id").alias("sequence"))
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return transform.apply_patches(parts, patches, "p_partkey", ["p_name"])


@query(f"""WITH stock AS ({CTE['stock']}), m AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS material, s_acctbal AS stock_level,
    DATE '2001-01-01' AS date FROM supplier WHERE s_acctbal >= 0)
    SELECT id, material, stock_level, date FROM m UNION ALL SELECT material_code, material, stock_level, date FROM stock
    WHERE material_code NOT IN (SELECT id FROM m)""")
def upsert_stock(spark, folder):
    from supplylens.registry.views import stock
    base = stock(spark, folder).select(F.col("material_code").alias("id"), "material", "stock_level", "date")
    manual = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("material"),
                                                     F.col("s_acctbal").alias("stock_level"), F.lit("2001-01-01").cast("date").alias("date"))
    return transform.upsert_stock(base, manual)


@query("""SELECT p_type AS kind, p_partkey AS id, p_name || '!' AS name FROM part""")
def edit_columns(spark, folder):
    parts = transform.hide_columns(table(spark, folder, "part"), ["p_size", "p_retailprice"])
    parts = transform.add_column(parts, "name", F.concat("p_name", F.lit("!")))
    parts, _ = transform.rename_column(parts, "p_partkey", "id", {"name": ["p_name"]})
    parts, _ = transform.rename_column(parts, "p_type", "kind")
    return transform.reorder_columns(transform.drop_column(transform.drop_column(parts, "p_brand"), "p_name"), ["kind"])


@query("""SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS quantity, o_orderstatus AS material, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders""")
def sync_mapped(spark, folder):
    rows = table(spark, folder, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("source__0"), F.col("o_totalprice").cast("string").alias("source__1"),
                                                 F.concat(F.lit(" "), "o_orderstatus").alias("source__2"))
    return transform.sync_mapped(rows, {"date": "source__0", "quantity": "source__1", "material": "source__2"}).select("date", "quantity", "material", "month_key")


# ---- filters --------------------------------------------------------------------------

@query(with_views("usage") + " SELECT * FROM usage WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def filter_dates(spark, folder):
    return filters.filter_dates(usage(spark, folder), "1998-03-01", "1998-03-31")


@query(with_views("usage") + " SELECT material_code, sum(quantity) AS quantity FROM usage WHERE lower(category) = 'promo' AND quantity = 7 AND unit = 'kg' GROUP BY 1")
def filter_values(spark, folder):
    rows = filters.filter_values(usage(spark, folder), {"category": " Prómo", "quantity": "7,0", "unit": "KG"})
    return rows.groupBy("material_code").agg(F.sum("quantity").alias("quantity"))


@query(with_views("usage") + """ SELECT brand, count(*) AS n FROM usage WHERE material LIKE '%widget%' AND material NOT LIKE 'red%' AND quantity > 10
    AND quantity <= 40 AND date >= DATE '1997-02-01' AND category <> 'PROMO' AND material LIKE '%t' GROUP BY brand""")
def filter_operators(spark, folder):
    rows = filters.filter_ops(usage(spark, folder).where(~F.col("material").startswith("red")), [
        ("material", "contains", "WIDGET"), ("quantity", ">", "10"), ("quantity", "<=", "40,0"), ("date", ">=", "01.02.1997"),
        ("category", "not-equals", "promo"), ("material", "ends-with", "T"), ("brand", "is-not-empty", None)])
    return rows.groupBy("brand").agg(F.count("*").alias("n"))


@query(with_views("usage") + " SELECT brand, count(*) AS n FROM usage WHERE lower(material) LIKE '%ring%' OR lower(supplier) LIKE '%ring%' GROUP BY brand")
def search_rows(spark, folder):
    return filters.search(usage(spark, folder), " RÍNG ", ["material", "supplier"]).groupBy("brand").agg(F.count("*").alias("n"))


@query("""SELECT p_name AS value, false AS is_blank FROM part WHERE p_size <> 7 GROUP BY p_name
    UNION ALL SELECT NULL, true FROM (SELECT 1 FROM part WHERE p_size = 7 LIMIT 1)""")
def filter_options(spark, folder):
    rows = table(spark, folder, "part").withColumn("name", F.when(F.col("p_size") == 7, " ").otherwise(F.col("p_name")))
    return filters.filter_options(rows, "name")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def scope_filtered(spark, folder):
    rows = table(spark, folder, "lineitem")
    return filters.scope(rows, rows.where("l_quantity > 45"), "filtered").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("""SELECT p_type, p_size, p_partkey, row_number() OVER (ORDER BY p_type DESC, p_size, p_partkey) AS place FROM part""")
def sort_rows(spark, folder):
    from supplylens.plans.ordered import row_numbers
    parts = table(spark, folder, "part").select("p_type", "p_size", "p_partkey")
    order = [filters.sort_key(parts, "p_type").desc(), filters.sort_key(parts, "p_size").asc(), F.col("p_partkey").asc()]
    return rounded(row_numbers(parts, order, "place"))


@query("""SELECT month, n, row_number() OVER (ORDER BY m) AS place FROM (SELECT ['Styczeń','Luty','Marzec','Kwiecień','Maj','Czerwiec','Lipiec','Sierpień',
    'Wrzesień','Październik','Listopad','Grudzień'][month(o_orderdate)] AS month, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL)""")
def pivot_order(spark, folder):
    from supplylens.functions.dates import date_fields
    from supplylens.plans.ordered import row_numbers
    groups = table(spark, folder, "orders").groupBy(date_fields(F.col("o_orderdate"))["month"].alias("month")).agg(F.count("*").alias("n"))
    return rounded(row_numbers(groups, filters.pivot_order(groups, "month"), "place"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def top_rows(spark, folder):
    return filters.top_k(table(spark, folder, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 100)


@query("SELECT least(500, count(*)) AS n, least(500, count(*)) AS different, 0 AS foreign_rows FROM part")
def sample_rows(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    picked = filters.sample_rows(parts, 500, ["p_partkey"])
    strange = picked.join(parts, ["p_partkey", "p_name"], "left_anti").agg(F.count("*").alias("foreign_rows"), F.lit(1).alias("_one"))
    counts = picked.agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("different"), F.lit(1).alias("_one"))
    return counts.join(strange, "_one").drop("_one")


SHARES = """WITH c AS (SELECT {fields}, count(*) AS n, md5({text}) AS h FROM {table} GROUP BY ALL),
    b AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS before, sum(n) OVER () AS total FROM c),
    t AS (SELECT *, ((2 * {k} * (before + n) + total - 1) // (2 * total) - (2 * {k} * before + total - 1) // (2 * total))::BIGINT AS take FROM b)
    SELECT {names} FROM (SELECT *, unnest(range(take)) FROM t)"""


@query(SHARES.format(fields="l_returnflag AS flag, CASE WHEN l_linenumber > 3 THEN l_linenumber END AS line, l_tax AS tax", k=500, table="lineitem", names="flag, line, tax",
                     text="l_returnflag || '|' || coalesce(CASE WHEN l_linenumber > 3 THEN l_linenumber END::VARCHAR, '-') || '|' || round(l_tax * 100)::BIGINT"))
def sample_shares(spark, folder):
    """Rows with many copies, drawn without a key: each keeps its share."""
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).alias("line"), F.col("l_tax").alias("tax"))
    digest = F.md5(F.concat_ws("|", "flag", F.coalesce(F.col("line").cast("string"), F.lit("-")), F.round(F.col("tax") * 100).cast("bigint").cast("string")))
    return filters.sample_rows(rows, 500, digest=digest)


@query(SHARES.format(fields="o_orderkey, o_totalprice", k=2000, table="orders", names="o_orderkey, o_totalprice", text="o_orderkey::VARCHAR"))
def sample_without_key(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return filters.sample_rows(rows, 2000, digest=F.md5(F.col("o_orderkey").cast("string")))
