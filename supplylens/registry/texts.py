"""Parsing and text functions on texts that Spark derives from the tables.

The texts are written in many formats from known values, so the SQL only has to know the
value that must come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.functions import dates, parse, text
from supplylens.operators.clean import shift_alias, unit_alias
from supplylens.registry import query, rounded
from supplylens.registry.views import table


def _pick(number, *choices):
    """One of the choices by an integer column."""
    column = F.when(number == 0, choices[0])
    for i, choice in enumerate(choices[1:], start=1):
        column = column.when(number == i, choice)
    return column


def number_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Prices in ten spellings: ``shape`` 0..9 and the text."""
    shape = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    us = F.format_number("l_extendedprice", 2)
    plain = F.replace(us, F.lit(","), F.lit(""))
    eu = F.translate(us, ",.", ".,")
    return table(spark, folder, "lineitem").select("l_extendedprice", shape.alias("shape"), _pick(
        shape, us, eu, plain, F.translate(us, ",.", " ,"), F.concat(F.lit("("), plain, F.lit(")")),
        F.concat(plain, F.lit(" %")), F.concat(F.lit("-"), plain, F.lit("e1")), F.concat(plain, F.lit(" PLN")),
        F.concat(plain, F.lit("x")), F.lit("  ")).alias("raw"))


NUMBER_SQL = """SELECT shape, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS unreadable,
    coalesce(round(sum(v), 2), 0.0) AS total FROM (
    SELECT (l_orderkey + l_linenumber) % 10 AS shape, CASE (l_orderkey + l_linenumber) % 10
        WHEN 4 THEN {paren} WHEN 6 THEN -10 * l_extendedprice WHEN 7 THEN {pln} WHEN 8 THEN NULL WHEN 9 THEN NULL
        ELSE l_extendedprice END AS v FROM lineitem) GROUP BY shape"""


def _numbers(spark, folder, dialect):
    value = parse.parse_number(F.col("raw"), dialect)
    rows = number_texts(spark, folder).select("shape", value.alias("v"))
    return rounded(rows.groupBy("shape").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("unreadable"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")), 2)


@query(NUMBER_SQL.format(paren="-l_extendedprice", pln="NULL"))
def parse_number_import(spark, folder):
    return _numbers(spark, folder, "import")


@query(NUMBER_SQL.format(paren="NULL", pln="l_extendedprice"))
def parse_number_analytics(spark, folder):
    return _numbers(spark, folder, "analytics")


def date_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates in ten spellings: ``shape`` 0..9, the day and the text."""
    shape = F.col("o_orderkey") % 10
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    return table(spark, folder, "orders").select(day.alias("day"), shape.alias("shape"), _pick(
        shape, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "d/M/yyyy"),
        F.date_format(day, "yyyy/M/d"), F.date_format(day, "dd-MM-yy"), serial, F.date_format(day, "MMM d, yyyy"),
        F.concat(F.year(day), F.lit("-02-31")), F.date_format(day, "yyyy-MM-dd HH:mm"),
        F.concat(F.lit("week "), F.weekofyear(day), F.lit(" "), F.year(day))).alias("raw"))


DATE_SQL = """SELECT shape, count(*) AS n, count(d) AS readable, min(d) AS first, max(d) AS last,
    CAST(sum(date_diff('day', DATE '1990-01-01', d)) AS BIGINT) AS days FROM (
    SELECT o_orderkey % 10 AS shape, CASE WHEN o_orderkey % 10 IN ({lost}) THEN NULL {extra}
        ELSE CAST(o_orderdate AS DATE) END AS d FROM orders) GROUP BY shape"""


def _dates(spark, folder, dialect):
    rows = date_texts(spark, folder).select("shape", parse.parse_date(F.col("raw"), dialect).alias("d"))
    return rounded(rows.groupBy("shape").agg(
        F.count("*").alias("n"), F.count("d").alias("readable"), F.min("d").alias("first"), F.max("d").alias("last"),
        F.sum(F.datediff("d", F.lit("1990-01-01").cast("date"))).alias("days")))


@query(DATE_SQL.format(lost="7, 9", extra=""))
def parse_date_import(spark, folder):
    return _dates(spark, folder, "import")


# 'yy' years are 20yy in this dialect; slashed ISO dates and serial texts are not dates
@query(DATE_SQL.format(lost="3, 5, 7, 9", extra="""WHEN o_orderkey % 10 = 4 THEN
    make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate))"""))
def parse_date_analytics(spark, folder):
    return _dates(spark, folder, "analytics")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 5 IN (0, 1)) AS import_true,
    count(*) FILTER (WHERE event_id % 5 = 2) AS import_false,
    count(*) FILTER (WHERE event_id % 5 IN (0, 3)) AS analytics_true,
    count(*) FILTER (WHERE event_id % 5 IN (2, 4)) AS analytics_false FROM events GROUP BY event_type""")
def parse_booleans(spark, folder):
    word = _pick(F.col("event_id") % 5, F.lit(" TAK"), F.lit("t"), F.lit("nie"), F.lit("Prawda"), F.lit("fałsz"))
    rows = table(spark, folder, "events").select("event_type", word.alias("w"))
    a, b = parse.parse_bool(F.col("w")), parse.parse_bool(F.col("w"), "analytics")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(a).alias("import_true"), F.count_if(~a).alias("import_false"),
        F.count_if(b).alias("analytics_true"), F.count_if(~b).alias("analytics_false"))


@query("""SELECT CAST(isoyear(o_orderdate) AS BIGINT) AS iso_year, CAST(week(o_orderdate) AS BIGINT) AS iso_week,
    'W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') || ' ' || isoyear(o_orderdate) AS label,
    CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, count(*) AS n FROM orders GROUP BY ALL""")
def resolve_periods(spark, folder):
    day = F.col("o_orderdate").cast("date")
    year, week = F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)
    raw = F.concat(F.lit("cw "), week, F.lit("/"), year)
    rows = table(spark, folder, "orders").select(year.alias("iso_year"), week.alias("iso_week"), raw.alias("raw"))
    return rounded(rows.select("iso_year", "iso_week", parse.parse_period(F.col("raw"))["label"].alias("label"),
                               parse.resolve_period(F.col("raw")).alias("monday")).groupBy(
        "iso_year", "iso_week", "label", "monday").agg(F.count("*").alias("n")))


@query("""WITH t AS (SELECT month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
    SELECT 'mdy' AS convention, round(greatest(0.55, least(1.0, s / greatest(1.0, s))), 4) AS confidence, 'us' AS "column"
    FROM (SELECT sum(CASE WHEN d > 12 THEN 3.0 ELSE 0 END) AS s FROM t)
    UNION ALL SELECT 'dmy', 1.0, 'eu'
    UNION ALL SELECT 'ymd', 1.0, 'iso'""")
def date_conventions(spark, folder):
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, folder, "orders").select(
        F.date_format(day, "M/d/yyyy").alias("us"), F.date_format(day, "dd.MM.yyyy").alias("eu"),
        F.date_format(day, "yyyy-MM-dd").alias("iso"))
    return rounded(parse.infer_date_convention(rows, ["us", "eu", "iso"]))


CALENDAR_SQL = """SELECT DISTINCT CAST(d AS DATE) AS date, CAST(year(d) AS BIGINT) AS year, 'Q' || quarter(d) AS quarter,
    ['Styczeń','Luty','Marzec','Kwiecień','Maj','Czerwiec','Lipiec','Sierpień','Wrzesień','Październik','Listopad',
     'Grudzień'][month(d)] AS month, CAST(month(d) AS BIGINT) AS month_number, strftime(d, '%Y-%m') AS month_key,
    CAST(week(d) AS BIGINT) AS week, isoyear(d) || '-W' || lpad(CAST(week(d) AS VARCHAR), 2, '0') AS week_key,
    ['Poniedziałek','Wtorek','Środa','Czwartek','Piątek','Sobota','Niedziela'][isodow(d)] AS weekday,
    CAST(isodow(d) AS BIGINT) AS weekday_number, CAST(day(d) AS BIGINT) AS day,
    CASE WHEN month(d) IN (12, 1, 2) THEN 'Zima' WHEN month(d) <= 5 THEN 'Wiosna' WHEN month(d) <= 8 THEN 'Lato'
         ELSE 'Jesień' END AS season,
    CASE WHEN month(d) = 12 THEN 'Zima ' || year(d) || '/' || (year(d) + 1)
         WHEN month(d) <= 2 THEN 'Zima ' || (year(d) - 1) || '/' || year(d)
         WHEN month(d) <= 5 THEN 'Wiosna ' || year(d) WHEN month(d) <= 8 THEN 'Lato ' || year(d)
         ELSE 'Jesień ' || year(d) END AS season_period,
    CAST(CASE WHEN month(d) <= 2 THEN year(d) - 1 ELSE year(d) END AS BIGINT) AS season_start_year,
    CAST(CASE WHEN month(d) IN (12, 1, 2) THEN 4 ELSE month(d) // 3 END AS BIGINT) AS season_order,
    CAST(CASE WHEN month(d) <= 2 THEN year(d) - 1 ELSE year(d) END * 10
         + CASE WHEN month(d) IN (12, 1, 2) THEN 4 ELSE month(d) // 3 END AS BIGINT) AS season_sort_key,
    isodow(d) >= 6 AS is_weekend, CAST(hour(d) AS BIGINT) AS hour, strftime(d, '%H:%M') AS time
    FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT date_trunc('minute', ts) FROM events)"""


@query(CALENDAR_SQL)
def derive_date_fields(spark, folder):
    stamps = table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("d")).unionByName(
        table(spark, folder, "events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("d"))).distinct()
    fields = dates.derive_date_fields(stamps, "d").withColumn("date", F.col("d").cast("date"))
    return rounded(fields.select("date", *dates.DATE_FIELDS))


@query("""SELECT CASE WHEN month(d) = 12 THEN 'Zima ' || year(d) || '/' || (year(d) + 1)
         WHEN month(d) <= 2 THEN 'Zima ' || (year(d) - 1) || '/' || year(d)
         WHEN month(d) <= 5 THEN 'Wiosna ' || year(d) WHEN month(d) <= 8 THEN 'Lato ' || year(d)
         ELSE 'Jesień ' || year(d) END AS season_period, sum(l_quantity) AS quantity, count(*) AS n
    FROM (SELECT l_shipdate AS d, l_quantity FROM lineitem) GROUP BY 1""")
def season_periods(spark, folder):
    day = F.col("l_shipdate").cast("date")
    return table(spark, folder, "lineitem").groupBy(dates.season_period(day)["season_period"].alias("season_period")).agg(
        F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("""SELECT g AS granularity, key, count(*) AS n FROM (
    SELECT unnest(['day','week','month','quarter','year']) AS g, unnest([strftime(ts, '%Y-%m-%d'),
        isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0'), strftime(ts, '%Y-%m'),
        year(ts) || '-Q' || quarter(ts), CAST(year(ts) AS VARCHAR)]) AS key FROM events) GROUP BY ALL""")
def period_keys(spark, folder):
    day = F.col("ts").cast("date")
    keys = F.array(*[F.struct(F.lit(g).alias("granularity"), dates.period_key(day, g).alias("key"))
                     for g in ("day", "week", "month", "quarter", "year")])
    return table(spark, folder, "events").select(F.inline(keys)).groupBy("granularity", "key").agg(F.count("*").alias("n"))


@query("""SELECT 'orders' AS t, CAST(min(o_orderdate) AS DATE) AS minimum, CAST(max(o_orderdate) AS DATE) AS maximum,
    date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) + 1 AS days, 'quarter' AS granularity FROM orders
    UNION ALL SELECT 'events', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE),
    date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 'day' FROM events""")
def date_ranges(spark, folder):
    a = dates.date_range(table(spark, folder, "orders"), "o_orderdate").withColumn("t", F.lit("orders"))
    b = dates.date_range(table(spark, folder, "events"), "ts").withColumn("t", F.lit("events"))
    return rounded(a.unionByName(b))


@query("""SELECT lang, count(*) AS n, CAST(sum(length(k)) AS BIGINT) AS characters, count(DISTINCT k) AS different,
    max(k) AS last FROM (SELECT lang, trim(regexp_replace(strip_accents(replace(replace(lower(text), 'ł', 'l'), 'đ', 'd')),
    '[^a-z0-9%]+', ' ', 'g')) AS k FROM documents) GROUP BY lang""")
def label_keys(spark, folder):
    rows = table(spark, folder, "documents").select("lang", text.normalize_label(F.col("text")).alias("k"))
    return rounded(rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("k")).alias("characters"), F.count_distinct("k").alias("different"),
        F.max("k").alias("last")))


@query("""SELECT lang, count(*) AS n, CAST(sum(length(k)) AS BIGINT) AS characters, count(DISTINCT k) AS different FROM (
    SELECT lang, trim(regexp_replace(regexp_replace(translate(strip_accents(lower(regexp_replace(text,
    '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'))), 'ł‐‑‒–—―', 'l------'),
    '[^a-z0-9а-яёіїєґ\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM documents) GROUP BY lang""")
def comparable_keys(spark, folder):
    rows = table(spark, folder, "documents").select("lang", text.comparable_text(F.col("text")).alias("k"))
    return rounded(rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("k")).alias("characters"), F.count_distinct("k").alias("different")))


@query("""SELECT p_type AS category, count(*) AS n, count(DISTINCT upper(p_brand)) AS codes, count(DISTINCT lower(p_name)) AS names
    FROM part GROUP BY p_type""")
def join_keys(spark, folder):
    rows = table(spark, folder, "part")
    spelled = F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" "))
    named = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("  ")))
    return rows.groupBy(F.col("p_type").alias("category")).agg(
        F.count("*").alias("n"), F.count_distinct(text.normalize_key(spelled, "sku")).alias("codes"),
        F.count_distinct(text.normalize_key(named, "material")).alias("names"))


@query("""SELECT unit, shift, count(*) AS n FROM (SELECT
    CASE event_id % 6 WHEN 0 THEN 'szt.' WHEN 1 THEN 'kg' WHEN 2 THEN 'rolka' WHEN 3 THEN 'karton' WHEN 4 THEN 'paleta' END AS unit,
    CASE event_id % 4 WHEN 0 THEN 'Zmiana 1' WHEN 1 THEN 'Popołudnie' WHEN 2 THEN 'Noc' END AS shift FROM events) GROUP BY ALL""")
def unit_and_shift_aliases(spark, folder):
    units = _pick(F.col("event_id") % 6, *map(F.lit, ("PCS", " Kilogram", "Roll", "box", "PALLET", "beczka")))
    shifts = _pick(F.col("event_id") % 4, *map(F.lit, ("Shift 1", "popołudnie", "NIGHT", "?")))
    return table(spark, folder, "events").groupBy(
        unit_alias(units).alias("unit"), shift_alias(shifts).alias("shift")).agg(F.count("*").alias("n"))
