"""Filters, search, sorting, limits and repeatable samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.dates import MONTHS, SEASONS, WEEKDAYS
from supplylens.functions.parse import date_of, number_of, parse_date, parse_number, timestamp_of
from supplylens.functions.text import comparable_text, is_blank
from supplylens.session import checkpointed

EMPTY = "__empty__"
MAXIMUM_OPTIONS = 1000


def filter_dates(df: DataFrame, date_from: str | None = None, date_to: str | None = None,
                 column: str = "date") -> DataFrame:
    """Rows inside the closed range; a NULL date fails as soon as a bound is set."""
    if date_from:
        df = df.where(F.col(column) >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.where(F.col(column) <= F.lit(date_to).cast("date"))
    return df


def equals_value(df: DataFrame, field: str, value) -> Column:
    if value == EMPTY:
        return is_blank(F.col(field))
    if isinstance(df.schema[field].dataType, T.NumericType) or (
            isinstance(value, (int, float)) and not isinstance(value, bool)):
        wanted = F.lit(float(value)) if isinstance(value, (int, float)) else parse_number(F.lit(value))
        return F.coalesce(number_of(df, field) == wanted, F.lit(False))
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return comparable_text(F.col(field)) == comparable_text(F.lit(text))


def filter_values(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """AND of equalities: numbers by value, text by folded text, ``EMPTY`` for blanks."""
    for field, value in values.items():
        df = df.where(equals_value(df, field, value))
    return df


def operator_test(df: DataFrame, field: str, op: str, value: str | None = None) -> Column:
    column = F.col(field)
    if op == "is-empty":
        return is_blank(column)
    if op == "is-not-empty":
        return ~is_blank(column)
    if op in (">", ">=", "<", "<="):
        if isinstance(df.schema[field].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            day_only = isinstance(df.schema[field].dataType, T.DateType)
            actual = date_of(df, field) if day_only else timestamp_of(df, field)
            wanted = parse_date(F.lit(str(value))) if day_only else parse_date(F.lit(str(value))).cast("timestamp_ntz")
        else:
            actual, wanted = number_of(df, field), parse_number(F.lit(str(value)))
        tests = {">": actual > wanted, ">=": actual >= wanted, "<": actual < wanted, "<=": actual <= wanted}
        return F.coalesce(tests[op], F.lit(False))
    text, wanted = comparable_text(column), comparable_text(F.lit(str(value)))
    return {"equals": text == wanted, "not-equals": text != wanted, "contains": F.contains(text, wanted),
            "starts-with": F.startswith(text, wanted), "ends-with": F.endswith(text, wanted)}[op]


def filter_ops(df: DataFrame, conditions: list[tuple]) -> DataFrame:
    """AND of ``(field, operator, value)`` conditions."""
    for condition in conditions:
        df = df.where(operator_test(df, *condition))
    return df


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any visible column contains the folded text."""
    wanted = comparable_text(F.lit(text))
    tests = [F.contains(comparable_text(F.col(c)), wanted) for c in columns or df.columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def filter_options(df: DataFrame, field: str, limit: int = MAXIMUM_OPTIONS) -> DataFrame:
    """``value, is_blank``: the first distinct values in order, one blank row if any."""
    column = F.col(field)
    options = df.select(F.when(~is_blank(column), column).alias("value")).distinct()
    filled = options.where("value IS NOT NULL").orderBy("value").limit(limit)
    return filled.unionByName(options.where("value IS NULL")).select(
        "value", F.col("value").isNull().alias("is_blank"))


def scope(df: DataFrame, filtered: DataFrame, mode: str = "all") -> DataFrame:
    return filtered if mode == "filtered" else df


def sort_key(df: DataFrame, field: str) -> Column:
    """Numbers with NULL lowest, dates with NULL as 1970, text folded."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.col(field).cast("double"), F.lit(float("-inf")))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(timestamp_of(df, field), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.collate(comparable_text(F.col(field)), "pl")


def sort_rows(df: DataFrame, keys: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """Sort by ``(field, asc|desc)`` keys, equal rows in source order."""
    parts = [sort_key(df, f).desc() if way == "desc" else sort_key(df, f).asc() for f, way in keys]
    return df.orderBy(*parts, *order)


def _natural(text: Column) -> Column:
    """Digits padded to one width, so that 'item 9' sorts before 'item 10'."""
    padded = F.regexp_replace(text, r"(\d+)", "00000000000000000000$1")
    return F.collate(F.regexp_replace(padded, r"\d*?(\d{20})(?!\d)", "$1"), "pl_CI")


def pivot_order(df: DataFrame, field: str, sort_field: str | None = None) -> list[Column]:
    """Sort columns of a pivot axis: blanks last, known sequences first, else natural."""
    ranks = {"month": MONTHS, "weekday": WEEKDAYS, "season": SEASONS, "quarter": ["Q1", "Q2", "Q3", "Q4"]}
    parts = [F.col(field).isNull().asc()]
    if sort_field:
        parts.append(F.col(sort_field).asc_nulls_last())
    elif field in ranks:
        place = F.array_position(F.array(*[F.lit(x) for x in ranks[field]]), F.col(field).cast("string"))
        parts.append(F.when(place > 0, place).asc_nulls_last())
    if isinstance(df.schema[field].dataType, T.NumericType):
        parts.append(F.col(field).asc_nulls_last())
    else:
        parts.append(_natural(F.col(field).cast("string")).asc_nulls_last())
    return parts


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def row_digest(df: DataFrame) -> Column:
    """32 hex digits of a row's content; NULLs count by their place, maps by their JSON."""
    parts = [F.to_json(f"`{c}`") if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in df.dtypes]
    parts += [p.isNull() for p in parts]
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(i), *parts)), 16, "0")) for i in (1, 2)])


def sample_rows(df: DataFrame, n: int, key: list[str] | None = None, digest: Column | None = None) -> DataFrame:
    """``n`` whole rows, the same ones for the same data however it is partitioned.

    ``key`` columns tell all rows apart: the rows with the lowest hash of them are drawn.
    Without a key equal rows are drawn one by one: rows stand in the order of ``digest`` (hex
    digits of their content, ``row_digest`` unless given), equal ones side by side, and one is
    taken at each place ``(2 i + 1) N / 2 n``. So the copies of a row keep their share to within
    one. No table is sorted for that: counts by the first digits of the digest show where the
    places fall, and only rows with these digits are counted on, by more digits each round.
    """
    if key:
        return df.orderBy(F.xxhash64(*key), *key).limit(n)
    digest = row_digest(df) if digest is None else digest
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), digest.alias("_digest"))
    digits = max(2, math.ceil(math.log(max(2, 4 * n), 16)))
    counts = checkpointed(rows.groupBy(F.left("_digest", F.lit(digits)).alias("_head")).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if total <= n:
        return df

    def below(place: Column) -> Column:
        """How many places lie below a row number; whole numbers throughout."""
        return F.call_function("div", F.lit(2 * n) * place + F.lit(total - 1), F.lit(2 * total))

    def chosen(counted: DataFrame, order: WindowSpec) -> DataFrame:
        """Stretches of rows in which a place lies, with the rows before them and the places in them."""
        before = F.col("_before") + F.sum("_n").over(order) - F.col("_n")
        return counted.withColumn("_before", before).withColumn(
            "_take", below(F.col("_before") + F.col("_n")) - below(F.col("_before"))).where("_take > 0")

    # at most 64 times as many heads as places
    heads = checkpointed(chosen(counts.withColumn("_before", F.lit(0).cast("bigint")), Window.orderBy("_head")))
    while digits < 30 and (heads.agg(F.max("_n")).first()[0] or 0) > 100_000:
        narrow = rows.withColumn("_of", F.left("_digest", F.lit(digits))).join(
            F.broadcast(heads.select(F.col("_head").alias("_of"), "_before")), "_of")
        digits += 2
        counts = narrow.groupBy("_of", "_before", F.left("_digest", F.lit(digits)).alias("_head")).agg(F.count("*").alias("_n"))
        grown = checkpointed(chosen(counts, Window.partitionBy("_of").orderBy("_head")).drop("_of"))
        if grown.agg(F.max("_n")).first()[0] == heads.agg(F.max("_n")).first()[0]:
            heads = grown
            break  # one row with very many copies: more digits do not split it
        heads = grown
    places = F.broadcast(heads.select("_head", "_before"))  # at most one per row drawn
    same = (rows.withColumn("_head", F.left("_digest", F.lit(digits))).join(places, "_head")
            .groupBy("_head", "_before", "_digest").agg(F.count("*").alias("_n"), F.first("_row").alias("_row")))
    drawn = chosen(same, Window.partitionBy("_head").orderBy("_digest"))
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("_take")))).select("_row.*")
