"""Raw grids: header detection, ghost columns, empty rows, column types.

A grid is a table of text cells with a row number; many tables may share one DataFrame,
told apart by a table column.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.parse import parse_bool, parse_number, parse_timestamp
from supplylens.functions.text import clean_text, comparable_text, is_blank, let
from supplylens.vocab import HEADER_WORDS, TOTAL_WORDS

NUMERIC_CELL = r"^\s*[-+]?\d[\d\s.,]*\s*$"


def fold_name(name: str) -> str:
    """Comparable form of a column name (schema level; data uses ``comparable_text``)."""
    text = unicodedata.normalize("NFD", " ".join(str(name or "").split()))
    text = "".join(c for c in text if not "̀" <= c <= "ͯ").lower().replace("ł", "l")
    return " ".join(re.sub(r"[^a-z0-9а-яёіїєґ\-\s]", " ", text).split())


def unique_headers(names: list[str | None]) -> list[str]:
    """Clean names; empty ones become ``Kolumna n``; repeats get ``(2)``, ``(3)`` ..."""
    seen: dict[str, int] = {}
    result = []
    for position, name in enumerate(names, start=1):
        base = " ".join(str(name or "").split()) or f"Kolumna {position}"
        key = fold_name(base)
        seen[key] = seen.get(key, 0) + 1
        result.append(base if seen[key] == 1 else f"{base} ({seen[key]})")
    return result


def to_cells(grid: DataFrame, row: str, columns: list[str], table: list[str] | None = None) -> DataFrame:
    """Long form ``table..., row, col, value`` with one row per cell, blanks included."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value"))
                      for i, c in enumerate(columns)])
    return grid.select(*(table or []), F.col(row).alias("row"), F.inline(cells))


def detect_header_rows(cells: DataFrame, table: list[str], candidates: int = 25) -> DataFrame:
    """The most header-like of the first rows of each table: ``table..., header_row, score``.

    Rows count from 0. In text grids a cell that looks like a number counts as one.
    """
    head = cells.where(F.col("row") < candidates + 5)
    filled = head.where((F.col("row") < candidates) & ~is_blank(F.col("value")))
    text = clean_text(F.col("value"))
    rows = filled.groupBy(*table, "row").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("value").rlike(NUMERIC_CELL)).alias("texts"),
        F.count_distinct(F.lower(text)).alias("different"),
        F.count_if(text.rlike(HEADER_WORDS)).alias("words"),
        F.count_if(text.rlike(TOTAL_WORDS)).alias("totals"))
    below = filled.select(*table, F.col("row").alias("at"), "col",
                          F.explode(F.sequence(F.col("row") + 1, F.col("row") + 5)).alias("row"))
    seen = below.join(head, [*table, "row", "col"]).groupBy(*table, F.col("at").alias("row")).agg(
        F.count("*").alias("below"),
        F.count_if(~is_blank(F.col("value"))).alias("below_filled"),
        F.count_if(F.col("value").rlike(NUMERIC_CELL)).alias("below_numbers"))
    score = (
        F.least(F.lit(12), F.col("n")) * 0.8 + F.col("texts") / F.col("n") * 5
        + F.col("different") / F.col("n") * 3 + F.col("words") * 1.8
        + F.coalesce(F.try_divide("below_filled", "below"), F.lit(0.0)) * 4
        + F.coalesce(F.try_divide("below_numbers", "below_filled"), F.lit(0.0)) * 2.5
        - F.col("totals") * 4 - F.col("row") * 0.08)
    scored = (rows.where("n >= 2").join(seen, [*table, "row"], "left")
              .withColumn("score", score))
    best = F.max_by("row", F.struct("score", -F.col("row")))
    return scored.groupBy(*table).agg(best.alias("header_row"), F.max("score").alias("score"))


def kept_columns(grid: DataFrame, row: str, columns: list[str], header_row: int) -> list[str]:
    """Columns with a header, with two or more values, or at least a tenth filled."""
    below = F.col(row) > header_row
    facts = grid.agg(
        F.count_if(below).alias("rows"),
        *[F.count_if(below & ~is_blank(F.col(c))).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.max((F.col(row) == header_row) & ~is_blank(F.col(c))).alias(f"h_{i}")
          for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns)
            if facts[f"h_{i}"] or facts[f"n_{i}"] >= 2
            or facts[f"n_{i}"] / max(1, facts["rows"]) >= 0.1]


def any_filled(columns: list[str]) -> Column:
    test = F.lit(False)
    for name in columns:
        test = test | ~is_blank(F.col(name))
    return test


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(any_filled(columns))


def count_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count_if(~any_filled(columns)).alias("empty_rows"), F.count("*").alias("rows"))


def table_from_grid(grid: DataFrame, row: str, columns: list[str], keep: list[str] | None = None,
                    header_row: int | None = None, depth: int = 25) -> DataFrame:
    """One table from a raw grid: header found, ghost columns and empty rows gone.

    ``row`` counts from 1 and survives as ``source_row``; ``keep`` columns are carried. The
    heading is one of the first ``depth`` rows.
    """
    zero = grid.withColumn("_row", F.col(row) - 1)
    if header_row is None:
        # a candidate is judged with the five rows below it
        cells = to_cells(zero.where(F.col("_row") < depth + 5), "_row", columns).withColumn("_t", F.lit(0))
        found = detect_header_rows(cells, ["_t"], depth).first()
        header_row = found["header_row"] if found else 0
    used = kept_columns(zero, "_row", columns, header_row)
    header = zero.where(F.col("_row") == header_row).select(*used).first()
    names = unique_headers(list(header) if header else [None] * len(used))
    body = drop_empty_rows(zero.where(F.col("_row") > header_row), used)
    return body.select(*[F.col(c).alias(n) for c, n in zip(used, names)],
                       F.col(row).alias("source_row"), *(keep or []))


def date_like(name: str) -> bool:
    return bool(re.search(r"(^|\s)(data|date|datum|dzien|day|czas|time)(\s|$)", fold_name(name)))


def text_type(text: Column) -> Column:
    return let(text, lambda x: (F.when(is_blank(x), F.lit(None)).when(parse_bool(x).isNotNull(), "boolean")
                                .when(parse_number(x).isNotNull(), "number")
                                .when(parse_timestamp(x, serial_text=False).isNotNull(), "date").otherwise("text")))


def cell_type(df: DataFrame, name: str) -> Column:
    """``boolean``, ``number``, ``date`` or ``text`` per cell, NULL when blank."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.when(column.isNotNull(), "boolean")
    if isinstance(kind, T.NumericType):
        serial = (column > 0) & (column < 2958466) if date_like(name) else F.lit(False)
        return F.when(serial, "date").when(column.isNotNull(), "number")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(column.isNotNull(), "date")
    return text_type(column)


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, type``: the most frequent cell type, ``mixed`` when a second one passes 35 %.

    Reads all rows; pass a :func:`supplylens.operators.filters.sample_rows` result to look
    at a sample only. Equal texts of a column are merged before they are parsed.
    """
    columns = columns or df.columns
    none = F.lit(None).cast("string")

    def cell(name: str) -> Column:
        typed = isinstance(df.schema[name].dataType, (T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        value, kind = (none, cell_type(df, name)) if typed else (F.col(name).cast("string"), none)
        return F.struct(F.lit(name).alias("column"), value.alias("value"), kind.alias("kind"))

    cells = df.select(F.inline(F.array(*[cell(c) for c in columns]))).groupBy("column", "value", "kind").agg(F.count("*").alias("n"))
    kinds = cells.select("column", F.coalesce("kind", text_type(F.col("value"))).alias("kind"), "n")
    order = ["text", "number", "date", "boolean"]  # the earlier one wins a tie
    counts = kinds.groupBy("column").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in order])
    ranked = F.reverse(F.array_sort(F.array(*[
        F.struct(F.col(k).alias("n"), F.lit(len(order) - i).alias("place"), F.lit(k).alias("kind"))
        for i, k in enumerate(order)])))
    best, second = ranked[0], ranked[1]
    return counts.select("column", F.when(best["n"] == 0, "empty")
                         .when(second["n"] / best["n"] > 0.35, "mixed")
                         .otherwise(best["kind"]).alias("type"), *order)


def header_table(headers: DataFrame, header: str = "header") -> DataFrame:
    """Add the folded name without a ``(n)`` suffix to a catalogue of headers."""
    bare = F.regexp_replace(clean_text(F.col(header)), r"\s+\(\d+\)$", "")
    return headers.withColumn("folded", comparable_text(F.col(header))).withColumn(
        "bare", comparable_text(bare))
