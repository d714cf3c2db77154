"""Writing results: CSV for spreadsheets, clean data, errors, role tables, JSON.

These write plain folders; ``published.publish`` takes any of them as its writer where readers
must see a whole table or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.vocab import VALIDATION_MESSAGES

# Headings of the planning export.
FORECAST_COLUMNS = {
    "material": "Materiał", "season": "Sezon", "forecast_days": "Horyzont użytkownika (dni)",
    "lead_time_days": "Lead time (dni)", "planning_days": "Horyzont planowania (dni)",
    "buffer_percent": "Bufor (%)", "average_daily": "Śr. dzienne zużycie",
    "recommended_quantity": "Zapotrzebowanie z buforem", "safety_stock": "Safety stock",
    "stock": "Aktualny stan zapasu", "open_orders": "Otwarte zamówienia",
    "minimum_order_quantity": "MOQ", "order_multiple": "Krotność zamówienia",
    "raw_to_order": "Surowe zapotrzebowanie do zamówienia", "to_order": "Do zamówienia po regułach",
    "unit": "Jednostka", "supplier": "Dostawca", "observed_days": "Dni obserwacji",
    "calendar_days": "Zakres kalendarzowy", "density_percent": "Gęstość danych (%)",
    "reliability": "Wiarygodność"}


def neutralize(text: Column, forecast: bool = False) -> Column:
    """Text a spreadsheet would run as a formula gets a leading apostrophe.

    The analysis export lets text such as ``-5`` pass; the planning export does not.
    """
    risky = r"^[=+\-@\t\r]" if forecast else r"^[=+@\t\r]|^-(?!\d+(?:[.,]\d+)?$)"
    return F.when(text.rlike(risky), F.concat(F.lit("'"), text)).otherwise(text)


def export_columns(df: DataFrame, forecast: bool = False) -> DataFrame:
    """Every column as export text: Tak/Nie, ISO dates, numbers without '.0', safe text."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.BooleanType):
            text = F.when(column, "Tak").when(~column, "Nie")
        elif isinstance(kind, T.DateType):
            text = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(kind, T.ArrayType):
            text = F.array_join(column.cast("array<string>"), "; ")
        elif isinstance(kind, (T.StructType, T.MapType)):
            text = F.to_json(column)
        elif isinstance(kind, T.NumericType):
            text = F.regexp_replace(column.cast("string"), r"\.0$", "")
            text = F.replace(text, F.lit("."), F.lit(",")) if forecast else text
        else:
            text = neutralize(column.cast("string"), forecast)
        out.append(F.coalesce(text, F.lit("")).alias(field.name))
    return df.select(*out)


def _headed(head: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], schema=first.schema)
            yield first
            yield from batches
        elif TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
    return run


def write_csv(df: DataFrame, path: str, forecast: bool = False, mode: str = "errorifexists") -> None:
    """``;`` separated, CRLF lines, a byte-order mark on the heading of every file."""
    text = export_columns(df, forecast)
    def cell(column: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(column.rlike('[;"\\r\\n]'), quoted).otherwise(column)

    head = "﻿" + ";".join('"' + c.replace('"', '""') + '"' if any(m in c for m in ';"\r\n') else c
                               for c in text.columns)
    line = F.concat_ws(";", *[cell(F.col(f"`{c}`")) for c in text.columns])
    # a text file has no heading of its own: each task that writes a file begins with one
    lines = text.select(line.alias("value")).mapInArrow(_headed(head), "value string")
    lines.write.mode(mode).option("lineSep", "\r\n").text(path)


def clean_data(df: DataFrame, internal: list[str] | None = None) -> DataFrame:
    """Visible fields only: internal and technical season columns are left out."""
    hidden = {"season_start_year", "season_order", "season_sort_key", "validation_status",
              "validation_errors", "duplicate_key", "original_values", "imported_at", "id", "source_row",
              "source_sheet", "source_file", *(internal or [])}
    return df.select(*[c for c in df.columns if c not in hidden])


def error_report(rejected: DataFrame) -> DataFrame:
    """Rejected rows with readable messages next to their source values."""
    messages = F.create_map(*[F.lit(x) for pair in VALIDATION_MESSAGES.items() for x in pair])
    readable = F.transform("errors", lambda code: F.coalesce(messages[code], code))
    lead = [c for c in ("source_row", "source_file", "source_sheet") if c in rejected.columns]
    rest = [c for c in rejected.columns if c not in {*lead, "errors"}]
    return rejected.select(*lead, F.array_join(readable, "; ").alias("errors"), *rest)


def forecast_report(plan: DataFrame, season: str, days: int, buffer: float) -> DataFrame:
    """The 21 planning columns under their export headings."""
    table = plan.withColumns({
        "season": F.lit(season), "forecast_days": F.lit(days), "buffer_percent": F.lit(buffer * 100.0),
        "density_percent": F.col("density") * 100})
    return table.select(*[F.col(c).alias(h) for c, h in FORECAST_COLUMNS.items()])


def write_clean(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(clean_data(df), path, mode=mode)


def write_errors(rejected: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(error_report(rejected), path, mode=mode)


def write_pivot(pivot: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pivot rows with their totals row, as built by ``pivot_table``."""
    write_csv(pivot, path, mode=mode)


def write_forecast(plan: DataFrame, path: str, season: str, days: int, buffer: float,
                   mode: str = "errorifexists") -> None:
    write_csv(forecast_report(plan, season, days, buffer), path, forecast=True, mode=mode)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet",
                 mode: str = "errorifexists") -> None:
    """One folder per named table: role tables, or the results of an analysis."""
    for name, table in tables.items():
        table.write.mode(mode).format(fmt).save(f"{folder}/{name}")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
