"""Reading tabular files as untyped cells with their origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.functions.parse import date_of, number_of
from supplylens.functions.text import clean_text
from supplylens.sources.csvgrid import csv_records
from supplylens.sources.grid import unique_headers


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with ``source_file`` and their 1-based ``source_row`` in the file.

    The row number is the line's place in its file block plus the lines of the blocks
    before it, so a large file stays split over many tasks.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_place", F.monotonically_increasing_id())
    blocks = lines.groupBy("source_file", "_block").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source_file", "_block", "_first",
                            F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    return lines.join(offsets, ["source_file", "_block"]).select(
        "value", "source_file", (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("source_row"))


def read_csv_grid(spark: SparkSession, paths: str | list[str], sep: str = ";",
                  width: int | None = None) -> tuple[DataFrame, list[str]]:
    """All cells as text, empty lines kept; returns the grid and its cell columns.

    Quoted separators and line breaks are text, see ``csvgrid.csv_records``. Without ``width``
    one more pass counts the cells of the records; shorter records end in NULL.
    """
    records = csv_records(spark, paths, sep)
    if width is None:
        width = records.agg(F.max(F.size("cells"))).first()[0] or 1
    columns = [f"c{i}" for i in range(width)]
    return records.select("source_file", "source_row", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)]), columns


def read_raw(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Parquet or JSON columns as text with unique headers and ``source_file``.

    Parquet also yields ``source_row``, the 1-based row in its file.
    """
    reader = spark.read.option("primitivesAsString", True) if fmt == "json" else spark.read
    df = reader.format(fmt).load(paths)
    origin = [F.col("_metadata.file_path").alias("source_file")]
    if fmt == "parquet":
        origin.append((F.col("_metadata.row_index") + 1).alias("source_row"))
    names = unique_headers(df.columns)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, names)], *origin)


def read_many(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Many files of one shape; the file name without folder and suffix is ``source_sheet``."""
    df = read_raw(spark, paths, fmt)
    return df.withColumn("source_sheet", F.regexp_extract("source_file", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1))


def raw_dataset(df: DataFrame, provenance: list[str] | None = None) -> DataFrame:
    """All source columns as ``source__0``, ``source__1`` ... with status ``raw``."""
    provenance = provenance or []
    sources = [c for c in df.columns if c not in provenance]
    return df.select(*[F.col(f"`{c}`").alias(f"source__{i}") for i, c in enumerate(sources)],
                     *provenance, F.lit("raw").alias("validation_status"))


OPTIONAL_STOCK = ["lead_time_days", "minimum_order_quantity", "order_multiple", "safety_stock", "open_orders"]


def read_stock(df: DataFrame, mapping: dict[str, str], run_date: str) -> DataFrame:
    """A stock table: rows need a material, a stock of 0 or more and, if mapped, a date."""
    def text(field: str):
        return F.nullif(clean_text(F.col(mapping[field])), F.lit("")) if field in mapping else F.lit(None).cast("string")

    stock = number_of(df, mapping["stock_level"])
    date = date_of(df, mapping["date"]) if "date" in mapping else F.lit(run_date).cast("date")
    optional = {f: F.greatest(number_of(df, mapping[f]), F.lit(0.0)) if f in mapping
                else F.lit(None).cast("double") for f in OPTIONAL_STOCK}
    # greatest() skips NULL, so keep NULL where the number is missing
    optional = {f: F.when(number_of(df, mapping[f]).isNotNull(), c) if f in mapping else c
                for f, c in optional.items()}
    extra = [c for c in ("source_file", "source_sheet", "source_row") if c in df.columns]
    table = df.select(text("material").alias("material"), stock.alias("stock_level"), date.alias("date"),
                      text("unit").alias("unit"), *[c.alias(f) for f, c in optional.items()],
                      text("supplier").alias("supplier"), *extra)
    return table.where(F.col("material").isNotNull() & (F.col("stock_level") >= 0) & F.col("date").isNotNull())
