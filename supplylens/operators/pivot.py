"""Grouped tables with totals, in the import dialect and in the analytics dialect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.dates import period_key
from supplylens.functions.parse import date_of, number_of, timestamp_of
from supplylens.functions.text import is_blank
from supplylens.session import kept
from supplylens.vocab import MISSING

# Preset groupings, all the sum of quantity.
TEMPLATES = {"material": ["material"], "brand": ["brand"], "line": ["line"], "month": ["month_key"],
             "season": ["season_period"]}

LEVELS = {0: "cell", 1: "row_total", 2: "column_total", 3: "grand_total"}


def _finish(agg: str, prefix: str) -> Column:
    total, count = F.col(f"{prefix}_sum"), F.col(f"{prefix}_n")
    if agg == "count":
        return F.col("records").cast("double")
    if agg in ("avg", "average"):
        return F.try_divide(total, count)
    if agg == "min":
        return F.col(f"{prefix}_min")
    if agg == "max":
        return F.col(f"{prefix}_max")
    return F.coalesce(total, F.lit(0.0))


def _states(name: str, value: Column) -> list[Column]:
    return [F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n"),
            F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]


def _merge(name: str) -> list[Column]:
    return [F.sum(f"{name}_sum").alias(f"{name}_sum"), F.sum(f"{name}_n").alias(f"{name}_n"),
            F.min(f"{name}_min").alias(f"{name}_min"), F.max(f"{name}_max").alias(f"{name}_max")]


def _group_value(name: str) -> Column:
    return F.when(~is_blank(F.col(name)), F.col(name)).alias(name)


def pivot(df: DataFrame, rows: list[str], columns: list[str], values: list[str],
          agg: str = "sum") -> DataFrame:
    """Cells with row, column and grand totals, all from the raw rows.

    Long form ``level, rows..., columns..., values..., combined, records`` where level is
    ``cell``, ``row_total``, ``column_total`` or ``grand_total`` and ``combined`` spans all
    value fields. Blank group values are NULL. The rows are aggregated once at cell level;
    the totals merge the cells' sums, counts and extremes.
    """
    numbers = {v: number_of(df, v) for v in values}
    cells = df.select(*[_group_value(c) for c in rows + columns],
                      *[n.alias(v) for v, n in numbers.items()])
    states = [s for v in values for s in _states(v, F.col(v))]
    base = cells.groupBy(*rows, *columns).agg(F.count("*").alias("records"), *states)
    axes = [(rows, columns)]
    sets = [rows + columns, rows, columns, []]
    unique = [list(x) for x in dict.fromkeys(tuple(s) for s in sets)]
    merged = [m for v in values for m in _merge(v)]
    row_gone = F.grouping(rows[0]) if rows else F.lit(1)
    column_gone = F.grouping(columns[0]) if columns else F.lit(1)
    if axes[0] == ([], []):
        rolled = base.agg(F.sum("records").alias("records"), *merged).withColumn("_level", F.lit(3))
    else:
        level = (row_gone * 2 + column_gone).cast("int")
        rolled = base.groupingSets(unique, *rows, *columns).agg(
            level.alias("_level"), F.sum("records").alias("records"), *merged)
    if not columns:  # without column fields the row groups are both cells and row totals
        rolled = rolled.withColumn("_level", F.when(F.col("_level") == 1, 0).otherwise(F.col("_level")))
    together = rolled.withColumns({
        "_all_sum": _total([F.col(f"{v}_sum") for v in values]),
        "_all_n": sum((F.col(f"{v}_n") for v in values), F.lit(0)),
        "_all_min": F.least(*[F.col(f"{v}_min") for v in values], F.lit(None)),
        "_all_max": F.greatest(*[F.col(f"{v}_max") for v in values], F.lit(None))})
    names = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return together.select(names[F.col("_level")].alias("level"), *rows, *columns,
                           *[_finish(agg, v).alias(v) for v in values],
                           _finish(agg, "_all").alias("combined"), "records")


def _total(parts: list[Column]) -> Column:
    whole = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), whole)


#: a wide table has at most this many columns of one key
WIDEST = 2000


def widen(long: DataFrame, rows: list[str], key: str, value: str, maximum: int = WIDEST) -> DataFrame:
    """One column per ``key``, in the order of their names; ``long`` itself where there are more than ``maximum``.

    The keys are counted in a written table before any comes to the driver.
    """
    keys = kept(long.select(key).where(F.col(key).isNotNull()).distinct())
    if keys.count() > maximum:
        return long
    return long.groupBy(*rows).pivot(key, sorted(r[0] for r in keys.collect())).agg(F.first(value))


def pivot_table(df: DataFrame, rows: list[str], column: str, value: str, agg: str = "sum", maximum: int = WIDEST) -> DataFrame:
    """Wide form of one value and one column field, with a ``Razem`` row at the end.

    Beyond ``maximum`` columns the result is complete in long form: ``rows, _key, _value``.
    """
    long = pivot(df, rows, [column], [value], agg)
    cells = long.where(F.col("level").isin("cell", "column_total"))
    marked = cells.select(F.col("level") == "column_total", *rows,
                          F.coalesce(F.col(column).cast("string"), F.lit("(pusta wartość)")).alias("_key"),
                          F.col(value).alias("_value")).toDF("_footer", *rows, "_key", "_value")
    wide = widen(kept(marked), ["_footer", *rows], "_key", "_value", maximum)
    label = F.when(F.col("_footer"), "Razem").otherwise(F.col(rows[0]).cast("string"))
    return wide.withColumn(rows[0], label).orderBy("_footer", *rows).drop("_footer")


def source_statistics(df: DataFrame, rows: list[str], values: list[str]) -> DataFrame:
    """``field, count, total, average, minimum, maximum`` per value field and overall."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("field"), number_of(df, v).alias("x")) for v in values])))
    stats = [F.count("x").alias("count"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"),
             F.coalesce(F.avg("x"), F.lit(0.0)).alias("average"), F.min("x").alias("minimum"),
             F.max("x").alias("maximum")]
    parts = long.groupingSets([["field"], []], "field").agg(F.grouping("field").alias("_all"), *stats)
    return parts.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("field")).alias("field"),
                        "count", "total", "average", "minimum", "maximum")


def template(df: DataFrame, name: str = "material") -> DataFrame:
    """A preset grouping; its field has to be there."""
    fields = TEMPLATES[name]
    missing = [f for f in [*fields, "quantity"] if f not in df.columns]
    if missing:
        raise ValueError(f"template {name} needs {', '.join(missing)}")
    return pivot(df, fields, [], ["quantity"], "sum")


def templates(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All presets (those whose fields are there) as grouping sets of one aggregate: the table is read once.

    ``template, level, key, quantity, records``: cells have the preset's keys as text (joined by
    `` / ``), the ``grand_total`` belongs to all and has no template.
    """
    names = available_templates(df) if names is None else names
    fields = list(dict.fromkeys(f for n in names for f in TEMPLATES[n]))
    cells = df.select(*[_group_value(f) for f in fields], number_of(df, "quantity").alias("x"))
    flags = {f: F.grouping(f).alias(f"_no_{f}") for f in fields}
    grouped = cells.groupingSets([*[[F.col(f) for f in TEMPLATES[n]] for n in names], []], *[F.col(f) for f in fields]).agg(
        *flags.values(), F.coalesce(F.sum("x"), F.lit(0.0)).alias("quantity"), F.count("*").alias("records"))
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in names:
        own = [F.col(f"_no_{f}") == (0 if f in TEMPLATES[n] else 1) for f in fields]
        name = F.when(reduce(lambda a, b: a & b, own), n).otherwise(name)
        key = F.when(reduce(lambda a, b: a & b, own), F.concat_ws(" / ", *[F.col(f).cast("string") for f in TEMPLATES[n]])).otherwise(key)
    key = F.when(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull(), key)  # a blank group is NULL
    return grouped.select(name.alias("template"), F.when(name.isNull(), "grand_total").otherwise("cell").alias("level"),
                          key.alias("key"), "quantity", "records")


def available_templates(df: DataFrame) -> list[str]:
    return [n for n, fields in TEMPLATES.items() if set(fields) <= set(df.columns) and "quantity" in df.columns]


# ---- analytics dialect -------------------------------------------------------------------

def summary_cells(df: DataFrame, row: str, column: str | None, value: str, agg: str = "sum",
                  granularity: str | None = None, order_by: str | None = None,
                  sequence: list[str] | None = None, convention: str = "dmy") -> DataFrame:
    """``row_key, column_key, value, total_value`` for one row, column and value field.

    Blank keys become ``(brak)``; count is of filled cells; a group without numbers is NULL;
    totals come from the raw rows. ``latest`` takes the value of the newest ``order_by``
    date, undated rows first, equal dates by ``sequence``.
    """
    def key(name: str) -> Column:
        text = F.regexp_replace(F.col(name).cast("string"), r"\.0$", "") if dict(df.dtypes)[name] == "double" \
            else F.col(name).cast("string")
        return F.when(~is_blank(F.col(name)), F.trim(text)).otherwise(MISSING)

    if column is None:
        column_key = F.lit("Wartość")
    elif granularity:
        column_key = F.coalesce(period_key(date_of(df, column, "analytics", convention), granularity),
                                F.lit(MISSING))
    else:
        column_key = key(column)
    number = number_of(df, value, "analytics")
    base = df.select(key(row).alias("row_key"), column_key.alias("column_key"), number.alias("x"),
                     (~is_blank(F.col(value))).cast("int").alias("filled"),
                     (timestamp_of(df, order_by, "analytics", convention) if order_by
                      else F.lit(None).cast("timestamp_ntz")).alias("_at"),
                     *[F.col(c).alias(f"_s{i}") for i, c in enumerate(sequence or [])])
    # totals merge the states of the cells of their row: the table is read and shuffled once
    row_cells = Window.partitionBy("row_key")
    if agg == "latest":
        place = F.struct("_at", *[f"_s{i}" for i in range(len(sequence or []))])
        newest = F.max(F.when(F.col("x").isNotNull(), F.struct(place.alias("place"), F.col("x").alias("x"))))
        cells = base.groupBy("row_key", "column_key").agg(newest.alias("state"))
        total = F.max("state").over(row_cells)
        return cells.select("row_key", "column_key", F.col("state.x").alias("value"), total["x"].alias("total_value"))
    cells = base.groupBy("row_key", "column_key").agg(F.sum("filled").alias("records"), *_states("v", F.col("x")))
    whole = cells.select("row_key", "column_key", *[F.struct(*[c.alias(n) for n, c in parts.items()]).alias(name) for name, parts in (
        ("cell", {n: F.col(n) for n in ("records", "v_sum", "v_n", "v_min", "v_max")}),
        ("total", {"records": F.sum("records").over(row_cells), "v_sum": F.sum("v_sum").over(row_cells), "v_n": F.sum("v_n").over(row_cells),
                   "v_min": F.min("v_min").over(row_cells), "v_max": F.max("v_max").over(row_cells)}))])

    def finish(state: str) -> Column:
        part = F.col(state)
        if agg == "count":
            return part["records"].cast("double")
        done = {"avg": F.try_divide(part["v_sum"], part["v_n"]), "average": F.try_divide(part["v_sum"], part["v_n"]),
                "min": part["v_min"], "max": part["v_max"]}.get(agg, part["v_sum"])
        return F.when(part["v_n"] > 0, done)

    return whole.select("row_key", "column_key", finish("cell").alias("value"), finish("total").alias("total_value"))


def pivot_summary(df: DataFrame, row: str, column: str | None, value: str, agg: str = "sum",
                  limit: int = 100, **options) -> DataFrame:
    """The ``limit`` rows of the largest absolute total, as cells."""
    cells = kept(summary_cells(df, row, column, value, agg, **options))
    totals = cells.select("row_key", "total_value").distinct()
    size = F.abs(F.coalesce("total_value", F.lit(0.0)))
    best = totals.orderBy(size.desc(), "row_key").limit(limit).select("row_key")
    return cells.join(F.broadcast(best), "row_key", "left_semi")  # at most ``limit`` keys


def long_pivot_top(df: DataFrame, row: str, column: str | None, value: str, agg: str = "sum",
                   limit: int | None = None, **options) -> DataFrame:
    """The ``limit`` cells of the largest absolute value; all cells where none is given."""
    if agg == "latest" and not options.get("order_by"):
        raise ValueError("latest needs an ordering column")
    cells = summary_cells(df, row, column, value, agg, **options)
    return cells if limit is None else cells.orderBy(F.abs("value").desc_nulls_last(), "row_key", "column_key").limit(max(1, limit))


def long_to_wide(cells: DataFrame, maximum: int = WIDEST) -> DataFrame:
    """One row per ``row_key`` with a column per ``column_key`` and the ``total``; the cells as they are beyond ``maximum`` columns."""
    named = kept(cells.withColumnRenamed("total_value", "total"))
    return widen(named, ["row_key", "total"], "column_key", "value", maximum)


def chart_series(long: DataFrame, rows: list[str], value: str, kind: str = "bar", limit: int = 100,
                 order: list[Column] | None = None) -> DataFrame:
    """Cells of the groups a chart shows: ``label, series values``.

    A line keeps the first groups in order, a pie those of the largest combined value, other
    charts those of the largest sum of absolute cells.
    """
    cells = long.where(F.col("level") == "cell")
    if kind == "line":
        groups = cells.select(*rows).distinct().orderBy(*(order or [F.col(r).asc_nulls_last() for r in rows]))
    elif kind == "pie":
        totals = long.where(F.col("level").isin("row_total", "cell"))
        size = F.max_by(F.abs("combined"), F.col("level") == "row_total")
        groups = totals.groupBy(*rows).agg(size.alias("_size")).orderBy(
            F.col("_size").desc_nulls_last(), *rows)
    else:
        groups = cells.groupBy(*rows).agg(F.sum(F.abs(value)).alias("_size")).orderBy(
            F.col("_size").desc_nulls_last(), *rows)
    shown = F.broadcast(groups.limit(limit).select(*[F.col(r).alias(f"_{r}") for r in rows]))
    same = [F.col(r).eqNullSafe(F.col(f"_{r}")) for r in rows]
    test = same[0]
    for part in same[1:]:
        test = test & part
    return cells.join(shown, test, "left_semi")


def class_statistics(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows per class, with quantity and date ranges of the valid rows; one row.

    ``rejected`` has the ``errors`` of each row; a row with ``duplicate_record`` is a duplicate.
    """
    kind = F.when(F.array_contains("errors", "duplicate_record"), "duplicate").otherwise("invalid")
    rows = valid.select(F.lit("valid").alias("kind"), "quantity", "date").unionByName(
        rejected.select(kind.alias("kind")), allowMissingColumns=True)
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_rows") for k in ("valid", "invalid", "duplicate")]
    return rows.agg(F.count("*").alias("source_rows"), *counts, F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity_sum"),
                    F.coalesce(F.avg("quantity"), F.lit(0.0)).alias("quantity_avg"),
                    F.min("quantity").alias("quantity_min"), F.max("quantity").alias("quantity_max"),
                    F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Rows with quantity and date ranges, one row; :func:`class_statistics` counts the classes."""
    return df.agg(F.count("*").alias("rows"), F.count("quantity").alias("quantities"),
                  F.sum("quantity").alias("quantity_sum"), F.avg("quantity").alias("quantity_avg"),
                  F.min("quantity").alias("quantity_min"), F.max("quantity").alias("quantity_max"),
                  F.min("date").alias("date_min"), F.max("date").alias("date_max"))
