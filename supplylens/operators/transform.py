"""Cell transformations, step lists, patches and column editing."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.dates import derive_date_fields
from supplylens.functions.parse import date_of, number_of, parse_date
from supplylens.functions.text import is_blank
from supplylens.operators.clean import tag_duplicates
from supplylens.plans.ordered import carry_forward
from supplylens.session import kept


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def replace(column: Column, find: str, by: str) -> Column:
    """All literal occurrences, or a ``/pattern/flags`` (first match only without ``g``)."""
    text = _text(column)
    if not find:
        return text
    shape = re.fullmatch(r"/(.+)/([gimsuy]*)", find, re.S)
    if not shape:
        return F.replace(text, F.lit(find), F.lit(by))
    pattern, flags = shape.groups()
    inline = "".join(f for f in flags if f in "ims")
    pattern = f"(?{inline}){pattern}" if inline else pattern
    by = by.replace("\\", "\\\\").replace("$&", "$0")
    if "g" in flags:
        return F.regexp_replace(text, F.lit(pattern), F.lit(by))
    # only the first match: it is the one that nothing before it matches
    first = f"(?s)^(.*?)(?:{pattern})"
    shifted = re.sub(r"\$(\d+)", lambda m: "$" + str(int(m[1]) + 1 if m[1] != "0" else 0), by)
    return F.regexp_replace(text, F.lit(first), F.lit("$1" + shifted))


def trim(column: Column) -> Column:
    return F.regexp_replace(_text(column), r"^[\s ﻿]+|[\s ﻿]+$", "")


def clean(column: Column) -> Column:
    return F.regexp_replace(_text(column), r"[\x00-\x1F\x7F]", "")


def upper(column: Column) -> Column:
    return F.upper(_text(column))


def lower(column: Column) -> Column:
    return F.lower(_text(column))


def proper(column: Column) -> Column:
    """A capital after the start, a space or a hyphen."""
    pieces = F.transform(F.split(F.lower(_text(column)), "-"), F.initcap)
    return F.array_join(pieces, "-")


def to_number(df: DataFrame, field: str) -> Column:
    return number_of(df, field)


def to_date(df: DataFrame, field: str) -> Column:
    """ISO text of a readable date; anything else stays as it is."""
    iso = F.date_format(date_of(df, field), "yyyy-MM-dd")
    return F.coalesce(iso, F.col(field).cast("string"))


def round_to(df: DataFrame, field: str, digits: int = 0) -> Column:
    """Half away from zero; text that is not a number stays."""
    digits = max(-10, min(10, int(digits)))
    rounded = F.round(number_of(df, field), digits)
    if isinstance(df.schema[field].dataType, T.NumericType):
        return rounded
    return F.coalesce(F.regexp_replace(rounded.cast("string"), r"\.0$", ""), F.col(field))


def absolute(df: DataFrame, field: str) -> Column:
    number = F.abs(number_of(df, field))
    if isinstance(df.schema[field].dataType, T.NumericType):
        return number
    return F.coalesce(F.regexp_replace(number.cast("string"), r"\.0$", ""), F.col(field))


def fill(df: DataFrame, field: str, order: list[str], up: bool = False,
         within: list[str] | None = None) -> DataFrame:
    """Blanks take the last (or next) filled value in row order.

    Without ``within`` the whole table is one sequence; with it each key is one. Either way
    the rows are filled range by range, so no key has to fit one task.
    """
    within = within or []
    value = F.when(~is_blank(F.col(field)), F.col(field))
    way = [F.col(c).asc() for c in within] + [F.col(c).desc() if up else F.col(c).asc() for c in order]
    marker = F.when(value.isNotNull(), F.struct(value.alias("_value"), *within))
    filled = carry_forward(df, way, {"_filled": marker})
    same = F.col("_filled").isNotNull()
    for name in within:
        same = same & F.col(f"_filled.{name}").eqNullSafe(F.col(name))
    return filled.withColumn(field, F.when(same, F.col("_filled._value")).otherwise(F.col(field))).select(*df.columns)


def remove_empty(df: DataFrame, field: str) -> DataFrame:
    return df.where(~is_blank(F.col(field)))


def remove_duplicates(df: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows whose ``columns`` repeat an earlier row go; the first one stays."""
    columns = columns or [c for c in df.columns if c not in order]
    key = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    tagged = tag_duplicates(df, key, order)
    return tagged.where("duplicate_of IS NULL").select(*df.columns)


VALUE_STEPS: dict[str, Callable[..., Column]] = {
    "replace": lambda df, f, a, b: replace(F.col(f), a or "", b or ""),
    "trim": lambda df, f, a, b: trim(F.col(f)),
    "clean": lambda df, f, a, b: clean(F.col(f)),
    "upper": lambda df, f, a, b: upper(F.col(f)),
    "lower": lambda df, f, a, b: lower(F.col(f)),
    "proper": lambda df, f, a, b: proper(F.col(f)),
    "number": lambda df, f, a, b: to_number(df, f),
    "date": lambda df, f, a, b: to_date(df, f),
    "round": lambda df, f, a, b: round_to(df, f, int(a or 0)),
    "abs": lambda df, f, a, b: absolute(df, f),
}


def apply_step(df: DataFrame, step: tuple, order: list[str]) -> DataFrame:
    """One ``(operation, field, arg1, arg2)`` step; missing arguments may be left out."""
    operation, field, first, second = (*step, None, None, None)[:4]
    if operation == "remove-empty":
        return remove_empty(df, field)
    if operation == "remove-duplicates":
        return remove_duplicates(df, order)
    if operation in ("fill-down", "fill-up"):
        return fill(df, field, order, up=operation == "fill-up")
    return df.withColumn(field, VALUE_STEPS[operation](df, field, first, second))


def apply_steps(df: DataFrame, steps: list[tuple], order: list[str]) -> DataFrame:
    for step in steps:
        df = apply_step(df, step, order)
    return df


def affected_counts(df: DataFrame, steps: list[tuple], order: list[str]) -> DataFrame:
    """``step, operation, field, affected``: changed cells, or removed rows, per step.

    Steps that look at one row at a time share one run: each leaves a flag on the row, a removed
    row stays with ``_alive`` false, and one aggregate adds all flags. The rows are written before
    a step that needs other rows (a fill, duplicates), and no step is computed again for a later one.
    """
    parts: list[DataFrame] = []
    pending: list[tuple[int, str, str]] = []
    rows = df.withColumn("_alive", F.lit(True))

    def counted(source: DataFrame, named: list[tuple[tuple[int, str, str], Column]]) -> DataFrame:
        sums = source.agg(*[value.alias(f"_{number}") for (number, _, _), value in named])
        return sums.select(F.inline(F.array(*[F.struct(
            F.lit(number).alias("step"), F.lit(operation).alias("operation"), F.lit(field).alias("field"),
            F.coalesce(F.col(f"_{number}"), F.lit(0)).cast("bigint").alias("affected")) for (number, operation, field), _ in named])))

    def flags(source: DataFrame) -> None:
        if pending:
            parts.append(counted(source, [(p, F.count_if(f"_flag{p[0]}")) for p in pending]))
            pending.clear()

    for number, step in enumerate(steps, start=1):
        operation, field, first, second = (*step, None, None, None)[:4]
        name = (number, operation, field)
        if operation in VALUE_STEPS or operation == "remove-empty":
            alive = F.col("_alive")
            if operation == "remove-empty":
                blank = is_blank(F.col(field))
                rows = rows.withColumns({f"_flag{number}": alive & blank, "_alive": alive & ~blank})
            else:
                new = VALUE_STEPS[operation](rows, field, first, second)
                same = F.col(field).cast("string").eqNullSafe(new.cast("string"))
                rows = rows.withColumns({f"_flag{number}": alive & ~same, field: new})
            pending.append(name)
            continue
        written = kept(rows)
        flags(written)
        before = written.where("_alive").select(*df.columns)
        after = kept(apply_step(before, step, order))
        weight = F.lit(1) if operation == "remove-duplicates" else is_blank(F.col(field)).cast("int")
        both = before.select(weight.alias("_sign")).unionByName(after.select((-weight).alias("_sign")))
        parts.append(counted(both, [(name, F.sum("_sign"))]))
        rows = after.withColumn("_alive", F.lit(True))
    flags(rows)
    return reduce(DataFrame.unionByName, parts)


def apply_patches(df: DataFrame, patches: DataFrame, key: str, fields: list[str],
                  sequence: str = "sequence") -> DataFrame:
    """Cell patches ``(key, field, value, sequence)`` override; the last one wins."""
    last = {f: F.max_by(F.struct("value"), F.when(F.col("field") == f, F.col(sequence))) for f in fields}
    wide = patches.groupBy(key).agg(*[c.alias(f"_new_{f}") for f, c in last.items()])
    joined = df.join(wide, key, "left")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for field in fields:
        patch = F.col(f"_new_{field}")
        joined = joined.withColumn(field, F.when(patch.isNotNull(), patch["value"].try_cast(kinds[field]))
                                   .otherwise(F.col(field)))
    return joined.select(*df.columns)


def upsert_stock(stock: DataFrame, manual: DataFrame, key: str = "id") -> DataFrame:
    """Manual entries replace the row of the same id, else are appended.

    Entries need a material and a date; given numbers must not be negative.
    """
    numbers = [c for c in ("stock_level", "lead_time_days", "minimum_order_quantity", "order_multiple",
                           "safety_stock", "open_orders") if c in manual.columns]
    good = ~is_blank(F.col("material")) & F.col("date").isNotNull() & F.col("stock_level").isNotNull()
    for name in numbers:
        good = good & F.coalesce(F.col(name) >= 0, F.lit(True))
    entries = manual.where(good)
    rest = stock.join(entries.select(key), key, "left_anti")
    return rest.unionByName(entries, allowMissingColumns=True)


# ---- columns ---------------------------------------------------------------------------

def add_column(df: DataFrame, name: str, column: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, column)


def rename_column(df: DataFrame, old: str, new: str, reads: dict[str, list[str]] | None = None
                  ) -> tuple[DataFrame, dict[str, list[str]]]:
    """Rename, also in the lists of columns that calculated columns read."""
    if new in df.columns:
        raise ValueError(f"column {new} exists")
    renamed = {(new if n == old else n): [new if c == old else c for c in cols]
               for n, cols in (reads or {}).items()}
    return df.withColumnRenamed(old, new), renamed


def drop_column(df: DataFrame, name: str, reads: dict[str, list[str]] | None = None) -> DataFrame:
    users = [n for n, cols in (reads or {}).items() if name in cols and n != name]
    if users:
        raise ValueError(f"column {name} is read by {', '.join(users)}")
    return df.drop(name)


def reorder_columns(df: DataFrame, first: list[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def hide_columns(df: DataFrame, hidden: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in hidden])


def sync_mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped and calendar fields again from their (changed) source columns."""
    for field, source in mapping.items():
        if field == "date":
            df = derive_date_fields(df.withColumn("date", parse_date(F.col(source))), "date")
        elif field in ("quantity", "stock_level"):
            df = df.withColumn(field, number_of(df, source))
        else:
            df = df.withColumn(field, F.nullif(F.trim(F.col(source)), F.lit("")))
    return df
