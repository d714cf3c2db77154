"""One material key over usage, stock, receipts, orders and master data."""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.parse import date_of, number_of
from supplylens.functions.text import clean_text, comparable_text, normalize_key
from supplylens.operators.mapping import has_business_value
from supplylens.plans.ordered import attach
from supplylens.vocab import IDENTITY_FIELDS

TEXT_FIELDS = ["material", "material_code", "sku", "unit", "supplier", "brand", "category", "line", "order"]
NUMBER_FIELDS = ["quantity", "stock_level", "open_orders", "lead_time_days", "minimum_order_quantity",
                 "order_multiple", "safety_stock"]


def identity_key(df: DataFrame, field: str) -> Column:
    """The normalized key of one identity field, NULL if the table lacks it."""
    return normalize_key(F.col(field), field) if field in df.columns else F.lit(None).cast("string")


def fallback_key(df: DataFrame) -> Column:
    return F.coalesce(*[identity_key(df, f) for f in IDENTITY_FIELDS])


def normalize_role_table(df: DataFrame, role: str, stock_mode: str = "snapshot") -> DataFrame:
    """Typed role table: texts cleaned, numbers and dates parsed, empty rows dropped.

    A row without a name takes its code, else its SKU, as name.
    """
    df = df.where(has_business_value(role, df.columns))
    typed = {}
    for field in TEXT_FIELDS:
        if field in df.columns:
            typed[field] = F.nullif(clean_text(F.col(field)), F.lit(""))
    for field in NUMBER_FIELDS:
        if field in df.columns:
            typed[field] = number_of(df, field)
    if "date" in df.columns:
        typed["date"] = date_of(df, "date")
    df = df.withColumns(typed)
    names = [F.col(f) for f in ("material", "material_code", "sku") if f in df.columns]
    df = df.withColumn("material", F.coalesce(*names)).withColumn("role", F.lit(role))
    if role == "stock" and "stock_mode" not in df.columns:
        df = df.withColumn("stock_mode", F.lit(stock_mode))
    return df


def source_labels(headers: list[str], fields: list[str]) -> dict[str, str]:
    """A free name per source header: marked as source where a field has it, numbered where taken."""
    names = dict.fromkeys(fields)
    labels = {}
    for header in dict.fromkeys(headers):
        base = f"Źródło: {header}" if header in names else header
        labels[header] = next(n for n in chain([base], (f"{base} ({i})" for i in count(2))) if n not in names)
        names[labels[header]] = None
    return labels


def union_role(tables: list[DataFrame], fields: list[str], unmapped: list[set[int]] | None = None) -> DataFrame:
    """All tables of one role; extra source columns stay, renamed where they clash.

    ``unmapped`` has, for each table, the positions of the columns that the mapping left as they
    came: such a column stays apart from a field of the same name. Without it, columns named as
    a field are that field.
    """
    extra = unmapped or [{i for i, c in enumerate(t.columns) if c not in fields} for t in tables]
    labels = source_labels([c for t, x in zip(tables, extra) for i, c in enumerate(t.columns) if i in x], fields)
    renamed = [t.toDF(*[labels[c] if i in x else c for i, c in enumerate(t.columns)]) for t, x in zip(tables, extra)]
    stacked = renamed[0]
    for table in renamed[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked


def combine(tables: list[DataFrame], provenance: tuple[str, ...] = ("source_file", "source_sheet", "source_row")
            ) -> DataFrame:
    """Tables with identical headers stacked; anything else is an error."""
    def headers(table: DataFrame) -> list[str]:
        return [c for c in table.columns if c not in provenance]

    result = tables[0]
    for table in tables[1:]:
        if headers(table) != headers(result):
            raise ValueError("tables have different columns; align the headers first")
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def key_overlap(usage: DataFrame, stock: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``place, field, usage_keys, stock_keys, shared, coverage`` per identity field."""
    fields = fields or IDENTITY_FIELDS

    def keys(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), identity_key(df, f).alias("key"))
                          for i, f in enumerate(fields)])
        return df.select(F.inline(pairs)).where("key IS NOT NULL").distinct().withColumn(side, F.lit(1))

    both = keys(usage, "u").join(keys(stock, "s"), ["place", "field", "key"], "full")
    counts = both.groupBy("place", "field").agg(
        F.count("u").alias("usage_keys"), F.count("s").alias("stock_keys"),
        F.count_if(F.col("u").isNotNull() & F.col("s").isNotNull()).alias("shared"))
    return counts.withColumn("coverage", F.coalesce(F.try_divide("shared", "usage_keys"), F.lit(0.0)))


def resolve_join_field(usage: DataFrame, stock: DataFrame, strategy: str = "auto") -> str:
    """The identity field with the best coverage of usage keys in stock (stock only)."""
    if strategy != "auto":
        return strategy
    best = key_overlap(usage, stock).orderBy(F.desc("coverage"), F.desc("shared"), "place").first()
    return best["field"] if best else "material"


def _spellings(df: DataFrame) -> dict[str, Column]:
    """The identity fields as written; NULL and '' have the same key."""
    return {f"_as_{f}": F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("") for f in IDENTITY_FIELDS}


def _identities(df: DataFrame, field: str) -> DataFrame:
    """Distinct spellings of identities with their keys and their primary or fallback key; no text is folded twice."""
    written = df.select(*[c.alias(n) for n, c in _spellings(df).items()]).distinct()
    keys = {f"_{f}": F.coalesce(normalize_key(F.col(f"_as_{f}"), f), F.lit("")) for f in IDENTITY_FIELDS}
    return written.withColumns(keys).withColumn(
        "_own", F.coalesce(*[F.nullif(F.col(f"_{f}"), F.lit("")) for f in [field, *IDENTITY_FIELDS]]))


def alias_groups(usage: DataFrame, field: str) -> DataFrame:
    """``alias, material_key, ambiguous`` for every code, SKU and name of the usage rows."""
    tuples = _identities(usage, field).where("_own IS NOT NULL")
    names = F.array("_own", *[F.nullif(F.col(f"_{f}"), F.lit("")) for f in IDENTITY_FIELDS])
    pairs = tuples.select(F.explode(F.array_distinct(F.array_compact(names))).alias("alias"),
                          F.col("_own").alias("material_key"))
    low, high = F.min("material_key"), F.max("material_key")
    return pairs.groupBy("alias").agg(low.alias("material_key"), (low != high).alias("ambiguous"))


def build_alias_map(usage: DataFrame, field: str) -> DataFrame:
    """``alias, material_key``; an alias that leads to two keys is left out."""
    return alias_groups(usage, field).where("NOT ambiguous").select("alias", "material_key")


def ambiguous_aliases(usage: DataFrame, field: str) -> DataFrame:
    return alias_groups(usage, field).where("ambiguous").select("alias")


def resolve_identity(df: DataFrame, aliases: DataFrame, field: str, name: str = "material_key") -> DataFrame:
    """Add the material key: by the join field, the code, the SKU, the name, else its own.

    Distinct spellings of identities are resolved, not rows, and are joined back as written.
    """
    tuples = _identities(df, field)
    steps = list(dict.fromkeys([field, *IDENTITY_FIELDS]))
    asked = tuples.select("*", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_rank"), F.col(f"_{f}").alias("alias")) for i, f in enumerate(steps)])))
    found = attach(asked.where("alias != ''"), aliases.withColumnRenamed("material_key", "_found"), ["alias"])
    key = list(_spellings(df))
    best = F.min_by("_found", F.when(F.col("_found").isNotNull(), F.col("_rank")))
    resolved = found.groupBy(*key).agg(F.coalesce(best, F.first("_own")).alias(name))
    return attach(df.withColumns(_spellings(df)), resolved, key).drop(*key)


def attach_keys(df: DataFrame, aliases: DataFrame, field: str, role: str) -> tuple[DataFrame, DataFrame]:
    """Receipts, orders or master rows with a key and their required values; and the rest."""
    keyed = resolve_identity(df, aliases, field)
    warning = F.when(F.col("material_key").isNull(), "missing_identity")
    if role == "receipts":
        warning = warning.when(F.col("quantity").isNull() | F.col("date").isNull(), "incomplete_receipt")
    if role == "orders":
        warning = warning.when(F.col("open_orders").isNull(), "missing_quantity")
    marked = keyed.withColumn("warning", warning)
    return marked.where("warning IS NULL").drop("warning"), marked.where("warning IS NOT NULL")


def latest_by_key(df: DataFrame, order: list[str], date: str | None = None) -> DataFrame:
    """The last row per ``material_key``: by date if the table has one, else by order."""
    place = F.struct(*([F.col(date)] if date else []), *order)
    rest = [c for c in df.columns if c != "material_key"]
    return df.groupBy("material_key").agg(F.max_by(F.struct(*rest), place).alias("_row")).select(
        "material_key", "_row.*")


def order_totals(orders: DataFrame, order: list[str]) -> DataFrame:
    """Open quantity per key, and the first filled value of each attribute."""
    attributes = [c for c in ("supplier", "unit", "lead_time_days", "minimum_order_quantity", "order_multiple",
                              "safety_stock", "material", "material_code", "sku") if c in orders.columns]
    place = F.struct(*order)
    return orders.where("material_key IS NOT NULL").groupBy("material_key").agg(
        F.sum(F.greatest(F.coalesce("open_orders", F.lit(0.0)), F.lit(0.0))).alias("open_orders"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in attributes])


def enrich_stock(stock: DataFrame, master: DataFrame, orders: DataFrame, run_date: str | None = None) -> DataFrame:
    """Stock rows with planning data.

    Master first for supplier and planning numbers, stock first for names and unit, open
    orders from orders, else from stock, else 0. Tables are keyed; master and orders have
    one row per key. Rows without key or stock, and opening stock without date, go.
    """
    joined = stock.alias("s")
    for table, name in ((master, "m"), (orders, "o")):
        renamed = table.select("material_key", *[F.col(c).alias(f"_{name}_{c}") for c in table.columns
                                                 if c != "material_key"])
        joined = joined.join(renamed, "material_key", "left")

    def first_of(field: str, *sides: str) -> Column:
        names = [field if side == "s" else f"_{side}_{field}" for side in sides]
        present = [F.col(n) for n in names if n in joined.columns]
        return F.coalesce(*present) if present else F.lit(None)

    wanted = {f: first_of(f, "s", "m", "o") for f in ("material", "material_code", "sku", "unit")}
    wanted["supplier"] = first_of("supplier", "m", "s", "o").cast("string")
    for field in ("lead_time_days", "minimum_order_quantity", "order_multiple", "safety_stock"):
        wanted[field] = first_of(field, "m", "s", "o").cast("double")
    wanted["open_orders"] = F.coalesce(first_of("open_orders", "o", "s").cast("double"), F.lit(0.0))
    for field in ("material_code", "sku", "unit"):
        wanted[field] = wanted[field].cast("string")
    out = joined.withColumns(wanted).drop(*[c for c in joined.columns if c.startswith(("_m_", "_o_"))])
    good = F.col("material_key").isNotNull() & F.col("stock_level").isNotNull()
    good = good & ~((F.col("stock_mode") == "opening") & F.col("date").isNull())
    out = out.where(good)
    return out.withColumn("date", F.coalesce("date", F.lit(run_date).cast("date"))) if run_date else out


def unit_key(column: Column) -> Column:
    """Folded unit, NULL when blank: ``szt`` equals ``szt.``."""
    return F.nullif(comparable_text(column), F.lit(""))
