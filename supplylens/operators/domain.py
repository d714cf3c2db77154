"""What kind of table it is, hierarchical delivery plans, delivery and procurement figures."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.parse import date_of, is_period, number_of
from supplylens.functions.text import GAP, analytics_text, is_blank
from supplylens.operators.profile import cell_text
from supplylens.plans.ordered import carry_forward
from supplylens.sources.grid import fold_name
from supplylens.vocab import MISSING, SUBTOTAL_CELL

MATERIAL_NAMES = ["article", "artykul", "material", "product name"]

# Words in column names that signal a kind of table.
NAME_SIGNALS = {
    "date": ["delivery date", "transport date", "on site date", "data dostaw", "data rozlad", r"\bdate\b", r"\bdata\b"],
    "ordered": ["qty ordered", "ord qty", "ordered qty", "zamowion"],
    "delivered": ["^qty$", "rozladowan", "delivered"],
    "remaining": ["pozostal", "remaining"],
    "usage": ["zuzyc", "usage", "consumption"],
    "stock": ["stan zapasu", "^stock$", "inventory (?:level|qty|quantity)", "on hand"],
    "order": ["ord req number", "order number", "numer zamow"],
    "product": ["article", "artykul", "material", "product name", "product number"],
    "supplier": ["supplier", "dostawc", "vendor"],
    "transport": ["transport date"],
    "on_site": ["on site date"],
}


def column_label(name: str) -> str:
    """Folded column name with '_' and other marks as spaces."""
    return " ".join(re.sub("[^a-z0-9%]+", " ", fold_name(name.replace("_", " "))).split())


def name_signals(columns: list[str]) -> dict[str, bool]:
    labels = [column_label(c) for c in columns]
    return {s: any(re.search(p, label) for p in patterns for label in labels) for s, patterns in NAME_SIGNALS.items()}


def material_column(columns: list[str]) -> str | None:
    return next((c for c in columns if any(p in column_label(c) for p in MATERIAL_NAMES)), None)


def is_subtotal(df: DataFrame, columns: list[str] | None = None) -> Column:
    """True for rows with a cell that says SUMA, RAZEM or TOTAL."""
    texts = [c for c, kind in df.dtypes if kind == "string" and (columns is None or c in columns)]
    # few cells begin like one of the words; only those are folded
    tests = [F.coalesce(F.col(c).rlike(rf"(?i)^{GAP}*(?:suma|razem|total)"), F.lit(False)) & analytics_text(F.col(c)).rlike(SUBTOTAL_CELL) for c in texts]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def domain_facts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``rows, missing_material, subtotals``."""
    columns = columns or df.columns
    material = material_column(columns)
    missing = is_blank(F.col(material)) if material else F.lit(False)
    return df.agg(F.count("*").alias("rows"), F.count_if(missing).alias("missing_material"),
                  F.count_if(is_subtotal(df, columns)).alias("subtotals"))


def classify_raw(df: DataFrame, columns: list[str] | None = None) -> dict[str, object]:
    """Domain from column names, blank materials and subtotal rows (reads one summary row)."""
    columns = columns or df.columns
    s, facts = name_signals(columns), domain_facts(df, columns).first()
    share = facts["missing_material"] / facts["rows"] if facts["rows"] else 0.0
    rules = [
        (s["product"] and s["ordered"] and s["date"] and share > 0.5 and facts["subtotals"] > 0,
         "hierarchical_delivery_plan", 0.94),
        (s["product"] and s["ordered"] and s["transport"] and s["on_site"] and s["order"], "procurement_plan", 0.93),
        (s["product"] and s["ordered"] and s["date"] and s["order"] and (s["delivered"] or s["remaining"]),
         "delivery_tracking", 0.95),
        (s["product"] and s["usage"] and s["date"], "consumption", 0.93),
        (s["product"] and s["stock"], "inventory_snapshot", 0.9),
        (s["order"] and s["date"] and s["delivered"], "unloading_events", 0.82),
    ]
    domain, confidence = next(((d, c) for test, d, c in rules if test), ("generic", 0.5))
    return {"domain": domain, "confidence": confidence, "missing_share": share,
            "subtotals": facts["subtotals"], "material": material_column(columns)}


def refine_domain(raw: dict[str, object], business_roles: set[str]) -> dict[str, object]:
    """The raw domain, overruled by the recognised business roles of the columns."""
    def has(*names: str) -> bool:
        return bool(business_roles & set(names))

    rules = [
        (has("ordered_quantity") and has("order_id") and has("planned_delivery_date") and has(
            "delivered_quantity", "remaining_quantity", "delivered_pallet_count", "remaining_pallet_count"),
         "delivery_tracking", 0.96),
        (has("ordered_quantity") and has("order_id") and has("transport_date") and has("planned_delivery_date"),
         "procurement_plan", 0.95),
        (has("usage_quantity") and has("material_name") and has("date", "actual_delivery_date", "planned_delivery_date"),
         "consumption", 0.95),
        (has("stock") and has("material_name"), "inventory_snapshot", 0.92),
    ]
    for test, domain, confidence in rules:
        if test:
            return {**raw, "domain": domain, "confidence": max(raw["confidence"], confidence)}
    return dict(raw)


def prepare_hierarchy(df: DataFrame, material: str, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Carry the material down and drop subtotal rows.

    The carry sees the material of a subtotal row before that row goes.
    """
    value = F.nullif(analytics_text(F.col(material)), F.lit(""))
    filled = carry_forward(df, [F.col(c) for c in order], {"_material": value})
    body = filled.where(~is_subtotal(df, columns))
    return body.withColumn("filled_down", is_blank(F.col(material)) & F.col("_material").isNotNull()).withColumn(
        material, F.when(is_blank(F.col(material)), F.coalesce("_material", F.col(material)))
        .otherwise(F.col(material))).drop("_material")


def hierarchy_summary(source: DataFrame, prepared: DataFrame) -> DataFrame:
    counts = source.agg(F.lit(1).alias("_one"), F.count("*").alias("source_rows"))
    done = prepared.agg(F.lit(1).alias("_one"), F.count("*").alias("analyzed_rows"),
                        F.count_if("filled_down").alias("filled_down_values"))
    return counts.join(done, "_one").select(  # two one-row tables
        "source_rows", "analyzed_rows", (F.col("source_rows") - F.col("analyzed_rows")).alias("excluded_subtotal_rows"),
        "filled_down_values")


def sum_field(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, total, valid, invalid`` per column; blanks count as neither."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), is_blank(F.col(c)).alias("blank"),
                 number_of(df, c, "analytics").alias("x")) for c in columns])))
    return cells.groupBy("field").agg(
        F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.count("x").alias("valid"),
        F.count_if(~F.col("blank") & F.col("x").isNull()).alias("invalid"))


def top_groups(df: DataFrame, dimension: str, measure: str, k: int = 8) -> DataFrame:
    """``label, value``: the largest sums."""
    label = F.coalesce(F.nullif(analytics_text(cell_text(df, dimension)), F.lit("")), F.lit(MISSING))
    rows = df.select(label.alias("label"), number_of(df, measure, "analytics").alias("x")).where("x IS NOT NULL")
    return rows.groupBy("label").agg(F.sum("x").alias("value")).orderBy(F.desc("value"), "label").limit(k)


def rankings(df: DataFrame, dimensions: dict[str, str], measure: str, k: int = 8) -> DataFrame:
    """``ranking, place, label, value``: the ``k`` largest sums of each named dimension, all from one aggregate."""
    labels = {name: F.coalesce(F.nullif(analytics_text(cell_text(df, c)), F.lit("")), F.lit(MISSING)).alias(f"_{name}") for name, c in dimensions.items()}
    rows = df.select(*labels.values(), number_of(df, measure, "analytics").alias("x")).where("x IS NOT NULL")
    sums = rows.groupingSets([[F.col(f"_{n}")] for n in labels], *[F.col(f"_{n}") for n in labels]).agg(
        *[F.grouping(f"_{n}").alias(f"_no_{n}") for n in labels], F.sum("x").alias("value"))
    name, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in labels:
        name, label = F.when(F.col(f"_no_{n}") == 0, n).otherwise(name), F.when(F.col(f"_no_{n}") == 0, F.col(f"_{n}")).otherwise(label)
    order = Window.partitionBy("ranking").orderBy(F.desc("value"), "label")
    return (sums.select(name.alias("ranking"), label.alias("label"), "value").withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= k).select("ranking", "place", "label", "value"))


def _first_of_kinds(df: DataFrame, kinds: dict[str, Column], order: list[str], columns: list[Column], limit: int) -> DataFrame:
    """``kind, place`` and ``columns`` of the first ``limit`` rows of each kind in the order of the rows."""
    found = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in kinds.items()]))
    rows = df.select(F.explode(found).alias("kind"), *order, *columns)
    window = Window.partitionBy("kind").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


def _numbers(df: DataFrame, roles: dict[str, str]) -> dict[str, Column]:
    return {name: number_of(df, roles[name], "analytics") if name in roles else F.lit(None).cast("double")
            for name in ("ordered", "delivered", "remaining")}


def delivery_rows(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Rows with ``o, d, r`` as numbers and the flags of the delivery checks.

    ``roles`` names the columns of ``ordered, delivered, remaining, order, document``.
    """
    n = _numbers(df, roles)
    blank = is_blank(F.col(roles["document"])) if "document" in roles else F.lit(False)
    rows = df.withColumns({"o": n["ordered"], "d": n["delivered"], "r": n["remaining"], "_blank": blank})
    gap = F.col("o") - F.col("d") - F.col("r")
    off = F.abs(gap) > F.greatest(F.lit(1.0), F.abs("o") * 0.001)
    open_rest = F.coalesce(F.col("r") > 0, F.lit(False)) | F.coalesce(F.col("d") < F.col("o"), F.lit(False))
    return rows.withColumns({
        "delta": gap, "inconsistent": F.coalesce(off, F.lit(False)),
        "over_delivered": F.coalesce(F.col("d") > F.col("o"), F.lit(False)), "incomplete": open_rest,
        "missing_document": F.coalesce((F.col("d") > 0) & F.col("_blank"), F.lit(False)) if "document" in roles
        else F.lit(False)}).drop("_blank")


def delivery_kpis(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row of totals, completion and control counts of a delivery register."""
    rows = delivery_rows(df, roles)
    order = F.count_distinct(F.nullif(analytics_text(cell_text(df, roles["order"])), F.lit(""))) if "order" in roles \
        else F.lit(None).cast("bigint")
    bad = [F.count_if(~is_blank(F.col(roles[n])) & F.col(c).isNull())
           for n, c in (("ordered", "o"), ("delivered", "d"), ("remaining", "r")) if n in roles]
    bad += [F.count_if(~is_blank(F.col(roles[n])) & number_of(df, roles[n], "analytics").isNull())
            for n in ("ordered_pallets", "delivered_pallets", "remaining_pallets") if n in roles]
    pallets = {name: F.sum(number_of(df, roles[name], "analytics"))
               for name in ("ordered_pallets", "delivered_pallets", "remaining_pallets") if name in roles}
    facts = rows.agg(
        F.count("*").alias("rows"), F.sum("o").alias("ordered"), F.sum("d").alias("delivered"),
        F.sum("r").alias("remaining"), *[c.alias(n) for n, c in pallets.items()], order.alias("orders"),
        F.count_if("incomplete").alias("incomplete"), F.count_if("over_delivered").alias("over_delivered"),
        F.count_if("inconsistent").alias("inconsistent"), F.count_if("missing_document").alias("missing_documents"),
        reduce(lambda a, b: a + b, bad, F.lit(0)).alias("invalid_numbers"))
    return facts.withColumn("completion", F.when(F.col("ordered") > 0, F.col("delivered") / F.col("ordered")))


def delivery_details(df: DataFrame, roles: dict[str, str], order: list[str], limit: int = 100) -> DataFrame:
    """The first ``limit`` rows, in the order of ``order``, of each check of a delivery register.

    ``kind`` is ``incomplete``, ``inconsistent`` or ``over_delivered``; ``amount`` is what
    remains, the difference of the equation, or the excess.
    """
    rows = delivery_rows(df, roles)
    amount = (F.when(F.col("kind") == "incomplete", F.coalesce(F.col("r"), F.col("o") - F.col("d")))
              .when(F.col("kind") == "inconsistent", F.col("delta")).otherwise(F.col("d") - F.col("o")))
    kinds = {k: F.col(k) for k in ("incomplete", "inconsistent", "over_delivered")}
    name = cell_text(df, roles["order"]) if "order" in roles else F.lit(None).cast("string")
    found = _first_of_kinds(rows, kinds, order, [name.alias("_order"), F.col("o"), F.col("d"), F.col("r"), F.col("delta")], limit)
    return found.select("kind", "place", *order, F.col("_order").alias("order_name"), F.col("o").alias("ordered_amount"), F.col("d").alias("delivered_amount"),
                        F.col("r").alias("remaining_amount"), amount.alias("amount"))


def procurement_details(df: DataFrame, roles: dict[str, str], order: list[str], conventions: dict[str, str] | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows each with a period in place of a day (``week_only``) or a delivery before its transport (``negative``)."""
    rows = lead_times(df, roles, conventions)
    kinds = {"week_only": F.col("week_only"), "negative": F.coalesce(F.col("lead_days") < 0, F.lit(False))}
    found = _first_of_kinds(rows, kinds, order, [F.col("lead_days"), F.col(roles["on_site"]).cast("string").alias("_text")], limit)
    return found.select("kind", "place", *order, F.when(F.col("kind") == "week_only", F.col("_text")).alias("period"), "lead_days")


def lead_times(df: DataFrame, roles: dict[str, str], conventions: dict[str, str] | None = None) -> DataFrame:
    """Rows with ``lead_days`` and ``week_only`` for dates that name a period only.

    ``roles`` names the columns of ``transport`` and ``on_site``.
    """
    conventions = conventions or {}
    start = date_of(df, roles["transport"], "analytics", conventions.get("transport", "dmy"))
    end = date_of(df, roles["on_site"], "analytics", conventions.get("on_site", "dmy"))
    days = F.datediff(end, start)
    return df.withColumn("lead_days", days).withColumn(
        "week_only", days.isNull() & is_period(F.col(roles["on_site"]).cast("string")))


def procurement_kpis(df: DataFrame, roles: dict[str, str], conventions: dict[str, str] | None = None) -> DataFrame:
    """One row of totals and lead times of a procurement plan.

    The median counts days, of which there are few different ones.
    """
    rows = lead_times(df, roles, conventions)

    def distinct(name: str) -> Column:
        if name not in roles:
            return F.lit(None).cast("bigint")
        return F.count_distinct(F.nullif(analytics_text(cell_text(df, roles[name])), F.lit("")))

    number = number_of(df, roles["ordered"], "analytics")
    return rows.agg(
        F.sum(number).alias("ordered"),
        F.count_if(~is_blank(F.col(roles["ordered"])) & number.isNull()).alias("invalid_numbers"),
        distinct("order").alias("orders"), distinct("product").alias("products"),
        distinct("supplier").alias("suppliers"), F.count("lead_days").alias("lead_count"),
        F.avg("lead_days").alias("lead_mean"), F.percentile("lead_days", F.lit(0.5)).alias("lead_median"),
        F.min("lead_days").alias("lead_min"), F.max("lead_days").alias("lead_max"),
        F.count_if(F.col("lead_days") < 0).alias("lead_negative"), F.count_if("week_only").alias("week_only"))
