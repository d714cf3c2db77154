"""Stock as of a date, coverage, risk, Pareto and ABC classes, order quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.dates import SEASONS, season, season_period
from supplylens.operators.identity import unit_key
from supplylens.plans.ordered import running_totals
from supplylens.vocab import (
    ABC_A, ABC_B, FORECAST_BUFFER, FORECAST_DAYS, LOW_DENSITY, MEDIUM_DENSITY, MEDIUM_OBSERVED_DAYS,
    MINIMUM_OBSERVED_DAYS, PARETO_SHARE, RISK_COVERAGE_DAYS, UNIT_CONFLICT, UNIT_MISMATCH, UNKNOWN_MATERIAL,
)

PLANNING_NUMBERS = ["lead_time_days", "minimum_order_quantity", "order_multiple", "safety_stock", "open_orders"]


def usage_by_material(usage: DataFrame, order: list[str]) -> DataFrame:
    """``material_key, material, used``: the sum per key with its first label."""
    return usage.groupBy("material_key").agg(
        F.min_by(F.coalesce("material", F.lit(UNKNOWN_MATERIAL)), F.struct(*order)).alias("material"),
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("used"))


def daily_usage(usage: DataFrame) -> DataFrame:
    return usage.where("date IS NOT NULL").groupBy("date").agg(
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("used"))


def ranked_usage(usage: DataFrame, order: list[str]) -> DataFrame:
    """Materials by usage with shares: ``used, share, share_before, cumulative_share``.

    Equal usage is ordered by key. The running sum works range by range.
    """
    totals = usage_by_material(usage, order)
    placed = running_totals(totals, [F.col("used").desc(), F.col("material_key")], {"running": "used"})
    whole = F.col("running_total")

    def percent(part: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))

    return placed.select("material_key", "material", "used", percent(F.col("used")).alias("share"),
                         percent(F.col("running") - F.col("used")).alias("share_before"),
                         percent(F.col("running")).alias("cumulative_share"))


def pareto(usage: DataFrame, order: list[str]) -> DataFrame:
    """Ranked usage with ``needed_for_80``: the share before the row is under 80 %."""
    return ranked_usage(usage, order).withColumn("needed_for_80", F.col("share_before") < PARETO_SHARE)


def abc_class(cumulative: Column) -> Column:
    # sums of many shares may pass a bound by rounding noise only
    at = F.round(cumulative, 9)
    return F.when(at <= ABC_A, "A").when(at <= ABC_B, "B").otherwise("C")


def abc(usage: DataFrame, order: list[str]) -> DataFrame:
    return ranked_usage(usage, order).withColumn("classification", abc_class(F.col("cumulative_share"))).drop(
        "share_before")


def half_trend(usage: DataFrame) -> DataFrame:
    """``days, first_mean, second_mean, change, trend``: the second half of the days against
    the first. One row per calendar day enters the window."""
    days = daily_usage(usage)
    numbered = days.select("used", F.row_number().over(Window.orderBy("date")).alias("n"),
                           F.count("*").over(Window.partitionBy()).alias("days"))
    middle = F.greatest(F.lit(1), F.floor(F.col("days") / 2))
    halves = numbered.agg(
        F.coalesce(F.max("days"), F.lit(0)).alias("days"),
        F.avg(F.when(F.col("n") <= middle, F.col("used"))).alias("first_mean"),
        F.avg(F.when(F.col("n") > middle, F.col("used"))).alias("second_mean"))
    change = F.try_divide(F.col("second_mean") - F.col("first_mean"), F.col("first_mean")) * 100
    change = F.when(F.col("days") >= 2, change)
    return halves.withColumn("change", change).withColumn(
        "trend", F.when(F.col("change") > 10, "rosnący").when(F.col("change") < -10, "malejący")
        .when(F.col("change").isNotNull(), "stabilny"))


def as_of_date(tables: list[DataFrame], explicit: str | None = None, run_date: str | None = None) -> DataFrame:
    """One row ``as_of``: the given date, else the newest date of the tables, else the run date."""
    if explicit:
        spark = tables[0].sparkSession
        return spark.range(1).select(F.lit(explicit).cast("date").alias("as_of"))
    dates = tables[0].select("date")
    for table in tables[1:]:
        dates = dates.unionByName(table.select("date"))
    return dates.agg(F.coalesce(F.max("date"), F.lit(run_date).cast("date")).alias("as_of"))


def stock_as_of(stock: DataFrame, as_of: str, order: list[str], explicit: bool = True) -> DataFrame:
    """The newest stock row per key up to a date; equal dates by source order.

    Undated rows count as of the date itself, after dated ones, unless it was set explicitly.
    """
    day = F.lit(as_of).cast("date")
    rows = stock.where(F.col("date") <= day) if explicit else stock.where(
        (F.col("date") <= day) | F.col("date").isNull())
    place = F.struct(F.coalesce("date", day), F.col("date").isNull(), *order)
    rest = [c for c in rows.columns if c != "material_key"]
    return rows.groupBy("material_key").agg(F.max_by(F.struct(*rest), place).alias("_row")).select(
        "material_key", "_row.*")


def visible_stock(stock: DataFrame, usage: DataFrame) -> DataFrame:
    """Stock of the materials in the (filtered) usage only."""
    return stock.join(usage.select("material_key").distinct(), "material_key", "left_semi")


def latest_stock_simple(rows: DataFrame, order: list[str]) -> DataFrame:
    """The newest dated stock of 0 or more per key, without a role model."""
    good = rows.where((F.col("stock_level") >= 0) & F.col("date").isNotNull())
    place = F.struct("date", *order)
    rest = [c for c in good.columns if c != "material_key"]
    return good.groupBy("material_key").agg(F.max_by(F.struct(*rest), place).alias("_row")).select(
        "material_key", "_row.*").withColumnRenamed("stock_level", "stock")


def effective_stock(stock: DataFrame, usage: DataFrame, receipts: DataFrame, as_of: str) -> DataFrame:
    """Snapshots as they are; opening stock plus receipts minus usage in the closed range
    from the stock date to ``as_of``.

    ``stock`` has one row per key. Movements are first summed per key and day, so a busy
    material adds at most one row per day to the join.
    """
    day = F.lit(as_of).cast("date")

    def per_day(table: DataFrame, name: str) -> DataFrame:
        used = table.where((F.col("date") <= day) & F.col("quantity").isNotNull())
        return used.groupBy("material_key", F.col("date").alias("_day")).agg(F.sum("quantity").alias(name))

    moves = per_day(usage, "_used").join(per_day(receipts, "_received"), ["material_key", "_day"], "full")
    opening = stock.where("stock_mode = 'opening' AND date IS NOT NULL").select(
        "material_key", F.col("date").alias("_from"))
    sums = opening.join(moves, "material_key").where(F.col("_day") >= F.col("_from")).groupBy("material_key").agg(
        F.sum("_used").alias("_used"), F.sum("_received").alias("_received"))
    joined = stock.where("stock_level IS NOT NULL").join(sums, "material_key", "left")
    used, received = F.coalesce("_used", F.lit(0.0)), F.coalesce("_received", F.lit(0.0))
    return joined.withColumns({
        "stock": F.col("stock_level") + received - used, "original_stock": F.col("stock_level"),
        "usage_since": used, "receipts_since": received,
        "stale_days": F.greatest(F.lit(0), F.datediff(day, F.col("date"))), "as_of": day,
    }).drop("_used", "_received")


def reliability(observed: Column, calendar: Column) -> Column:
    density = F.coalesce(F.try_divide(observed, calendar), F.lit(0.0))
    return (F.when(observed < MINIMUM_OBSERVED_DAYS, "insufficient").when(density < LOW_DENSITY, "low")
            .when((observed < MEDIUM_OBSERVED_DAYS) | (density < MEDIUM_DENSITY), "medium").otherwise("high"))


def _per_day(usage: DataFrame, order: list[str], extra: list[str] | None = None) -> DataFrame:
    """Usage per key, day and unit: what coverage and plans are built from."""
    return usage.groupBy("material_key", *(extra or []), "date", unit_key(F.col("unit")).alias("_unit")).agg(
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("_used"),
        F.min(F.struct(*order)).alias("_place"),
        F.min_by("material", F.struct(*order)).alias("_label"))


def _unit_facts() -> list[Column]:
    return [F.min("_unit").alias("_unit_low"), F.max("_unit").alias("_unit_high")]


def _unit_issue(stock_unit: Column) -> Column:
    low, high = F.col("_unit_low"), F.col("_unit_high")
    return F.when(low != high, UNIT_CONFLICT).when((stock_unit != low), UNIT_MISMATCH)


def coverage(usage: DataFrame, stock: DataFrame, order: list[str]) -> DataFrame:
    """Days the stock of each material lasts at its average daily use.

    ``stock`` has one row per key with ``stock`` and ``unit``. The average is over the
    calendar span of the usage. Too few days, several usage units or a different stock
    unit leave the coverage NULL.
    """
    totals = _per_day(usage, order).groupBy("material_key").agg(
        F.sum("_used").alias("_total"), F.min("date").alias("_first"), F.max("date").alias("_last"),
        F.count_distinct("date").alias("observed_days"), F.min_by("_label", "_place").alias("_label"),
        *_unit_facts())
    joined = stock.join(totals, "material_key", "left")
    calendar = F.greatest(F.lit(1), F.coalesce(F.datediff("_last", "_first") + 1, F.lit(1)))
    observed = F.coalesce("observed_days", F.lit(0))
    rows = joined.withColumns({
        "observed_days": observed, "calendar_days": calendar,
        "data_issue": _unit_issue(unit_key(F.col("unit")))})
    rows = rows.withColumns({
        "material": F.coalesce("_label", "material", F.lit(UNKNOWN_MATERIAL)),
        "density": F.col("observed_days") / F.col("calendar_days"),
        "average_daily": F.coalesce("_total", F.lit(0.0)) / F.col("calendar_days"),
        "reliability": F.when(F.col("data_issue").isNotNull(), "insufficient").otherwise(
            reliability(F.col("observed_days"), F.col("calendar_days")))})
    usable = (F.col("reliability") != "insufficient") & (F.col("average_daily") > 0)
    days = F.when(usable, F.greatest(F.col("stock"), F.lit(0.0)) / F.col("average_daily"))
    out = rows.withColumn("coverage_days", days).withColumn(
        "at_risk", F.coalesce(F.col("coverage_days") < RISK_COVERAGE_DAYS, F.lit(False)))
    return out.drop("_total", "_first", "_last", "_label", "_unit_low", "_unit_high")


def next_season(run_date: str) -> str:
    """The season after the one a date lies in."""
    month = int(run_date[5:7])
    return SEASONS[(month % 12 // 3 + 1) % 4]


def order_plan(usage: DataFrame, stock: DataFrame, order: list[str], season_name: str,
               days: int = FORECAST_DAYS, buffer: float = FORECAST_BUFFER) -> DataFrame:
    """What to order per material for a season, from its use in the same past seasons.

    Calendar days add up per season period. The need covers the longer of ``days`` and the
    lead time, plus buffer and safety stock; stock and open orders are subtracted, then the
    minimum quantity and the order multiple apply. Unit issues and thin data give 0.
    """
    seasonal = usage.where(season(F.col("date")) == season_name).withColumn(
        "_period", season_period(F.col("date"))["season_period"])
    periods = _per_day(seasonal, order, ["_period"]).groupBy("material_key", "_period").agg(
        F.sum("_used").alias("_used"), F.count_distinct("date").alias("_observed"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("_calendar"),
        F.min("_place").alias("_place"), F.min_by("_label", "_place").alias("_label"), *_unit_facts())
    needs = periods.groupBy("material_key").agg(
        F.sum("_used").alias("_used"), F.sum("_observed").alias("observed_days"),
        F.greatest(F.lit(1), F.sum("_calendar")).alias("calendar_days"),
        F.min_by("_label", "_place").alias("material"),
        F.min("_unit_low").alias("_unit_low"), F.max("_unit_high").alias("_unit_high"))
    have = stock.select("material_key", "stock", "unit", "supplier",
                        *[F.col(c).alias(c) for c in PLANNING_NUMBERS])
    rows = needs.join(have, "material_key", "left")

    def at_least_zero(name: str) -> Column:
        return F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(0.0))

    rows = rows.withColumns({c: at_least_zero(c) for c in ["stock", *PLANNING_NUMBERS]})
    rows = rows.withColumns({
        "material": F.coalesce("material", F.lit(UNKNOWN_MATERIAL)),
        "density": F.col("observed_days") / F.col("calendar_days"),
        "average_daily": F.col("_used") / F.col("calendar_days"),
        "data_issue": _unit_issue(unit_key(F.col("unit"))),
        "planning_days": F.greatest(F.lit(float(days)), F.col("lead_time_days"))})
    rows = rows.withColumn("reliability", F.when(F.col("data_issue").isNotNull(), "insufficient").otherwise(
        reliability(F.col("observed_days"), F.col("calendar_days"))))
    usable = F.col("reliability") != "insufficient"
    rows = rows.withColumn("base_forecast", F.when(
        usable, F.col("average_daily") * F.col("planning_days")).otherwise(0.0))
    rows = rows.withColumn("recommended_quantity", F.when(
        usable, F.col("base_forecast") * (1 + buffer) + F.col("safety_stock")).otherwise(0.0))
    rows = rows.withColumn("raw_to_order", F.when(usable, F.greatest(
        F.lit(0.0), F.col("recommended_quantity") - F.col("stock") - F.col("open_orders"))).otherwise(0.0))
    moq = F.greatest(F.col("raw_to_order"), F.col("minimum_order_quantity"))
    # a quotient that is whole up to rounding noise must not be lifted by one multiple
    lots = F.ceil(F.round(moq / F.col("order_multiple"), 9)) * F.col("order_multiple")
    rows = rows.withColumn("to_order", F.when(F.col("raw_to_order") <= 0, 0.0)
                           .when(F.col("order_multiple") > 0, lots).otherwise(moq))
    return rows.drop("_used", "_unit_low", "_unit_high")


RELIABILITY_RANK = {"insufficient": 0, "low": 1, "medium": 2, "high": 3}


def plan_order() -> list[Column]:
    """Sort columns of an order plan: reliability, then quantity, both descending."""
    ranks = F.create_map(*[F.lit(x) for pair in RELIABILITY_RANK.items() for x in pair])
    return [ranks[F.col("reliability")].desc(), F.col("to_order").desc(), F.col("material_key")]


def kpis(usage: DataFrame, covered: DataFrame, order: list[str]) -> DataFrame:
    """One row of headline figures; stock is NULL when its units differ."""
    totals = usage_by_material(usage, order)
    used = totals.agg(F.lit(1).alias("_one"), F.sum("used").alias("used"), F.count("*").alias("materials"),
                      F.max(F.struct("used", "material")).alias("_top"))
    place = F.when(F.col("coverage_days").isNotNull(), F.struct("coverage_days", "material_key"))
    stock = covered.agg(
        F.lit(1).alias("_one"),
        F.when(F.coalesce(F.min("unit") == F.max("unit"), F.lit(True)), F.sum("stock")).alias("stock"),
        (F.min("unit") != F.max("unit")).alias("mixed_units"),
        F.count_if("at_risk").alias("at_risk"),
        F.min_by("material", place).alias("lowest_material"), F.min("coverage_days").alias("lowest_coverage"))
    trend = half_trend(usage).select(F.lit(1).alias("_one"), F.col("change").alias("trend_change"), "trend")
    row = used.join(stock, "_one").join(trend, "_one")  # three one-row tables
    return row.select("used", "materials", F.col("_top.material").alias("top_material"),
                      F.coalesce(F.try_divide("_top.used", "used") * 100, F.lit(0.0)).alias("top_share"),
                      "stock", F.coalesce("mixed_units", F.lit(False)).alias("mixed_units"), "at_risk",
                      "lowest_material", "lowest_coverage", "trend_change", "trend")


# ---- join audit -------------------------------------------------------------------------

def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys on the left side only, with one label."""
    names = left.groupBy("material_key").agg(F.min("material").alias("material"))
    return names.join(right.select("material_key").distinct(), "material_key", "left_anti")


def unit_mismatch(usage: DataFrame, latest: DataFrame, order: list[str]) -> DataFrame:
    """Keys whose first usage unit differs from the unit of their latest stock."""
    first = usage.groupBy("material_key").agg(F.min_by(F.struct("unit"), F.struct(*order)).alias("_u"))
    both = first.select("material_key", F.col("_u.unit").alias("usage_unit")).join(
        latest.select("material_key", F.col("unit").alias("stock_unit")), "material_key")
    return both.where(unit_key(F.col("usage_unit")) != unit_key(F.col("stock_unit")))


def duplicate_snapshots(stock: DataFrame) -> DataFrame:
    """Keys with several stock rows on one day."""
    return stock.groupBy("material_key", "date").agg(F.count("*").alias("rows")).where("rows > 1")


def negative_stock(stock: DataFrame) -> DataFrame:
    return stock.where("stock_level < 0")


def join_audit(usage: DataFrame, stock: DataFrame, order: list[str], stock_order: list[str],
               counts: dict[str, DataFrame] | None = None, ambiguous: DataFrame | None = None) -> DataFrame:
    """``metric, value`` rows: sizes, matches and what needs a look."""
    place = F.struct("date", *stock_order)
    latest = stock.groupBy("material_key").agg(F.max_by(F.struct("unit"), place).alias("_u")).select(
        "material_key", F.col("_u.unit").alias("unit"))
    sides = usage.select("material_key").distinct().withColumn("u", F.lit(1)).join(
        latest.select("material_key", F.lit(1).alias("s")), "material_key", "full").where("material_key IS NOT NULL")
    matched = sides.agg(
        F.count("u").alias("usage_materials"), F.count("s").alias("stock_materials"),
        F.count_if(F.col("u").isNotNull() & F.col("s").isNotNull()).alias("matched_materials"),
        F.count_if(F.col("s").isNull()).alias("unmatched_usage"),
        F.count_if(F.col("u").isNull()).alias("unmatched_stock"))
    facts = [usage.agg(F.count("*").alias("usage_rows")),
             stock.agg(F.count("*").alias("stock_rows"), F.count_if(F.col("stock_level") < 0).alias("negative_stock")),
             matched,
             duplicate_snapshots(stock).agg(F.count("*").alias("duplicate_snapshots")),
             unit_mismatch(usage, latest, order).agg(F.count("*").alias("unit_mismatches"))]
    facts += [table.agg(F.count("*").alias(f"{name}_rows")) for name, table in (counts or {}).items()]
    if ambiguous is not None:
        facts.append(ambiguous.agg(F.count("*").alias("ambiguous_aliases")))
    parts = [f.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in f.columns])))
        for f in facts]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
