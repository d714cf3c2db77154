"""Anomalies, time series, trends, period comparison and associations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.dates import period_key
from supplylens.functions.parse import date_of, number_of, timestamp_of
from supplylens.functions.text import is_blank
from supplylens.operators.profile import cell_text
from supplylens.plans.ordered import attach, narrowed_quantiles, quantiles, running_totals, value_counts
from supplylens.session import kept, spread
from supplylens.vocab import AGGREGATION_BY_ROLE, MISSING

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(low))))


#: Names the results below use for their own columns.
OWN_NAMES = {"measure", "value", "period", "records", "method", "distance", "local", "severity", "confidence"}


def free_names(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Row columns under names that cannot clash: ``value`` becomes ``row_value``."""
    names = [f"row_{c}" if c in OWN_NAMES else c for c in columns]
    return df.withColumns({n: F.col(c) for n, c in zip(names, columns) if n != c}), names


def melt(df: DataFrame, measures: list[str], keep: list[str]) -> DataFrame:
    """``keep..., measure, value`` with one row per filled number."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), number_of(df, m, "analytics").alias("value"))
                      for m in measures])
    return df.select(*keep, F.inline(pairs)).where("value IS NOT NULL")


# ---- outliers -----------------------------------------------------------------------------

#: Up to this many groups, quantiles are found by counts in narrowing ranges; more groups are sorted.
NARROWED_GROUPS = 1000


def robust_bounds(values: DataFrame, group: list[str], minimum: int = 4, multiplier: float = 1.5) -> DataFrame:
    """``group..., n, q1, median, q3, iqr, mad, lower, upper`` for groups large enough.

    ``group`` columns must not be NULL. ``values`` is read twice. The number of groups is measured:
    few of them need no sort, as each of their quantiles lies in a range that counts narrow.
    """
    groups = kept(values.where("value IS NOT NULL").select(*group).distinct())
    if groups.count() <= NARROWED_GROUPS:
        named = groups.withColumn("_id", F.row_number().over(Window.orderBy(*group)))
        numbers = kept(values.where("value IS NOT NULL").join(F.broadcast(named), group).select("_id", "value"))
        middle = narrowed_quantiles(numbers, "value", QUARTILES, "_id").where(F.col("n") >= minimum)
        away = numbers.join(F.broadcast(middle.select("_id", "median")), "_id").select(
            "_id", F.abs(F.col("value") - F.col("median")).alias("away"))
        mad = narrowed_quantiles(away, "away", {"mad": 0.5}, "_id").drop("n")
        spread = middle.join(mad, "_id").join(named, "_id").drop("_id")
    else:
        counted = kept(value_counts(values, "value", group))
        middle = kept(quantiles(counted, "value", QUARTILES, group, "_weight").where(F.col("n") >= minimum))
        away = attach(counted, middle.select(*group, "median"), group, "inner").select(
            *group, "_weight", F.abs(F.col("value") - F.col("median")).alias("away"))
        spread = middle.join(quantiles(away, "away", {"mad": 0.5}, group, "_weight").drop("n"), group)
    spread = spread.withColumn("iqr", F.col("q3") - F.col("q1"))
    return spread.withColumns({"lower": F.col("q1") - multiplier * F.col("iqr"),
                               "upper": F.col("q3") + multiplier * F.col("iqr")})


def _judge(prefix: str) -> dict[str, Column]:
    value = F.col("value")
    iqr, mad, low, high = (F.col(f"{prefix}{c}") for c in ("iqr", "mad", "lower", "upper"))
    z = F.when(mad > 0, 0.6745 * (value - F.col(f"{prefix}median")) / mad).otherwise(0.0)
    outside = (iqr > 0) & ((value < low) | (value > high))
    distance = F.when(iqr > 0, F.when(value > high, (value - high) / iqr).otherwise((low - value) / iqr))
    return {f"{prefix}z": z, f"{prefix}outside": F.coalesce(outside, F.lit(False)),
            f"{prefix}distance": F.coalesce(distance, F.abs(z))}


def outliers(df: DataFrame, measures: list[str], row: list[str], dimension: str | None = None,
             minimum_values: int = 8) -> DataFrame:
    """Rows outside the robust bounds of their measure, or of their group in it.

    ``row`` columns identify a row. Global and local judgement meet in one pass over the
    values: each value looks up the bounds of its measure and of its group.
    """
    df, row = free_names(df, row)
    keep = [F.col(c) for c in row]
    cells = melt(df.withColumn("_group", F.when(~is_blank(F.col(dimension)), cell_text(df, dimension))
                               if dimension else F.lit(None).cast("string")), measures, [*row, "_group"])
    bounds = robust_bounds(cells, ["measure"]).where(F.col("n") >= minimum_values)
    side = ["median", "mad", "iqr", "lower", "upper"]
    judged = cells.join(F.broadcast(bounds.select("measure", *[F.col(c).alias(f"g_{c}") for c in side])), "measure")
    judged = judged.withColumns(_judge("g_"))  # the bounds have one row per measure
    if dimension:
        grouped = cells.where("_group IS NOT NULL")
        local = robust_bounds(grouped, ["measure", "_group"], minimum_values)
        local = local.select("measure", "_group", *[F.col(c).alias(f"l_{c}") for c in side])
        judged = attach(judged, local, ["measure", "_group"]).withColumns(_judge("l_"))
    else:
        judged = judged.withColumns({"l_outside": F.lit(False), "l_z": F.lit(None).cast("double"),
                                     "l_distance": F.lit(None).cast("double"), "l_iqr": F.lit(None).cast("double")})
    globally = F.col("g_outside") | (F.abs("g_z") >= 3.5)
    locally = F.col("l_iqr").isNotNull() & (F.col("l_outside") | (F.abs("l_z") >= 3.5)) if dimension else F.lit(False)
    found = judged.withColumns({"is_global": globally, "is_local": F.coalesce(locally, F.lit(False))}).where(
        "is_global OR is_local")
    method = (F.when(~F.col("is_global"), "lokalny IQR / robust Z-score")
              .when(F.col("g_outside") & (F.abs("g_z") >= 3.5), "IQR + robust Z-score")
              .when(F.col("g_outside"), "IQR").otherwise("robust Z-score"))
    z = F.when(F.col("is_global"), F.col("g_z")).otherwise(F.col("l_z"))
    own = F.when(F.col("is_global"), F.col("g_distance"))
    distance = F.when(F.col("is_local"), F.greatest(F.coalesce(own, F.lit(0.0)), F.col("l_distance"))).otherwise(own)
    local_z = F.when(F.col("is_local"), F.col("l_z"))
    found = found.withColumns({"method": method, "robust_z": z, "distance": distance, "local_z": local_z})
    size = F.greatest(F.abs(F.coalesce("robust_z", F.lit(0.0))), F.abs(F.coalesce("local_z", F.lit(0.0))),
                      F.coalesce("distance", F.lit(0.0)))
    found = found.withColumn("magnitude", size)
    return found.select(
        *keep, "measure", "value", "method", "robust_z", "distance", F.col("is_local").alias("local"),
        F.when(F.col("is_local"), F.col("_group")).alias("group_value"), "local_z", "magnitude",
        severity(F.col("magnitude")).alias("severity"),
        F.round(clamp(0.68 + F.least(F.lit(0.3), F.col("magnitude") / 20)
                      + F.when(F.col("is_local"), 0.04).otherwise(0.0)), 3).alias("confidence"))


def severity(magnitude: Column) -> Column:
    return F.when(magnitude >= 8, "high").when(magnitude >= 4.5, "medium").otherwise("low")


def top_findings(found: DataFrame, row: list[str], limit: int = 300) -> DataFrame:
    row = [f"row_{c}" if c in OWN_NAMES else c for c in row]
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.orderBy(rank, F.desc("distance"), "measure", *row).limit(limit)


def outlier_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), *[
        F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


# ---- time series ---------------------------------------------------------------------------

def aggregation_for(role: str) -> str:
    return AGGREGATION_BY_ROLE.get(role, "sum")


def _per_period(df: DataFrame, date: str, measures: dict[str, str], granularity: str, convention: str,
                sequence: list[str], by: Column | None = None) -> DataFrame:
    df, sequence = free_names(df, sequence)
    stamp, day = timestamp_of(df, date, "analytics", convention), date_of(df, date, "analytics", convention)
    placed = df.withColumns({"_at": stamp, "_period": period_key(day, granularity), "_by": by if by is not None else F.lit("")})
    parts = []
    # only the newest value of a period needs the sequence, and an aggregate that sorts its rows
    for latest in (False, True):
        named = [m for m, how in measures.items() if (how == "latest") == latest]
        if not named:
            continue
        cells = melt(placed, named, ["_at", "_period", "_by", *sequence] if latest else ["_period", "_by"]).where("_period IS NOT NULL")
        newest = F.max(F.struct("_at", *sequence, F.col("value").alias("_v")))["_v"] if latest else F.sum("value")
        sums = cells.groupBy("measure", "_period", "_by").agg(newest.alias("_value"), F.count("*").alias("records"))
        how = F.element_at(F.create_map(*[F.lit(x) for m in named for x in (m, measures[m])]), F.col("measure"))
        value = F.when(how == "average", F.col("_value") / F.col("records")).otherwise(F.col("_value"))
        parts.append(sums.select("measure", F.col("_period").alias("period"), "_by", value.alias("value"), "records"))
    return reduce(DataFrame.unionByName, parts)


def series(df: DataFrame, date: str, measures: dict[str, str], granularity: str = "month",
           convention: str = "dmy", sequence: list[str] | None = None) -> DataFrame:
    """``measure, period, value, records`` for measures with their aggregation.

    ``latest`` takes the newest value of a period, equal times by ``sequence``.
    """
    return _per_period(df, date, measures, granularity, convention, sequence or []).drop("_by")


def trends(points: DataFrame) -> DataFrame:
    """One row per measure of a series: change, slope, fit, recent change, direction.

    The windows hold one row per period.
    """
    by = Window.partitionBy("measure")
    placed = points.withColumns({
        "x": (F.row_number().over(by.orderBy("period")) - 1).cast("double"),
        "back": F.row_number().over(by.orderBy(F.desc("period"))), "size": F.count("*").over(by)})
    recent = F.least(F.lit(3), F.floor(F.col("size") / 2))
    facts = placed.where("size >= 2").groupBy("measure").agg(
        F.max("size").alias("periods"), F.min_by("value", "x").alias("first"), F.max_by("value", "x").alias("last"),
        F.regr_slope("value", "x").alias("slope"), F.regr_r2("value", "x").alias("r2"),
        F.avg("value").alias("average"), F.stddev_pop("value").alias("sd"),
        F.avg(F.when(F.col("back") <= recent, F.col("value"))).alias("now"),
        F.avg(F.when((F.col("back") > recent) & (F.col("back") <= recent * 2), F.col("value"))).alias("before"))
    size, average = F.abs("average"), F.col("average")
    out = facts.withColumns({
        "change": F.col("last") - F.col("first"),
        "change_percent": F.try_divide(F.col("last") - F.col("first"), F.abs("first")),
        "recent_change_percent": F.try_divide(F.col("now") - F.col("before"), F.abs("before")),
        "normalized_slope": F.when(average != 0, F.col("slope") / size),
        "volatility": F.when(average != 0, F.col("sd") / size)})
    level = F.col("normalized_slope")
    direction = F.when(level.isNull() | (F.abs(level) < 0.01), "stable").when(level > 0, "up").otherwise("down")
    confidence = F.round(clamp(F.coalesce("r2", F.lit(0.0)) * 0.55 + F.least(F.lit(0.35), F.col("periods") / 30)
                               + F.when(F.col("periods") >= 6, 0.1).otherwise(0.0)), 3)
    return out.withColumn("direction", direction).withColumn("confidence", confidence).drop(
        "average", "sd", "now", "before")


def previous_period(points: DataFrame) -> DataFrame:
    """The last period of each measure against the one before."""
    by = Window.partitionBy("measure").orderBy("period")
    pairs = points.select(
        "measure", F.col("period").alias("current_period"), F.col("value").alias("current_value"),
        F.col("records").alias("current_records"), F.lag("period").over(by).alias("previous_period"),
        F.lag("value").over(by).alias("previous_value"), F.lag("records").over(by).alias("previous_records"),
        F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("period"))).alias("_back"))
    last = pairs.where("_back = 1 AND previous_period IS NOT NULL").drop("_back")
    change = F.col("current_value") - F.col("previous_value")
    return last.withColumns({
        "absolute_change": change, "percentage_change": F.try_divide(change, F.abs("previous_value")),
        "direction": F.when(change > 0, "up").when(change < 0, "down").otherwise("stable")})


def contributors(df: DataFrame, date: str, measures: dict[str, str], dimension: str, granularity: str = "month",
                 convention: str = "dmy", sequence: list[str] | None = None, limit: int = 10) -> DataFrame:
    """``measure, dimension, current_value, previous_value, change``: the largest movers of the
    last two periods; a side without rows counts as 0."""
    key = F.when(~is_blank(F.col(dimension)), cell_text(df, dimension)).otherwise(MISSING)
    points = series(df, date, measures, granularity, convention, sequence)
    last = previous_period(points).select("measure", "current_period", "previous_period")
    cells = _per_period(df, date, measures, granularity, convention, sequence or [], key)
    two = cells.join(F.broadcast(last), "measure").where(  # one row per measure
        (F.col("period") == F.col("current_period")) | (F.col("period") == F.col("previous_period")))
    sides = two.groupBy("measure", F.col("_by").alias("dimension")).agg(
        F.coalesce(F.max(F.when(F.col("period") == F.col("current_period"), F.col("value"))), F.lit(0.0))
        .alias("current_value"),
        F.coalesce(F.max(F.when(F.col("period") == F.col("previous_period"), F.col("value"))), F.lit(0.0))
        .alias("previous_value"))
    sides = sides.withColumn("change", F.col("current_value") - F.col("previous_value"))
    window = Window.partitionBy("measure").orderBy(F.abs("change").desc(), "dimension")
    return sides.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


def compare_confidence(trend_confidence: Column) -> Column:
    """Less sure when one of the two periods has fewer than three records."""
    enough = (F.col("current_records") >= 3) & (F.col("previous_records") >= 3)
    return F.round(clamp(trend_confidence * F.when(enough, 1.0).otherwise(0.78)), 3)


# ---- associations ----------------------------------------------------------------------------

#: pairs of one aggregate; more pairs take one more pass over the (narrow) numbers for each so many
PAIRS = 120


def pair_rows(df: DataFrame, measures: list[str]) -> DataFrame:
    """``left_field, right_field, x, y`` of every row and pair: for charts of a bounded sample, not for whole tables."""
    numbers = _numbers(df, measures)
    return numbers.select(F.inline(F.array(*[
        F.struct(F.lit(measures[i]).alias("left_field"), F.lit(measures[j]).alias("right_field"), F.col(f"m{i}").alias("x"), F.col(f"m{j}").alias("y"))
        for i, j in combinations(range(len(measures)), 2)]))).where("x IS NOT NULL AND y IS NOT NULL")


def _numbers(df: DataFrame, measures: list[str]) -> DataFrame:
    return df.select(*[number_of(df, m, "analytics").alias(f"m{i}") for i, m in enumerate(measures)])


def _correlations(numbers: DataFrame, pairs: list[tuple[int, int]], names: dict[tuple[int, int], tuple[str, str]] | None = None) -> DataFrame:
    """``i, j, n, value`` of pairs of columns: their joint moments side by side in one row, whatever the number of pairs.

    A pair counts the rows that have both numbers. ``value`` is NULL without variance.
    """
    def block(part: list[tuple[int, int]]) -> DataFrame:
        parts = []
        for k, (i, j) in enumerate(part):
            x, y = (F.col(c) for c in (names[i, j] if names else (f"m{i}", f"m{j}")))
            spread_of = [F.var_pop(F.when(other.isNotNull(), one)) for one, other in ((x, y), (y, x))]
            value = F.try_divide(F.covar_pop(x, y), F.sqrt(spread_of[0] * spread_of[1]))
            parts += [F.count(x + y).alias(f"n{k}"), value.alias(f"c{k}")]
        return numbers.agg(*parts).select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"n{k}").alias("n"), F.col(f"c{k}").alias("value"))
            for k, (i, j) in enumerate(part)])))

    if not pairs:
        return numbers.sparkSession.createDataFrame([], "i int, j int, n bigint, value double")
    return reduce(DataFrame.unionByName, [block(pairs[at:at + PAIRS]) for at in range(0, len(pairs), PAIRS)])


def _named(found: DataFrame, measures: list[str], value: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m in measures])
    return found.select(F.get(names, F.col("i")).alias("left_field"), F.get(names, F.col("j")).alias("right_field"), "n",
                        F.when(F.col("n") >= 3, F.col("value")).alias(value))


def pearson(df: DataFrame, measures: list[str]) -> DataFrame:
    """``left_field, right_field, n, pearson`` of all pairs with common rows in one pass; NULL without variance."""
    found = _correlations(_numbers(df, measures), list(combinations(range(len(measures)), 2)))
    return _named(found.where("n > 0"), measures, "pearson")


def _ranked(numbers: DataFrame, places: dict[int, list[tuple[int, ...]]]) -> DataFrame:
    """The rows with ``r<i>_<k>``: the centred average rank of measure ``i`` among the rows of its ``k``-th set.

    A set names the measures that its rows have. Each measure is counted once for all its sets,
    one ordered run ranks all of them, and the rows look up each measure once.
    """
    parts, name = [], {}
    for i, sets in places.items():
        inside = [reduce(lambda a, b: a & b, [F.col(f"m{j}").isNotNull() for j in s]) for s in sets]
        counted = numbers.where(F.col(f"m{i}").isNotNull()).groupBy(F.col(f"m{i}").alias("value")).agg(
            *[F.count_if(test).alias(f"w{k}") for k, test in enumerate(inside)])
        for k in range(len(sets)):
            name[len(name)] = (i, k)
        first = len(name) - len(sets)
        parts.append(counted.select("value", F.inline(F.array(*[F.struct(F.lit(first + k).alias("g"), F.col(f"w{k}").alias("w")) for k in range(len(sets))]))))
    counts = kept(reduce(DataFrame.unionByName, parts).where("w > 0"))
    placed = running_totals(counts, [F.col("value")], {"_end": "w"}, ["g"])
    # centred on the mean (n + 1) / 2
    centred = (F.col("_end") - F.col("w") + (F.col("w") + 1) / 2) - (F.col("_end_total") + 1) / 2
    ranks = kept(placed.select("g", "value", centred.alias("r")))
    sizes = {r.g: r["count"] for r in ranks.groupBy("g").count().collect()}
    own = {i: [g for g, (j, _) in name.items() if j == i] for i in places}
    # a large table is joined by a shuffle of the rows: these come first, while the rows are narrow
    for i in sorted(places, key=lambda i: -max(sizes.get(g, 0) for g in own[i])):
        table = ranks.where(F.col("g").isin(own[i])).groupBy(F.col("value").alias(f"m{i}")).agg(
            *[F.max(F.when(F.col("g") == g, F.col("r"))).alias(f"r{i}_{name[g][1]}") for g in own[i]])
        numbers = attach(numbers, table, [f"m{i}"])
    return numbers


def spearman(df: DataFrame, measures: list[str]) -> DataFrame:
    """Rank correlation of all pairs, average ranks on ties.

    The ranks of a pair count the rows that have both numbers. Pairs with the same common rows
    share the ranks of their measures; all ranks are found in one run, and one aggregate takes
    all pairs. One row of counts, two per pair, comes to the driver.
    """
    pairs = list(combinations(range(len(measures)), 2))
    numbers = kept(_numbers(spread(df), measures))
    filled = numbers.agg(*[F.count(f"m{i}").alias(f"m{i}") for i in range(len(measures))],
                         *[F.count(F.col(f"m{i}") + F.col(f"m{j}")).alias(f"n{i}_{j}") for i, j in pairs]).first()
    both = {(i, j): filled[f"n{i}_{j}"] for i, j in pairs}
    pairs = [p for p in pairs if both[p]]
    if not pairs:
        return _named(_correlations(numbers, list(both)).where("false"), measures, "spearman")

    def covers(i: int, j: int) -> bool:
        """All rows of ``i`` have ``j``."""
        return i == j or both[min(i, j), max(i, j)] == filled[f"m{i}"]

    places: dict[int, list[tuple[int, ...]]] = {}
    names = {}
    for i, j in pairs:
        whole = next((a for a, b in ((i, j), (j, i)) if covers(a, b)), None)
        rows = (i, j) if whole is None else (next(k for k in range(len(measures)) if covers(k, whole) and covers(whole, k)),)
        for one in (i, j):
            if rows not in places.setdefault(one, []):
                places[one].append(rows)
        names[i, j] = tuple(f"r{one}_{places[one].index(rows)}" for one in (i, j))
    ranked = _ranked(numbers, places)
    if len(pairs) > PAIRS:
        ranked = kept(ranked)
    return _named(_correlations(ranked, pairs, names), measures, "spearman")


def numeric_associations(df: DataFrame, measures: list[str]) -> DataFrame:
    """Pairs with at least five rows, with strength, direction and confidence."""
    both = pearson(df, measures).join(spearman(df, measures).drop("n"), ["left_field", "right_field"])
    one, two = F.coalesce("pearson", F.lit(0.0)), F.coalesce("spearman", F.lit(0.0))
    out = both.where("n >= 5").withColumn("strength", F.greatest(F.abs(one), F.abs(two)))
    lead = F.when(one != 0, one).otherwise(two)
    return out.withColumn("direction", F.when(lead > 0, "positive").otherwise("negative")).withColumn(
        "confidence", F.round(clamp(0.45 + F.least(F.lit(0.3), F.col("n") / 1000) + F.col("strength") * 0.25), 3))


def eta_squared(df: DataFrame, categories: list[str], measures: list[str]) -> DataFrame:
    """``category_field, measure_field, n, groups, eta_squared`` for all combinations.

    One pass: the rows are grouped by each category at once, then the group means combined.
    """
    cells = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("category_field"),
                                    F.when(~is_blank(F.col(c)), cell_text(df, c)).alias("category"))
                           for c in categories])),
        *[number_of(df, m, "analytics").alias(f"m{i}") for i, m in enumerate(measures)]).where("category IS NOT NULL")
    # all measures side by side: a row is read once for each category, not for each pair
    moments = [f(f"m{i}").alias(f"{k}{i}") for i in range(len(measures)) for k, f in (("c", F.count), ("a", F.avg), ("v", F.var_pop))]
    wide = cells.groupBy("category_field", "category").agg(*moments)
    groups = wide.select("category_field", "category", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure_field"), F.col(f"c{i}").alias("c"), F.col(f"a{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, m in enumerate(measures)]))).where("c > 0")
    c, m = F.col("c"), F.col("m")
    sums = groups.groupBy("category_field", "measure_field").agg(
        F.sum("c").alias("n"), F.count("*").alias("groups"), F.sum(c * m).alias("s"), F.sum(c * m * m).alias("q"),
        F.sum(c * F.col("v")).alias("within"))
    between = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    out = sums.withColumn("between", between)
    eta = F.when(F.col("n") >= 4, F.try_divide(F.col("between"), F.col("between") + F.col("within")))
    return out.select("category_field", "measure_field", "n", "groups", eta.alias("eta_squared"))


def cramers_v(df: DataFrame, dimensions: list[str], maximum_levels: int = 50) -> DataFrame:
    """``left_field, right_field, n, rows, columns, cramers_v`` for all pairs of dimensions.

    Empty cells need no rows: chi square is n times (the sum of o^2 / (row * column) - 1).
    """
    texts = df.select(*[F.when(~is_blank(F.col(d)), cell_text(df, d)).alias(d) for d in dimensions])
    pair = ["left_field", "right_field"]
    # equal rows are merged before they are split into pairs
    joint = texts.groupBy(*[F.col(f"`{d}`") for d in dimensions]).agg(F.count("*").alias("_o"))
    cells = joint.select("_o", F.inline(F.array(*[
        F.struct(F.lit(a).alias("left_field"), F.lit(b).alias("right_field"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
        for a, b in combinations(dimensions, 2)]))).where("a IS NOT NULL AND b IS NOT NULL")
    counts = kept(cells.groupBy(*pair, "a", "b").agg(F.sum("_o").alias("o")))
    rows = counts.groupBy(*pair, "a").agg(F.sum("o").alias("r"))
    columns = counts.groupBy(*pair, "b").agg(F.sum("o").alias("c"))
    sizes = rows.groupBy(*pair).agg(F.count("*").alias("rows"), F.sum("r").alias("n")).join(
        columns.groupBy(*pair).agg(F.count("*").alias("columns")), pair)
    fit = F.col("rows").between(2, maximum_levels) & F.col("columns").between(2, maximum_levels) & (F.col("n") >= 4)
    small = sizes.where(fit)
    fitting = counts.join(F.broadcast(small.select(*pair)), pair)  # one row per pair
    parts = fitting.join(rows, [*pair, "a"]).join(columns, [*pair, "b"])
    sums = parts.groupBy(*pair).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("t"))
    value = F.sqrt(F.greatest(F.lit(0.0), F.col("t") - 1) / F.least(F.col("rows") - 1, F.col("columns") - 1))
    return sizes.join(sums, pair, "left").select(*pair, "n", "rows", "columns", value.alias("cramers_v"))


def reported(found: DataFrame, value: str) -> DataFrame:
    """Associations worth a report, strongest first, with ``strength`` and ``confidence``.

    Values from fewer than 8 rows are left out; the sample adds up to 0.25 to the confidence.
    """
    strength, n = F.col("strength"), F.col("n")
    score = clamp(F.lit(0.45) + F.least(F.lit(0.25), n / 1000) + strength * 0.3)
    kept = found.where((n >= 8) & F.col(value).isNotNull()).withColumn("strength", F.col(value))
    names = [c for c in found.columns if c.endswith("_field")]
    return kept.withColumn("confidence", F.round(score, 3)).orderBy(strength.desc(), *names)


def score_confidence(sample: Column, completeness: Column, stability: Column, effect: Column) -> Column:
    """Mean of four factors between 0 and 1; the sample counts by its magnitude up to 1000."""
    size = clamp(F.log10(F.greatest(F.lit(1), sample)) / 3)
    return F.round(clamp((size + clamp(completeness) + clamp(stability) + clamp(effect)) * 0.25), 3)


def confidence_label(score: Column) -> Column:
    return (F.when(score >= 0.85, "wysoka").when(score >= 0.65, "średnia").when(score >= 0.45, "ograniczona")
            .otherwise("niska"))
