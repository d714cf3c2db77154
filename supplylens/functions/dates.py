"""Calendar fields, Polish seasons and period keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the calendar fields.
MONTHS = ["Styczeń", "Luty", "Marzec", "Kwiecień", "Maj", "Czerwiec",
          "Lipiec", "Sierpień", "Wrzesień", "Październik", "Listopad", "Grudzień"]
WEEKDAYS = ["Poniedziałek", "Wtorek", "Środa", "Czwartek", "Piątek", "Sobota", "Niedziela"]
SEASONS = ["Zima", "Wiosna", "Lato", "Jesień"]

DATE_FIELDS = ["year", "quarter", "month", "month_number", "month_key", "week", "week_key",
               "weekday", "weekday_number", "day", "season", "season_period",
               "season_start_year", "season_order", "season_sort_key", "is_weekend", "hour", "time"]


def _label(names: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in names]), number - 1)


def week_key(date: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def season(date: Column) -> Column:
    return _label(SEASONS, F.floor((F.month(date) % 12) / 3).cast("int") + 1)


def season_period(date: Column) -> dict[str, Column]:
    """The continuous season a day lies in; a winter starts in December."""
    year, month = F.year(date), F.month(date)
    start = F.when(month <= 2, year - 1).otherwise(year)
    order = F.when((month == 12) | (month <= 2), 4).otherwise(F.floor(month / 3).cast("int"))
    label = F.concat(season(date), F.lit(" "), start.cast("string"),
                     F.when(order == 4, F.concat(F.lit("/"), (start + 1).cast("string"))).otherwise(""))
    return {"season_period": label, "season_start_year": start, "season_order": order,
            "season_sort_key": start * 10 + order}


def date_fields(stamp: Column) -> dict[str, Column]:
    date = stamp.cast("date")
    weekday = F.weekday(date) + 1
    return {
        "year": F.year(date),
        "quarter": F.concat(F.lit("Q"), F.quarter(date).cast("string")),
        "month": _label(MONTHS, F.month(date)),
        "month_number": F.month(date),
        "month_key": F.date_format(date, "yyyy-MM"),
        "week": F.weekofyear(date),
        "week_key": week_key(date),
        "weekday": _label(WEEKDAYS, weekday),
        "weekday_number": weekday,
        "day": F.dayofmonth(date),
        "season": season(date),
        **season_period(date),
        "is_weekend": weekday >= 6,
        "hour": F.hour(stamp),
        "time": F.date_format(stamp, "HH:mm"),
    }


def derive_date_fields(df: DataFrame, column: str = "date") -> DataFrame:
    """Add the 18 calendar fields; all NULL where the date is NULL."""
    return df.withColumns(date_fields(F.col(column)))


def period_key(date: Column, granularity: str = "month") -> Column:
    if granularity == "day":
        return F.date_format(date, "yyyy-MM-dd")
    if granularity == "week":
        return week_key(date)
    if granularity == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))
    if granularity == "year":
        return F.year(date).cast("string")
    return F.date_format(date, "yyyy-MM")


def granularity_for(first: Column, last: Column) -> Column:
    days = F.greatest(F.lit(1), F.datediff(last, first))
    choice = F.when(days <= 62, "day").when(days <= 240, "week").when(days <= 1460, "month")
    return F.when(first.isNull() | last.isNull(), "month").otherwise(choice.otherwise("quarter"))


def date_range(df: DataFrame, column: str) -> DataFrame:
    """One row: ``minimum, maximum, days`` (inclusive) and the fitting ``granularity``."""
    day = F.col(column).cast("date")
    span = df.agg(F.min(day).alias("minimum"), F.max(day).alias("maximum"))
    return span.select(
        "minimum", "maximum",
        F.greatest(F.lit(1), F.datediff("maximum", "minimum") + 1).alias("days"),
        granularity_for(F.col("minimum"), F.col("maximum")).alias("granularity"))
