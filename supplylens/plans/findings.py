"""Findings and chart data from the results of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.operators.filters import sample_rows
from supplylens.operators.quality import severity_rank
from supplylens.operators.stats import clamp
from supplylens.vocab import (
    CORRELATION_CHART, CORRELATION_SHOWN, CORRELATION_STRONG, DELIVERY_DOMAINS, PERIOD_CHANGE, TREND_HIGH,
    TREND_MEDIUM, TREND_STABLE,
)

FIELDS = ["id", "type", "severity", "subject", "value", "confidence"]


def _finding(df: DataFrame, id_: Column, kind: str, severity: Column, subject: Column, value: Column,
             confidence: Column) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(kind).alias("type"), severity.alias("severity"),
                     subject.cast("string").alias("subject"), value.cast("double").alias("value"),
                     confidence.cast("double").alias("confidence"))


def _first(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a short table, numbered from 0."""
    short = df.orderBy(*order).limit(k)
    return short.withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)


def quality_findings(score: DataFrame, issues: DataFrame) -> DataFrame:
    level = F.when(F.col("score") < 65, "high").when(F.col("score") < 85, "medium").otherwise("low")
    head = _finding(score, F.lit("insight-quality-score"), "quality", level, F.col("grade"), F.col("score"), F.lit(0.98))
    first = _first(issues, [severity_rank(), F.col("id")], 5)
    return head.unionByName(_finding(
        first, F.concat(F.lit("insight-quality-"), F.col("_place")), "quality_issue", F.col("severity"),
        F.coalesce("column", "type"), F.col("count"), F.lit(0.95)))


def trend_findings(trends: DataFrame) -> DataFrame:
    first = _first(trends, [F.desc("confidence"), F.col("measure")], 5)
    change = F.when(F.col("change_percent") != 0, F.col("change_percent"))
    size = F.abs(F.coalesce(change, "normalized_slope", F.lit(0.0)))
    shown = first.withColumn("_size", size).where(~((F.col("_size") < TREND_STABLE) & (F.col("direction") == "stable")))
    level = F.when(F.col("_size") >= TREND_HIGH, "high").when(F.col("_size") >= TREND_MEDIUM, "medium").otherwise("low")
    return _finding(shown, F.concat(F.lit("insight-trend-"), F.col("_place")), "trend", level, F.col("measure"),
                    F.col("change_percent"), F.col("confidence"))


def period_findings(comparisons: DataFrame) -> DataFrame:
    first = _first(comparisons, [F.desc("trend_confidence"), F.col("measure")], 5)
    shown = first.where(F.abs("percentage_change") >= PERIOD_CHANGE)
    level = F.when(F.abs("percentage_change") >= TREND_HIGH, "high").otherwise("medium")
    return _finding(shown, F.concat(F.lit("insight-period-"), F.col("_place")), "period_change", level,
                    F.col("measure"), F.col("percentage_change"), F.col("confidence"))


def outlier_findings(summary: DataFrame) -> DataFrame:
    level = F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("low")
    return _finding(summary.where("total > 0"), F.lit("insight-outliers"), "anomaly", level, F.lit("outliers"),
                    F.col("total"), F.lit(0.88))


def correlation_findings(pairs: DataFrame) -> DataFrame:
    best = pairs.orderBy(F.desc("strength"), "left_field", "right_field").limit(1).where(
        F.col("strength") >= CORRELATION_SHOWN)
    level = F.when(F.col("strength") >= CORRELATION_STRONG, "medium").otherwise("low")
    return _finding(best, F.lit("insight-correlation"), "correlation", level,
                    F.concat_ws(" / ", "left_field", "right_field"), F.col("strength"), F.col("confidence"))


def delivery_findings(kpis: DataFrame) -> DataFrame:
    """Completion, and one finding per control that found something."""
    done = F.col("completion")
    level = F.when(done < 0.8, "high").when(done < 0.98, "medium").otherwise("low")
    head = _finding(kpis.where("completion IS NOT NULL"), F.lit("domain-delivery-completion"), "delivery", level,
                    F.lit("completion"), done, F.lit(0.96))
    controls = ["invalid_numbers", "inconsistent", "over_delivered", "missing_documents"]
    found = F.filter(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).cast("double").alias("value"))
                               for c in controls]), lambda x: x["value"] > 0)
    rows = kpis.select(F.posexplode(found).alias("_place", "_c"))
    level = F.when(F.col("_place") == 0, "medium").otherwise("high")
    return head.unionByName(_finding(rows, F.concat(F.lit("domain-delivery-warning-"), F.col("_place")),
                                     "delivery_control", level, F.col("_c.subject"), F.col("_c.value"), F.lit(0.95)))


def procurement_findings(kpis: DataFrame) -> DataFrame:
    head = _finding(kpis, F.lit("domain-procurement-scope"), "procurement", F.lit("low"), F.lit("orders"),
                    F.col("orders"), F.lit(0.97))
    controls = ["invalid_numbers", "week_only", "lead_negative"]
    found = F.filter(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).cast("double").alias("value"))
                               for c in controls]), lambda x: x["value"] > 0)
    rows = kpis.select(F.posexplode(found).alias("_place", "_c"))
    level = F.when(F.col("_place") == 0, "medium").otherwise("high")
    return head.unionByName(_finding(rows, F.concat(F.lit("domain-procurement-warning-"), F.col("_place")),
                                     "procurement_control", level, F.col("_c.subject"), F.col("_c.value"), F.lit(0.95)))


def insights(parts: list[DataFrame], domain: str = "generic") -> DataFrame:
    """All findings, most severe and most certain first; delivery data shows no trends."""
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    if domain in DELIVERY_DOMAINS:
        together = together.where(~F.col("type").isin("trend", "period_change"))
    return together.orderBy(severity_rank(), F.desc("confidence"), "id")


def scatter_sample(dots: DataFrame, n: int = 250) -> DataFrame:
    """``n`` of the points ``x, y``, the same ones each time: every cell of a 16 by 16 grid over the plane keeps its share."""
    low_x, high_x, low_y, high_y = dots.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()

    def digit(value: Column, low: float | None, high: float | None) -> Column:
        if low is None or low == high:
            return F.lit("0")
        cell = F.least(F.lit(15), F.floor((value - F.lit(low)) / F.lit(high - low) * 16))
        return F.lower(F.hex(cell.cast("bigint")))

    digest = F.concat(digit(F.col("x"), low_x, high_x), digit(F.col("y"), low_y, high_y), F.md5(F.concat_ws("|", F.col("x").cast("string"), F.col("y").cast("string"))))
    return sample_rows(dots.select("x", "y"), n, digest=digest)


def chart_datasets(points: DataFrame | None = None, trends: DataFrame | None = None, ranking: DataFrame | None = None,
                   pairs: DataFrame | None = None, scatter: DataFrame | None = None,
                   histogram: DataFrame | None = None, movers: DataFrame | None = None) -> DataFrame:
    """``chart, kind, place, label, x, y``: line, ranked bars, scatter, histogram, movers."""
    none = F.lit(None).cast("double")
    parts = []

    def add(df: DataFrame, chart: str, kind: Column, place: Column, label: Column, x: Column, y: Column) -> None:
        parts.append(df.select(F.lit(chart).alias("chart"), kind.alias("kind"), place.cast("int").alias("place"),
                               label.cast("string").alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y")))

    if points is not None and trends is not None:
        best = trends.orderBy(F.desc("confidence"), "measure").limit(1).select("measure")
        line = points.join(F.broadcast(best), "measure", "left_semi")
        add(line, "chart-primary-trend", F.lit("line"), F.row_number().over(Window.orderBy("period")),
            F.col("period"), none, F.col("value"))
    if ranking is not None:  # row_key, total_value
        order = [F.abs(F.coalesce("total_value", F.lit(0.0))).desc(), F.col("row_key")]
        bars = _first(ranking, order, 20)
        many = F.count("*").over(Window.partitionBy()) >= 9  # of at most 20 bars
        add(bars, "chart-primary-ranking", F.when(many, "bar-horizontal").otherwise("bar"), F.col("_place") + 1,
            F.col("row_key"), none, F.col("total_value"))
    if pairs is not None and scatter is not None:  # scatter: left_field, right_field, x, y
        best = pairs.orderBy(F.desc("strength"), "left_field", "right_field").limit(1).where(
            F.col("strength") >= CORRELATION_CHART).select("left_field", "right_field")
        dots = scatter.join(F.broadcast(best), ["left_field", "right_field"], "left_semi")
        add(scatter_sample(dots), "chart-correlation", F.lit("scatter"), F.lit(0), F.lit(""), F.col("x"), F.col("y"))
    if histogram is not None:
        label = F.concat(F.round("from", 2).cast("string"), F.lit("–"), F.round("to", 2).cast("string"))
        add(histogram, "chart-distribution", F.lit("histogram"), F.col("bin") + 1, label, F.col("from"), F.col("count"))
    if movers is not None:
        add(movers.where("place <= 12"), "chart-change-contributors", F.lit("bar-horizontal"), F.col("place"),
            F.col("dimension"), none, F.col("change"))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


__all__ = ["FIELDS", "chart_datasets", "clamp", "correlation_findings", "delivery_findings", "insights",
           "outlier_findings", "period_findings", "procurement_findings", "quality_findings", "trend_findings"]
