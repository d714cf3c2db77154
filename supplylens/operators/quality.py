"""Data-quality findings, duplicates, score and the per-column quality table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.parse import number_of
from supplylens.functions.text import comparable_text, is_blank
from supplylens.operators.clean import count_duplicates, row_digest
from supplylens.operators.profile import cell_text
from supplylens.vocab import DUPLICATE_HIGH, MISSING_HIGH, MISSING_MEDIUM

SIGNED_ROLES = ["quantity", "stock", "price", "cost", "currency", "percentage", "duration"]
NEVER_NEGATIVE = ["stock", "price", "cost", "duration"]


def column_issues(roles: DataFrame) -> DataFrame:
    """``id, type, severity, column, count, ratio`` from one profile row per column."""
    def issue(name: str, test: Column, kind: str, severity: Column, count: Column, ratio: Column | None = None) -> Column:
        return F.when(test, F.struct(
            F.concat(F.lit(f"{name}-"), F.col("column")).alias("id"), F.lit(kind).alias("type"),
            severity.alias("severity"), F.col("column").alias("column"), count.cast("bigint").alias("count"),
            (ratio if ratio is not None else F.lit(None)).cast("double").alias("ratio")))

    none = F.lit(None)
    ratio = F.col("missing_ratio")
    gap = F.when(ratio >= MISSING_HIGH, "high").when(ratio >= MISSING_MEDIUM, "medium").otherwise("low")
    signed = F.col("semantic_role").isin(SIGNED_ROLES) & (F.coalesce("negative_count", F.lit(0)) > 0)
    worse = F.when(F.col("semantic_role").isin(NEVER_NEGATIVE), "high").otherwise("medium")
    issues = F.array_compact(F.array(
        issue("missing", F.col("missing_count") > 0, "missing_values", gap, F.col("missing_count"), ratio),
        issue("mixed", F.col("physical_type") == "mixed", "mixed_type", F.lit("medium"), none),
        issue("constant", F.col("is_constant"), "constant_column", F.lit("low"), none),
        issue("almost-constant", ~F.col("is_constant") & F.col("is_almost_constant"), "almost_constant_column",
              F.lit("low"), none),
        issue("partial-date", (F.col("physical_type") == "date") & (F.col("partial_date_count") > 0),
              "partial_dates", F.lit("medium"), F.col("partial_date_count")),
        issue("type", F.col("type_errors") > 0, "type_errors", F.lit("high"), F.col("type_errors")),
        issue("negative", signed, "negative_values", worse, F.col("negative_count"))))
    return roles.select(F.inline(issues))


def duplicate_issue(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """No row, or one issue with the number of excess rows and its share of all rows."""
    share = F.col("duplicate_rows") / F.greatest(F.lit(1), F.col("rows"))
    return count_duplicates(df, columns).where("duplicate_rows > 0").select(
        F.lit("duplicate-rows").alias("id"), F.lit("duplicate_rows").alias("type"),
        F.when(share >= DUPLICATE_HIGH, "high").otherwise("medium").alias("severity"),
        F.lit(None).cast("string").alias("column"), F.col("duplicate_rows").cast("bigint").alias("count"),
        share.alias("ratio"))


def duplicate_examples(df: DataFrame, columns: list[str] | None = None, k: int = 50) -> DataFrame:
    """One sample row as JSON and the number of copies for the largest groups of copies."""
    columns = columns or df.columns
    groups = df.groupBy(row_digest(columns).alias("_row")).agg(
        F.count("*").alias("copies"), F.min(F.to_json(F.struct(*columns))).alias("example"))
    return groups.where("copies > 1").orderBy(F.desc("copies"), "_row").limit(k).select("copies", "example")


def key_duplicates(df: DataFrame, columns: list[str], values: DataFrame | None = None) -> DataFrame:
    """``column, duplicate_values, rows`` for identifiers that should be unique.

    ``values`` are the distinct values of all rows with their counts, if a profile has them.
    """
    if values is not None:
        counts = values.where(F.col("column").isin(columns) & F.col("value").isNotNull() & ~is_blank(F.col("value"))).select("column", "n")
        return counts.where("n > 1").groupBy("column").agg(F.count("*").alias("duplicate_values"), F.sum("n").alias("rows"))
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), cell_text(df, c).alias("value")) for c in columns])))
    counts = cells.where(~is_blank(F.col("value"))).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.where("n > 1").groupBy("column").agg(
        F.count("*").alias("duplicate_values"), F.sum("n").alias("rows"))


def key_issues(df: DataFrame, columns: list[str], values: DataFrame | None = None) -> DataFrame:
    found = key_duplicates(df, columns, values)
    return found.select(F.concat(F.lit("business-key-"), F.col("column")).alias("id"),
                        F.lit("business_key_duplicates").alias("type"), F.lit("high").alias("severity"), "column",
                        F.col("duplicate_values").cast("bigint").alias("count"), F.lit(None).cast("double").alias("ratio"))


SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}


def severity_rank() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in SEVERITY_RANK.items() for x in p]), F.col("severity"))


def quality_audit(df: DataFrame, roles: DataFrame, columns: list[str] | None = None,
                  values: DataFrame | None = None) -> DataFrame:
    """All issues of a table, most severe first; ``values`` of a full profile save counting its keys again."""
    issues = column_issues(roles).unionByName(duplicate_issue(df, columns))
    keys = [r["column"] for r in roles.where(
        "semantic_role = 'identifier' AND expected_unique AND unique_ratio < 1 AND non_null_count > 0"
    ).select("column").collect()]  # at most one row per column
    if keys:
        issues = issues.unionByName(key_issues(df, keys, values))
    return issues.orderBy(severity_rank(), "id")


def grade(score: Column) -> Column:
    return (F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D")
            .otherwise("E"))


def quality_score(issues: DataFrame, rows: int, columns: int) -> DataFrame:
    """One row: ``score, grade`` and the counts behind it."""
    def count(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("count"))), F.lit(0))

    facts = issues.agg(
        count("missing_values").alias("missing_cells"), count("duplicate_rows").alias("duplicate_rows"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    cells = float(max(1, rows * max(1, columns)))
    penalty = (F.least(F.lit(45.0), F.col("missing_cells") / cells * 55)
               + F.least(F.lit(25.0), F.col("duplicate_rows") / float(max(1, rows)) * 80)
               + F.least(F.lit(25.0), F.col("high") * 4.0) + F.least(F.lit(15.0), F.col("medium") * 1.5))
    scored = facts.withColumn("score", F.greatest(F.lit(0), F.floor(100 - penalty + 0.5)).cast("int"))
    return scored.select("score", grade(F.col("score")).alias("grade"), "missing_cells", "duplicate_rows",
                         "high", "medium", "low")


def quality_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: empty and different (folded) values, number range and mean, % filled."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), cell_text(df, c).alias("value"), number_of(df, c).alias("number"))
        for c in columns or df.columns])))
    values = cells.groupBy("column", "value", "number").agg(F.count("*").alias("n"))
    filled = ~is_blank(F.col("value"))
    folded = values.withColumn("folded", F.when(filled, comparable_text(F.col("value"))))
    empty = F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0))
    weight = F.when(F.col("number").isNotNull(), F.col("n"))
    out = folded.groupBy("column").agg(
        empty.alias("empty"), F.count_distinct("folded").alias("different"), F.min("number").alias("minimum"),
        F.max("number").alias("maximum"),
        F.try_divide(F.sum(F.col("number") * F.col("n")), F.sum(weight)).alias("mean"), F.sum("n").alias("rows"))
    return out.withColumn("filled_percent", F.floor((1 - F.col("empty") / F.col("rows")) * 100 + 0.5).cast("int"))


def row_accounting(original: DataFrame, analyzed: DataFrame, profiles: DataFrame,
                   excluded: DataFrame | None = None) -> DataFrame:
    """``check, left, right, passed``: rows and columns add up.

    ``excluded`` are the rows that the analysis leaves out, found by what leaves them out and
    not as a difference of counts.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(1).alias("_one"), F.count("*").alias(name))

    left_out = original.limit(0) if excluded is None else excluded
    counts = (count(original, "o").join(count(analyzed, "a"), "_one").join(count(profiles, "p"), "_one")
              .join(count(left_out, "x"), "_one"))
    total = F.col("a") + F.col("x")
    columns = F.lit(len(analyzed.columns)).cast("bigint")
    return counts.select(F.inline(F.array(
        F.struct(F.lit("rows").alias("check"), F.col("o").alias("left"),
                 total.alias("right"), (F.col("o") == total).alias("passed")),
        F.struct(F.lit("columns").alias("check"), columns.alias("left"), F.col("p").alias("right"),
                 (columns == F.col("p")).alias("passed")))))
