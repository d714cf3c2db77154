"""Catalogues of many tables: what each one is, its role, and how tables relate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.text import analytics_text, comparable_text, normalize_label
from supplylens.operators.mapping import role_fields
from supplylens.operators.profile import cell_text
from supplylens.vocab import IDENTITY_FIELDS, ROLE_NAME_WORDS, ROLE_PRIMARY_WORDS, ROLE_THRESHOLDS

# Words in column names behind the table scores.
TABLE_SIGNALS = {
    "date": ["delivery date", "transport date", "on site date", "data dostaw", "data rozlad"],
    "order": ["ord req", "order number", "numer zamow", "planning category"],
    "product": ["article", "artykul", "material", "product name", "product number"],
    "ordered": ["qty ordered", "ord qty", "ordered qty", "zamowion"],
    "delivered": ["rozladowan", "^qty$", "delivered"],
    "remaining": ["pozostal", "remaining"],
    "supplier": ["supplier", "dostawc", "vendor"],
    "carrier": ["przewoz", "carrier"],
    "transport": ["transport date"], "on_site": ["on site date"], "document": ["wz"],
    "summary": ["sum of", "row labels", "column labels", "grand total", "suma", "razem"],
}
# Points of a signal per kind of table.
TABLE_SCORES = {
    "delivery_tracking": {"product": 2.0, "ordered": 2.0, "date": 1.5, "order": 1.5, "delivered": 2.0,
                          "remaining": 1.5, "supplier": 0.5},
    "procurement_plan": {"product": 2.0, "ordered": 2.0, "order": 1.0, "supplier": 1.0, "plan_dates": 3.0},
    "unloading_events": {"order": 1.5, "carrier": 2.0, "date": 2.0, "delivered": 1.0},
}


def classify_tables(catalog: DataFrame) -> DataFrame:
    """Add ``type``, the scores, ``usefulness`` and ``recommended`` to a table catalogue.

    The catalogue has one row per table: ``name, position, headers, row_count, header_row``
    (from 0), ``density`` (filled share) and ``blank_first`` (share of blank first cells).
    """
    labels = F.filter(F.transform("headers", normalize_label), lambda h: h != "")
    rows = catalog.withColumn("_labels", labels).withColumn("_name", normalize_label(F.col("name")))

    def signal(patterns: list[str]) -> Column:
        return F.exists("_labels", lambda h: h.rlike("|".join(patterns)))

    rows = rows.withColumns({f"_{s}": signal(patterns) for s, patterns in TABLE_SIGNALS.items()})
    rows = rows.withColumn("_plan_dates", F.col("_transport") & F.col("_on_site"))

    def points(flag: Column, value: float) -> Column:
        return F.when(flag, value).otherwise(0.0)

    scores = {kind: sum((points(F.col(f"_{s}"), v) for s, v in parts.items()), F.lit(0.0))
              for kind, parts in TABLE_SCORES.items()}
    scores["summary"] = (points(F.col("_summary"), 4.0) + points(F.col("header_row") > 0, 1.0)
                         + points(F.col("row_count") <= 20, 1.0))
    scores["generic_table"] = points(F.col("row_count") > 0, 1.0)
    rows = rows.withColumns({f"score_{k}": c for k, c in scores.items()})
    kinds = list(scores)
    best = F.array_max(F.array(*[F.struct(F.col(f"score_{k}").alias("s"), F.lit(-i).alias("p"), F.lit(k).alias("k"))
                                 for i, k in enumerate(kinds)]))["k"]
    archive = F.col("_name").rlike(r"(^|\s)(old|archive|archiw|kopia)(\s|$)|^old")
    helper = F.col("_name").rlike(r"sheet\d*|arkusz\d*") & (F.col("row_count") < 30)
    delivery, procurement = F.col("score_delivery_tracking"), F.col("score_procurement_plan")
    kind = (F.when(F.col("row_count").isNull() | (F.size("headers") == 0), "empty").when(archive, "archive")
            .when(helper & (F.col("score_summary") >= 2), "summary")
            .when(F.col("_product") & F.col("_ordered") & F.col("_date") & (F.col("blank_first") > 0.5)
                  & F.col("_document"), "hierarchical_delivery_plan")
            .when((procurement >= delivery) & (procurement >= 6), "procurement_plan")
            .when(delivery >= 7, "delivery_tracking").when(F.col("score_unloading_events") >= 4.5, "unloading_events")
            .when(F.col("score_summary") >= 4, "summary").otherwise(best))
    rows = rows.withColumn("type", kind)
    bonus = (F.when(F.col("type") == "delivery_tracking", F.when(F.col("position") == 0, 38.0).otherwise(34.0))
             .when(F.col("type") == "procurement_plan", 18.0).when(F.col("type") == "unloading_events", 10.0)
             .when(F.col("type") == "archive", -35.0).when(F.col("type").isin("summary", "empty"), -22.0).otherwise(0.0))
    aside = F.when(F.col("_name").rlike("na potrzeby|pomoc|helper|roboczy"), 20.0).otherwise(0.0)
    value = (F.log10(F.greatest(F.lit(1), F.col("row_count")) + 1) * 8 + F.size("headers") * 0.35
             + F.col("density") * 8 + bonus - aside)
    rows = rows.withColumn("usefulness", F.when(F.col("type") == "empty", -100.0).otherwise(value))
    return rows.select(*catalog.columns, "type", *[f"score_{k}" for k in kinds], "usefulness")


def recommended_table(classified: DataFrame) -> DataFrame:
    """One row: the most useful table that is neither a summary, a copy nor empty."""
    usable = F.col("row_count") > 0
    regular = usable & ~F.col("type").isin("summary", "archive", "empty")
    place = F.struct(regular.cast("int"), "usefulness", -F.col("position"))
    best = F.max_by(F.struct("name", "type", "usefulness"), F.when(usable, place))
    return classified.agg(best.alias("best")).select("best.name", "best.type", "best.usefulness")


def header_jaccard(left: Column, right: Column) -> Column:
    a, b = (F.filter(F.transform(x, normalize_label), lambda h: h != "") for x in (left, right))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def row_signatures(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct digests of the cells of each row that is not empty."""
    text = F.concat_ws("␟", *[F.nullif(analytics_text(cell_text(df, c)), F.lit("")) for c in columns])
    return df.select(text.alias("t")).where("t != ''").select(F.sha2("t", 256).alias("signature")).distinct()


def overlap(left: DataFrame, right: DataFrame, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """One row: header similarity, share of equal rows over the smaller side, and an alert."""
    a, b = row_signatures(left, left_columns), row_signatures(right, right_columns)
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "signature", "full")
    counts = sides.agg(F.count("l").alias("left_rows"), F.count("r").alias("right_rows"),
                       F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"))
    share = F.coalesce(F.try_divide("common", F.least("left_rows", "right_rows")), F.lit(0.0))
    names = [F.array(*[F.lit(c) for c in cols]) for cols in (left_columns, right_columns)]
    out = counts.withColumn("overlap", share).withColumn("header_similarity", header_jaccard(*names))
    return out.withColumn("similar", (F.col("header_similarity") >= 0.72) | (F.col("overlap") >= 0.55))


def key_coverage(left: DataFrame, right: DataFrame, left_column: str, right_column: str, left_type: str = "",
                 right_type: str = "") -> DataFrame:
    """One row: shared values, coverage of the smaller side, relation type and confidence."""
    def values(df: DataFrame, column: str) -> DataFrame:
        return df.select(normalize_label(cell_text(df, column)).alias("v")).where("v != ''").distinct()

    both = values(left, left_column).withColumn("l", F.lit(1)).join(
        values(right, right_column).withColumn("r", F.lit(1)), "v", "full")
    counts = both.agg(F.count("l").alias("left_values"), F.count("r").alias("right_values"),
                      F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common_values"))
    coverage = F.col("common_values") / F.greatest(F.lit(1), F.least("left_values", "right_values"))
    planned = {left_type, right_type} == {"procurement_plan", "delivery_tracking"}
    confidence = F.least(F.lit(0.98), 0.65 + coverage * 0.25 + F.least(F.lit(0.08), F.col("common_values") / 100))
    return counts.withColumns({
        "coverage": coverage, "relation_type": F.lit("planned_vs_actual" if planned else "candidate_join"),
        "confidence": confidence})


ORDER_HEADER = r"(?:^| )(?:order number|ord req number|numer zamowienia|nr zamowienia)(?: |$)"
PRODUCT_HEADER = r"(?:^| )(?:article|artykul|material|product name|product number)(?: |$)"


def related_columns(left: list[str], right: list[str]) -> list[tuple[str, str, str]]:
    """Pairs of order or product columns of two tables, from their names."""
    import re

    from supplylens.operators.domain import column_label
    pairs = []
    for a in left:
        for b in right:
            for kind, pattern in (("order", ORDER_HEADER), ("product", PRODUCT_HEADER)):
                if re.search(pattern, column_label(a)) and re.search(pattern, column_label(b)):
                    pairs.append((a, b, kind))
                    break
    return pairs


# ---- roles ---------------------------------------------------------------------------------

def role_scores(catalog: DataFrame, headers: DataFrame) -> DataFrame:
    """``name, position, role, score`` of every table for every role.

    ``headers`` lists ``name, header, position, type`` of the catalogue's tables.
    """
    wanted = {
        "usage": {"date": 2.0, "identity": 2.0, "quantity": 3.0},
        "stock": {"identity": 2.0, "stock_level": 4.0},
        "receipts": {"identity": 2.0, "quantity": 2.0, "date": 2.0},
        "orders": {"identity": 2.0, "open_orders": 3.0},
        "master": {"identity": 2.0, "material_code": 1.0, "sku": 1.0, "unit": 1.0, "supplier": 1.0,
                   "lead_time_days": 1.0},
    }
    folded = catalog.select("name", "position", comparable_text(F.col("name")).alias("_name"))
    # a role has at most a dozen fields
    rows = folded.join(role_fields(headers, ["name"], list(wanted)), "name", "left")
    parts = []
    for role, points in wanted.items():
        has = F.coalesce(role, F.array().cast("array<string>"))
        score = F.when(F.col("_name").rlike(ROLE_NAME_WORDS[role]), 2.0).otherwise(0.0)
        for field, value in points.items():
            test = F.arrays_overlap(has, F.array(*[F.lit(f) for f in IDENTITY_FIELDS])) if field == "identity" \
                else F.array_contains(has, field)
            score = score + F.when(test, value).otherwise(0.0)
        parts.append(F.struct(F.lit(role).alias("role"), score.alias("score")))
    return rows.select("name", "position", F.inline(F.array(*parts)))


def assign_roles(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``name, role``: one primary table per role first, then clear cases by margin.

    ``scores`` holds the eligible tables; with ``group`` columns several workbooks are
    assigned at once. A workbook has few tables, each with five scores.
    """
    group = group or []
    roles = list(ROLE_THRESHOLDS)
    wide = scores.groupBy(*group, "name", "position").pivot("role", roles).agg(F.first("score"))
    primary = Window.partitionBy(*group)
    wide = wide.withColumn("assigned", F.lit(None).cast("string"))
    for role in roles:
        words = ROLE_PRIMARY_WORDS.get(role)
        free = F.col("assigned").isNull() & (F.col("name").rlike(f"(?i){words}") if words else F.lit(True))
        best = F.max(F.when(free, F.struct(F.col(role).alias("s"), (-F.col("position")).alias("p")))).over(primary)
        chosen = free & (best["p"] == -F.col("position")) & (best["s"] >= ROLE_THRESHOLDS[role])
        wide = wide.withColumn("assigned", F.when(chosen, role).otherwise(F.col("assigned")))
    ranked = F.reverse(F.array_sort(F.array(*[
        F.struct(F.col(r).alias("s"), F.lit(-i).alias("p"), F.lit(r).alias("r")) for i, r in enumerate(roles)])))
    bound = F.element_at(F.create_map(*[F.lit(x) for p in ROLE_THRESHOLDS.items() for x in p]), ranked[0]["r"])
    clear = (ranked[0]["s"] >= bound) & (ranked[0]["s"] - ranked[1]["s"] >= 1.5)
    return wide.select(*group, "name", F.coalesce("assigned", F.when(clear, ranked[0]["r"]), F.lit("ignore")).alias("role"))
