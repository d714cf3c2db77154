"""The automatic analysis of one table: all results under their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.functions.dates import granularity_for
from supplylens.functions.parse import date_of
from supplylens.operators import domain as dom
from supplylens.operators import pivot, quality, stats
from supplylens.operators.filters import sample_rows
from supplylens.operators.profile import describe, fingerprint, primary_fields, profile, semantic_roles
from supplylens.plans import findings
from supplylens.session import checkpointed, kept

DIMENSION_RANK = {"material": 7, "category": 6, "brand": 5, "supplier": 4, "location": 3, "status": 2, "boolean": 1}


def auto_pivots(roles: list, date: str | None, measure: str | None, granularity: str = "month",
                maximum: int = 6) -> list[dict]:
    """Up to six recommended pivots from one profile row per column."""
    dimensions = [r for r in roles if r["analytical_role"] == "dimension" and 2 <= r["unique_count"] <= 500]
    measures = [r for r in roles if r["analytical_role"] == "measure" and (r["numeric_count"] or 0) > 0]
    dimensions.sort(key=lambda r: (-DIMENSION_RANK.get(r["semantic_role"], 0), r["unique_count"]))
    main = next((r for r in measures if r["column"] == measure), measures[0] if measures else None)

    def value(row) -> dict:
        agg = stats.aggregation_for(row["semantic_role"])
        if agg == "latest" and not date:
            agg = "average"
        return {"value": row["column"], "agg": agg, "order_by": date if agg == "latest" else None}

    found = []
    if main and dimensions:
        found.append({"id": "pivot-primary-dimension", "row": dimensions[0]["column"], "column": None, **value(main)})
        if date:
            found.append({"id": "pivot-time-dimension", "row": dimensions[0]["column"], "column": date,
                          "granularity": granularity, **value(main)})
    if main:
        found += [{"id": f"pivot-dimension-{i}", "row": d["column"], "column": None, **value(main)}
                  for i, d in enumerate(dimensions[1:4], start=2)]
    if len(measures) > 1 and dimensions:
        found.append({"id": "pivot-secondary-measure", "row": dimensions[0]["column"], "column": None,
                      **value(measures[1])})
    return found[:maximum]


def analyze(df: DataFrame, order: list[str], fields: list[str] | None = None, mode: str = "full",
            associations_sample: int | None = None, maximum_findings: int = 300,
            maximum_pivot_rows: int = 100, maximum_measures: int | None = None, maximum_dimensions: int | None = None,
            maximum_levels: int = 50) -> dict[str, DataFrame]:
    """Run every stage on one table; returns named DataFrames.

    ``order`` columns identify a row and give the source order. The rows are written once, so
    that each stage reads only its columns and no join or parse before them is done again. The
    driver reads only the profile, one row per column, to choose fields. Associations use all rows unless a sample
    size is given, and all measures and all dimensions of up to ``maximum_levels`` values unless
    a maximum is given.
    """
    fields = fields or [c for c in df.columns if not c.startswith("source_")]
    source = rows = kept(df)
    raw = dom.classify_raw(source, fields)
    if raw["domain"] == "hierarchical_delivery_plan":
        rows = kept(dom.prepare_hierarchy(source, raw["material"], order, fields).drop("filled_down"))
    profiled = profile(rows, fields, mode, key=order)
    roles = semantic_roles(profiled.columns)
    table = sorted(roles.collect(), key=lambda r: r["position"])  # one row per column
    size = table[0]["row_count"] if table else 0
    domain = dom.refine_domain(raw, {r["business_role"] for r in table})
    chosen = primary_fields(roles)
    date, dimension = chosen["date"], chosen["dimension"]
    convention = next((r["date_convention"] or "dmy" for r in table if r["column"] == date), "dmy")
    results = {"profile": roles, "histograms": profiled.histogram(), "fingerprint": fingerprint(rows, fields),
               **{f"describe_{k}": v for k, v in describe(profiled, roles).items()}}

    issues = checkpointed(quality.quality_audit(rows, roles, fields))
    score = quality.quality_score(issues, size, len(fields))
    results |= {"issues": issues, "quality": score, "type_errors": profiled.type_error_examples()}
    parts = [findings.quality_findings(score, issues)]

    measures = [r for r in table if r["analytical_role"] == "measure"]
    measured = [r["column"] for r in measures if (r["numeric_count"] or 0) >= 8]
    if measured:
        found = checkpointed(stats.outliers(rows, measured, order, dimension))
        results["outliers"] = stats.top_findings(found, order, maximum_findings)
        results["outlier_summary"] = stats.outlier_summary(found)
        parts.append(findings.outlier_findings(results["outlier_summary"]))

    granularity, line, movers, trend = "month", None, None, None
    dated = sorted((r for r in measures if (r["numeric_count"] or 0) >= 3), key=lambda r: -r["numeric_count"])[:maximum_measures]
    if date and dated:
        day = date_of(rows, date, "analytics", convention)
        granularity = rows.agg(granularity_for(F.min(day), F.max(day)).alias("g")).first()["g"]
        how = {r["column"]: stats.aggregation_for(r["semantic_role"]) for r in dated}
        line = checkpointed(stats.series(rows, date, how, granularity, convention, order))
        trend = checkpointed(stats.trends(line))
        compared = stats.previous_period(line).join(
            trend.select("measure", F.col("confidence").alias("trend_confidence")), "measure")
        compared = compared.withColumn("confidence", stats.compare_confidence(F.col("trend_confidence")))
        results |= {"series": line, "trends": trend, "period_comparison": compared}
        parts += [findings.trend_findings(trend), findings.period_findings(compared)]
        if dimension:
            movers = stats.contributors(rows, date, how, dimension, granularity, convention, order)
            results["contributors"] = movers

    sampled = sample_rows(rows, associations_sample, order) if associations_sample else rows
    numeric = [r["column"] for r in sorted((r for r in measures if (r["numeric_count"] or 0) >= 5),
                                           key=lambda r: -r["numeric_count"])[:maximum_measures]]
    dimensions = [r["column"] for r in sorted(
        (r for r in table if r["analytical_role"] == "dimension" and 2 <= r["unique_count"] <= maximum_levels),
        key=lambda r: r["unique_count"])[:maximum_dimensions]]
    pairs = None
    if len(numeric) > 1:
        pairs = checkpointed(stats.numeric_associations(sampled, numeric))
        results["correlations"] = pairs
        parts.append(findings.correlation_findings(pairs))
    if numeric and dimensions:
        results["category_measure"] = stats.reported(stats.eta_squared(sampled, dimensions, numeric), "eta_squared")
    if len(dimensions) > 1:
        results["category_pairs"] = stats.reported(stats.cramers_v(sampled, dimensions), "cramers_v")

    ranking = None
    for spec in auto_pivots(table, date, chosen["measure"], granularity):
        name = spec.pop("id")
        cells = pivot.pivot_summary(rows, spec["row"], spec["column"], spec["value"], spec["agg"], maximum_pivot_rows,
                                    granularity=spec.get("granularity"), order_by=spec["order_by"], sequence=order,
                                    convention=convention)
        results[name] = cells
        if ranking is None:
            ranking = cells.select("row_key", "total_value").distinct()

    role_of = {r["business_role"]: r["column"] for r in reversed(table)}
    if domain["domain"] in ("delivery_tracking", "hierarchical_delivery_plan"):
        names = {"ordered": "ordered_quantity", "delivered": "delivered_quantity", "remaining": "remaining_quantity",
                 "order": "order_id", "document": "document_id", "ordered_pallets": "pallet_count",
                 "delivered_pallets": "delivered_pallet_count", "remaining_pallets": "remaining_pallet_count"}
        figures = dom.delivery_kpis(rows, {k: role_of[v] for k, v in names.items() if v in role_of})
        results["domain_kpis"] = figures
        picked = {k: role_of[v] for k, v in names.items() if v in role_of}
        results["domain_details"] = dom.delivery_details(rows, picked, order)
        groups = {"suppliers": "supplier", "brands": "brand", "materials": "material_name"}
        if "ordered" in picked and any(v in role_of for v in groups.values()):
            results["domain_rankings"] = dom.rankings(rows, {k: role_of[v] for k, v in groups.items() if v in role_of}, picked["ordered"])
        parts.append(findings.delivery_findings(figures))
    elif domain["domain"] == "procurement_plan" and {"ordered_quantity", "transport_date", "planned_delivery_date"} <= set(role_of):
        names = {"ordered": "ordered_quantity", "order": "order_id", "product": "product_code", "supplier": "supplier",
                 "transport": "transport_date", "on_site": "planned_delivery_date"}
        if "product_code" not in role_of:
            names["product"] = "material_name"
        by_column = {r["column"]: r["date_convention"] or "dmy" for r in table}
        picked = {k: role_of[v] for k, v in names.items() if v in role_of}
        figures = dom.procurement_kpis(rows, picked, {k: by_column[picked[k]] for k in ("transport", "on_site")})
        results["domain_kpis"] = figures
        results["domain_details"] = dom.procurement_details(rows, picked, order, {k: by_column[picked[k]] for k in ("transport", "on_site")})
        groups = {k: picked[v] for k, v in (("suppliers", "supplier"), ("products", "product")) if v in picked}
        if groups:
            results["domain_rankings"] = dom.rankings(rows, groups, picked["ordered"])
        parts.append(findings.procurement_findings(figures))

    spark = df.sparkSession
    results["domain"] = spark.range(1).select(F.lit(domain["domain"]).alias("domain"),
                                              F.lit(float(domain["confidence"])).alias("confidence"))
    results["insights"] = findings.insights(parts, domain["domain"])
    first_measure = measured[0] if measured else None
    scatter = stats.pair_rows(sampled, numeric) if len(numeric) > 1 else None
    bars = results["histograms"].where(F.col("column") == first_measure) if first_measure else None
    if any(x is not None for x in (line, ranking, pairs, bars, movers)):
        top = None
        if movers is not None:
            best = trend.orderBy(F.desc("confidence"), "measure").limit(1).select("measure")
            top = movers.join(F.broadcast(best), "measure", "left_semi")
        results["charts"] = findings.chart_datasets(line, trend, ranking, pairs, scatter, bars, top)
    left_out = None if rows is source else source.join(rows.select(*order), order, "left_anti")
    results["checks"] = quality.row_accounting(source, rows.select(*fields), roles, left_out)
    return results
