"""Source columns to fields: explicit mappings and header matching for many tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.text import is_blank
from supplylens.plans.ordered import attach
from supplylens.sources.grid import fold_name, header_table
from supplylens.vocab import (
    FIELD_IDS, IDENTITY_FIELDS, MATCH_THRESHOLD, REQUIRED_FIELDS, ROLE_FIELDS, ROLE_MATCH_THRESHOLD,
    SYSTEM_FIELDS,
)


def check_mapping(columns: list[str], mapping: dict[str, str], required: list[str]) -> None:
    """Refuse a mapping with a missing field, an unknown source or a source used twice."""
    sources = [s for s in mapping.values() if s]
    problems = [f"field {f} is not mapped" for f in required if not mapping.get(f)]
    problems += [f"no column {s}" for s in sources if s not in columns]
    problems += [f"column {s} feeds several fields" for s in sorted({s for s in sources if sources.count(s) > 1})]
    if problems:
        raise ValueError("; ".join(problems))


def apply_mapping(df: DataFrame, mapping: dict[str, str], keep: list[str] | None = None,
                  with_sources: bool = False) -> DataFrame:
    """Project source columns to the 16 system fields; unmapped fields are NULL."""
    check_mapping(df.columns, mapping, REQUIRED_FIELDS)
    fields = [F.col(f"`{mapping[f]}`").alias(f) if mapping.get(f) else F.lit(None).cast("string").alias(f)
              for f in SYSTEM_FIELDS]
    keep = keep or []
    sources = [F.col(f"`{c}`").alias(f"source__{i}") for i, c in enumerate(
        c for c in df.columns if c not in keep)] if with_sources else []
    return df.select(*fields, *sources, *keep)


def check_role_mapping(columns: list[str], role: str, mapping: dict[str, str],
                       stock_mode: str = "snapshot") -> None:
    """Required fields of the role, one identifier at least, a date for opening stock."""
    required = [f for f, (_, needed, _) in ROLE_FIELDS[role].items() if needed]
    check_mapping(columns, mapping, required)
    if not any(mapping.get(f) for f in IDENTITY_FIELDS):
        raise ValueError("map a material code, a SKU or a material name")
    if role == "stock" and stock_mode == "opening" and not mapping.get("date"):
        raise ValueError("opening stock needs a date")


def has_business_value(role: str, columns: list[str]) -> Column:
    """Rows of a role table where a required field or an identifier is filled."""
    required = [f for f, (_, needed, _) in ROLE_FIELDS[role].items() if needed]
    test = F.lit(False)
    for field in dict.fromkeys([*required, *IDENTITY_FIELDS]):
        if field in columns:
            test = test | ~is_blank(F.col(field))
    return test


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def _field_rows(headers: DataFrame, fields: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Each header once per field of a fixed catalogue, with the field's folded words."""
    catalogue = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("field"), F.lit(kind).alias("field_type"),
                 F.array(*[F.lit(fold_name(w)) for w in words]).alias("words"))
        for i, (name, kind, words) in enumerate(fields)])
    return headers.select("*", F.inline(catalogue))


def _pick_one_to_one(options: Column) -> Column:
    """Best score first, each field and each header once; a table has few options."""
    def place(x: Column) -> Column:
        return F.struct((-x["score"]).alias("o"), x["place"].alias("p"), x["position"].alias("q"), x["header"].alias("h"), x.alias("x"))

    def add(chosen: Column, x: Column) -> Column:
        used = F.exists(chosen, lambda c: (c["field"] == x["field"]) | c["header"].eqNullSafe(x["header"]))
        return F.when(used, chosen).otherwise(F.concat(chosen, F.array(x)))

    best = F.transform(F.array_sort(F.transform(options, place)), lambda x: x["x"])
    return F.reduce(best, F.slice(best, 1, 0), add)


def _options(headers: DataFrame, table: list[str], score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """``table..., _options``: what each table may map, as an array of structs; tables without any are left out.

    A spelling is scored once however many tables have it; those that pass are looked up.
    """
    seen = headers.select("header", "type").distinct().withColumn("_spelling", F.struct("header", "type"))
    scored = score(seen).where(F.col("score") >= threshold)
    named = [c for c in ("role", "place", "field", "score") if c in scored.columns]
    passed = scored.groupBy("_spelling").agg(F.collect_list(F.struct(*named)).alias("_scores"))
    rows = headers.select(*table, "header", "position", F.struct("header", "type").alias("_spelling"))
    each = attach(rows, passed, ["_spelling"], "inner").select(*table, "header", "position", F.inline("_scores"))
    return each.groupBy(*table).agg(F.collect_list(F.struct("header", "position", *named)).alias("_options"))


def _mapped(options: DataFrame, table: list[str]) -> DataFrame:
    chosen = options.select(*table, F.explode(_pick_one_to_one(F.col("_options"))).alias("_x"))
    return chosen.select(*table, "_x.field", "_x.header", "_x.score")


def score_headers(headers: DataFrame) -> DataFrame:
    """Scores of every header against every system field.

    ``headers`` has ``header``, ``position`` and the detected ``type`` next to the table key.
    """
    fields = [(f, kind, list(dict.fromkeys([label, FIELD_IDS.get(f, f), *words])))
              for f, (label, kind, words) in SYSTEM_FIELDS.items()]
    rows = _field_rows(header_table(headers), fields)
    name, tokens = F.col("folded"), _tokens(F.col("folded"))

    def similar(word: Column) -> Column:
        longest = F.greatest(F.length(name), F.length(word))
        return F.when((name == "") | (word == ""), 0.0).otherwise(1 - F.levenshtein(name, word) / longest)

    def shared(word: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, _tokens(word))),
                                       F.size(F.array_union(tokens, _tokens(word)))), F.lit(0.0))

    words = F.col("words")
    near = F.array_max(F.transform(words, lambda w: F.greatest(similar(w), shared(w))))
    overlap = F.array_max(F.transform(words, shared))
    base = F.greatest(F.when(F.array_contains(words, F.col("bare")), 1.0).otherwise(near), overlap * 0.95)
    fits = (F.col("type").isNull() | F.col("type").isin("empty", "mixed")
            | (F.col("type") == F.col("field_type")) | (F.col("field_type") == "text"))
    dated = (F.col("field") == "date") & name.rlike(r"(^|\s)(data|date|datum|dzien|day|czas|time)(\s|$)")
    score = base + F.when(fits, 0.08).otherwise(-0.18) + F.when(dated, 0.12).otherwise(0.0)
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def match_columns(headers: DataFrame, table: list[str]) -> DataFrame:
    """``table..., field, header, score``: the automatic mapping of each table."""
    return _mapped(_options(headers, table, score_headers, MATCH_THRESHOLD), table)


def score_role_headers(headers: DataFrame, role: str) -> DataFrame:
    """Scores of every header against the fields of one role."""
    fields = [(f, kind, words) for f, (kind, _, words) in ROLE_FIELDS[role].items()]
    rows = _field_rows(header_table(headers), fields)
    name, tokens = F.col("folded"), _tokens(F.col("folded"))

    def near(word: Column) -> Column:
        overlap = F.size(F.array_intersect(tokens, _tokens(word)))
        return (F.when(name == word, 1.0).when(name.contains(word) | word.contains(name), 0.8)
                .when(overlap > 0, 0.45 + 0.12 * overlap).otherwise(0.0))

    best = F.when(name == "", 0.0).otherwise(F.array_max(F.transform("words", near)))
    fits = F.when(F.col("field_type") == F.col("type"), 0.08).otherwise(0.0)
    score = F.when(name == "", 0.0).otherwise(F.least(F.lit(1.0), best + fits))
    return rows.withColumn("score", score)


def match_role_columns(headers: DataFrame, table: list[str], role: str) -> DataFrame:
    """``table..., field, header, score``: the mapping of each table to one role."""
    return _mapped(_options(headers, table, lambda h: score_role_headers(h, role), ROLE_MATCH_THRESHOLD), table)


def role_fields(headers: DataFrame, table: list[str], roles: list[str]) -> DataFrame:
    """``table...`` and, under the name of each role, the fields that the table's mapping to it has."""
    def score(names: DataFrame) -> DataFrame:
        parts = [score_role_headers(names, role).withColumn("role", F.lit(role)) for role in roles]
        return reduce(DataFrame.unionByName, parts)

    options = _options(headers, table, score, ROLE_MATCH_THRESHOLD)

    def fields(role: str) -> Column:
        chosen = _pick_one_to_one(F.filter("_options", lambda x: x["role"] == role))
        return F.transform(chosen, lambda x: x["field"]).alias(role)

    return options.select(*table, *[fields(role) for role in roles])
