"""Normalizing, validating and deduplicating rows of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.dates import derive_date_fields
from supplylens.functions.parse import date_of, number_of, timestamp_of
from supplylens.functions.text import SPACE, clean_text, comparable_text, is_blank, let
from supplylens.plans.ordered import attach
from supplylens.session import checkpointed, kept, spread
from supplylens.vocab import CLEANABLE_FIELDS, SHIFT_ALIASES, UNIT_ALIASES


def _alias(key: Column, words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), key)


def unit_alias(value: Column) -> Column:
    """The standard unit for a spelling of it, NULL for an unknown one."""
    return _alias(comparable_text(value), UNIT_ALIASES)


def shift_alias(value: Column) -> Column:
    return _alias(comparable_text(value), SHIFT_ALIASES)


def _variants(df: DataFrame, fields: list[str], facts: list[Column], keep: list[Column]) -> DataFrame:
    """Distinct cleaned values of several fields in one pass, with their comparable key."""
    cells = df.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("field"), clean_text(F.col(f)).alias("variant")) for f in fields])), *keep)
    seen = cells.groupBy("field", "variant").agg(*facts)
    return seen.withColumn("key", comparable_text(F.col("variant"))).where("key != ''")


def preferred_variants(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, variant, preferred``: one spelling per group of equal comparable text.

    A built-in alias wins; else the most frequent variant, then more of ``&+@``, shorter,
    more capitals, alphabetical.
    """
    variants = checkpointed(_variants(df, fields, [F.count("*").alias("n")], []))
    rank = F.struct(
        -F.col("n"),
        -F.length(F.regexp_replace("variant", r"[^&+@]", "")),
        F.length("variant"),
        -F.length(F.regexp_replace("variant", "[^A-ZĄĆĘŁŃÓŚŹŻ]", "")),
        F.col("variant"))
    best = variants.groupBy("field", "key").agg(F.min_by("variant", rank).alias("best"))
    fixed = (F.when(F.col("field") == "unit", unit_alias(F.col("variant")))
             .when(F.col("field") == "shift", shift_alias(F.col("variant"))))
    return variants.join(best, ["field", "key"]).select("field", "variant", F.coalesce(fixed, "best").alias("preferred"))


def first_spellings(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """``field, variant, preferred``: the spelling seen first per comparable text."""
    seen = checkpointed(_variants(df, fields, [F.min("place").alias("place")], [F.struct(*order).alias("place")]))
    best = seen.groupBy("field", "key").agg(F.min_by("variant", "place").alias("preferred"))
    return seen.join(best, ["field", "key"]).select("field", "variant", "preferred")


def _replace_variants(df: DataFrame, fields: list[str], table: DataFrame) -> DataFrame:
    """Look the changed spellings up; all other values only get cleaned."""
    changed = checkpointed(table.where("variant != preferred"))
    for field in fields:
        words = changed.where(F.col("field") == field).select(F.col("variant").alias("_variant"), F.col("preferred").alias("_preferred"))
        rows = df.withColumn("_variant", clean_text(F.col(field)))
        df = attach(rows, words, ["_variant"]).withColumn(
            field, F.coalesce("_preferred", F.nullif("_variant", F.lit("")))).select(*df.columns)
    return df


def canonicalize(df: DataFrame, *fields: str) -> DataFrame:
    """Replace each value by the preferred spelling of its group."""
    return _replace_variants(df, list(fields), preferred_variants(df, list(fields)))


def canonicalize_first(df: DataFrame, field: str, order: list[str]) -> DataFrame:
    return _replace_variants(df, [field], first_spellings(df, [field], order))


def normalization_audit(df: DataFrame, field: str) -> DataFrame:
    """``original, normalized, changed, rows`` per distinct value of a cleanable field."""
    counts = df.groupBy(clean_text(F.col(field)).alias("original")).agg(F.count("*").alias("rows"))
    table = preferred_variants(df, [field]).select(F.col("variant").alias("original"), "preferred")
    joined = counts.where("original != ''").join(table, "original", "left")
    normalized = F.coalesce("preferred", "original")
    return joined.select("original", normalized.alias("normalized"),
                         (F.col("original") != normalized).alias("changed"), "rows")


def normalize_record(df: DataFrame, order: list[str]) -> DataFrame:
    """Mapped text to typed, cleaned fields plus calendar fields.

    Codes are upper-cased, cleanable fields canonicalized, other text cleaned, blanks NULL.
    ``original_values`` keeps the text of changed cleanable fields.
    """
    cleanable = [f for f in CLEANABLE_FIELDS if f in df.columns]
    out = df.withColumns({f"_was_{f}": clean_text(F.col(f)) for f in cleanable})
    if cleanable:
        out = _replace_variants(out, cleanable, preferred_variants(df, cleanable))
    if "operator" in out.columns:
        out = canonicalize_first(out, "operator", order)
    for field in ("material_code", "sku"):
        if field in out.columns:
            out = out.withColumn(field, F.nullif(F.upper(clean_text(F.col(field))), F.lit("")))
    for field in ("description", "order", "record_id"):
        if field in out.columns:
            out = out.withColumn(field, F.nullif(clean_text(F.col(field)), F.lit("")))
    for field in ("quantity", "stock_level"):
        if field in out.columns:
            out = out.withColumn(field, number_of(out, field))
    changed = F.array_compact(F.array(*[
        F.when((F.col(f"_was_{f}") != "") & (F.col(f"_was_{f}") != F.col(f)),
               F.struct(F.lit(f).alias("key"), F.col(f"_was_{f}").alias("value"))) for f in cleanable]))
    out = out.withColumn("original_values", F.map_from_entries(changed)).drop(*[f"_was_{f}" for f in cleanable])
    out = out.withColumn("_stamp", timestamp_of(out, "date"))
    return derive_date_fields(out, "_stamp").withColumn("date", F.col("_stamp").cast("date")).drop("_stamp")


def row_checks(df: DataFrame, required: tuple[str, ...] = ()) -> Column:
    """``struct<errors, warnings>`` with the codes of a mapped row; each cell is parsed once."""
    def blank(field: str) -> Column:
        return ~F.coalesce(F.col(field).cast("string").rlike(f"[^{SPACE}\\x00-\\x1F\\x7F]"), F.lit(False))

    def build(number: Column) -> Column:
        errors = [
            F.when(is_blank(F.col("date")), "missing_date").when(date_of(df, "date").isNull(), "invalid_date"),
            F.when(blank("material"), "missing_material"),
            F.when(is_blank(F.col("quantity")), "missing_quantity").when(number.isNull(), "invalid_quantity")
            .when(number < 0, "negative_quantity"),
            *[F.when(blank(f), f"missing_{f}") for f in ("brand", "line") if f in required]]
        warnings = [F.when(number == 0, "zero_quantity")]
        return F.struct(F.array_compact(F.array(*errors)).alias("errors"),
                        F.array_compact(F.array(*warnings)).alias("warnings"))

    return let(number_of(df, "quantity"), build)


def validate(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Add ``errors`` and ``warnings``; rows without errors are valid.

    The codes come out of a one-row generator, so that a later filter on them does not make
    Spark parse the cells a second time.
    """
    return df.select(*df.columns, F.inline(F.array(row_checks(df, required))))


def checked_rows(df: DataFrame, source_columns: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``errors``, ``warnings`` and ``duplicate_key``, written once.

    Valid and rejected rows are both read from there, so no source is joined or parsed for each.
    """
    checked = validate(spread(df), required)
    return kept(checked.withColumn("duplicate_key", duplicate_key(checked, source_columns)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size("errors") == 0), checked.where(F.size("errors") > 0)


def duplicate_key(df: DataFrame, source_columns: list[str]) -> Column:
    """The record id ignoring case, else the exact cleaned source row."""
    row = F.concat_ws("␟", *[clean_text(F.col(c)) for c in source_columns])
    by_row = F.concat(F.lit("row:"), row)
    if "record_id" not in df.columns:
        return by_row
    identifier = clean_text(F.col("record_id"))
    return F.when(identifier != "", F.concat(F.lit("id:"), comparable_text(identifier))).otherwise(by_row)


#: A table of repeated keys up to this many rows is sent to every task.
BROADCAST_KEYS = 1_000_000


def tag_duplicates(df: DataFrame, key: Column | None, order: list[str]) -> DataFrame:
    """Add ``duplicate_key`` and ``duplicate_of``: the first row's place, NULL on that row.

    The rows are written once with their keys; without ``key`` they are from :func:`checked_rows`. One aggregate, combined before it is shuffled,
    finds the keys that occur more than once and their first rows; only keys and places move
    for that. Few such keys are sent to the rows, which then do not move at all; many are
    joined, where adaptive execution splits a key with very many rows.
    """
    place = F.struct(*[F.col(f"`{c}`") for c in order])
    rows = df if key is None else kept(spread(df).withColumn("duplicate_key", key))
    # two hashes of 64 bits stand for the key, which may be a whole row
    marks = [F.xxhash64(F.lit(i), "duplicate_key").alias(f"_k{i}") for i in (1, 2)]
    repeated = kept(rows.groupBy(*marks).agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n"))
    few = repeated.count() <= BROADCAST_KEYS
    marked = rows.select("*", *marks)
    joined = marked.join(F.broadcast(repeated) if few else repeated, ["_k1", "_k2"], "left")
    return joined.select(*rows.columns, F.when(place != F.col("_first"), F.col("_first")).alias("duplicate_of"))


def dedupe(df: DataFrame, source_columns: list[str] | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Kept rows and duplicates; ``order`` has to tell any two different rows apart.

    Without ``source_columns`` the rows are from :func:`checked_rows`.
    """
    tagged = tag_duplicates(df, duplicate_key(df, source_columns) if source_columns else None, order)
    return (tagged.where("duplicate_of IS NULL").drop("duplicate_of"),
            tagged.where("duplicate_of IS NOT NULL"))


def row_digest(columns: list[str]) -> Column:
    """A SHA-256 of the whole row: equal rows share it, and it is all that is shuffled."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


#: rows of up to this many columns, and texts of up to this many bytes, are compared as they are
FEW_COLUMNS, SHORT_TEXT = 8, 64


def row_keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """Keys that equal rows share. Those of a narrow row are its own values, and a digest only of long texts."""
    if len(columns) > FEW_COLUMNS:
        return [row_digest(columns).alias("_row")]
    keys = []
    for i, (name, field) in enumerate(zip(columns, df.select(*columns).schema.fields)):
        kind, column = field.dataType, F.col(name)
        if isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType)):
            keys.append(column.alias(f"_row{i}"))
        elif isinstance(kind, T.StringType):
            short = F.octet_length(column) <= SHORT_TEXT
            keys += [F.when(short, column).alias(f"_row{i}"), F.when(~short, F.sha2(column, 256)).alias(f"_long{i}")]
        elif isinstance(kind, T.DoubleType):  # -0.0 is told from 0.0, as in a digest
            keys += [column.alias(f"_row{i}"), F.when(column == 0, column.cast("string")).alias(f"_zero{i}")]
        else:
            keys.append(row_digest([name]).alias(f"_row{i}"))
    return keys


def count_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``rows, groups, duplicate_rows``: excess over distinct full rows."""
    groups = df.groupBy(*row_keys(df, columns or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.count_if(F.col("n") > 1).alias("groups"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def process_dataset(df: DataFrame, source_columns: list[str], order: list[str],
                    required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Validate, drop duplicates among the valid rows, normalize: valid and rejected rows."""
    good, bad = split_valid(checked_rows(df, source_columns, required))
    kept, repeats = dedupe(good, None, order)
    status = F.when(F.size("warnings") > 0, "warning").otherwise("valid")
    valid = normalize_record(kept.withColumn("validation_status", status).drop("errors"), order)
    repeats = repeats.withColumn("errors", F.array(F.lit("duplicate_record"))).withColumn(
        "duplicate_of", F.to_json("duplicate_of"))
    return valid, repeats.unionByName(bad.drop("duplicate_key"), allowMissingColumns=True)


def validation_summary(checked: DataFrame) -> DataFrame:
    """``kind, code, rows``: totals and the rows per error and warning code.

    Expects ``errors``, ``warnings`` and, where duplicates were tagged, ``duplicate_of``.
    """
    invalid = F.size("errors") > 0
    repeat = F.col("duplicate_of").isNotNull() if "duplicate_of" in checked.columns else F.lit(False)
    valid = ~invalid & ~repeat
    facts = [("total", "all", F.lit(True)), ("total", "valid", valid), ("total", "invalid", invalid),
             ("total", "duplicate", ~invalid & repeat), ("total", "warning", valid & (F.size("warnings") > 0))]
    marks = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code")))
             for kind, code, test in facts]

    def named(kind: str, column: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("code")))

    codes = [named("error", "errors"), named("warning", "warnings")]
    events = F.concat(F.array_compact(F.array(*marks)), *codes)
    return checked.select(F.inline(events)).groupBy("kind", "code").agg(F.count("*").alias("rows"))


def revalidate(fixed: DataFrame, valid: DataFrame, source_columns: list[str], order: list[str],
               required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Fixed rows that now pass and whose key no valid row has; and the rest.

    An accepted row joins the valid ones, so of fixed rows with one key only the first by
    ``order`` is accepted.
    """
    good, bad = split_valid(checked_rows(fixed.drop("errors", "warnings", "duplicate_key"), source_columns, required))
    # only keys that a fixed row asks for; the valid rows themselves are not moved
    asked = good.select("duplicate_key").distinct()
    taken = kept(valid.select("duplicate_key").join(asked, "duplicate_key", "left_semi").distinct())
    tagged = tag_duplicates(good.join(taken, "duplicate_key", "left_anti"), F.col("duplicate_key"), order)
    accepted = tagged.where("duplicate_of IS NULL").drop("duplicate_of")
    repeated = good.join(taken, "duplicate_key", "left_semi").unionByName(
        tagged.where("duplicate_of IS NOT NULL").drop("duplicate_of"))
    return accepted, bad.unionByName(repeated.withColumn("errors", F.array(F.lit("duplicate_record"))))
