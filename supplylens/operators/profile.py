"""Column profiles: physical types, statistics and semantic roles, one row per column.

Everything is derived from one table of distinct cell values and their counts, so the data
is read once and a frequent value is parsed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.parse import (
    convention_evidence, convention_from, excel_serial, is_period, parse_bool, parse_date, parse_number,
    parse_period,
)
from supplylens.functions.text import GAP, analytics_text, is_blank, normalize_label
from supplylens.plans.ordered import narrowed_quantiles
from supplylens.session import checkpointed, kept, spread, stored
from supplylens.vocab import (
    ALMOST_CONSTANT, DIMENSION_ROLES, IDENTIFIER_HINT, MEASURE_HINT, MEASURE_ROLES, SEMANTIC_RULES,
    VALUE_PATTERNS, VALUE_STARTS,
)

STAMPS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def cell_text(df: DataFrame, name: str) -> Column:
    """The cell as text: whole doubles without '.0', days without a time of midnight."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(column.cast("string"), r"\.0$", "")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def value_table(df: DataFrame, columns: list[str] | None = None, blanks: bool = False) -> DataFrame:
    """``column, native, value, number, n``: distinct cells; blank ones as NULL value, or with ``blanks`` as written.

    ``native`` is ``number``, ``date`` or ``text``; ``number`` is set for native numbers.
    """
    columns = columns or df.columns
    rows, parts = df if stored(df) else kept(spread(df).select(*[F.col(f"`{c}`") for c in columns])), []
    # each column is counted by itself: one key of its own type, no row is repeated for a column
    for name in columns:
        kind = df.schema[name].dataType
        native = "number" if isinstance(kind, T.NumericType) else "date" if isinstance(kind, STAMPS) else "text"
        number = F.col(f"`{name}`").cast("double") if native == "number" else F.lit(None).cast("double")
        cells = spread(rows.select(F.col(f"`{name}`")))
        # doubles hold these numbers exactly: their text is made once for each distinct one
        if isinstance(kind, (T.DoubleType, T.IntegerType, T.ShortType, T.ByteType)):
            counted = cells.groupBy(number.alias("number")).agg(F.count("*").alias("n"))
            value = (F.regexp_replace(F.col("number").cast("string"), r"\.0$", "") if isinstance(kind, T.DoubleType)
                     else F.col("number").cast("bigint").cast("string"))
        elif isinstance(kind, T.LongType):  # a key of eight bytes; its text and double follow from it
            counted = cells.groupBy(F.col(f"`{name}`").alias("_whole")).agg(F.count("*").alias("n"))
            number, value = F.col("_whole").cast("double"), F.col("_whole").cast("string")
        else:
            text = cell_text(df, name)
            if native == "text" and not blanks:
                text = F.when(~is_blank(text), text)
            keys = [text.alias("value"), *([number.alias("number")] if native == "number" else [])]
            counted, value = cells.groupBy(*keys).agg(F.count("*").alias("n")), F.col("value")
        if native == "number" and not isinstance(kind, T.LongType):
            number = F.col("number")
        parts.append(counted.select(F.lit(name).alias("column"), F.lit(native).alias("native"), value.alias("value"),
                                    number.alias("number"), "n"))
    return reduce(DataFrame.unionByName, parts)


def parsed_values(values: DataFrame) -> DataFrame:
    """Add ``number``, ``day``, ``period`` and ``flag`` as the analytics dialect reads them.

    The day order is inferred per column from all its values.
    """
    text = F.when(F.col("native") == "text", F.col("value"))
    sums = values.groupBy("column").agg(*[
        F.coalesce(F.sum(part * F.col("n")), F.lit(0.0)).alias(name)
        for name, part in convention_evidence(text).items()])
    convention, confidence = convention_from(*[F.col(c) for c in ("ymd", "mdy", "dmy", "seen")])
    order = sums.select("column", convention.alias("convention"), confidence.alias("convention_confidence"))
    joined = values.join(F.broadcast(order), "column")  # one row per column
    is_number, is_date = F.col("native") == "number", F.col("native") == "date"
    epoch = F.timestamp_millis(F.when(F.col("number") > 1e11, F.col("number")).cast("bigint")).cast("date")
    serial = F.coalesce(excel_serial(F.col("number"), 20000, 100000).cast("date"), epoch)
    value = F.col("value")
    day = (F.when(is_number, serial).when(is_date, F.left(value, F.lit(10)).try_cast("date"))
           .when(F.col("convention") == "mdy", parse_date(value, "analytics", "mdy"))
           .otherwise(parse_date(value, "analytics")))
    number = F.when(is_number, F.when(~F.isnan("number"), F.col("number"))).when(~is_date, parse_number(value, "analytics"))
    out = joined.withColumn("day", day).withColumn("number", number)
    return out.withColumn("period", F.when(F.col("day").isNull() & (F.col("native") == "text"), is_period(value))
                          .otherwise(F.lit(False))).withColumn("flag", parse_bool(value, "analytics"))


def _weight(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))


def _messy() -> Column:
    return (F.col("value") != F.trim("value")) | F.col("value").rlike(r"\s{2,}")


def _pattern_shares() -> Column:
    """For each value pattern the share of the different filled texts that fit it: a common placeholder is one of them."""
    is_text = F.col("native") == "text"
    filled = F.count_if(is_text & F.col("value").rlike(f"[^{GAP[1:]}"))
    # only a text that begins like a pattern is folded
    text = F.when(is_text & F.col("value").rlike(f"(?i)^{GAP}*(?:{VALUE_STARTS})"), analytics_text(F.col("value")))
    return F.array(*[F.try_divide(F.count_if(F.regexp_like(text, F.lit(pattern))), filled) for pattern, _, _ in VALUE_PATTERNS])


def value_facts(parsed: DataFrame) -> DataFrame:
    """Weighted counts per column, one row each."""
    filled = F.col("value").isNotNull()
    number, day = F.col("number"), F.col("day")
    size = F.length("value")
    messy = (F.col("native") == "text") & _messy()
    return parsed.groupBy("column", "native").agg(
        F.first("convention").alias("convention"),
        F.sum("n").alias("row_count"), _weight(filled).alias("non_null_count"),
        F.count("value").alias("unique_count"), F.max(F.when(filled, F.col("n"))).alias("top_count"),
        _weight(number.isNotNull()).alias("number_count"), _weight(day.isNotNull()).alias("date_count"),
        _weight(F.col("period")).alias("period_count"), _weight(F.col("flag").isNotNull()).alias("bool_count"),
        F.min("number").alias("minimum"), F.max("number").alias("maximum"),
        F.sum(number * F.col("n")).alias("sum"), _weight(number == 0).alias("zero_count"),
        _weight(number < 0).alias("negative_count"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_distinct("day").alias("unique_days"),
        F.min(size).alias("minimum_length"), F.max(size).alias("maximum_length"),
        F.sum(size * F.col("n")).alias("_length"), _weight(messy).alias("whitespace_issues"), _pattern_shares().alias("pattern_shares"))


def physical_type(declared: Column | None = None) -> tuple[Column, Column]:
    """Type and confidence from the shares of readable values; see ``value_facts``."""
    filled = F.col("non_null_count")
    declared = declared if declared is not None else F.lit("")

    def share(count: Column) -> Column:
        return F.coalesce(F.try_divide(count, filled), F.lit(0.0))

    number, date, flag = share(F.col("number_count")), share(F.col("date_count")), share(F.col("bool_count"))
    dated = share(F.col("date_count") + F.col("period_count"))
    native_number, native_date = F.col("native") == "number", F.col("native") == "date"
    strongest = F.greatest(number, date, flag)
    rules = [
        (filled == 0, "empty", F.lit(1.0)),
        ((declared == "date") & (dated >= 0.6), "date", dated),
        ((declared == "number") & (number >= 0.6), "number", number),
        ((native_date | (dated >= 0.9)) & (dated >= number + 0.08), "date", dated),
        ((native_number | (number >= 0.9)) & (number >= date), "number", number),
        ((flag >= 0.9) & (F.col("unique_count") <= 4), "boolean", flag),
        (dated >= 0.8, "date", dated), (number >= 0.8, "number", number),
        ((strongest >= 0.2) | (dated >= 0.2), "mixed", 1 - F.greatest(strongest, dated)),
    ]
    kind, confidence = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, name, score in rules[1:]:
        kind, confidence = kind.when(test, name), confidence.when(test, score)
    return kind.otherwise("text"), confidence.otherwise(0.95)


def numeric_stats(parsed: DataFrame) -> DataFrame:
    """Exact quartiles, median, MAD and population sd per column of parsed values."""
    numbers = kept(parsed.where("number IS NOT NULL").select("column", "number", F.col("n").alias("w")))
    middle = narrowed_quantiles(numbers, "number", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "column", "w")
    middle = middle.withColumnRenamed("n", "numeric_count")
    means = numbers.groupBy("column").agg((F.sum(F.col("number") * F.col("w")) / F.sum("w")).alias("mean"))
    around = numbers.join(F.broadcast(middle.select("column", "median")), "column").join(
        F.broadcast(means), "column")  # one row per column
    spread = around.groupBy("column").agg(
        F.sqrt(F.sum(F.col("w") * F.pow(F.col("number") - F.col("mean"), F.lit(2.0))) / F.sum("w"))
        .alias("standard_deviation"))
    away = around.select("column", "w", F.abs(F.col("number") - F.col("median")).alias("away"))
    mad = narrowed_quantiles(away, "away", {"mad": 0.5}, "column", "w").drop("n")
    return middle.join(means, "column").join(spread, "column").join(mad, "column").withColumn(
        "iqr", F.col("q3") - F.col("q1"))


def text_stats(df: DataFrame, columns: list[str] | None = None, blanks: bool = False) -> DataFrame:
    """Count, lengths, distinct texts and white space issues per column, whatever its texts read as.

    Text of white space only is missing, as in a profile, or with ``blanks`` a text like any
    other. A column without texts has its row, too.
    """
    columns = columns or df.columns
    size, n = F.length("value"), F.col("n")
    facts = value_table(df, columns, blanks).where("value IS NOT NULL").groupBy("column").agg(
        F.sum(n).alias("count"), F.min(size).alias("minimum_length"), F.max(size).alias("maximum_length"),
        (F.sum(size * n) / F.sum(n)).alias("average_length"), F.count("value").alias("unique_count"),
        _weight(_messy()).alias("whitespace_issues"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return names.join(F.broadcast(facts), "column", "left").fillna(  # one row per column
        0, ["count", "unique_count", "whitespace_issues"])


def histograms(parsed: DataFrame) -> DataFrame:
    """``column, bin, from, to, count``: ceil(sqrt n) bins between 3 and 30, empty ones too."""
    numbers = parsed.where("number IS NOT NULL")
    span = numbers.groupBy("column").agg(F.min("number").alias("low"), F.max("number").alias("high"),
                                         F.sum("n").alias("size"))
    bins = F.greatest(F.lit(3), F.least(F.lit(30), F.ceil(F.sqrt("size")))).cast("int")
    span = span.withColumn("bins", F.when(F.col("low") == F.col("high"), 1).otherwise(bins)).withColumn(
        "width", (F.col("high") - F.col("low")) / F.col("bins"))
    spot = F.least(F.col("bins") - 1, F.coalesce(F.floor(F.try_divide(
        F.col("number") - F.col("low"), F.col("width"))), F.lit(0))).cast("int")
    counts = numbers.join(F.broadcast(span), "column").groupBy("column", spot.alias("bin")).agg(
        F.sum("n").alias("count"))
    edges = span.select("column", "low", "high", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    upper = F.when(F.col("width") == 0, F.col("high")).otherwise(F.col("low") + F.col("width") * (F.col("bin") + 1))
    return edges.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("low") + F.col("width") * F.col("bin")).alias("from"), upper.alias("to"),
        F.coalesce("count", F.lit(0)).alias("count"))


def top_values(values: DataFrame, k: int) -> DataFrame:
    """``column, place, value, n``: the most frequent values of a table of distinct ones, equal counts by value."""
    window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    counted = values.where("value IS NOT NULL")
    return counted.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).select(
        "column", "place", "value", "n")


def frequency(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """``value, count`` of filled cells, most frequent first."""
    counts = df.where(~is_blank(F.col(column))).groupBy(cell_text(df, column).alias("value")).agg(
        F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), "value")
    return ordered.limit(k) if k else ordered


def unique_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    value = F.when(~is_blank(F.col(column)), cell_text(df, column))
    count = F.approx_count_distinct(value) if approximate else F.count_distinct(value)
    return df.agg(count.alias("unique_count"))


class Profile:
    """The profile of one table; ``columns`` is the DataFrame with one row per column."""

    def __init__(self, df: DataFrame, fields: list[str] | None = None, declared: dict[str, str] | None = None,
                 labels: dict[str, str] | None = None, total_rows: int | None = None):
        self.df, self.fields = df, fields or df.columns
        self.parsed = kept(parsed_values(kept(value_table(df, self.fields))))
        self.labels, self.declared, self.total_rows = labels or {}, declared or {}, total_rows
        self.columns = checkpointed(self._columns())

    def _columns(self) -> DataFrame:
        def lookup(words: dict[str, str]) -> Column:
            if not words:
                return F.lit(None).cast("string")
            return F.element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), F.col("column"))

        kind, confidence = physical_type(F.coalesce(lookup(self.declared), F.lit("")))
        filled = F.col("non_null_count")
        facts = value_facts(self.parsed).withColumn("physical_type", kind).withColumn(
            "type_confidence", F.round(confidence, 3))
        observed = F.col("row_count") - filled
        ratio = F.coalesce(F.try_divide(observed, "row_count"), F.lit(0.0))
        dated = F.col("physical_type").isin("date", "mixed")
        numeric = F.col("physical_type").isin("number", "mixed")
        text = ~F.col("physical_type").isin("number", "date", "empty")
        facts = facts.join(numeric_stats(self.parsed), "column", "left")
        examples = top_values(self.parsed, 5).groupBy("column").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
            .alias("examples"))  # five short lists
        facts = facts.join(examples, "column", "left")
        rows = F.lit(self.total_rows) if self.total_rows else F.col("row_count")
        errors = (F.when(F.col("physical_type") == "number", filled - F.col("number_count"))
                  .when(F.col("physical_type") == "date", filled - F.col("date_count") - F.col("period_count"))
                  .when(F.col("physical_type") == "boolean", filled - F.col("bool_count")).otherwise(0))
        place = F.element_at(F.create_map(*[x for i, c in enumerate(self.fields) for x in (F.lit(c), F.lit(i))]),
                             F.col("column"))
        return facts.select(
            "column", place.alias("position"), F.coalesce(lookup(self.labels), F.col("column")).alias("label"),
            "physical_type", "type_confidence",
            F.when(dated, F.col("convention")).alias("date_convention"),
            F.when(dated, F.col("period_count")).otherwise(0).alias("partial_date_count"),
            rows.cast("bigint").alias("row_count"), F.col("row_count").alias("analyzed_rows"),
            F.round(ratio * rows).cast("bigint").alias("missing_count"), ratio.alias("missing_ratio"),
            (rows - F.round(ratio * rows)).cast("bigint").alias("non_null_count"), "unique_count",
            F.coalesce(F.try_divide("unique_count", filled), F.lit(0.0)).alias("unique_ratio"),
            ((F.col("unique_count") <= 1) & (filled > 0)).alias("is_constant"),
            F.coalesce((F.col("unique_count") > 1) & (F.col("top_count") / filled >= ALMOST_CONSTANT),
                       F.lit(False)).alias("is_almost_constant"),
            "examples", errors.cast("bigint").alias("type_errors"),
            *[F.when(numeric, F.col(c)).alias(c) for c in (
                "numeric_count", "minimum", "maximum", "sum", "mean", "median", "standard_deviation", "q1", "q3",
                "iqr", "mad", "zero_count", "negative_count")],
            *[F.when(dated, F.col(c)).alias(n) for c, n in (
                ("date_count", "exact_dates"), ("first_day", "first_day"), ("last_day", "last_day"),
                ("unique_days", "unique_days"))],
            F.when(dated, F.greatest(F.lit(1), F.datediff("last_day", "first_day") + 1)).alias("range_days"),
            *[F.when(text, F.col(c)).alias(c) for c in ("minimum_length", "maximum_length", "whitespace_issues")],
            F.when(text, F.try_divide("_length", filled)).alias("average_length"), "pattern_shares")

    def histogram(self) -> DataFrame:
        numeric = self.columns.where(F.col("physical_type").isin("number", "mixed")).select("column")
        return histograms(self.parsed).join(F.broadcast(numeric), "column", "left_semi")

    def top_values(self, k: int = 10) -> DataFrame:
        return top_values(self.parsed, k)

    def partial_examples(self, k: int = 5) -> DataFrame:
        """``column, place, label`` of week or month texts."""
        window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        found = self.parsed.where("period").withColumn("place", F.row_number().over(window))
        return found.where(F.col("place") <= k).select("column", "place", parse_period(F.col("value"))["label"].alias("label"))

    def type_error_examples(self, k: int = 50) -> DataFrame:
        """``column, value, n`` of filled values that do not fit the column's type."""
        joined = self.parsed.join(F.broadcast(self.columns.select("column", "physical_type")), "column")
        kind = F.col("physical_type")
        bad = ((kind == "number") & F.col("number").isNull()) | (
            (kind == "date") & F.col("day").isNull() & ~F.col("period")) | (
            (kind == "boolean") & F.col("flag").isNull())
        window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        return (joined.where(bad & F.col("value").isNotNull())
                .withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
                .select("column", "place", "value", "n"))


def profile(df: DataFrame, fields: list[str] | None = None, mode: str = "full", sample: int = 20_000,
            key: list[str] | None = None, **options) -> Profile:
    """Full mode reads all rows; quick mode a repeatable sample and scales missing counts.

    ``key`` columns tell the rows apart for the sample.
    """
    if mode == "full":
        return Profile(df, fields, **options)
    from supplylens.operators.filters import sample_rows
    return Profile(sample_rows(df, sample, key), fields, total_rows=df.count(), **options)


# ---- roles -------------------------------------------------------------------------------

def confidence_from_evidence(score: Column, size: Column, minimum: int = 20) -> Column:
    weight = F.log10(F.greatest(F.lit(1), size)) / F.log10(F.lit(float(max(10, minimum * 10))))
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.round(score * (0.55 + 0.45 * weight), 3)


def semantic_roles(columns: DataFrame) -> DataFrame:
    """Add ``semantic_role, business_role, analytical_role, expected_unique, semantic_confidence``.

    The table has one row per column; each step of the rules is checkpointed, because one
    plan of all nested rules takes far longer to optimize than the few rows to compute.
    """
    none = F.lit(None).cast("string")
    rules = F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(role).alias("role"), F.lit(business).alias("business"),
        F.lit(priority).alias("priority"),
        F.array(*[F.lit(t) for t in (types or [])]).cast("array<string>").alias("types"),
        F.array(*[F.lit(p) for p in patterns]).alias("patterns"),
        F.array(*[F.lit(p) for p in excluded]).cast("array<string>").alias("excluded"))
        for i, (role, business, priority, types, patterns, excluded) in enumerate(SEMANTIC_RULES)])
    names = F.array_distinct(F.filter(
        F.array(normalize_label(F.col("label")), normalize_label(F.col("column"))), lambda x: x != ""))
    named = columns.withColumn("_names", names).withColumn("_search", F.array_join("_names", " "))

    def matches(pattern: Column) -> Column:
        return F.exists("_names", lambda name: F.regexp_like(name, pattern))

    tried = named.select("column", "_names", "physical_type", F.inline(rules)).where(
        (F.size("types") == 0) | F.array_contains("types", F.col("physical_type")))
    tried = tried.withColumn("hits", F.size(F.filter("patterns", matches))).where(
        (F.col("hits") > 0) & ~F.exists("excluded", matches))
    score = 0.62 + F.least(F.lit(0.18), F.col("hits") * 0.06) + F.least(F.lit(0.18), F.col("priority") / 1000)
    best = tried.withColumn("score", score).groupBy("column").agg(F.max(F.struct(
        "score", "priority", (-F.col("place")).alias("_place"), "role", "business")).alias("_best"))
    rows = named.join(best, "column", "left").select(
        "*", F.col("_best.role").alias("role"), F.col("_best.business").alias("business"),
        F.coalesce("_best.score", F.lit(0.0)).alias("score"), F.coalesce("_best.priority", F.lit(0)).alias("priority"))
    rows = checkpointed(rows)

    # value patterns count for text only and give way to strong names
    for place, (_, business, level) in enumerate(VALUE_PATTERNS):
        share = F.when(F.col("physical_type") != "number", F.get("pattern_shares", F.lit(place)))
        take = F.coalesce((share >= 0.6) & (F.col("role").isNull() | (F.col("priority") < 120))
                          & (F.lit(level) > F.col("score")), F.lit(False))
        rows = rows.withColumns({
            "role": F.when(take, "identifier").otherwise(F.col("role")),
            "business": F.when(take, business).otherwise(F.col("business")),
            "score": F.when(take, level).otherwise(F.col("score")),
            "priority": F.when(take, 200).otherwise(F.col("priority"))})
    rows = checkpointed(rows)

    kind, role, unique = F.col("physical_type"), F.col("role"), F.col("unique_ratio")
    as_date = (kind == "date") & (role.isNull() | (role == "date"))
    as_flag = (kind == "boolean") & role.isNull()
    single = ((kind == "number") & (unique >= 0.97) & ~F.col("_search").rlike(MEASURE_HINT)
              & (F.coalesce(role == "identifier", F.lit(False)) | F.col("_search").rlike(IDENTIFIER_HINT)))
    as_measure = (kind == "number") & ~single & role.isNull()
    worded = kind.isin("text", "mixed") & role.isNull()
    as_identifier = worded & (unique >= 0.97) & (F.col("non_null_count") >= 10)
    as_long = worded & ~as_identifier & (F.coalesce("average_length", F.lit(0.0)) >= 45)
    top = F.least(F.lit(200.0), F.greatest(F.lit(20.0), F.col("non_null_count") * 0.25))
    as_category = worded & ~as_identifier & ~as_long & F.col("unique_count").between(2, top)
    as_rest = worded & ~as_identifier & ~as_long & ~as_category
    business = F.col("business")
    choices = [  # test, role, business role, score
        (as_date, F.lit("date"), F.coalesce(business, F.lit("date")), F.greatest("score", 0.9 * F.col("type_confidence"))),
        (as_flag, F.lit("boolean"), F.lit("boolean"), F.lit(0.9)),
        (single, F.lit("identifier"), F.coalesce(business, F.lit("record_id")), F.greatest("score", F.lit(0.94))),
        (as_measure, F.lit("measure"), F.lit("measure"), F.lit(0.72)),
        (as_identifier, F.lit("identifier"), F.lit("identifier"), F.lit(0.72)),
        (as_long, F.lit("free_text"), F.lit("free_text"), F.lit(0.78)),
        (as_category, F.lit("category"), F.lit("category"), F.lit(0.75)),
        (as_rest, F.lit("free_text"), F.lit("free_text"), F.lit(0.55)),
        (kind == "empty", F.lit("unknown"), F.lit("unknown"), F.lit(0.2)),
    ]
    new_role, new_business, new_score = none, none, F.lit(None).cast("double")
    for test, r, b, s in reversed(choices):
        new_role, new_business = F.when(test, r).otherwise(new_role), F.when(test, b).otherwise(new_business)
        new_score = F.when(test, s).otherwise(new_score)
    final_role = F.coalesce(new_role, role, F.lit("unknown"))
    rows = rows.withColumns({
        "semantic_role": final_role, "business_role": F.coalesce(new_business, business, final_role),
        "_score": F.coalesce(new_score, "score")})
    rows = checkpointed(rows)
    percent = ((F.col("semantic_role") == "percentage") & (kind == "number") & (F.col("minimum") >= 0)
               & (F.col("maximum") <= 1.5))
    analytical = (F.when(F.col("semantic_role") == "date", "time_dimension")
                  .when(F.col("semantic_role").isin(MEASURE_ROLES), "measure")
                  .when(F.col("semantic_role") == "identifier", "identifier")
                  .when(F.col("semantic_role").isin(DIMENSION_ROLES), "dimension").otherwise("attribute"))
    expected = (F.col("business_role") == "record_id") | (
        (F.col("semantic_role") == "identifier") & (unique >= 0.995) & F.col("_search").rlike(r"(^|\s)id(\s|$)"))
    return checkpointed(rows.select(
        *columns.columns, "semantic_role", "business_role", analytical.alias("analytical_role"),
        expected.alias("expected_unique"),
        confidence_from_evidence(F.col("_score") + F.when(percent, 0.05).otherwise(0.0), F.col("non_null_count"))
        .alias("semantic_confidence")))


# ---- descriptions --------------------------------------------------------------------------

def primary_fields(roles: DataFrame, top_cover: DataFrame | None = None) -> dict[str, str | None]:
    """The main date, measure and dimension by role priority (reads one row per column)."""
    def pick(rows: DataFrame, *order: Column) -> str | None:
        row = rows.orderBy(*order, "position").first()
        return row["column"] if row else None

    def rank(words: dict[str, int]) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]),
                                       F.col("semantic_role")), F.lit(0)).desc()

    dates = roles.where("semantic_role = 'date' AND exists(array(exact_dates, partial_date_count), x -> x > 0)")
    measures = roles.where("analytical_role = 'measure' AND numeric_count IS NOT NULL")
    dimensions = roles.where("analytical_role = 'dimension' AND unique_count BETWEEN 2 AND 200")
    covered = F.col("non_null_count")
    if top_cover is not None:
        dimensions, covered = dimensions.join(top_cover, "column", "left"), F.col("covered")
    return {
        "date": pick(dates, (F.col("exact_dates") + F.col("partial_date_count")).desc()),
        "measure": pick(measures, rank({"quantity": 8, "currency": 7, "cost": 6, "measure": 5, "stock": 4,
                                        "price": 3, "duration": 2, "percentage": 1}), F.desc("numeric_count")),
        "dimension": pick(dimensions, rank({"material": 5, "category": 4, "brand": 3, "supplier": 2,
                                            "location": 1}), covered.desc()),
    }


def describe(profiled: Profile, roles: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    """Numeric columns, the top values of dimensions, and date columns."""
    dimensions = roles.where("analytical_role = 'dimension'").select("column", "semantic_role")
    return {
        "numeric": roles.where("analytical_role = 'measure' AND numeric_count IS NOT NULL").select(
            "column", "semantic_role", "numeric_count", "minimum", "maximum", "sum", "mean", "median",
            "standard_deviation", "q1", "q3", "iqr", "mad", "zero_count", "negative_count", "missing_count",
            "missing_ratio"),
        "categories": profiled.top_values(top).join(F.broadcast(dimensions), "column"),
        "dates": roles.where("semantic_role = 'date' AND exact_dates IS NOT NULL").select(
            "column", "exact_dates", "partial_date_count", "first_day", "last_day", "date_convention",
            "unique_days", "range_days"),
    }


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row that is the same for the same rows in any order and changes with any value."""
    digest = F.xxhash64(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}))
    row = df.select(digest.alias("h")).agg(
        F.count("*").alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("total"))
    return row.select("rows", F.sha2(F.concat_ws("|", "rows", "xor", "total"), 256).alias("fingerprint"))
