"""Numbers, dates, booleans and partial periods from text, in two dialects.

``import`` is the dialect of loading, validation, pivots and planning; ``analytics`` that
of profiling, quality, statistics and the domain indicators. They differ on purpose:
``1,234`` is 1234 in the first and 1.234 in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.text import (
    GAP, SPACE, analytics_text, clean_text, comparable_text, is_blank, let, normalize_label,
)

#: Plain numbers that both dialects read alike, without the marks that need a closer look.
PLAIN = r"^[-+]?\d{1,15}(?:\.(?:\d{1,2}|\d{4,15}))?$"
#: The same with a decimal comma, which no grouping explains.
PLAIN_COMMA = r"^[-+]?\d{1,15},(?:\d{1,2}|\d{4,15})\z"
#: Three groups of digits with one or two in the middle: no thousands marks, so never a number.
DATED = r"^\d+[-/.]\d{1,2}[-/.]\d+(?:\z|[ T]\d{1,2}:)"
#: Days as nearly all tables write them; anything else takes the long way.
DAY_FIRST = r"^\d{2}[-/.]\d{2}[-/.]\d{4}\z"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}\z"
#: A sign that no number holds in the analytics dialect, currencies and spaces among them: prose has one soon.
FOREIGN = f"[^0-9+\\-.,%€$£PLNUSDERGBZŁplnusdergbzłſ{SPACE}]"
#: What a stamp of the analytics dialect begins with.
STAMP_START = r"^ *(?:\d|[A-Za-z]{3,9}\s+\d)"
GRAMMAR = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"
EXCEL_EPOCH = "1899-12-30"

# Words that mean yes and no in each dialect.
TRUE_WORDS = {"import": ["true", "tak", "yes", "1", "y", "t"],
              "analytics": ["true", "tak", "yes", "y", "1", "prawda"]}
FALSE_WORDS = {"import": ["false", "nie", "no", "0", "n"],
               "analytics": ["false", "nie", "no", "n", "0", "falsz"]}


def _finite(number: Column) -> Column:
    limit = 1.7976931348623157e308
    return F.when(number.between(-limit, limit), number)


def _one_mark(text: Column, comma_groups: str | None, dot_groups: str) -> Column:
    """Bring decimal and thousands marks to one form: digits with a single '.'.

    Where both marks occur the last one is the decimal mark.
    """
    comma, dot = text.contains(","), text.contains(".")
    without_dots = F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    without_commas = F.replace(text, F.lit(","), F.lit(""))
    chain = F.when(comma & dot, F.when(text.rlike(r",[^.]*$"), without_dots).otherwise(without_commas))
    if comma_groups:
        chain = chain.when(comma & text.rlike(comma_groups), without_commas)
    return (chain.when(comma, F.replace(text, F.lit(","), F.lit(".")))
            .when(dot & text.rlike(dot_groups), F.replace(text, F.lit("."), F.lit(""))).otherwise(text))


def parse_number(value: Column, dialect: str = "import") -> Column:
    """A double, or NULL where the text is not a finite number."""
    raw = value.cast("string")
    if dialect == "import":
        text = F.regexp_replace(clean_text(raw), f"[%{SPACE}]", "")
        text = F.regexp_replace(text, r"^\(-(.*)\)$", "$1")
        text = F.regexp_replace(text, r"^\(\+?(.*)\)$", "-$1")
        plain = let(text, lambda t: _one_mark(t, r"^[-+]?\d{1,3}(?:,\d{3})+$", r"^[-+]?\d{1,3}(?:\.\d{3})+$"))
    else:
        text = F.regexp_replace(raw, "[€$£]", "")
        text = F.regexp_replace(text, r"(?iu)(?<![\p{L}\d_])(?:PLN|USD|EUR|GBP|ZŁ)(?![\p{L}\d_])", "")
        text = F.regexp_replace(text, f"[%{SPACE}]", "")
        plain = let(text, lambda t: _one_mark(t, None, r"^[-+]?\d{1,3}(?:\.\d{3})+(?:[eE][-+]?\d+)?$"))
    # the grammar guards the cast, which alone would accept '5d' and 'NaN'
    written = let(F.regexp_extract(plain, GRAMMAR, 0).try_cast("double"), _finite)
    comma = F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")
    readable = raw.rlike(r"\d") & ~raw.rlike(DATED)
    if dialect != "import":
        readable = ~raw.rlike(FOREIGN) & readable
    return (F.when(raw.rlike(PLAIN), raw.try_cast("double")).when(raw.rlike(PLAIN_COMMA), comma).when(readable, written))


def no_word(dialect: str) -> str:
    """Text with two digits, or more letters and digits than any word; folding drops none of ASCII."""
    longest = max(map(len, TRUE_WORDS[dialect] + FALSE_WORDS[dialect]))
    return f"[0-9][^0-9]*[0-9]|(?:[A-Za-z0-9][^A-Za-z0-9]*){{{longest + 1}}}"


def parse_bool(value: Column, dialect: str = "import") -> Column:
    word = comparable_text(value) if dialect == "import" else normalize_label(value)
    found = let(word, lambda w: F.when(w.isin(TRUE_WORDS[dialect]), True).when(w.isin(FALSE_WORDS[dialect]), False))
    return F.when(~value.cast("string").rlike(no_word(dialect)), found)


def _stamp(text: Column) -> Column:
    """``Y-M-D H:M:S`` with any tail missing, as a timestamp; NULL if impossible."""
    text = F.regexp_replace(text, r"[ :]+$", "")
    text = F.regexp_replace(text, r"( \d{1,2})$", "$1:00")
    return F.regexp_extract(text, r"^\d{4}-\d{1,2}-\d{1,2}(?: .*)?$", 0).try_cast("timestamp_ntz")


def _month_name(text: Column) -> Column:
    """English month names: ``Mon D, YYYY``, ``D Mon YYYY`` and the same with a weekday."""
    month = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
    tail = r"(?:[ T,]+(\d{1,2}:\d{2}(?::\d{2})?))?(?: ?(?:GMT|UTC|Z))?$"
    week = r"(?i)^(?:[a-z]{3,9},? )?"
    text = F.regexp_replace(text, f"{week}{month} (\\d{{1,2}}),? (\\d{{4}}){tail}", "$2 $1 $3 $4")
    text = F.regexp_replace(text, f"{week}(\\d{{1,2}})[ -]{month},?[ -](\\d{{4}}){tail}", "$1 $2 $3 $4")
    shaped = F.regexp_extract(text, r"(?i)^\d{1,2} [a-z]{3} (?:19|20)\d{2}(?: [\d:]+)?(?= ?$)", 0)
    return F.try_to_timestamp(F.nullif(shaped, F.lit("")), F.lit("d MMM yyyy[ H:m[:s]]")).cast("timestamp_ntz")


def _zoned(text: Column) -> Column:
    pattern = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
    return F.when(text.rlike(pattern), text.try_cast("timestamp").cast("timestamp_ntz"))


def excel_serial(number: Column, low: float, high: float) -> Column:
    """Days since 1899-12-30 as a timestamp, for serials strictly inside (low, high)."""
    def stamp(n: Column) -> Column:
        seconds = F.round(n * 86400).cast("bigint")
        moment = F.expr(f"timestamp_ntz'{EXCEL_EPOCH} 00:00:00'") + F.make_dt_interval(secs=seconds)
        return F.when((n > low) & (n < high), moment)

    return let(number, stamp)


def parse_timestamp(value: Column, dialect: str = "import", convention: str = "dmy",
                    serial_text: bool = True) -> Column:
    """Text to a zone-less timestamp.

    ``convention`` ('dmy' or 'mdy') only matters to the analytics dialect; the import
    dialect is always day first and, with ``serial_text``, reads digits as Excel serials.
    """
    raw = value.cast("string")
    if dialect == "import":
        found = let(clean_text(raw), lambda text: _import_stamp(text, serial_text))
        turned = F.concat_ws("-", F.substring(raw, 7, 4), F.substring(raw, 4, 2), F.substring(raw, 1, 2))
        return (F.when(raw.rlike(DAY_FIRST), turned.try_cast("timestamp_ntz")).when(raw.rlike(ISO_DAY), raw.try_cast("timestamp_ntz"))
                .when(raw.rlike(r"\d"), found))
    found = let(F.trim(raw), lambda text: _analytics_stamp(text, convention))
    return F.when(raw.rlike(STAMP_START), found)


def _import_stamp(text: Column, serial_text: bool) -> Column:
    clock = r"(?:[ T]+(\d{1,2}):?(\d{2})?(?::?(\d{2}))?)?$"
    shape = F.regexp_replace(text, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + clock, "$1-$2-$3 $4:$5:$6")
    for century, years in (("", r"\d{4}"), ("19", r"[7-9]\d"), ("20", r"[0-6]\d")):
        pattern = r"^(\d{1,2})[-/.](\d{1,2})[-/.](" + years + ")" + clock
        shape = F.regexp_replace(shape, pattern, century + "$3-$2-$1 $4:$5:$6")
    stamp = F.coalesce(_stamp(shape), F.when(text.rlike("[A-Za-z:]"), F.coalesce(_month_name(text), _zoned(text))))
    if not serial_text:
        return stamp
    digits = text.rlike(r"^\d+(?:[.,]\d+)?$")
    return F.when(digits, excel_serial(parse_number(text), 0, 2958466)).otherwise(stamp)


def _analytics_stamp(text: Column, convention: str) -> Column:
    first, second = ("$1", "$3") if convention == "mdy" else ("$3", "$1")
    clock = r"(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
    shape = F.regexp_replace(text, r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})" + clock, f"$4-{first}-{second} $5:$6:$7")
    shape = F.regexp_replace(shape, r"^(\d{1,2})([./-])(\d{1,2})\2(\d{2})" + clock, f"20$4-{first}-{second} $5:$6:$7")
    return (F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{1,2}[./-]"), _stamp(shape))
            .when(text.rlike(r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}"), _month_name(text))
            .otherwise(_zoned(text)))


def parse_date(value: Column, dialect: str = "import", convention: str = "dmy",
               serial_text: bool = True) -> Column:
    return parse_timestamp(value, dialect, convention, serial_text).cast("date")


def number_of(df: DataFrame, name: str, dialect: str = "import") -> Column:
    """The column as double: native numbers by cast, text by :func:`parse_number`."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return _finite(F.col(name).cast("double"))
    if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("double")
    return parse_number(F.col(name), dialect)


def timestamp_of(df: DataFrame, name: str, dialect: str = "import", convention: str = "dmy") -> Column:
    """The column as timestamp: native dates by cast, numbers as serials, text parsed."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        number = column.cast("double")
        if dialect == "import":
            return excel_serial(number, 0, 2958466)
        epoch = F.timestamp_millis(F.when(number > 1e11, number).cast("bigint")).cast("timestamp_ntz")
        return F.coalesce(excel_serial(number, 20000, 100000), epoch)
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("timestamp_ntz")
    return parse_timestamp(column, dialect, convention)


def date_of(df: DataFrame, name: str, dialect: str = "import", convention: str = "dmy") -> Column:
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.col(name)
    return timestamp_of(df, name, dialect, convention).cast("date")


_TAIL = r"(?:\s*[-/]?\s*(\d{4}))?$"
_WEEK = (r"(?i)^(?:week|wk|cw|tydz(?:ien)?|tyg(?:odzien)?)\s*[-: ]?\s*(0?[1-9]|[1-4]\d|5[0-3])" + _TAIL)
_MONTH = r"(?i)^(?:month|miesiac|miesiąc)\s*[-: ]?\s*(0?[1-9]|1[0-2])" + _TAIL


def is_period(value: Column) -> Column:
    """True for text that names a week or a month without an exact day."""
    begins = F.coalesce(value.cast("string").rlike(rf"(?i)^{GAP}*(?:week|wk|cw|ty[dg]|month|miesi)"), F.lit(False))
    return begins & F.coalesce(analytics_text(value).rlike(f"{_WEEK}|{_MONTH}"), F.lit(False))


def parse_period(value: Column, reference_year: int | None = None) -> Column:
    """``week 35`` / ``month 3 2026`` as struct<type,week,month,year,label>, else NULL."""
    none, fallback = F.lit(None).cast("int"), F.lit(reference_year).cast("int")

    def token(text: Column, kind: str, pattern: str, label: str, joiner: str) -> Column:
        number = F.regexp_extract(text, pattern, 1).try_cast("int")
        year = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), fallback)
        caption = F.concat(F.lit(label), F.lpad(number.cast("string"), 2, "0"),
                           F.coalesce(F.concat(F.lit(joiner), year.cast("string")), F.lit("")))
        return F.when(text.rlike(pattern), F.struct(
            F.lit(kind).alias("type"),
            (number if kind == "iso_week" else none).alias("week"),
            (number if kind == "month" else none).alias("month"),
            year.alias("year"), caption.alias("label")))

    return let(analytics_text(value), lambda text: F.coalesce(
        token(text, "iso_week", _WEEK, "W", " "), token(text, "month", _MONTH, "", "/")))


def resolve_period(value: Column, reference_year: int | None = None) -> Column:
    """First day of the period: the Monday of an ISO week, or day 1 of a month."""
    def first_day(token: Column) -> Column:
        fourth = F.make_date(token["year"], F.lit(1), F.lit(4))
        monday = F.date_add(F.trunc(fourth, "week"), (token["week"] - 1) * 7)
        month = F.make_date(token["year"], token["month"], F.lit(1))
        return F.when(token["type"] == "iso_week", monday).when(token["type"] == "month", month)

    return let(parse_period(value, reference_year), first_day)


def convention_evidence(text: Column) -> dict[str, Column]:
    """Per-value evidence for the day/month order; sum it over a column."""
    text = F.trim(text.cast("string"))
    low, high, tail = r"(?:0?\d|1[0-2])", r"(?:1[3-9]|[2-9]\d)", r"\d{2,4}(?:\s|$)"

    def points(pattern: str, weight: float) -> Column:
        return F.when(text.rlike(pattern), weight).otherwise(F.lit(0.0))

    month_first = f"^{low}([./-]){high}\\1{tail}"
    day_first = F.when(text.rlike(f"^{high}([./-]){low}\\1{tail}"), 3.0)
    dotted = text.rlike(f"^\\d{{1,2}}\\.\\d{{1,2}}\\.{tail}") & ~text.rlike(month_first)
    return {
        "ymd": points(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}", 1.0),
        "mdy": points(month_first, 3.0),
        "dmy": day_first.when(dotted, 0.75).otherwise(F.lit(0.0)),
        "seen": points(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}|^\d{1,2}([./-])\d{1,2}\1" + tail, 1.0),
    }


def convention_from(ymd: Column, mdy: Column, dmy: Column, seen: Column) -> tuple[Column, Column]:
    """Convention and its confidence from the summed evidence."""
    def share(part: Column, whole: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.55), part / F.greatest(F.lit(1.0), whole)))

    by_year = ymd > F.greatest(dmy, mdy)
    convention = F.when(by_year, "ymd").when(mdy > dmy, "mdy").otherwise("dmy")
    confidence = (F.when(by_year, share(ymd, seen)).when(mdy > dmy, share(mdy, mdy + dmy))
                  .when(dmy > 0, share(dmy, mdy + dmy)).when(seen > 0, 0.5).otherwise(0.35))
    return convention, confidence


def infer_date_convention(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: ``column, convention, confidence``; blank cells do not count."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(name).cast("string").alias("value"))
        for name in columns])))
    evidence = convention_evidence(F.when(~is_blank(F.col("value")), F.col("value")))
    sums = cells.groupBy("column").agg(
        *[F.coalesce(F.sum(part), F.lit(0.0)).alias(name) for name, part in evidence.items()])
    convention, confidence = convention_from(*[F.col(n) for n in ("ymd", "mdy", "dmy", "seen")])
    return sums.select("column", convention.alias("convention"), confidence.alias("confidence"))
