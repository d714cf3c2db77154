import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplylens.functions import dates, exprs, parse, text

NUMBERS = [  # text, import dialect, analytics dialect
    ("1 234,50", 1234.5, 1234.5), ("1,234", 1234.0, 1.234), ("1.234", 1234.0, 1234.0),
    ("1.234.567,8", 1234567.8, 1234567.8), ("1,234.5", 1234.5, 1234.5), ("(123)", -123.0, None),
    ("(-5)", 5.0, None), ("12%", 12.0, 12.0), ("1e3", 1000.0, 1000.0), ("5d", None, None),
    ("NaN", None, None), ("", None, None), ("5.", 5.0, 5.0), (".5", 0.5, 0.5), ("1,234,567", 1234567.0, None),
    ("1,23,4", None, None), ("1.2,345", 12.345, 12.345), ("1,2.345", 12.345, 12.345),
    ("1.234,567,890", None, None), ("5 ZŁ", None, 5.0), ("1 234,50 PLN", None, 1234.5), ("€12", None, 12.0),
    ("true", None, None), ("1e400", None, None), (None, None, None),
]


def test_numbers_in_both_dialects(rows):
    df = rows([(v,) for v, _, _ in NUMBERS], "v string")
    got = df.select(parse.parse_number(F.col("v")), parse.parse_number(F.col("v"), "analytics")).collect()
    assert [tuple(r) for r in got] == [(a, b) for _, a, b in NUMBERS]


DATES = [  # text, import, analytics dmy, analytics mdy
    ("2024-02-29", "2024-02-29", "2024-02-29", "2024-02-29"), ("2025-02-31", None, None, None),
    ("2024/1/5", "2024-01-05", None, None), ("02.03.2026", "2026-03-02", "2026-03-02", "2026-02-03"),
    ("5.3.71", "1971-03-05", "2071-03-05", "2071-05-03"), ("2/23/2026", None, None, "2026-02-23"),
    ("45000", "2023-03-15", None, None), ("January 5, 2024", "2024-01-05", "2024-01-05", "2024-01-05"),
    ("5 Mar 2024", "2024-03-05", None, None), ("2024-01-01T10:00:00Z", "2024-01-01", "2024-01-01", "2024-01-01"),
    ("week 35", None, None, None), ("", None, None, None), (None, None, None, None),
]


def test_dates_in_both_dialects(rows):
    df = rows([(d[0],) for d in DATES], "v string")
    v = F.col("v")
    got = df.select(*[c.cast("string") for c in (
        parse.parse_date(v), parse.parse_date(v, "analytics"), parse.parse_date(v, "analytics", "mdy"))]).collect()
    assert [tuple(r) for r in got] == [d[1:] for d in DATES]


def test_native_values(rows):
    df = rows([(45000.0, True, dt.date(2024, 1, 2))], "n double, b boolean, d date")
    row = df.select(parse.date_of(df, "n").cast("string").alias("a"), parse.number_of(df, "b").alias("b"),
                    parse.date_of(df, "n", "analytics").cast("string").alias("c"), parse.number_of(df, "d").alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("2023-03-15", None, "2023-03-15", None)


def test_periods_and_convention(rows):
    df = rows([("week 35",), ("CW-7 2025",), ("month 3 2026",), ("week 60",), ("tydz 1",)], "v string")
    got = df.select(parse.parse_period(F.col("v"), 2026)["label"], parse.resolve_period(F.col("v"), 2026).cast("string"),
                    parse.is_period(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("W35 2026", "2026-08-24", True), ("W07 2025", "2025-02-10", True),
                                       ("03/2026", "2026-03-01", True), (None, None, False), ("W01 2026", "2025-12-29", True)]
    us = rows([("2/23/2026", "1.2.2026"), ("3/4/2026", "13.2.2026")], "a string, b string")
    found = {r.column: r.convention for r in parse.infer_date_convention(us, ["a", "b"]).collect()}
    assert found == {"a": "mdy", "b": "dmy"}


def test_booleans_and_text(rows):
    df = rows([("Tak",), ("fałsz",), ("T",), ("prawda",), ("?",)], "v string")
    got = df.select(parse.parse_bool(F.col("v")), parse.parse_bool(F.col("v"), "analytics")).collect()
    assert [tuple(r) for r in got] == [(True, True), (None, False), (True, None), (None, True), (None, None)]
    df = rows([("  Łódź  Ąę\x07 – kůň A_B",)], "v string")
    row = df.select(text.clean_text(F.col("v")), text.comparable_text(F.col("v")), text.normalize_label(F.col("v")),
                    text.normalize_key(F.col("v"), "sku")).first()
    assert tuple(row) == ("Łódź Ąę – kůň A_B", "lodz ae - kun a b", "lodz ae kun a b", "ŁÓDŹĄĘ–KŮŇA_B")


@pytest.mark.parametrize("day, season, period, key, week", [
    ("2025-12-31", "Zima", "Zima 2025/2026", 20254, "2026-W01"), ("2026-02-01", "Zima", "Zima 2025/2026", 20254, "2026-W05"),
    ("2026-03-01", "Wiosna", "Wiosna 2026", 20261, "2026-W09"), ("2026-11-30", "Jesień", "Jesień 2026", 20263, "2026-W49"),
    ("2027-01-01", "Zima", "Zima 2026/2027", 20264, "2026-W53")])
def test_date_fields(rows, day, season, period, key, week):
    row = dates.derive_date_fields(rows([(dt.date.fromisoformat(day),)], "date date")).first()
    assert (row.season, row.season_period, row.season_sort_key, row.week_key) == (season, period, key, week)
    assert row.weekday_number == dt.date.fromisoformat(day).isoweekday()
    empty = dates.derive_date_fields(rows([(None,)], "date date")).first().asDict()
    assert all(v is None for v in empty.values())


def test_period_keys_and_granularity(rows):
    df = rows([(dt.date(2026, 5, 3),)], "d date")
    got = df.select(*[dates.period_key(F.col("d"), g) for g in ("day", "week", "month", "quarter", "year")]).first()
    assert tuple(got) == ("2026-05-03", "2026-W18", "2026-05", "2026-Q2", "2026")
    spans = rows([(dt.date(2026, 1, 1), dt.date(2026, 1, 1) + dt.timedelta(n)) for n in (62, 63, 240, 241, 1460, 1461)],
                 "a date, b date")
    got = [r[0] for r in spans.select(dates.granularity_for(F.col("a"), F.col("b"))).collect()]
    assert got == ["day", "week", "week", "month", "month", "quarter"]


def test_expressions(rows):
    df = rows([(1.005, -1.5, 149.0, "false", None, "5", "abc", dt.date(2024, 3, 1))],
              "a double, b double, c double, t string, n double, s string, w string, d date")
    e = exprs.Expressions(df)
    c = F.col
    row = df.select(
        e.round(c("a"), 2), e.round(c("b")), e.round(c("c"), -1), e.if_(c("t"), 1, 0), e.min(c("n"), 5),
        e.pow(2.0, e.pow(3.0, 2.0)), e.neg(e.pow(2.0, 2.0)), e.add(c("s"), c("c")), e.add(c("a"), 1.0),
        e.div(1.0, 0.0), e.abs(c("w")), e.len(c("n")), e.concat(c("s"), c("n"), c("w")), e.isblank(c("n")),
        e.coalesce(F.lit(""), c("w")), e.iferror(e.div(1.0, 0.0), 7.0)).first()
    assert tuple(row) == (1.01, -2.0, 150.0, 0, 5.0, 512.0, -4.0, "5149", 2.005, None, 0.0, 0, "5abc", True, "abc", 7.0)
    row = df.select(e.compare(c("s"), "=", 5.0), e.compare(c("w"), "=", "ABC"), e.compare(c("d"), ">", "2024-02-01"),
                    e.compare(c("w"), "!=", 5.0), e.compare("1.2.2024", "<", "2.2.2024"), e.date_diff_days(c("d"), "2024-02-01"),
                    e.not_(c("t")), e.and_(c("s"), c("w"))).first()
    assert tuple(row) == (True, True, True, True, True, 29, True, True)


def test_calculated_columns_follow_dependencies(rows):
    df = rows([(30.0,)], "quantity double")
    row = exprs.calculate(df, {
        "b": (["a"], lambda e: e.add(F.col("a"), 1.0), "number"),
        "a": (["quantity"], lambda e: e.mul(F.col("quantity"), 2.0), "number")}).first()
    assert (row.a, row.b) == (60.0, 61.0)
    with pytest.raises(ValueError):
        exprs.calculate(df, {"x": (["y"], lambda e: F.col("y"), "number"), "y": (["x"], lambda e: F.col("x"), "number")})


def test_text_of_any_length_is_cleaned(spark):
    from pyspark.sql import functions as F

    from supplylens.functions.text import analytics_text, clean_text
    long = "word " * 200_000
    frame = spark.createDataFrame([(long,), (long.strip(),), ("a\u00a0 b",), ("abc\n",)], "t string")
    got = frame.select(clean_text(F.col("t")).alias("a"), analytics_text(F.col("t")).alias("b")).collect()
    assert got[0].a == got[1].a == got[1].b == long.strip() and got[2].a == "a b" and got[3].a == "abc"
