"""Short ways of the parsers against the long ones, and types from merged texts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from supplylens.functions import parse
from supplylens.sources import grid


def texts():
    rng = random.Random(5)
    pieces = ["0", "1", "12", "031", "2001", "1234567", ".", ",", "-", "/", "+", " ", ":", "T", "e5", "(", ")", "%", "tak", "Nie", "Ł", "\n", " ", "y"]
    found = {"".join(rng.choice(pieces) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6) for _ in range(700)}
    found |= {f"{a}{s}{b}{t}{c}{e}" for a, b, c, s, t, e in itertools.product(("1", "31", "2001"), ("2", "02", "13"), ("01", "2001", "333", "0000"), "-/.", "-/.", ("", " 12:30", ",5", "\n"))}
    found |= {"prawda", "fałsz", "T R U E", "t-a-k", "1,5", "1,234", "-1,2345", "1,234,5", "12,345.6", "1.22.333,5", " tak ", "1.", "1,\n", "17,0\n", "NULL", ""}
    return sorted(found)


@pytest.mark.parametrize("dialect", ["import", "analytics"])
def test_short_ways_read_as_the_long_ones(spark, monkeypatch, dialect):
    data = spark.createDataFrame([(t,) for t in texts()] + [(None,)], "t string")

    def read():
        t = F.col("t")
        return {r.t: tuple(r)[1:] for r in data.select(
            "t", parse.parse_number(t, dialect), parse.parse_bool(t, dialect), parse.parse_timestamp(t, dialect).cast("string"),
            parse.parse_timestamp(t, dialect, serial_text=False).cast("string")).collect()}

    short = read()
    for name in ("PLAIN_COMMA", "DATED", "DAY_FIRST", "ISO_DAY", "no_word"):
        monkeypatch.setattr(parse, name, "(?!)" if name != "no_word" else lambda dialect: "(?!)")
    assert short == read()


def test_types_from_merged_texts(rows):
    data = [(f"0{1 + i % 9}.03.2001", "1,5" if i % 2 else "x", "tak", None, float(i), i % 2 == 0) for i in range(400)]
    df = rows(data, "d string, m string, b string, e string, n double, t boolean")
    found = grid.infer_types(df)
    got = {r.column: (r.type, r.text, r.number, r.date, r.boolean) for r in found.collect()}
    assert got == {"d": ("date", 0, 0, 400, 0), "m": ("mixed", 200, 200, 0, 0), "b": ("boolean", 0, 0, 0, 400), "e": ("empty", 0, 0, 0, 0),
                   "n": ("number", 0, 400, 0, 0), "t": ("boolean", 0, 0, 0, 400)}
    # equal texts meet before they are typed: the first aggregate is on the values
    assert "value" in found._jdf.queryExecution().analyzed().toString().split("Aggregate [column")[-1][:60]
