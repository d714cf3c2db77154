"""Statistics of texts as written: blank ones count, and so do texts that read as numbers, days or periods."""

import duckdb
import pytest

import __spark_entry__ as entry
from supplylens.operators import profile

TEXTS = {
    "blank": ["", " ", "\n\t", " ", "abc", "de fg", None],
    "only blank": ["", "  "],
    "numbers": ["1", "22", "333", "4,5"],
    "days": ["2024-01-02", "5.3.2024", "5.3.2024"],
    "periods": ["week 3", "month 5"],
    "missing": [None],
    "no rows": [],
    "tie": ["a"] * 771 + ["aa"] * 29,  # a mean of 1.03625: its double times 10,000 lies off the tie
}


@pytest.mark.parametrize("name", TEXTS)
def test_text_statistics_equals_its_sql(spark, rows, tmp_path, name):
    rows([(t,) for t in TEXTS[name]], "text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["text_statistics"]).fetchall()
    assert [tuple(r) for r in entry.queries()["text_statistics"](spark, str(tmp_path)).collect()] == want


def test_blank_texts_are_missing_unless_asked_for(rows):
    df = rows([("a  b", 10), ("a  b", 2), (" ", 2), ("", None)], "t string, i int")
    got = {r["column"]: tuple(r)[1:] for r in profile.text_stats(df).collect()}
    assert got == {"t": (2, 4, 4, 4.0, 1, 2), "i": (3, 1, 2, 4 / 3, 2, 0)}
    assert tuple(profile.text_stats(df, ["t"], blanks=True).first()) == ("t", 4, 0, 4, 2.25, 3, 3)
    seen = profile.profile(df, ["t"]).columns.first()
    assert (seen.minimum_length, seen.maximum_length, seen.average_length, seen.unique_count, seen.whitespace_issues) == (4, 4, 4.0, 1, 2)
