"""Long texts are judged by their beginning before they are folded or parsed."""

from pyspark.sql import functions as F

from supplylens.functions.parse import is_period, parse_date, parse_number
from supplylens.operators import profile


def test_starts_decide_like_the_whole_text(rows):
    texts = ["1 234,5 zł", "PLN 7", "uſd 3", "brak 5", " \x01 Week 35", "weekly", "  2024-02-03", "May 5, 2024", "x 2024-02-03", None]
    got = rows([(t,) for t in texts], "t string").select(
        parse_number(F.col("t"), "analytics"), parse_date(F.col("t"), "analytics").cast("string"), is_period(F.col("t"))).collect()
    assert [r[0] for r in got] == [1234.5, 7.0, 3.0, None, None, None, None, None, None, None]
    assert [r[1] for r in got] == [None] * 6 + ["2024-02-03", "2024-05-05", None, None]
    assert [r[2] for r in got] == [False] * 4 + [True] + [False] * 5


def test_most_frequent_values_are_not_grouped_again(rows):
    values = profile.value_table(rows([("a",), ("b",), ("b",), (" ",)], "t string"))
    assert [tuple(r) for r in profile.top_values(values, 2).orderBy("place").collect()] == [("t", 1, "b", 2), ("t", 2, "a", 1)]
    plan = profile.top_values(values, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
