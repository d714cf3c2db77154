import __spark_entry__ as entry
from supplylens import registry


def test_every_query_is_registered_once_and_sql_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries)
    without = {"findings_of_usage", "findings_of_quality", "automatic_insights"}
    # the optional corpus queries are tested against brute force in tests/llm
    assert set(registry.QUERIES) - set(sql) == without


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["material_key", "used", "share", "cumulative_share", "classification"]
    assert got.count() == 200 and {r.classification for r in got.collect()} == {"A", "B", "C"}
