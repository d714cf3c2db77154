import random

import corpus_pipeline
from supplylens.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    rows = [(k, prose(80), "en", "s", 1, "x") for k in range(60)]
    rows += [(100 + k, " ".join(f"{w}###" for w in prose(60).split()), "en", "s", 1, "x") for k in range(40)]
    passage = prose(12)
    rows += [(200, rows[3][1], "en", "s", 1, "x"), (201, f"{prose(50)} {passage} {prose(50)}", "en", "s", 1, "x"),
             (202, f"{prose(60)} password=abcdef123456", "en", "s", 1, "x"), (203, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows[:100]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append({r.doc_id: r for r in docs.collect()})
    good = set(range(60))
    assert good <= set(steps[0]) and not set(range(100, 140)) & set(steps[0])
    assert good <= set(steps[1]) and 200 not in steps[1]
    assert good <= set(steps[2]) and 201 not in steps[2]
    assert "abcdef123456" not in steps[3][202].text and steps[3][202].n_chars == len(steps[3][202].text)
    assert good | {202} <= set(steps[4]) and all(r.length <= 2048 for r in steps[4].values())


def test_every_number_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
