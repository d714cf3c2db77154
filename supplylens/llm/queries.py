"""The queries of the operators, each on its whole table, beside SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm import (
    codes, crosstokens, decontaminate, kdtree, near, neighbours, packing, quality, secrets, substrings, suffixes, topk, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(spark, table(spark, sf_dir, "documents"), width=4)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(spark, table(spark, sf_dir, "documents"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.sharded(spark, table(spark, sf_dir, "documents"))


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_strings(spark, table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(spark, table(spark, sf_dir, "documents"))


@query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(spark, table(spark, sf_dir, "documents"))


@query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.embedding_neighbours(spark, table(spark, sf_dir, "embeddings"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS node FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

SQL["op2_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
t AS (SELECT page_id, n, d, max(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to FROM t
"""

SQL["op4_benchmark_decontamination"] = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, least(10, len(ws)) AS k,
        unnest([array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') FOR i IN range(1, len(ws) - least(10, len(ws)) + 2)]) AS x
        FROM iw WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, k, unnest([{{'i': i, 'x': array_to_string(ws[i:i + k - 1], ' ')}} FOR i IN range(1, len(ws) - k + 2)]) AS p
       FROM dw, ks WHERE len(ws) >= k),
occ AS (SELECT DISTINCT doc_id, p.i AS i, win.k, item_id FROM dp JOIN win ON win.k = dp.k AND win.x = p.x),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest([{'i': i, 'x': md5(array_to_string(ws[i:i + 49], ' '))} FOR i IN range(1, len(ws) - 48)]) AS p
      FROM w WHERE len(ws) >= 50),
m AS (SELECT p.x AS x, min(doc_id) AS d FROM p GROUP BY p.x),
g AS (SELECT doc_id, list_distinct(flatten(list(range(p.i, p.i + 50)))) AS gone FROM p JOIN m ON p.x = m.x AND doc_id > d GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN ws ELSE
      [ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(gone, i)] END AS kept
      FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

SQL["op10_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.node),
c AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


@query
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark, table(spark, sf_dir, "embeddings"))


@query
def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstokens.aligned_documents(spark, table(spark, sf_dir, "documents")).drop("groups")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compressed_vectors(spark, table(spark, sf_dir, "embeddings"))
    return codes.label_errors(spark, coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


SQL["op11_exact_topk"] = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def _codes_sql(rounds: int = 6) -> str:
    """Rounds of k-means as a chain of tables."""
    steps = ["""v AS (SELECT vec_id, label, i, floor(4096 * embedding[i + 1]::DOUBLE)::HUGEINT AS x, i // (len(embedding) // 8) AS p
  FROM embeddings, range(len(embedding)) r(i)
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             """b0 AS MATERIALIZED (SELECT e, i, p, x AS c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e
  FROM (SELECT DISTINCT vec_id FROM v ORDER BY vec_id LIMIT 16)) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d
  FROM v JOIN b{r} USING (p, i) GROUP BY vec_id, p, e) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT e, i, p, coalesce(m, c) AS c FROM b{r} LEFT JOIN
  (SELECT p, i, e, floor(sum(x)::DOUBLE / count(*))::HUGEINT AS m FROM v JOIN a{r} USING (vec_id, p) GROUP BY p, i, e) USING (p, i, e))""")
    return f"""WITH {', '.join(steps)},
t AS (SELECT vec_id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT t.*, label FROM t JOIN embeddings USING (vec_id))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256 FROM l
"""


SQL["op13_vector_codes"] = _codes_sql()
