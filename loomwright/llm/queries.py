"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, html_extract, language_id, mixing, packing, pii, topk, url_filter
from .common import new_path
from .embedding_dedup import near_vectors
from .jaccard_join import near_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("component")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.dealt(mixing.mix(_table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dac")
    dac.write(_table(spark, sf_dir, "documents"), path, vocabulary())
    return dac.documents(spark, path)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_embedding_dedup, op2_jaccard_join, op3_language_id, op4_url_filter, op5_pii, op6_mixing, op7_packing, op8_html_extract, op9_dac_tokens, op10_topk)
    return {f.__name__: f for f in every}


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT l.i, reach.r FROM reach JOIN l ON l.j = reach.vec_id),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT i, count(*) AS n_links FROM l GROUP BY i)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON i = vec_id
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, array_to_string(w, ' ') AS k, w FROM d WHERE len(w) > 0),
c AS (SELECT k, min(doc_id) AS rep, count(DISTINCT doc_id) AS n, any_value(w) AS w FROM t GROUP BY k),
s AS (SELECT DISTINCT rep, sh FROM (SELECT rep, unnest(CASE WHEN len(w) < 5 THEN [k] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM c)),
z AS (SELECT rep, count(*) AS m FROM s GROUP BY rep),
common AS (SELECT a.rep AS i, b.rep AS j, count(*) AS n FROM s a JOIN s b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS (SELECT i, j FROM common JOIN z x ON x.rep = i JOIN z y ON y.rep = j WHERE n::DOUBLE / (x.m + y.m - n) >= 0.8),
reach AS (SELECT rep, rep AS r FROM c UNION SELECT l.i, reach.r FROM reach JOIN l ON l.j = reach.rep),
g AS (SELECT rep, min(r) AS class_id FROM reach GROUP BY rep),
o AS (SELECT l.i AS rep, sum(c.n) AS links FROM l JOIN c ON c.rep = l.j GROUP BY l.i),
f AS (SELECT k, class_id, coalesce(links, 0) + n - 1 AS n_links, n FROM c JOIN g USING (rep) LEFT JOIN o USING (rep))
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n, 1)::BIGINT AS n_copies
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN f ON f.k = t.k
"""

#: Absolute targets only: relative ones are held against a plain union-find in the tests.
OP4_SQL = r"""
WITH RECURSIVE r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
e AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')),
x AS (SELECT url, CASE WHEN tag ILIKE '<link%' THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?i)url\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS target
      FROM e WHERE regexp_matches(tag, '(?i)\srel\s*=\s*["'']?\s*canonical|\shttp-equiv\s*=\s*["'']?\s*refresh')),
u AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM x)),
p AS (SELECT url, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
      lower(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)) || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS node FROM u),
m AS (SELECT url, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY url ORDER BY length(rhost || rpath) DESC, verdict) AS k
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
b AS (SELECT p.url, node, host, path, rule, verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) w ON w.url = p.url),
l AS (SELECT DISTINCT s.node AS i, t.node AS j FROM x JOIN b s ON s.url = x.url JOIN b t ON t.url = x.target WHERE s.host <> '' AND t.host <> ''),
bad AS (SELECT node FROM b WHERE verdict = 'block' AND host <> '' UNION SELECT CASE WHEN l.i = bad.node THEN l.j ELSE l.i END FROM bad JOIN l ON bad.node IN (l.i, l.j))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN host <> '' AND node IN (SELECT node FROM bad WHERE node IS NOT NULL AND node IN (SELECT i FROM l UNION SELECT j FROM l)) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN b ON b.url = pages.url
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express whole; the others are held against plain versions in the tests."""
    return {"op1_embedding_dedup": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op4_url_filter": OP4_SQL, "op10_topk": OP10_SQL}
