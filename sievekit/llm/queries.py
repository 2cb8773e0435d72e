"""The queries of the llm operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe, embed_dedup, layout, lm, packing, pieces, quality, secrets, simhash, substring, topk, toxicity, whitening
from sievekit.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.classify(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_layout(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_embed_dedup": op2_embed_dedup,
    "op3_topk": op3_topk,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_substring": op6_substring,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_lm": op9_lm,
    "op10_toxicity": op10_toxicity,
    "op11_layout": op11_layout,
    "op12_pieces": op12_pieces,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embed_dedup": """
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
reach(u, w) AS (SELECT u, w FROM links UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u),
least AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(w, vec_id)) AS component_id, vec_id <= coalesce(w, vec_id) AS kept FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN degree ON degree.u = vec_id""",
    "op3_topk": """
WITH good AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
products AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank FROM products)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_substring": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (h), range(0, 50) t(k) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op11_layout": """
WITH d AS (SELECT doc_id, encode(source) AS s, encode(lang) AS g, coalesce(strlen(text), -1) AS n,
  xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b)), CAST(4294967295 AS BIGINT))) % 365 AS t FROM documents),
c AS (SELECT doc_id, 16 * (rank() OVER (ORDER BY s NULLS FIRST) - 1) // count(*) OVER () AS s, 16 * (rank() OVER (ORDER BY g NULLS FIRST) - 1) // count(*) OVER () AS g,
  16 * (rank() OVER (ORDER BY n) - 1) // count(*) OVER () AS n, 16 * (rank() OVER (ORDER BY t NULLS FIRST) - 1) // count(*) OVER () AS t FROM d),
z AS (SELECT *, list_sum(list_transform(range(4), lambda b: ((s // (1 << b)) % 2 * 8 + (g // (1 << b)) % 2 * 4 + (n // (1 << b)) % 2 * 2 + (t // (1 << b)) % 2) * (1 << (4 * b)))) AS z FROM
  (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(g AS BIGINT) AS g, CAST(n AS BIGINT) AS n, CAST(t AS BIGINT) AS t FROM c)),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM z),
f AS (SELECT position // 1000 AS file, min(s) AS s0, max(s) AS s1, min(g) AS g0, max(g) AS g1, min(n) AS n0, max(n) AS n1, min(t) AS t0, max(t) AS t1 FROM p GROUP BY ALL),
cells AS (SELECT DISTINCT z, s, g, n, t FROM p), held AS (SELECT DISTINCT position // 1000 AS file, s, g, n, t FROM p),
touched AS (SELECT z, count(*) AS files FROM cells JOIN f ON s BETWEEN s0 AND s1 AND g BETWEEN g0 AND g1 AND n - 2 <= n1 AND n + 2 >= n0 AND t - 2 <= t1 AND t + 2 >= t0 GROUP BY z),
matching AS (SELECT z, count(DISTINCT file) AS files FROM cells a JOIN held b ON a.s = b.s AND a.g = b.g AND abs(a.n - b.n) <= 2 AND abs(a.t - b.t) <= 2 GROUP BY z)
SELECT doc_id, CAST(p.z AS BIGINT) AS z, position, file, touched.files AS files_touched, matching.files AS files_matching, concat_ws(',', s0, s1, g0, g1, n0, n1, t0, t1) AS file_bounds
FROM p JOIN f ON file = position // 1000 JOIN touched ON touched.z = p.z JOIN matching ON matching.z = p.z""",
}
