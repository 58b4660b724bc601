"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, dedup, html, language, mixing, neardup, quality, tokens, topk, toxicity
from tracelake.llm._spark import crc_bucket, small_batches, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup.remove_repeats(table(spark, sf_dir, "documents"), window=400, digest=True, note_words=dedup.PASSAGE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit_toxicity_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html.extract_text(table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=4)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = language.fit_language_model(docs, ~held_out)
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_full")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, F.col("vec_id") % 50 == 0, k=5)


OP2_SQL = r"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents
), seg AS (  -- 1000 window starts a row, so that substr() has little to skip
  SELECT r, g AS base, substr(x, 2 * g + 1, 2798) AS s FROM raw, unnest(generate_series(0, len(x) // 2 - 400, 1000)) AS q(g)
), win AS (
  SELECT r, base + p AS a, hash(substr(s, 2 * p + 1, 800)) AS h FROM seg, unnest(generate_series(0, least(999, len(s) // 2 - 400))) AS q(p)
), again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT r, a, a > coalesce(lag(a) OVER (PARTITION BY r ORDER BY a), -401) + 400 AS fresh FROM win SEMI JOIN again USING (h)
), isle AS (SELECT r, a, sum(fresh::int) OVER (PARTITION BY r ORDER BY a) AS i FROM hit
), span AS (SELECT r, i, min(a) AS a, max(a) + 400 AS z FROM isle GROUP BY r, i
), rest AS (  -- the bytes before each span, and those behind the last
  SELECT raw.r, i, substr(x, 2 * f + 1, 2 * (a - f)) AS b FROM raw JOIN (SELECT r, i, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM span) USING (r)
  UNION ALL SELECT raw.r, NULL, substr(x, 2 * coalesce(z, 0) + 1) FROM raw LEFT JOIN (SELECT r, max(z) AS z FROM span GROUP BY r) USING (r)
), left_over AS (SELECT r, sha256(unhex(string_agg(b, '' ORDER BY i NULLS LAST))) AS s FROM rest GROUP BY r
), total AS (SELECT r, sum(z - a) AS n, count(*) AS k FROM span GROUP BY r
), dw AS (SELECT r, regexp_extract_all(t, '[^\x{20}\x{09}-\x{0D}]+') AS w FROM raw
), wwin AS (SELECT r, hash(array_to_string(w[p:p + 48], ' ')) AS h FROM dw, unnest(generate_series(1, len(w) - 48)) AS q(p)
), noted AS (SELECT DISTINCT r FROM wwin SEMI JOIN (SELECT h FROM wwin GROUP BY h HAVING count(*) > 1) USING (h)
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, s AS kept_sha256, noted.r IS NOT NULL AS repeats_passage
FROM raw JOIN left_over USING (r) LEFT JOIN total USING (r) LEFT JOIN noted USING (r)
"""

OP6_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(4, len(w)) - 1], ' ') AS s
  FROM dw, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS t(p) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT x, y FROM both_have JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), reach(d, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, link.y FROM reach JOIN link ON reach.r = link.x
), comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, documents.doc_id = c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON comp.d = documents.doc_id
"""

OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), bwin AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
  FROM bw, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(p) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM bwin
), dwin AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM dw, ks, unnest(generate_series(1, len(w) - k + 1)) AS t(p) WHERE len(w) >= k
), occ AS (SELECT d.doc_id, d.p, d.k, b.item_id FROM dwin d JOIN bwin b ON d.k = b.k AND d.win = b.win
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, k FROM occ) o, unnest(generate_series(p, p + k - 1)) AS t(q) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) x GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_token_counts, op2_suffix_dedup, op3_toxicity, op4_html_extraction, op5_source_mixing, op6_minhash_neardup, op7_quality, op8_language_id, op9_decontamination, op10_exact_topk)
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op6_minhash_neardup": OP6_SQL, "op9_decontamination": OP9_SQL, "op10_exact_topk": OP10_SQL}
