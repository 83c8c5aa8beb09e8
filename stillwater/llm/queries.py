"""The thin queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm._bpe import tokenizer_path
from stillwater.llm._scratch import Scope, materialize, new_path
from stillwater.llm.decontaminate import find_leaks
from stillwater.llm.language_id import fold, identify_languages
from stillwater.llm.ngram_join import ngram_components
from stillwater.llm.quality import fit_quality, grades, score_quality
from stillwater.llm.source_mix import mix_sources
from stillwater.llm.substring_dedup import deduplicate
from stillwater.llm.token_counts import token_counts
from stillwater.llm.token_files import read_tokens, write_tokens
from stillwater.llm.vector_topk import vector_topk
from stillwater.llm.warc_audit import audit, in_order, leaves, merkle_tree, warc_records
from stillwater.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), links=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_tokens(spark, path, digest=True)


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scope(spark) as tables:
        # the replica: one byte of every 97th record is damaged; its records are hashed where they are, too
        damaged = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit(bytearray(b"#")), F.expr("substring(record, octet_length(record) - 3, 4)"))
        records = warc_records(table(spark, sf_dir, "pages"))
        replica = F.sha2(F.when(F.col("page_id") % 97 == 3, damaged).otherwise(F.col("record")), 256)
        archive = materialize(in_order(records.withColumn("replica", replica).drop("record")), "archive")
        found = audit(merkle_tree(leaves(archive, "digest")), merkle_tree(leaves(archive, "replica"))).select("idx", F.lit(False).alias("ok"))
        rows = archive.join(found, F.col("pos") == F.col("idx"), "left")
        return tables.keep(rows.select("page_id", "offset", "n_bytes", "digest", F.coalesce("ok", F.lit(True)).alias("intact")))


OP5_SQL = """
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages)
SELECT page_id, CAST(sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record) AS BIGINT) AS "offset",
  CAST(strlen(record) AS BIGINT) AS n_bytes, sha256(record) AS digest, page_id % 97 <> 3 AS intact
FROM r
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, grades(table(spark, sf_dir, "labels")), 3)
    scored = score_quality(docs, model, 3)
    return scored.select("doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", F.coalesce(F.col("p_at_least_2") >= 0.5, F.lit(True)).alias("kept"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), digest=True)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), fold())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_token_counts, op3_vector_topk, op4_token_files, op5_warc_audit, op6_quality, op7_decontaminate, op8_substring_dedup, op9_source_mix, op10_language_id)}

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: words of the documents, and their distinct 5-word shingles (of fewer words, all of them)
OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(x) >= 5 THEN list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')))
    WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM s JOIN c ON c.a = s.doc_id LEFT JOIN l ON l.a = s.doc_id
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
v AS (
  SELECT doc_id, unnest(range(1, len(x) - 11)) AS i, unnest(list_transform(range(1, len(x) - 11), lambda i: array_to_string(x[i:i + 12], ' '))) AS t
  FROM d WHERE len(x) >= 13),
f AS (SELECT t, min(doc_id) AS first FROM v GROUP BY t),
c AS (SELECT DISTINCT v.doc_id, unnest(range(v.i, v.i + 13)) AS i FROM v JOIN f ON v.t = f.t AND f.first < v.doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(x) AS n, coalesce(len(gone), 0) AS r,
    array_to_string(CASE WHEN gone IS NULL THEN x ELSE list_transform(list_sort(list_filter(range(1, len(x) + 1), lambda i: NOT list_contains(gone, i))), lambda i: x[i]) END, ' ') AS kept
  FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""

SQL: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op3_vector_topk": OP3_SQL, "op5_warc_audit": OP5_SQL, "op8_substring_dedup": OP8_SQL}
