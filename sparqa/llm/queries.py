"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit_packing, dual_tree_search, embedding_whitening, flow_resharding, license_scan, line_blocks, piece_nbest, quality_rules,
               quotation_linking, setsketch_dedup, simhash_dedup, substring_dedup, token_alignment)
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_search.top_k(table(spark, sf_dir, "embeddings"))


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = substring_dedup.repeat_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_linking.link(table(spark, sf_dir, "conversations"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.packed_sequences(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the model's encoding and the scores of the three best segmentations."""
    return piece_nbest.encode_table(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ["doc_id"])


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_resharding.reshard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's rows; a deviation past 64 bits, which takes some 10^8 rows, is null here and exact in ``whiten``."""
    white = embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_dual_tree_search, op2_line_blocks, op3_license_scan, op4_substring_dedup, op5_quotation_linking, op6_simhash_dedup,
        op7_best_fit_packing, op8_piece_nbest, op9_flow_resharding, op10_quality_rules, op11_token_alignment, op12_embedding_whitening,
        op13_setsketch_dedup)
}

OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), k AS (
  SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM t
), c AS (
  SELECT win, count(*) AS starts FROM k WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1
), m AS (
  SELECT k.doc_id, k.i, k.word, max(CASE WHEN c.starts IS NOT NULL THEN k.i END)
    OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS hit
  FROM k LEFT JOIN c ON k.win = c.win
)
SELECT d.doc_id, count(m.i) AS n_words, count(m.hit) AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE m.hit IS NULL AND m.i IS NOT NULL), '')) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d
), u AS (
  SELECT r, unnest(s) AS x FROM g
), p AS (
  SELECT a.r AS a, b.r AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN g x ON x.r = a JOIN g y ON y.r = b WHERE 100 * i >= 80 * (len(x.s) + len(y.s) - i)
), c AS (
  SELECT r, r AS t FROM g UNION SELECT c.r, l.b FROM c JOIN l ON c.t = l.a
), m AS (
  SELECT c.r, min(g.doc_id) AS component_id FROM c JOIN g ON g.r = c.t GROUP BY c.r
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM g JOIN m ON g.r = m.r
"""

#: SQL of the queries that it can express; the tests hold the others against brute force.
ORACLE_SQL: dict[str, str] = {"op1_dual_tree_search": OP1_SQL, "op4_substring_dedup": OP4_SQL,
                              "op13_setsketch_dedup": OP13_SQL}
