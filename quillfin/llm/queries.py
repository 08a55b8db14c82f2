"""The queries opN_<name> over the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align_tokens, bpe, common, decontaminate, exact_dedup, hard_negatives, near_dedup, nearest, ppm_language, pu_quality, substring_dedup, token_counts, token_sst, warc_zstd


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.workspace(spark, "token-sst")
    manifest = token_sst.write_shards(common.table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=2)
    return token_sst.read_shards(manifest)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.workspace(spark, "warc")
    return warc_zstd.read_archives(warc_zstd.write_archives(common.table(spark, sf_dir, "pages"), path))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (
  SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p
)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND (page_id < top OR page_id IS NULL AND top IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND (page_id < top OR page_id IS NULL AND top IS NOT NULL) THEN top END AS refers_to
FROM d
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the vocabulary ends at 49407, so 65535 fits 16 bits and is no text's token
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 65535)


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pu_quality.classify(docs, pu_quality.fit(docs, common.table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return ppm_language.identify(docs, ppm_language.fit(docs))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT doc_id, sha256(t) AS h, t FROM d)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM g WINDOW w AS (PARTITION BY t)
"""

def op11_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(common.table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS v, row_number() OVER () AS uid FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
),
p AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.uid <> c.uid AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= 20
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v, row_number() OVER () AS uid FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT a.uid, a.vec_id AS anchor_id, c.uid AS other, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.uid <> c.uid AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, id NULLS LAST) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.uid = n.uid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.uid, p.other ORDER BY n.score DESC, n.id NULLS LAST) QUALIFY row_number() OVER w <= 3
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.align(common.table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"), digest=True)


QUERIES = {
    "op1_token_sst": op1_token_sst,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_warc_zstd": op3_warc_zstd,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_pu_quality": op6_pu_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_ppm_language": op9_ppm_language,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_block_nearest": op11_block_nearest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {"op3_warc_zstd": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op11_block_nearest": OP11_SQL, "op12_hard_negatives": OP12_SQL}
