"""One query for each operator, over its whole table, with the digest columns derived from the operator's outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_chunks import bpe_round_trip
from .common import crc32_mod, read
from .exact_dedup import exact_dedup
from .language import fit_language, identify
from .nra import top_k_search
from .packing import pack_sequences
from .pii import pii_spans
from .quality import fit_quality, score_quality
from .simhash import simhash_table
from .suffix_dedup import suffix_dedup
from .token_files import token_file_digests


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), threshold=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(read(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(read(spark, sf_dir, "documents"), capacity=4096, name="word_bpe_49k.json", end_id=1)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read(spark, sf_dir, "documents"), crc32_mod("doc_id", 4)
    model = fit_quality(docs, read(spark, sf_dir, "labels"), allowed=fold != 2)
    return score_quality(docs, model).select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), "byte_bpe_50k.json").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read(spark, sf_dir, "embeddings"), k=10)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_table(read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read(spark, sf_dir, "documents"), crc32_mod("doc_id", 3)
    model = fit_language(docs, allowed=fold != 1)
    return identify(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_token_files, op4_packing, op5_quality, op6_bpe, op7_exact_dedup, op8_top_k, op9_simhash, op10_language)}

ORACLE = {
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
