"""The queries of the training-data operators: QUERIES and, where SQL can express them, ORACLE_SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe_codec, content_store, jpeg, mixing, near_dedup, pii, quality, token_counts, toxicity
from .common import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op3_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_store.store_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jpeg.store_texts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumbnail_hash")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_codec.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mix": op1_cube_mix,
    "op2_adaptive_scan": op2_adaptive_scan,
    "op3_content_store": op3_content_store,
    "op4_hierarchical_quality": op4_hierarchical_quality,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_jpeg": op6_jpeg,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_bbit_minhash": op9_bbit_minhash,
    "op10_token_counts": op10_token_counts,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL: dict[str, str] = {
    "op9_bbit_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    k AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
    c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
