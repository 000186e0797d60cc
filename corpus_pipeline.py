"""From raw documents to token ids: toxicity, near-duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as Parquet
and reads it back for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslane.llm import bpe_codec, mixing, near_dedup, pii, toxicity
from corpuslane.llm.common import bounded_batches, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score 0.5 or more go.

    Null and empty texts have the score of no words, repeated rows share their fate, no labels or rows are no error.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 one document of least id stays.

    Rows with a null id and null or wordless texts link with nothing and stay; repeated rows are copies.
    """
    return near_dedup.deduplicated(docs, words=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, by pattern or context, give way to the name of their kind; all rows stay, null and empty texts as they are."""
    return pii.without_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources meet their targets.

    A null source is one of its own; null and wordless texts have no words; equal rows are interchangeable.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digests of ids and decoded text; a null text counts as empty."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec.encode_documents(docs, path, keep=["lang", "source"]).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """work in a session whose Arrow batches are bounded."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return work(spark, docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("near-duplicates", _stage(drop_near_duplicates)),
    ("personal data", _stage(mask_personal_data)),
    ("mixing", _stage(mix_sources)),
    ("encoding", _stage(encode)),
]

#: The stages use models, hashes and chance that SQL cannot express; tests compare them with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
