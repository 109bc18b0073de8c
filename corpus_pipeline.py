"""From raw documents to training tokens: five stages, each a table that the next one reads.

1. quality rules: documents that a base rule or the outlier rule rejects go;
2. n-gram Jaccard join: of each component of near-copies the smallest doc_id stays;
3. PII: identifiers, plain or disguised, become their kind in brackets;
4. mixing: documents are repeated or left out so that sources take their target words;
5. BPE: whole texts become token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairlattice.llm import bpe, jaccard_join, mixing, pii, quality
from pairlattice.llm.common import delete, scope, tables_folder, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, one row per copy that the mix made."""
    return bpe.encode(docs, decode=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_copy_stage),
    ("pii", pii_stage),
    ("mix_sources", mixing_stage),
    ("bpe", bpe_stage),
]

#: The covariance estimates and the byte-pair merges have no SQL form; tests hold the rows to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables go once its result is written, and its input once the next one's is."""
    docs, folder, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{tables_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if last:
            delete(spark, last)
        last = f"{folder}/{name}"
    return docs
