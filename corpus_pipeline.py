"""Training corpus pipeline: five stages over ``documents``, each written and read again.

Quality rules drop what they reject; of each near-duplicate group one document
stays; secrets are replaced in the texts; sources are mixed to their target
weights, so documents come as often as the mix takes them; the last stage
encodes the texts and returns the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlance.llm import bpe, mixing, quality, secrets, simhash
from parlance.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are near a language's histograms."""
    return quality.kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints at most 3 bits apart."""
    return simhash.one_of_each(docs, shingle=3, distance=3, seed=42)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redacted_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                      public_tokenizers.PATTERN)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, limit=2.0)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of ids and decoded bytes, a row per taken copy."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                       keep=["doc_id", "source"], with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("byte-level bpe", byte_bpe),
]

#: SQL cannot express the fingerprints, the token counts or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
