"""The registered queries of the training-data operators.

Each ``opN_*`` applies its operator, with production parameters, to its whole
table; ``SQL`` has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (bitplanes, bpe, collocations, graph_search, langid, minmax_dedup, mixing, oracle, quality, secrets,
                          sharding, simhash, simple8b, toxicity)
from parlance.llm.common import documents, stored

JOBS: dict = {}
SQL: dict = {}


def _job(f):
    JOBS[f.__name__] = f
    return f


@_job
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document: base counts, distances to the language references, kept."""
    rules = quality.QualityRules()
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    counted = quality.base_counts(quality.histograms(docs, rules)).drop("_words", "text")
    counted = stored(counted, "quality")  # counts only; texts are read once
    judged = quality.judge(counted, quality.language_references(counted, rules), rules)
    return judged.select("doc_id", *quality.RESULT).withColumns(
        {c: F.round(c, 6) for c in ("class_distance", "word_distance")})


SQL["op1_quality_rules"] = oracle.quality_sql(quality.QualityRules())


@_job
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and their bytes decoded again, as digests."""
    return bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN, keep=["doc_id"])


@_job
def op10_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in document order, written and read back: place, length and digest of each."""
    manifest = simple8b.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.PATTERN, end_id=2)
    return simple8b.read_tokens(manifest)


@_job
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    docs = stored(mixing.sized(documents(spark, sf_dir)), "sizes")  # ids, sources and sizes; texts are read once
    mixed = mixing.with_copies(docs, docs.drop("place"), weights=(5, 2, 1), share=1.5, limit=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies", "rate")


@_job
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: base pattern counts and digest, all spans."""
    return secrets.scanned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN, keep=["doc_id"])


@_job
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, distance=3, seed=42)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@_job
def op2_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document: equal texts together where they fit, row counts at most one apart."""
    nodes = sharding.documents_as_nodes(documents(spark, sf_dir))
    placed = sharding.balanced_shards(nodes, shards=16, rounds=6)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_job
def op6_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of every vector whose id is divisible by 100."""
    vectors = stored(graph_search.valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return graph_search.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@_job
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; documents with crc32(doc_id) mod 4 = 2 are held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    params = langid.LangParams()
    may_learn = ~F.col("held_out") & F.col("doc_id").isNotNull()
    model = langid.train(langid.labelled_sample(docs, may_learn, params), params)
    return langid.predicted(docs, model, keep=["doc_id", "held_out"])


@_job
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text; documents with crc32(doc_id) mod 3 = 1 are held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out(F.col("doc_id"), 3, 1))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    params = toxicity.ToxicityParams()
    sample = toxicity.labelled_sample(docs, labels, ~langid.held_out(F.col("doc_id"), 3, 1), params)
    return toxicity.scored(docs, toxicity.train(sample, params), keep=["doc_id", "held_out"], threshold=0.7)


@_job
def op11_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document (5-word shingles, similarity 0.85)."""
    return minmax_dedup.near_duplicates(documents(spark, sf_dir))


@_job
def op12_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole-number vector of 64 components, after 10 rounds from 8 centroids."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return bitplanes.clustered(vectors, k=8, rounds=10, scale=1024, seed=3)


@_job
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 3 words of each language by the score of their weakest cut."""
    return collocations.collocations(documents(spark, sf_dir))


SQL["op11_minmax_near_dedup"] = oracle.near_dedup_sql()
SQL["op12_bitplane_clusters"] = oracle.clusters_sql()
SQL["op13_phrase_collocations"] = oracle.phrases_sql()
