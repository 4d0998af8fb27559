"""The registered query of each operator: thin callables (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, langid, mixing, ngram_join, packing, phrases, quality, sharding, surrogates, topk, toxicity, vector_codes
from .common import bounded_batches
from .oracle import ORACLE  # noqa: F401  (registered with the queries)

SHARDS = 16
#: A deployment passes its own secret.
SURROGATE_KEY = "registered-query-key"
TOP_K, QUERY_EVERY = 5, 50
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    """Word pattern of the byte-level tokenizers."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_target_weight_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), mixing.label_weights(table(spark, sf_dir, "labels")))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), TOP_K)


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(table(spark, sf_dir, "documents"), SHARDS)


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_pattern())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost")


def op13_walsh_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_target_weight_mixing,
    op2_quality_ranking,
    op3_ngram_jaccard_join,
    op4_pii_surrogates,
    op5_exact_top_k,
    op6_rendezvous_sharding,
    op7_repeated_phrases,
    op8_language_id,
    op9_benchmark_decontamination,
    op10_toxicity,
    op11_source_divergence,
    op12_cost_balanced_packing,
    op13_walsh_vector_codes,
)}
