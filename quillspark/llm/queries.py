"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chunks, decontaminate, fingerprint, langid, mixture, neardup, quality, reputation, toxicity
from .common import read_table, remainder

#: A public vocabulary of byte strings with ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def op1_quartile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op2_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read_table(spark, sf_dir, "documents"))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.learn_quality(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return quality.score_quality(docs.select("doc_id", held, "text"), model).drop("text")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.learn_toxicity(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score_toxicity(docs.select("doc_id", held, "text"), model).drop("text")


def op6_marginalised_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.learn_languages(docs, remainder(F.col("doc_id"), 3) != 1, VOCABULARY)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return langid.predict_languages(docs.select("doc_id", held, "text"), model).drop("text")


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad where the label of its number says quality 0 or toxic 1."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return reputation.judge_urls(read_table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = archives.write_archives(read_table(spark, sf_dir, "pages"), archives.new_folder(spark))
    read = archives.read_archives(packages)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fast_similarity_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.dedup_substrings(docs)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quartile_fingerprints,
        op2_pareto_mixture,
        op3_compression_quality,
        op4_benchmark_decontamination,
        op5_counterfactual_toxicity,
        op6_marginalised_language,
        op7_host_reputation,
        op8_zip_warc,
        op9_fast_similarity_near_duplicates,
        op10_gear_chunk_dedup,
    )
}
ORACLES = {
    "op2_pareto_mixture": mixture.SQL,
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op7_host_reputation": reputation.SQL,
    "op8_zip_warc": archives.SQL,
    "op9_fast_similarity_near_duplicates": neardup.SQL,
}
