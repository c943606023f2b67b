"""From raw documents to a training mix: toxicity, near-duplicates, repeated substrings, benchmark leaks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chunks, decontaminate, mixture, neardup, toxicity
from quillspark.llm.common import SCORES, free_names, read_table, remainder, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic; it learns as op5's query does.

    Null and empty texts score as the model's intercept; repeated rows fare alike; an empty table gives none.
    """
    model = toxicity.learn_toxicity(docs, read_table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    predicted = free_names(docs.columns, SCORES)["predicted"]
    return toxicity.score_toxicity(docs, model).filter(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words and a similarity of 0.8 link.

    Texts without words, nulls and rows without doc_id link with nothing and stay, as do rows that repeat a kept doc_id.
    """
    return neardup.one_of_each(docs, neardup.near_duplicates(docs, shingle=5, percent=80, bands=40, rows=5))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages cut from their texts; n_chars follows.

    Null texts stay null (n_chars too) and empty ones empty; rows without doc_id stay as they are; no row goes.
    """
    cut = chunks.dedup_substrings(docs)
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none and stay."""
    hit = free_names(docs.columns, decontaminate.ADDED)["contaminated"]
    marked = decontaminate.mark_contaminated(docs, read_table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return marked.filter(~F.col(hit)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, texts as the stages before left them, with their words, copies and source's target.

    A null source is a source of its own; texts without words have size 0 and are taken as their rank says; other columns end here.
    """
    return mixture.mix(docs, passed=["source", "lang", "text", "n_chars"]).filter("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
]

#: SQL can't express the classifier, the sketches or the rolling hash; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
