"""Scoring answers of two groups (a baseline and one with context packs), pairing, scorecards and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, is_placeholder, normalize_space

# Fixed values.
TARGETS = {"accuracy_points": 30.0, "missed_reduction": 0.30, "token_reduction": 0.50, "minutes_reduction": 0.30, "citation_rate": 0.90}
GATES = {"page_metadata_rate": 0.95, "span_traceability_rate": 0.90, "table_accuracy": 0.80, "reading_order_accuracy": 0.90, "ocr_accuracy": 0.95}


def metric(cell: Column) -> Column:
    """A number, also one with a percent sign; null for placeholders and anything else."""
    plain = F.trim(cell)
    number = plain.try_cast("double")
    percent = F.regexp_extract(plain, r"^(-?\d+(?:\.\d+)?)\s*%$", 1).try_cast("double") / 100
    return F.when(~is_placeholder(cell), F.coalesce(number, percent))


def truth(cell: Column) -> Column:
    """1, 0.5 and 0 for yes, partial and no; null for anything else."""
    low = F.lower(F.trim(cell))
    return F.when(low.isin("yes", "true", "1", "y", "correct"), 1.0).when(low.isin("partial", "partly"), 0.5).when(low.isin("no", "false", "0", "n", "wrong"), 0.0)


def score_answers(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """cases: task_id, gold_answer_points, required_constraints; outputs: task_id, group, output_text.

    coverage is the share of points and constraints in the text; yes from 0.999, partial above 0, no at 0.
    """
    rows = outputs.join(cases.select("task_id", "gold_answer_points", "required_constraints"), "task_id", "left")
    low = F.lower(normalize_space(F.coalesce("output_text", F.lit(""))))
    held = lambda items: F.size(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda p: contains_phrase(low, p)))
    size = lambda items: F.size(F.coalesce(items, F.array().cast("array<string>")))
    points, needs = F.col("gold_answer_points"), F.col("required_constraints")
    total = size(points) + size(needs)
    coverage = F.when(total > 0, (held(points) + held(needs)) / total).otherwise(0.0)
    out = rows.select("task_id", "group", F.round(coverage, 6).alias("coverage"), (size(needs) - held(needs)).alias("missed_constraints"))
    return out.withColumn("answer_correct", F.when(F.col("coverage") >= 0.999, "yes").when(F.col("coverage") > 0, "partial").otherwise("no"))


def paired(scores: DataFrame) -> DataFrame:
    """A row for each task that both groups answered, in one grouped pass."""
    side = lambda g: F.max(F.when(F.col("group") == g, F.col("coverage")))
    rows = scores.groupBy("task_id").agg(side("baseline").alias("baseline"), side("context_pack").alias("context_pack")).filter("baseline is not null and context_pack is not null")
    return rows.withColumn("winner", F.when(F.col("context_pack") > F.col("baseline"), "context_pack").when(F.col("context_pack") < F.col("baseline"), "baseline").otherwise("tie"))


def group_stats(results: DataFrame) -> DataFrame:
    """results: group and cells answer_correct, citation_correct, missed_constraints, token_cost, elapsed_minutes."""
    return results.groupBy("group").agg(
        F.count("*").alias("n"),
        F.avg((truth(F.col("answer_correct")) == 1).cast("double")).alias("accuracy"),
        F.avg((truth(F.col("citation_correct")) == 1).cast("double")).alias("citation_rate"),
        F.avg(metric(F.col("missed_constraints"))).alias("missed"),
        F.avg(metric(F.col("token_cost"))).alias("tokens"),
        F.avg(metric(F.col("elapsed_minutes"))).alias("minutes"),
    )


def verdict(stats: DataFrame) -> DataFrame:
    """One row: gains of context_pack over baseline, how many of four targets are met, and whether it is accepted."""
    of = lambda c, g: F.max(F.when(F.col("group") == g, F.col(c)))
    less = lambda c: F.when(of(c, "baseline") > 0, (of(c, "baseline") - of(c, "context_pack")) / of(c, "baseline"))
    one = stats.agg(
        (100 * (of("accuracy", "context_pack") - of("accuracy", "baseline"))).alias("accuracy_points"),
        less("missed").alias("missed_reduction"),
        less("tokens").alias("token_reduction"),
        less("minutes").alias("minutes_reduction"),
        of("citation_rate", "context_pack").alias("citation_rate"),
    )
    met = sum((F.coalesce(F.col(c) >= v, F.lit(False)).cast("int") for c, v in TARGETS.items() if c != "citation_rate"), F.lit(0))
    cited = F.coalesce(F.col("citation_rate") >= TARGETS["citation_rate"], F.lit(False))
    return one.withColumn("targets_met", met).withColumn("accepted", (met >= 2) & cited)


def parser_scorecards(sheet: DataFrame, least_documents: int = 1) -> DataFrame:
    """sheet: cells document_id, parser, the rates of GATES, parse_minutes, critical_failures. Best parser first."""
    rates = [F.avg(metric(F.col(c))).alias(c) for c in GATES]
    card = sheet.groupBy("parser").agg(F.countDistinct("document_id").alias("n_documents"), *rates, F.avg(metric(F.col("parse_minutes"))).alias("minutes"), F.coalesce(F.sum(metric(F.col("critical_failures"))), F.lit(0.0)).alias("failures"))
    known = F.array_compact(F.array(*(F.col(c) for c in GATES)))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    passes = (F.col("failures") == 0) & (F.col("n_documents") >= least_documents)
    for c, v in GATES.items():
        passes = passes & F.coalesce(F.col(c) >= v, F.lit(False))
    return card.withColumn("score", F.round(mean, 6)).withColumn("passed", passes).orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("minutes"), "parser")


def readiness(cases: DataFrame, log: DataFrame) -> DataFrame:
    """task_id and blockers: what a task lacks before it can count. log: task_id, group, agent, raw_output_path, score_status."""
    own = log.withColumn("done", ~is_placeholder(F.col("raw_output_path"))).withColumn("simulated", F.lower(F.coalesce("agent", F.lit(""))).contains("simulat"))
    per = own.groupBy("task_id").agg(
        F.bool_or((F.col("group") == "baseline") & F.col("done")).alias("a"),
        F.bool_or((F.col("group") == "context_pack") & F.col("done")).alias("b"),
        F.bool_or("simulated").alias("s"),
        F.bool_and(F.lower(F.coalesce("score_status", F.lit(""))) == "scored").alias("scored"),
    )
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    blockers = F.array_compact(F.array(F.when(no("a"), "baseline_missing"), F.when(no("b"), "context_pack_missing"), F.when(F.coalesce("s", F.lit(False)), "simulated_run"), F.when(no("scored"), "not_scored")))
    return cases.select("task_id").join(per, "task_id", "left").select("task_id", blockers.alias("blockers"))


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of new in place of rows of the same keys."""
    return rows.join(new.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def evidence_use(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """evidence: task_id, text, page. likely_useful where it holds an expected phrase, else possibly_irrelevant."""
    rows = evidence.join(cases.select("task_id", "expected_evidence"), "task_id", "left")
    low = F.lower(normalize_space(F.coalesce("text", F.lit(""))))
    hit = F.exists(F.coalesce("expected_evidence", F.array().cast("array<string>")), lambda p: contains_phrase(low, p))
    return rows.withColumn("use", F.when(hit, "likely_useful").otherwise("possibly_irrelevant"))
