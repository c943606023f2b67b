"""Answers after the fact: facts in retrieved text, evidence that was really retrieved, and claims without support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, normalize_space, summarize

#: Kind and pattern (its first group is the name) of facts in technical text.
FACTS = (
    ("limit", r"(?i)\b(?:maximum|minimum|limit|at most|at least)\b[^.\n]{0,40}?(\d[\d,.]*\s?\w*)"),
    ("default", r"(?i)\bdefault(?:s to| is|:)\s+([\w./-]+)"),
    ("version", r"(?i)\bversion\s+(\d+(?:\.\d+)+)"),
    ("function", r"\b([A-Za-z_]\w*)\(\)"),
    ("option", r"(?<!\S)(--?[A-Za-z][\w-]*)"),
    ("path", r"(?<!\S)(/(?:[\w.-]+/)*[\w.-]+)"),
)


def facts(chunks: DataFrame, patterns: Sequence[tuple[str, str]] = FACTS) -> DataFrame:
    """kind, name and the first chunk (by rank) that has it. chunks: chunk_id, rank, text."""
    found = F.flatten(F.array(*(_named(kind, p) for kind, p in patterns)))
    rows = chunks.select("chunk_id", "rank", F.explode(F.array_distinct(found)).alias("f")).select("chunk_id", "rank", "f.kind", "f.name")
    return rows.groupBy("kind", "name").agg(F.min(F.struct("rank", "chunk_id")).alias("m")).select("kind", "name", F.col("m.chunk_id").alias("chunk_id"))


def _named(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def bind_evidence(replies: DataFrame) -> DataFrame:
    """replies: cited and retrieved ids, confidence. Only retrieved ids stay; high confidence without any falls to medium."""
    kept = F.array_intersect("cited", "retrieved")
    out = replies.withColumn("evidence_ids", kept)
    return out.withColumn("confidence", F.when((F.col("confidence") == "high") & (F.size("evidence_ids") == 0), "medium").otherwise(F.col("confidence")))


def unsupported_names(replies: DataFrame) -> DataFrame:
    """replies: reply_id, answer, evidence_text. Identifiers of the answer that the evidence lacks."""
    names = F.filter(identifiers(F.col("answer")), lambda n: ~F.contains(F.col("evidence_text"), n))
    return replies.select("reply_id", F.explode(names).alias("name"))


def title_fragment(text: Column) -> Column:
    """Whether a text is only a title or number: short, without an end mark, few words or digits alone."""
    plain = normalize_space(text)
    return (plain == "") | (~plain.contains("\n") & ~plain.rlike(r"[.。！？!?;；:]") & ((F.size(F.split(plain, " ")) <= 6) | plain.rlike(r"^[\d.\s]+$")) & (F.length(plain) <= 60))


def evidence_summaries(chunks: DataFrame, n: int = 3) -> DataFrame:
    """The first n chunks of each reply that are more than titles, in short. chunks: reply_id, rank, chunk_id, text."""
    rows = chunks.filter(~title_fragment(F.col("text")))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("reply_id").orderBy("rank", "chunk_id"))).filter(F.col("n") <= n)
    return ranked.select("reply_id", "n", "chunk_id", summarize(F.col("text")).alias("summary"))


def answer_violations(answers: DataFrame) -> DataFrame:
    """answers: answer_id, answer, evidence_text. Markers left in, doubled numbering, mostly title lines, names without evidence."""
    text = F.col("answer")
    lines = F.filter(F.split(normalize_space(text), "\n"), lambda x: x != "")
    fragments = F.size(F.filter(lines, lambda x: ~x.rlike(r"[.。！？!?;；:]$") & (F.length(x) <= 40)))
    problems = F.array_compact(
        F.array(
            F.when(text.rlike(r"(?i)\b(?:span|chunk|docver)_[0-9a-f]{8,}"), "traceability_marker"),
            F.when(text.rlike(r"(?m)^\s*\d+[.、)]\s*\d+[.、)]"), "double_numbering"),
            F.when((F.size(lines) > 1) & (fragments * 2 >= F.size(lines)), "title_fragments"),
            F.when(F.exists(identifiers(text), lambda n: ~F.contains(F.col("evidence_text"), n)), "name_without_evidence"),
        )
    )
    return answers.select("answer_id", F.explode(problems).alias("violation"))
