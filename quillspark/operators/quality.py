"""Quality signals, the policy that turns them into decisions, their spread to chunks, and rollups.

A detector is a filter over one table; detectors are united, never looped over documents. Duplicates and
missing references come from grouped minima and anti joins, so a hot text or version is combined first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_space, stable_id
from ..storage import stored

# Reason code, severity, recommended action, hard.
REGISTRY = [
    ("release.integrity.no_documents", "fatal", "block_release", True),
    ("document.evaluator.detector_error", "error", "block_document", True),
    ("document.integrity.canonical_missing", "fatal", "block_document", True),
    ("document.integrity.canonical_invalid", "fatal", "block_document", True),
    ("document.integrity.chunks_missing", "fatal", "block_document", True),
    ("document.integrity.chunks_invalid", "fatal", "block_document", True),
    ("document.integrity.no_chunks", "fatal", "block_document", True),
    ("document.integrity.processing_record_missing", "error", "block_document", True),
    ("document.integrity.processing_record_invalid", "error", "block_document", True),
    ("document.integrity.quality_record_missing", "error", "block_document", True),
    ("document.integrity.quality_record_invalid", "error", "block_document", True),
    ("document.integrity.document_version_mismatch", "fatal", "block_document", True),
    ("document.integrity.duplicate_evidence_id", "error", "block_document", True),
    ("document.parse.failed", "fatal", "block_document", True),
    ("document.parse.unsupported", "fatal", "block_document", True),
    ("document.content.text_too_short", "warning", "warn", False),
    ("document.parse.warning_count_high", "warning", "warn", False),
    ("document.parse.fallback_used", "warning", "warn", False),
    ("page.integrity.reference_out_of_range", "error", "quarantine", True),
    ("page.integrity.document_version_mismatch", "error", "quarantine", True),
    ("page.integrity.source_location_missing", "error", "quarantine", True),
    ("page.content.text_too_short", "warning", "warn", False),
    ("block.integrity.empty", "error", "quarantine", True),
    ("block.integrity.type_invalid", "error", "quarantine", True),
    ("block.integrity.page_range_invalid", "error", "quarantine", True),
    ("block.integrity.document_version_mismatch", "error", "quarantine", True),
    ("block.evidence.missing", "error", "quarantine", True),
    ("block.evidence.hash_mismatch", "error", "quarantine", True),
    ("block.evidence.block_reference_missing", "error", "quarantine", True),
    ("block.content.too_long", "warning", "warn", False),
    ("block.content.duplicate", "warning", "warn", False),
    ("chunk.integrity.empty", "error", "quarantine", True),
    ("chunk.evidence.missing", "error", "quarantine", True),
    ("chunk.evidence.reference_missing", "error", "quarantine", True),
    ("chunk.integrity.document_version_mismatch", "error", "quarantine", True),
    ("chunk.content.too_short", "warning", "warn", False),
    ("chunk.content.too_long", "warning", "warn", False),
    ("chunk.content.duplicate", "warning", "warn", False),
]
BLOCK_TYPES = ("heading", "paragraph", "table", "code")
LEAST_DOCUMENT, LEAST_PAGE, MOST_BLOCK, LEAST_CHUNK, MOST_CHUNK, MOST_WARNINGS = 40, 10, 20_000, 10, 8_000, 10
BLOCKING = ("quarantine", "block_document", "block_release")
HARD = {code: hard for code, _, _, hard in REGISTRY}
# What a signal is worth by whether its code is hard; the schema of canonical documents.
CONFIDENCE = {True: 1.0, False: 0.75}
SCHEMA_VERSION = "layer1.processed.v1"
SIDECARS = ("canonical", "chunks", "processing_record", "quality_record")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "reason_code string, severity string, recommended_action string, hard boolean")


def signal(rows: DataFrame, code: str, object_id: Column | str, *, actual: Column | None = None, evidence: Column | None = None, version: str = "document_version_id") -> DataFrame:
    actual = F.lit(None).cast("string") if actual is None else actual.cast("string")
    evidence = F.array().cast("array<string>") if evidence is None else evidence
    picked = F.col(object_id) if isinstance(object_id, str) else object_id
    out = rows.select(F.lit(code).alias("reason_code"), F.lit(code.split(".")[0]).alias("scope"), F.col(version).alias("document_version_id"), picked.alias("object_id"), actual.alias("actual_value"), evidence.alias("evidence_ids"))
    out = out.withColumn("confidence", F.lit(CONFIDENCE[HARD[code]]))
    return out.withColumn("signal_id", stable_id("signal", F.col("document_version_id"), F.col("reason_code"), F.col("object_id"), F.col("actual_value")))


def united(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def measured(rows: DataFrame, *columns: str) -> DataFrame:
    """A table of columns, n_chars and n (text's characters as it is and normalised) and _h, which stands for normalised text; null for empty text.

    Texts are normalised once, however many detectors read the table.
    """
    plain = rows.select(*columns, "text", normalize_space(F.col("text")).alias("_plain"))
    h = F.when(F.col("text") != "", F.unhex(F.sha2(F.col("_plain").cast("binary"), 256)))
    return stored(plain.select(*columns, F.length("text").alias("n_chars"), F.length("_plain").alias("n"), h.alias("_h")), "measured")


def later_copies(rows: DataFrame, key: str) -> DataFrame:
    """Rows of measured() whose normalised text an earlier key of the same version has."""
    marked = rows.filter("_h is not null")
    first = marked.groupBy("document_version_id", "_h").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return marked.join(first, ["document_version_id", "_h"]).filter(F.col(key) > F.col("_first"))


def document_signals(versions: DataFrame, blocks: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """versions: document_version_id, warnings (count), fallback_used, error (null, failed or unsupported)."""
    chars = blocks.groupBy("document_version_id").agg(F.sum(F.length(normalize_space(F.col("text")))).alias("n"))
    short = versions.join(chars, "document_version_id", "left").filter(F.coalesce("n", F.lit(0)) < LEAST_DOCUMENT)
    twice = evidence.groupBy("document_version_id", "evidence_id").agg(F.count("*").alias("n")).filter("n > 1")
    v = "document_version_id"
    return united(
        [
            signal(versions.join(blocks.select(v).distinct(), v, "left_anti"), "document.integrity.canonical_missing", v),
            signal(versions.join(chunks.select(v).distinct(), v, "left_anti"), "document.integrity.no_chunks", v),
            signal(twice, "document.integrity.duplicate_evidence_id", "evidence_id", actual=F.col("n"), evidence=F.array("evidence_id")),
            signal(versions.filter("error = 'failed'"), "document.parse.failed", v),
            signal(versions.filter("error = 'unsupported'"), "document.parse.unsupported", v),
            signal(short, "document.content.text_too_short", v, actual=F.coalesce("n", F.lit(0))),
            signal(versions.filter(F.col("warnings") > MOST_WARNINGS), "document.parse.warning_count_high", v, actual=F.col("warnings")),
            signal(versions.filter("fallback_used"), "document.parse.fallback_used", v),
        ]
    )


def page_signals(versions: DataFrame, blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """versions with page_count (null: no pages), blocks with page_start and page_end, evidence with page."""
    paged = versions.filter("page_count is not null").select("document_version_id", "page_count")
    out = evidence.join(paged, "document_version_id").filter("page < 1 or page > page_count")
    missing = evidence.join(paged, "document_version_id").filter("page is null")
    spread = blocks.filter("page_start is not null and page_end >= page_start").select("document_version_id", F.explode(F.sequence("page_start", "page_end")).alias("page"), F.length(normalize_space(F.col("text"))).alias("n"))
    every = paged.filter("page_count >= 1").select("document_version_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    sums = every.join(spread.groupBy("document_version_id", "page").agg(F.sum("n").alias("n")), ["document_version_id", "page"], "left").filter(F.coalesce("n", F.lit(0)) < LEAST_PAGE)
    ids = F.array("evidence_id")
    return united(
        [
            signal(out, "page.integrity.reference_out_of_range", "evidence_id", actual=F.col("page"), evidence=ids),
            signal(missing, "page.integrity.source_location_missing", "evidence_id", evidence=ids),
            signal(sums, "page.content.text_too_short", F.concat_ws(":", "document_version_id", "page"), actual=F.coalesce("n", F.lit(0))),
        ]
    )


def block_signals(blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """blocks: document_version_id, block_id, ord, block_type, text, page_start, page_end; evidence: evidence_id, block_id, text, text_hash."""
    keys = ["document_version_id", "block_id"]
    facts = measured(blocks, *keys, "block_type", "page_start", "page_end")
    orphan = evidence.join(facts.select(*keys), keys, "left_anti")
    bad_hash = evidence.filter(F.sha2(F.col("text").cast("binary"), 256) != F.col("text_hash"))
    bad_pages = facts.filter("page_start < 1 or page_end < page_start or (page_start is null) <> (page_end is null)")
    return united(
        [
            signal(facts.filter("n = 0"), "block.integrity.empty", "block_id"),
            signal(facts.filter(~F.col("block_type").isin(*BLOCK_TYPES)), "block.integrity.type_invalid", "block_id", actual=F.col("block_type")),
            signal(bad_pages, "block.integrity.page_range_invalid", "block_id"),
            signal(facts.join(evidence.select(*keys).distinct(), keys, "left_anti"), "block.evidence.missing", "block_id"),
            signal(bad_hash, "block.evidence.hash_mismatch", "evidence_id", evidence=F.array("evidence_id")),
            signal(orphan, "block.evidence.block_reference_missing", "evidence_id", evidence=F.array("evidence_id")),
            signal(facts.filter(F.col("n_chars") > MOST_BLOCK), "block.content.too_long", "block_id", actual=F.col("n_chars")),
            signal(later_copies(facts, "block_id"), "block.content.duplicate", "block_id"),
        ]
    )


def chunk_signals(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """chunks: document_version_id, chunk_id, chunk_ord, text, evidence_ids."""
    keys = ["document_version_id", "evidence_id"]
    facts, n = measured(chunks, "document_version_id", "chunk_id", "chunk_ord", "evidence_ids"), F.col("n")
    used = facts.select("document_version_id", "chunk_id", F.explode("evidence_ids").alias("evidence_id"))
    lost = used.join(evidence.select(*keys).distinct(), keys, "left_anti")
    return united(
        [
            signal(facts.filter(n == 0), "chunk.integrity.empty", "chunk_id"),
            signal(facts.filter(F.size("evidence_ids") == 0), "chunk.evidence.missing", "chunk_id"),
            signal(lost, "chunk.evidence.reference_missing", "chunk_id", actual=F.col("evidence_id"), evidence=F.array("evidence_id")),
            signal(facts.filter((n > 0) & (n < LEAST_CHUNK)), "chunk.content.too_short", "chunk_id", actual=n, evidence=F.col("evidence_ids")),
            signal(facts.filter(n > MOST_CHUNK), "chunk.content.too_long", "chunk_id", actual=n, evidence=F.col("evidence_ids")),
            signal(later_copies(facts, "chunk_ord"), "chunk.content.duplicate", "chunk_id", evidence=F.col("evidence_ids")),
        ]
    )


def release_signals(versions: DataFrame) -> DataFrame:
    """One signal where there are no versions at all."""
    tree = F.lit("processed-tree")
    none = versions.agg(F.count("*").alias("n")).filter("n = 0").withColumn("document_version_id", tree)
    return signal(none, "release.integrity.no_documents", tree, actual=F.col("n"))


def sidecar_signals(versions: DataFrame, sidecars: DataFrame, kinds: Sequence[str] = SIDECARS) -> DataFrame:
    """Files of a version that are missing, aren't valid, or are records of another version.

    sidecars: document_version_id, kind, json; a row a file, of JSON lines a row a line. A file without a row, or with
    null for its json, is missing. Blank lines count as there but aren't read. All else that isn't an object is invalid.
    """
    v = "document_version_id"
    text = F.trim(F.coalesce("json", F.lit("")), F.lit(" \t\r\n"))
    is_object = F.json_object_keys(text).isNotNull()
    blank = (F.col("kind") == "chunks") & (text == "")
    bad = ~blank & ~is_object
    stated = F.coalesce(F.get_json_object("json", f"$.{v}"), F.lit(""))
    alien = is_object & F.col("kind").isin("processing_record", "quality_record") & (stated != F.col(v))
    found = sidecars.filter(F.col("json").isNotNull() & F.col("kind").isin(*kinds)).groupBy(v, "kind").agg(F.bool_or(bad).alias("bad"), F.min(F.when(alien, stated)).alias("alien"))
    every = versions.select(v).distinct().withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    seen = every.join(found, [v, "kind"], "left")
    parts = []
    for kind in kinds:
        rows = seen.filter(F.col("kind") == kind)
        parts.append(signal(rows.filter("bad is null"), f"document.integrity.{kind}_missing", v, actual=F.lit("False")))
        parts.append(signal(rows.filter("bad"), f"document.integrity.{kind}_invalid", v, actual=F.lit("False")))
    parts.append(signal(seen.filter("alien is not null"), "document.integrity.document_version_mismatch", v, actual=F.col("alien")))
    return united(parts)


def mismatch_signals(rows: DataFrame, scope: str, stated: str = "stated_version_id") -> DataFrame:
    """Blocks, chunks or evidence (scope page) that state another version than the one they stand in; null states none.

    rows: document_version_id, the stated version, and block_id; chunk_id and evidence_ids; or evidence_id and page.
    """
    other = rows.filter(F.coalesce(stated, F.lit("")) != F.col("document_version_id"))
    said = F.coalesce(stated, F.lit(""))
    code = f"{scope}.integrity.document_version_mismatch"
    if scope == "page":
        at = F.when(F.col("page") > 0, F.concat_ws(":page:", "document_version_id", "page")).otherwise(F.coalesce("evidence_id", "document_version_id"))
        return signal(other, code, at, actual=said, evidence=F.array_compact(F.array("evidence_id")))
    return signal(other, code, f"{scope}_id", actual=said, evidence=F.col("evidence_ids") if scope == "chunk" else None)


def check_policy(policy: Sequence[tuple[str, str, str]]) -> None:
    """A policy names every registered code once and no other."""
    codes, known = [p[0] for p in policy], {r[0] for r in REGISTRY}
    if len(set(codes)) != len(codes):
        raise ValueError("a reason code stands twice in the policy")
    if set(codes) != known:
        raise ValueError(f"policy and registry differ: {sorted(set(codes) ^ known)}")


def decisions(signals: DataFrame, policy: Sequence[tuple[str, str, str]] | None = None, *, policy_id: str = "default-observe") -> DataFrame:
    """A decision for each signal. Observe mode warns or allows, whatever is recommended."""
    rules = [(c, s, a) for c, s, a, _ in REGISTRY] if policy is None else list(policy)
    check_policy(rules)
    table = signals.sparkSession.createDataFrame(rules, "reason_code string, severity string, recommended_action string")
    joined = signals.join(F.broadcast(table), "reason_code")
    effective = F.when(F.col("recommended_action") == "warn", "warn").otherwise("allow")
    return joined.withColumn("effective_action", effective).withColumn("decision_id", stable_id("decision", F.lit(policy_id), F.col("signal_id"), F.col("recommended_action")))


def excluded_chunks(decided: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that blocking decisions would exclude: their own, their document's, or those on their evidence; the nearest cause wins."""
    blocking = decided.filter(F.col("recommended_action").isin(*BLOCKING))
    ids = chunks.select("document_version_id", "chunk_id", "evidence_ids")
    own = blocking.filter("scope = 'chunk'").select("document_version_id", F.col("object_id").alias("chunk_id")).distinct()
    own = ids.join(own, ["document_version_id", "chunk_id"], "left_semi").select("document_version_id", "chunk_id", F.lit(0).alias("c"))
    whole = blocking.filter("recommended_action = 'block_document'").select("document_version_id").distinct()
    whole = ids.join(whole, "document_version_id", "left_semi").select("document_version_id", "chunk_id", F.lit(1).alias("c"))
    proof = blocking.select("document_version_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    used = ids.select("document_version_id", "chunk_id", F.explode("evidence_ids").alias("evidence_id"))
    shared = used.join(proof, ["document_version_id", "evidence_id"], "left_semi").select("document_version_id", "chunk_id", F.lit(2).alias("c"))
    cause = F.element_at(F.array(*map(F.lit, ("chunk", "document", "evidence"))), F.min("c") + 1)
    return united([own, whole, shared]).groupBy("document_version_id", "chunk_id").agg(cause.alias("cause"))


def report(decided: DataFrame) -> DataFrame:
    return decided.groupBy("scope", "recommended_action").agg(F.count("*").alias("n_decisions"), F.countDistinct("object_id").alias("n_objects"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a hash of the rows whatever their order. Each row's hash is summed, so nothing is gathered."""
    h = F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns)).cast("binary"), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*"), *(F.coalesce(part(k), F.lit(0)) for k in range(8))).cast("binary"), 256).alias("fingerprint"))


def quality_record(blocks: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """By version: counts, and the share of chunks all of whose references exist."""
    keys = ["document_version_id", "evidence_id"]
    used = chunks.select("document_version_id", "chunk_ord", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = used.join(evidence.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "left")
    per = known.groupBy("document_version_id", "chunk_ord").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("traceable"))
    sums = per.groupBy("document_version_id").agg(F.count("*").alias("n_chunks"), F.bround(F.avg(F.col("traceable").cast("double")), 8).alias("traceable_ratio"))
    n = blocks.groupBy("document_version_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("block_type") == "table").alias("n_tables"))
    return n.join(sums, "document_version_id", "left")


# --- contract ---

REQUIRED = {
    "section": ("section_id", "document_version_id", "section_path", "title"),
    "block": ("block_id", "document_version_id", "block_type", "text", "section_path"),
    "evidence": ("evidence_id", "document_version_id", "block_id", "text", "text_hash"),
    "chunk": ("chunk_id", "document_version_id", "text", "evidence_ids", "section_path"),
}


def missing_fields(lines: DataFrame, kind: str) -> DataFrame:
    """lines: path, line, json. A row for each required field that an object lacks; null counts as there."""
    keys = F.json_object_keys("json")
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED[kind])), F.coalesce(keys, F.array().cast("array<string>")))
    code = F.when(keys.isNull(), F.lit(f"{kind}_invalid_json")).otherwise(f"{kind}_missing_field")
    return lines.select("path", "line", code.alias("code"), F.explode(F.when(keys.isNull(), F.array(F.lit(""))).otherwise(lacking)).alias("field"))


def contract_issues(sections: DataFrame, blocks: DataFrame, evidence: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Broken references: sections of blocks, blocks of evidence, evidence of chunks, versions of all; and documents without chunks."""
    v = "document_version_id"
    path = lambda df: df.withColumn("_p", F.array_join("section_path", "."))
    known = path(sections).select(v, "_p").distinct()
    ids = chunks.select(v, "chunk_id", F.explode("evidence_ids").alias("evidence_id"))
    issue = lambda df, code, obj: df.select(v, F.lit(code).alias("code"), F.col(obj).cast("string").alias("object_id"))
    return united(
        [
            issue(path(blocks).join(known, [v, "_p"], "left_anti"), "block_section_missing", "block_id"),
            issue(evidence.join(blocks.select(v, "block_id"), [v, "block_id"], "left_anti"), "evidence_block_missing", "evidence_id"),
            issue(ids.join(evidence.select(v, "evidence_id"), [v, "evidence_id"], "left_anti"), "chunk_evidence_missing", "chunk_id"),
            issue(path(chunks).join(known, [v, "_p"], "left_anti"), "chunk_section_missing", "chunk_id"),
            issue(chunks.join(versions.select(v), v, "left_anti"), "chunk_version_missing", "chunk_id"),
            issue(versions.join(chunks.select(v).distinct(), v, "left_anti"), "no_chunks", v),
        ]
    )


def canonical_issues(documents: DataFrame, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """documents: path, json, a canonical document each. Its schema version and its quality report, severity and code a row.

    Null or broken JSON counts as an empty object. Blanks alone are no version and no status; a score must be a number.
    """
    at = lambda p: normalize_space(F.coalesce(F.get_json_object("json", p), F.lit("")))
    version, report_, status, score = at("$.schema_version"), at("$.parse_report.quality_report"), at("$.parse_report.quality_report.status"), at("$.parse_report.quality_report.score")
    is_object = F.json_object_keys(report_).isNotNull()
    issue = lambda when, severity, code: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    found = F.array_compact(
        F.array(
            issue(version == "", "error", "missing_schema_version"),
            issue((version != "") & (version != schema_version), "error", "unsupported_schema_version"),
            issue(~is_object, "error", "missing_quality_report"),
            issue(is_object & (status == ""), "error", "missing_quality_status"),
            issue(is_object & score.try_cast("double").isNull(), "warning", "missing_quality_score"),
        )
    )
    return documents.select("path", F.inline(found))


def chunk_line_issues(files: DataFrame, lines: DataFrame) -> DataFrame:
    """files: path, document_version_id; lines: path, line, json. Lines that are no objects or of another version; files without lines.

    line is null for a whole file; blank lines are skipped. Broken JSON and JSON of another kind have codes of their own.
    """
    text = F.trim("json", F.lit(" \t\r\n"))
    kept = lines.filter(text != "").join(files, "path")
    value = F.try_parse_json(text)
    is_object = F.json_object_keys(text).isNotNull()
    stated = F.coalesce(F.get_json_object(text, "$.document_version_id"), F.lit(""))
    code = (
        F.when(value.isNull(), "invalid_chunk_json")
        .when(~is_object, "invalid_chunk")
        .when(stated != F.col("document_version_id"), "chunk_document_version_mismatch")
    )
    bad = kept.select("path", F.col("line").cast("long").alias("line"), code.alias("code")).filter("code is not null")
    empty = files.join(kept.select("path").distinct(), "path", "left_anti")
    return bad.unionByName(empty.select("path", F.lit(None).cast("long").alias("line"), F.lit("empty_chunks_jsonl").alias("code")))
