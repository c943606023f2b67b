import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import quality as Q


@pytest.fixture(scope="module")
def tree(spark):
    docs = spark.createDataFrame([("v1", "# A\n\n" + "First paragraph, long enough to be kept here.\n\n" * 1 + "Second paragraph, also long enough."), ("v2", "# B\n\nAnother document with one paragraph of text.")], "document_version_id string, text string")
    blocks = D.canonical(docs).withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(1)).cache()
    evidence = blocks.select("evidence_id", "document_version_id", "block_id", "text", "text_hash", F.lit(1).alias("page")).cache()
    versions = spark.createDataFrame([("v1", 0, False, None, 1), ("v2", 0, False, None, 1)], "document_version_id string, warnings int, fallback_used boolean, error string, page_count int")
    return versions, blocks, evidence, D.chunks(blocks).cache(), D.sections(blocks).cache()


def codes(df):
    return sorted((r.reason_code, r.document_version_id) for r in df.collect())


def test_a_sound_tree_has_no_signals(tree):
    versions, blocks, evidence, chunks, sections = tree
    assert codes(Q.document_signals(versions, blocks, chunks, evidence)) == []
    assert codes(Q.page_signals(versions, blocks, evidence)) == []
    assert codes(Q.block_signals(blocks, evidence)) == []
    assert codes(Q.chunk_signals(chunks, evidence)) == []
    assert Q.contract_issues(sections, blocks, evidence, chunks, versions).count() == 0
    r = {x.document_version_id: x for x in Q.quality_record(blocks, chunks, evidence).collect()}
    assert r["v1"].traceable_ratio == 1.0 and r["v1"].n_blocks == 3


def test_mutations_are_found(spark, tree):
    versions, blocks, evidence, chunks, sections = tree
    v3 = versions.unionByName(spark.createDataFrame([("v3", 11, True, "failed", None)], versions.schema))
    assert [c for c, v in codes(Q.document_signals(v3, blocks, chunks, evidence.unionByName(evidence.limit(1))))] == ["document.content.text_too_short", "document.integrity.canonical_missing", "document.integrity.duplicate_evidence_id", "document.integrity.no_chunks", "document.parse.failed", "document.parse.fallback_used", "document.parse.warning_count_high"]
    far = evidence.withColumn("page", F.when(F.col("document_version_id") == "v2", 9))
    assert {c for c, _ in codes(Q.page_signals(versions, blocks, far))} == {"page.integrity.reference_out_of_range", "page.integrity.source_location_missing"}
    assert codes(Q.page_signals(versions.withColumn("page_count", F.lit(2)), blocks, evidence)) == [("page.content.text_too_short", "v1"), ("page.content.text_too_short", "v2")]
    bad = blocks.withColumn("page_start", F.lit(3)).withColumn("block_type", F.lit("odd")).withColumn("text", F.when(F.col("ord") == 1, " ").otherwise(F.lit("same text " * 2500)))
    found = codes(Q.block_signals(bad, evidence.withColumn("text_hash", F.lit("0" * 64)).withColumn("block_id", F.lit("gone"))))
    assert {c for c, _ in found} == {"block.integrity.empty", "block.integrity.type_invalid", "block.integrity.page_range_invalid", "block.evidence.missing", "block.evidence.hash_mismatch", "block.evidence.block_reference_missing", "block.content.too_long", "block.content.duplicate"}
    odd = chunks.unionByName(chunks.withColumn("chunk_ord", F.col("chunk_ord") + 50).withColumn("evidence_ids", F.array(F.lit("nope")))).unionByName(chunks.limit(1).withColumn("text", F.lit("short")).withColumn("evidence_ids", F.array().cast("array<string>")).withColumn("chunk_ord", F.lit(99)))
    assert {c for c, _ in codes(Q.chunk_signals(odd, evidence))} == {"chunk.content.duplicate", "chunk.evidence.reference_missing", "chunk.evidence.missing", "chunk.content.too_short"}
    assert {r.code for r in Q.contract_issues(sections.limit(0), blocks, evidence.limit(0), chunks, v3).collect()} == {"block_section_missing", "chunk_evidence_missing", "chunk_section_missing", "no_chunks"}


def test_decisions_spread_to_chunks(spark, tree):
    versions, blocks, evidence, chunks, _ = tree
    e = evidence.filter("document_version_id = 'v1'").first().evidence_id
    far = evidence.withColumn("page", F.when(F.col("evidence_id") == e, 9).otherwise(1))
    decided = Q.decisions(Q.page_signals(versions, blocks, far))
    assert [(r.recommended_action, r.effective_action) for r in decided.collect()] == [("quarantine", "allow")]
    assert [(r.document_version_id, r.cause) for r in Q.excluded_chunks(decided, chunks).collect()] == [("v1", "evidence")]
    assert Q.report(decided).first().n_decisions == 1
    one, two = (Q.fingerprint(df, "signal_id", "decision_id").first()[0] for df in (decided, decided.orderBy(F.desc("signal_id")).repartition(3)))
    assert one == two and len(one) == 64


def test_policy_must_be_whole():
    rules = [(c, s, a) for c, s, a, _ in Q.REGISTRY]
    Q.check_policy(rules)
    for bad in (rules[1:], [*rules, rules[0]], [*rules, ("x.y.z", "error", "warn")]):
        with pytest.raises(ValueError):
            Q.check_policy(bad)
    assert len(rules) == 38 and sum(r[3] for r in Q.REGISTRY) == 29


def test_missing_is_not_null(spark):
    lines = spark.createDataFrame([("p", 1, '{"evidence_id":null,"document_version_id":"v","block_id":"b","text":"t"}'), ("p", 2, "{broken")], "path string, line int, json string")
    assert sorted((r.line, r.code, r.field) for r in Q.missing_fields(lines, "evidence").collect()) == [(1, "evidence_missing_field", "text_hash"), (2, "evidence_invalid_json", "")]


def test_records_and_versions(spark):
    versions = spark.createDataFrame([("v1",), ("v2",)], "document_version_id string")
    ok = '{"document_version_id": "%s"}'
    files = [("v1", k, ok % "v1") for k in Q.SIDECARS] + [("v1", "chunks", "  ")]
    assert codes(Q.sidecar_signals(versions.limit(1), spark.createDataFrame(files, "document_version_id string, kind string, json string"))) == []
    files += [("v2", "canonical", "[1]"), ("v2", "chunks", ok % "v2"), ("v2", "chunks", "{broken"), ("v2", "processing_record", ok % "v1"), ("v2", "quality_record", None)]
    found = Q.sidecar_signals(versions, spark.createDataFrame(files, "document_version_id string, kind string, json string"))
    want = ["canonical_invalid", "chunks_invalid", "document_version_mismatch", "quality_record_missing"]
    assert codes(found) == [(f"document.integrity.{c}", "v2") for c in want]
    assert {r.actual_value for r in found.filter("reason_code like '%mismatch'").collect()} == {"v1"}
    assert {r.confidence for r in found.collect()} == {1.0}
    assert codes(Q.release_signals(versions)) == []
    assert codes(Q.release_signals(versions.limit(0))) == [("release.integrity.no_documents", "processed-tree")]


def test_rows_of_another_version(tree):
    _, blocks, evidence, chunks, _ = tree
    stated = F.when(F.col("document_version_id") == "v2", "v1").otherwise(F.col("document_version_id"))
    for rows, scope in ((blocks, "block"), (evidence, "page"), (chunks, "chunk")):
        n = rows.filter("document_version_id = 'v2'").count()
        assert codes(Q.mismatch_signals(rows.withColumn("stated_version_id", stated), scope)) == [(f"{scope}.integrity.document_version_mismatch", "v2")] * n
        assert Q.mismatch_signals(rows.withColumn("stated_version_id", F.lit(None).cast("string")), scope).count() == rows.count()


def test_canonical_contract(spark):
    good = '{"schema_version":"layer1.processed.v1","parse_report":{"quality_report":{"status":"ok","score":"91.5"}}}'
    rows = [("a", good), ("b", good.replace("v1", "v9").replace("91.5", "high")), ("c", good.replace('"ok"', '" "')), ("d", "{broken"), ("e", None), ("f", '{"schema_version":null,"parse_report":{"quality_report":[1]}}')]
    found = Q.canonical_issues(spark.createDataFrame(rows, "path string, json string"))
    empty = [("error", "missing_quality_report"), ("error", "missing_schema_version")]
    want = {"b": [("error", "unsupported_schema_version"), ("warning", "missing_quality_score")], "c": [("error", "missing_quality_status")], "d": empty, "e": empty, "f": empty}
    got = {}
    for r in found.collect():
        got.setdefault(r.path, []).append((r.severity, r.code))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_chunk_lines(spark):
    files = spark.createDataFrame([("p", "v"), ("q", "v")], "path string, document_version_id string")
    lines = ['{"document_version_id":"v"}', "", "{broken", "[1, 2]", '{"document_version_id":"w"}', "{}"]
    rows = spark.createDataFrame([("p", n, x) for n, x in enumerate(lines, 1)] + [("q", 1, "  "), ("q", 2, None)], "path string, line int, json string")
    other = "chunk_document_version_mismatch"
    assert sorted((r.path, r.line or 0, r.code) for r in Q.chunk_line_issues(files, rows).collect()) == [("p", 3, "invalid_chunk_json"), ("p", 4, "invalid_chunk"), ("p", 5, other), ("p", 6, other), ("q", 0, "empty_chunks_jsonl")]
