import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import evaluation as E
from quillspark.operators import release as R
from quillspark.operators import replies as P


@pytest.fixture(scope="module")
def tree(spark):
    docs = spark.createDataFrame([("v1", "# A\n\nFirst paragraph, long enough.", "h1"), ("v2", "# B\n\nAnother paragraph of text.", "h2")], "document_version_id string, text string, file_hash string")
    return docs, D.chunks(D.canonical(docs)).cache()


def test_release_life(spark, tree, tmp_path):
    docs, chunks = tree
    folder = str(tmp_path / "releases")
    one = R.create_candidate(R.artefacts(docs, chunks), folder)
    assert R.create_candidate(R.artefacts(docs, chunks.repartition(3)), folder) == one
    path = f"{folder}/{one['release_id']}"
    with pytest.raises(ValueError, match="ready"):
        R.activate(spark, path, f"{folder}/active.json")
    changed = chunks.withColumn("text", F.concat("text", F.when(F.col("document_version_id") == "v2", "!").otherwise("")))
    assert [(r.document_version_id, r.problem) for r in R.validate(R.artefacts(docs, changed), path).collect()] == [("v2", "chunks_hash_mismatch")]
    assert [(r.document_version_id, r.problem) for r in R.validate(R.artefacts(docs.limit(1), chunks), path).collect()] == [("v2", "missing")]
    with pytest.raises(ValueError, match="chunks_hash_mismatch:v2"):
        R.finalize(R.artefacts(docs, changed), path, {})
    index = chunks.select("chunk_id", "text")
    ready = R.finalize(R.artefacts(docs, chunks), path, {"fts": index})
    assert ready["status"] == "ready" and R.finalize(R.artefacts(docs, chunks), path, {"fts": index}) == ready
    with pytest.raises(ValueError, match="other indexes"):
        R.finalize(R.artefacts(docs, chunks), path, {"fts": index.limit(1)})
    R.activate(spark, path, f"{folder}/active.json")
    assert R.active(spark, f"{folder}/active.json") == ready
    R.write_text(spark, f"{path}/manifest.json", R.read_text(spark, f"{path}/manifest.json").replace('"ready"', '"candidate"'))
    with pytest.raises(ValueError, match="changed"):
        R.active(spark, f"{folder}/active.json")
    assert R.pinned_rows(chunks, path).count() == chunks.count()


def test_incremental_state(spark):
    found = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", None), ("d", None, "failed")], "path string, file_hash string, error string")
    state = spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "9"), ("e", "5")], "path string, file_hash string")
    status, new = R.next_state(found, state)
    assert sorted(map(tuple, status.collect())) == [("a", "unchanged"), ("b", "changed"), ("c", "processed"), ("d", "failed")]
    assert sorted(map(tuple, new.collect())) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "9"), ("e", "5")]


def test_scores_pairs_and_verdict(spark):
    cases = spark.createDataFrame([("t1", ["use timer create"], ["must not block"]), ("t2", [], [])], "task_id string, gold_answer_points array<string>, required_constraints array<string>")
    outputs = spark.createDataFrame([("t1", "baseline", "Use the TIMER to create."), ("t1", "context_pack", "use timer create; must not block."), ("t2", "baseline", "x")], "task_id string, group string, output_text string")
    scores = E.score_answers(cases, outputs)
    assert sorted((r.task_id, r.group, r.coverage, r.answer_correct, r.missed_constraints) for r in scores.collect()) == [("t1", "baseline", 0.5, "partial", 1), ("t1", "context_pack", 1.0, "yes", 0), ("t2", "baseline", 0.0, "no", 0)]
    assert [(r.task_id, r.winner) for r in E.paired(scores).collect()] == [("t1", "context_pack")]
    results = spark.createDataFrame([("baseline", "no", "yes", "4", "1000", "10"), ("baseline", "yes", "no", "2", "1000", "10"), ("context_pack", "yes", "yes", "1", "400", "9"), ("context_pack", "yes", "yes", "unknown", "40%", "9")], "group string, answer_correct string, citation_correct string, missed_constraints string, token_cost string, elapsed_minutes string")
    v = E.verdict(E.group_stats(results)).first()
    assert v.accuracy_points == 50 and v.missed_reduction == pytest.approx(2 / 3) and v.targets_met == 3 and v.accepted


def test_scorecards_and_readiness(spark):
    cell = "95%"
    sheet = spark.createDataFrame([("d1", "p1", cell, "1", "0.9", "1", "1", "2", "0"), ("d1", "p2", "0.5", "1", "0.9", "1", "1", "1", "1")], "document_id string, parser string, page_metadata_rate string, span_traceability_rate string, table_accuracy string, reading_order_accuracy string, ocr_accuracy string, parse_minutes string, critical_failures string")
    assert [(r.parser, r.passed, r.n_documents) for r in E.parser_scorecards(sheet).collect()] == [("p1", True, 1), ("p2", False, 1)]
    cases = spark.createDataFrame([("t1",), ("t2",)], "task_id string")
    log = spark.createDataFrame([("t1", "baseline", "a", "x.md", "scored"), ("t1", "context_pack", "simulated", "y.md", "scored")], "task_id string, group string, agent string, raw_output_path string, score_status string")
    assert {r.task_id: r.blockers for r in E.readiness(cases, log).collect()} == {"t1": ["simulated_run"], "t2": ["baseline_missing", "context_pack_missing", "not_scored"]}
    assert sorted(map(tuple, E.upsert(cases.withColumn("v", F.lit(1)), cases.limit(1).withColumn("v", F.lit(2)), ["task_id"]).collect())) == [("t1", 2), ("t2", 1)]


def test_replies(spark):
    chunks = spark.createDataFrame([("c1", 1, "The default is 40. Call timer_create() with --fast at most 10 ms."), ("c2", 2, "Call timer_create() from version 7.1")], "chunk_id string, rank int, text string")
    got = {(r.kind, r["name"]): r.chunk_id for r in P.facts(chunks).collect()}
    assert got[("function", "timer_create")] == "c1" and got[("version", "7.1")] == "c2" and got[("option", "--fast")] == "c1"
    replies = spark.createDataFrame([(1, ["e1", "x"], ["e1"], "high"), (2, ["x"], ["e1"], "high")], "reply_id int, cited array<string>, retrieved array<string>, confidence string")
    assert [(r.evidence_ids, r.confidence) for r in P.bind_evidence(replies).collect()] == [(["e1"], "high"), ([], "medium")]
    answers = spark.createDataFrame([(1, "Use made_up_call here.", "timer_create does it"), (2, "1. 2. See span_0123456789ab.", "x")], "answer_id int, answer string, evidence_text string")
    assert sorted(map(tuple, P.answer_violations(answers).collect())) == [(1, "name_without_evidence"), (2, "double_numbering"), (2, "name_without_evidence"), (2, "traceability_marker")]
    rows = chunks.withColumn("reply_id", F.lit(1)).unionByName(spark.createDataFrame([("c0", 0, "Only a title", 1)], "chunk_id string, rank int, text string, reply_id int"))
    assert [r.chunk_id for r in P.evidence_summaries(rows, 2).orderBy("n").collect()] == ["c1", "c2"]
