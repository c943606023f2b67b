import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.operators import retrieval as R

TEXTS = {
    "v1": "# Transfer rules\n\nAn outbound transfer must pass a safety assessment before data leaves.\n\n## Limits\n\nThe limit is 7.1 units of traffic in every window of time.",
    "v2": "# Cooking\n\nBoil the pasta for nine minutes and add salt to the water early.\n\n## Sauce\n\nTomatoes and basil make the sauce; simmer it slowly.",
    "v3": "# Safety handbook\n\nEvery transfer of a load needs a safety check by two people.",
}


@pytest.fixture(scope="module")
def tree(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "document_version_id string, text string")
    blocks = D.canonical(docs).cache()
    versions = docs.select("document_version_id", F.concat(F.lit("Title "), "document_version_id").alias("title"), F.lit(True).alias("allowed"), F.lit(100.0).alias("quality_score"))
    chunks = D.chunks(blocks).cache()
    return blocks, chunks, versions, R.search_units(chunks, D.sections(blocks), versions).cache()


def test_units_hold_windows(tree):
    _, chunks, _, units = tree
    rows = units.filter("document_version_id = 'v1'").collect()
    merged = next(r for r in rows if r.chunk_ord is None)
    parts = chunks.filter("document_version_id = 'v1'").orderBy("chunk_ord").collect()
    assert len(rows) == 3 and merged.text == "\n\n".join(p.text for p in parts) and merged.section_path == ["1"]
    assert merged.chunk_id == T.stable_id_of("chunkmerge", "v1", parts[0].chunk_id, parts[-1].chunk_id)
    assert merged.section_titles == ["Transfer rules", "Transfer rules + Limits"]


def test_pack_ranks_and_traces(spark, tree):
    blocks, chunks, versions, units = tree
    q = R.Query("outbound transfer safety assessment", top_k=2)
    pack = R.context_pack(units, q)
    assert pack.chunks[0]["document_version_id"] == "v1" and pack.chunks[1]["document_version_id"] == "v3"
    e = pack.chunks[0]["evidence_ids"][0]
    rows = R.trace(blocks, chunks, versions, e).collect()
    assert rows and all(r.document_version_id == "v1" for r in rows)
    items = spark.createDataFrame([("outbound transfer safety",), ("quantum gravity research",)], "item string")
    assert {r["item"]: r.covered for r in R.gap_report(items, pack).collect()} == {"outbound transfer safety": True, "quantum gravity research": False}
    assert "## Title v1 / Transfer rules" in pack.markdown


def test_budget_keeps_one(tree):
    units = tree[3]
    pack = R.context_pack(units, R.Query("transfer safety salt", top_k=4), budget=5)
    assert len(pack.chunks) == 1 and [w.split(":")[0] for w in pack.warnings] == ["token_budget_exceeded", "token_budget_too_small"]


def test_full_text_needs_every_term(tree):
    units = tree[3]
    assert R.fts_hits(units, "transf safe", 9).count() >= 2 and R.fts_hits(units, "transfer basil", 9).count() == 0 and R.fts_hits(units, " ! ", 9).count() == 0


def test_sparse_hits_cross_synonyms(spark):
    units = spark.createDataFrame([("a", "出境需要审批", "t", []), ("b", "煮面条的方法", "t", [])], "chunk_id string, text string, title string, section_titles array<string>")
    assert [r.chunk_id for r in R.sparse_hits(R.sparse_index(units), 2, "海外批准要求", 5).collect()] == ["a"]


def test_soft_gate(tree):
    units = tree[3]
    shut = units.withColumn("allowed", F.lit(False))
    assert R.context_pack(shut, R.Query("pasta salt", top_k=1)).warnings == ["quality_gate_bypassed:v2"]
    half = units.withColumn("allowed", F.col("document_version_id") != "v2")
    found = R.scored(half, R.Query("zzz nothing")).select("document_version_id").distinct().collect()
    assert {r[0] for r in found} == {"v1", "v3"}


def test_selection_spreads_over_documents():
    row = lambda v, n, score, hits=(): {"document_version_id": v, "chunk_id": f"{v}{n}", "text": f"{v} text number {n} {'x' * n}", "section_path": [str(n)], "section_titles": [], "title": v, "evidence_ids": [f"{v}{n}"], "score": score, "clause_hits": list(hits)}
    pool = [row("a", 1, 50), row("a", 2, 49), row("a", 3, 48), row("b", 1, 44), row("c", 1, 30, [0, 1])]
    got = [r["chunk_id"] for r in R.select(pool, R.Query("first clause; second clause", top_k=3, per_document=2))]
    assert got == ["c1", "a1", "b1"]
    assert R.is_duplicate(pool[0], {**pool[0], "section_path": ["9"]})


def test_adjustments(spark):
    rows = spark.createDataFrame([("1.2 Rules\nthe device must stop", ["S"]), ("lower case text", []), ("", []), ("contents\n1 One\n2 Two\n3 Three\n4 Four\n5 Five", [])], "text string, titles array<string>")
    got = [tuple(r) for r in rows.select(R.coherence(F.col("text")), F.round(R.structure(F.col("text")), 6), R.evidence_quality(F.col("text"), F.col("titles")), R.contents_list(F.col("text"))).collect()]
    assert got == [(1.2, 3.0, 13.5, False), (-2.0, 0.0, 0.0, False), (-3.0, 0.0, -8.0, False), (-2.0, 0.0, -34.0, True)]


def test_planning(spark):
    assert [R.intent_of(q) for q in ("timer crash", "open() flags", "有哪些 drivers", "why so", "hm")] == ["troubleshooting", "api", "inventory", "mechanism", "general"]
    memory = spark.createDataFrame([("m1", 0.7, ["timer setup guide"], ["timer_create"]), ("m2", 0.9, ["audio"], ["snd"])], "memory_id string, confidence double, user_patterns array<string>, expanded_queries array<string>")
    rows = R.remembered(memory, "timer setup").collect()
    assert [(r.memory_id, round(r.weight, 3)) for r in rows] == [("m1", 1.933)]
    assert [r["title"] for r in R.reranked([{"title": "a", "section_titles": []}, {"title": "list", "section_titles": []}], ["list"])] == ["list", "a"]
