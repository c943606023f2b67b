"""Queries whose time or memory grew faster than their input: what they hold at a time, and the same results."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.operators import quality as Q
from quillspark.operators import retrieval as R
from quillspark.plans import CATALOG, engine, search
from quillspark.sources import parsers

ODD = [
    "", " \n\t ", "plain", "Shall we? must not.", "- a\n* b\n - c", "1.2 Scope\n2.3.4 应 do", "目录\n1 总则\n2 范围\n3 术语\n4 要求\n5 附录\n附录 A", "附录 A 应采取措施", "Appendix B", "page 12", "PAGE\n7",
    "a b c d e f g h", "_x y", "GET /a\nfeature flag 回滚", "contents\npage 3\n1 A\n2 B\n3 C\n4 D\n5 E", "出境数据应评估。不得\n必须\n\nrequired", "x-y z_1 如果", "１.2 é", "　wide blank",
]


def test_unit_scores_in_python_are_those_of_the_expressions(spark):
    rows = [(n, t, title, [title, leaf]) for n, (t, title, leaf) in enumerate((t, title, leaf) for t in ODD for title, leaf in (("plain", "Appendix B"), ("Doc", "page 12")))]
    frame = spark.createDataFrame(rows, "n int, text string, title string, titles array<string>")
    x, titles = F.col("text"), F.col("titles")
    thin = R.thinness(x, F.col("title"), titles, F.lit(None))
    got = {r.n: r for r in frame.select("n", R.coherence(x).alias("c"), R.structure(x).alias("s"), R.evidence_quality(x, titles).alias("e"), R.contents_list(x).alias("l"), thin.alias("t")).collect()}
    for n, text, title, heads in rows:
        plain = T.normalized(text)
        low = plain.lower()
        want = (R.coherence_of(plain), R.structure_of(text, low), R.evidence_quality_of(plain, heads), R.contents_list_of(plain), R.thinness_of(text, plain, low, T.normalized(title).lower(), T.normalized(heads[-1]).lower()))
        assert [round(float(v), 6) for v in (got[n].c, got[n].s, got[n].e, got[n].l, got[n].t)] == [round(float(v), 6) for v in want], (text, heads)


def test_context_pack_stores_neither_tokens_nor_chunks(spark, sf_dir, monkeypatch):
    """One table of units with their facts, as large as the text; before, token arrays and chunks were written too."""
    tables = []
    keep = lambda df, label: tables.append((label, df.columns)) or df.cache()
    monkeypatch.setattr(R, "stored", keep, raising=False)
    monkeypatch.setattr(engine, "stored", keep)
    engine.context_pack(spark, sf_dir)
    spark.catalog.clearCache()
    assert [label for label, _ in tables] == ["facts"] and "tokens" not in tables[0][1]


def test_blocks_leave_python_slice_by_slice(spark):
    """No column of arrays holds a batch's blocks before they become rows."""
    pages = [(n, f"<h1>T{n}</h1><p>a</p><p>b {n}</p>", k) for n, k in enumerate(["html"] * 1200 + ["pdf", "txt", None])] + [(2000, None, "html")]
    frame = spark.createDataFrame(pages, "page_id int, html string, kind string").coalesce(1)
    found = parsers.explode_blocks(frame, ["page_id"], "html", F.col("kind"))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    got = sorted(map(tuple, found.collect()))
    want = [(n, k, *b) for n, html, kind in pages if kind in parsers.PARSERS for k, b in enumerate(parsers.PARSERS[kind](html or ""), 1)]
    assert got == sorted((n, k, b, x, v) for n, k, b, x, v in want) and len(got) > 3600


def test_runs_of_chunks_without_windows(spark):
    """Runs made within a document's row are those of a table of chunks; of two runs with one id the shortest holds."""
    text = "# A\n\nalpha beta gamma\n\n# B\n\nother words here\n\n# A\n\nalpha beta gamma\n\n# C\n\nlast of the words"
    docs = spark.createDataFrame([("v1", text), ("v2", "# One\n\n" + "word " * 900 + "\n\n# Two\n\nshort text of it"), ("v3", None)], "document_version_id string, text string")
    both = D.chunk_documents(docs, windows=True)
    runs = D.chunk_documents(docs, windows=False)
    table = R.merged_windows(D.chunk_documents(docs).withColumn("section_titles", F.array().cast("array<string>")))
    columns = ["document_version_id", "chunk_id", "text", "section_path", "evidence_ids"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(runs) == rows(both.filter("chunk_ord is null")) == rows(table) and rows(both.filter("chunk_ord is not null")) == rows(D.chunk_documents(docs))
    assert "Window" not in runs._jdf.queryExecution().toString() and "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    chunks = [{"chunk_id": i, "text": i, "section_path": [str(n)], "evidence_ids": [str(n)]} for n, i in enumerate("abac")]
    twice = [r for r in D.runs("v", chunks) if r["chunk_id"] == T.stable_id_of("chunkmerge", "v", "a", "c")]
    assert [r["text"] for r in twice] == ["a\n\nc"]
    assert D.runs("v", chunks * 301) == [] and len(D.runs("v", chunks * 300)) > 0


def test_text_layers_are_counted_without_regular_expressions(spark):
    texts = [*ODD, None, "ÃÂÿ" * 20, "é" * 30, "汉字" * 15 + "ÃÃÃ", "ひらカタ", "𝒳" * 50, "a b\x85c 　 d"]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    found = frame.select("n", T.text_layer_quality(F.col("text")).alias("q"))
    assert "regexp" not in found._jdf.queryExecution().executedPlan().toString()
    plain = T.normalize_space(F.coalesce("text", F.lit("")))
    cjk, latin1 = T.count_class(plain, "一-鿿"), T.count_class(plain, T.LATIN1_MOJIBAKE)
    want = frame.select("n", F.length(plain), cjk, latin1 + T.count_class(plain, "぀-ゟ゠-ヿ"), F.when(F.length(plain) > 0, latin1 / F.length(plain)).otherwise(0.0))
    got = found.select("n", "q.char_count", "q.cjk_count", "q.suspect_count", "q.latin1_ratio")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    reasons = {r.n: list(r.q.reason_codes) for r in found.collect()}
    assert [reasons[n] for n in range(len(ODD), len(texts))] == [["text_too_short"], ["latin1_mojibake_ratio_high"], ["text_too_short"], ["text_too_short", "mojibake_suspect_ratio_high"], ["text_too_short"], [], ["text_too_short"]]


def test_signals_normalise_each_text_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(Q, "normalize_space", lambda c: calls.append(1) or T.normalize_space(c))
    docs = spark.createDataFrame([("v1", "# A\n\nsame words here\n\n# B\n\nsame  words here\n\n# A\n\nx"), ("v2", "# A\n\nsame words here")], "document_version_id string, text string")
    blocks = D.canonical(docs).withColumns({"page_start": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")})
    chunks = D.chunk_documents(docs, min_chars=1)
    signals = Q.block_signals(blocks, blocks).unionByName(Q.chunk_signals(chunks, blocks))
    found = sorted((r.reason_code, r.document_version_id, r.actual_value) for r in signals.collect())
    assert len(calls) == 2 and found == [("block.content.duplicate", "v1", None)] * 2 + [("chunk.content.too_short", "v1", "3")]


def test_sparse_search_shuffles_rare_features_alone(spark, sf_dir, monkeypatch):
    """Common features meet their frequencies without a shuffle; the hits are the same, however few count as common."""
    found = lambda: sorted(map(tuple, CATALOG["sparse_cosine_search"][0](spark, sf_dir).collect()))
    plan = CATALOG["sparse_cosine_search"][0](spark, sf_dir)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan
    want = found()
    monkeypatch.setattr(search, "COMMON", 50)
    assert found() == want
    monkeypatch.setattr(search, "LONGEST_COMMON", 0)
    assert found() == want and len(want) >= 10


def test_features_add_up():
    low = "ab_cd ab cd_x 出境数据 出境数据 " + "甲乙丙丁戊己庚辛壬 long_identifier_name ab_cd"
    got = T.features_of(low, [(re.compile("出境"), "syn:x", 1.2)])
    assert got["ascii:ab"] == pytest.approx(1.2 + 2 * 0.7) and got["ascii:cd"] == pytest.approx(3 * 0.7) and "ascii:x" not in got
    assert got["cjk:出境"] == 2.0 and got["cjk:出境数据"] == pytest.approx(2 * (1.6 + 1.6 + 0.4)) and got["syn:x"] == 1.2
    assert "cjk:甲乙丙丁戊己庚辛壬" not in got and got["ascii:long_identifier_name"] == 2.4
