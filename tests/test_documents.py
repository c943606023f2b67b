import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.sources import files, parsers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, " a\t b \r\n\n　c　d\x0be ", T.normalize_space) == "a b\nc d\ne" == T.normalized(" a\t b \r\n\n　c　d\x0be ")
    assert one(spark, "  Ab 中文--x!", T.slugify) == "Ab-中文-x" and one(spark, "!!", T.slugify) == "item"
    assert one(spark, "n", lambda c: T.stable_id("doc", c, F.lit(None).cast("string"), "False", 3)) == T.stable_id_of("doc", "n", None, False, 3)
    assert [one(spark, v, T.is_placeholder) for v in ("", " N/A ", "待提供", "x", None)] == [True, True, True, False, True]
    for text in ("", "abcdefgh", "中文abcd", "カタカナ한글", "，。中"):
        assert one(spark, text, T.chunk_tokens) == T.chunk_tokens_of(text)
        assert one(spark, text, T.pack_tokens) == T.pack_tokens_of(text)
    for text in ("Set io_file=7.1 a b", "出境审批如何 abc", "中文很长很长很长很长的一段", "如果"):
        got = one(spark, text, T.search_tokens)
        assert sorted(got) == sorted(T.search_tokens_of(text).elements())
    assert T.search_tokens_of("出境")["出境"] == 2
    for term in ("abc", "abcdef", "abcdefghijkl", "中", "中文字", "中文字字"):
        assert one(spark, term, T.term_weight) == T.term_weight_of(term)
    assert one(spark, "a=b io-x 中文字", T.memory_tokens) == ["io-x", "中文", "文字"]


def test_sparse_features(spark):
    frame = spark.createDataFrame([(1, "run io_file 海外批准")], "id int, text string")
    got = {r.feature: round(r.weight, 6) for r in T.feature_weights(frame, "id", F.col("text"), (("run", (), ("run",)),)).collect()}
    assert got["ascii:io_file"] == 1.8 and got["ascii:io"] == 0.7 and got["concept:run"] == 1.4
    assert got["syn:出境|跨境|境外|海外"] == 1.2 and got["cjk:海外批准"] == 1.6 + 2.0


def test_match_terms():
    assert T.match_terms('Open "io_x" 7.1 分区 a ab. 12 ab.') == [("open", True), ("io_x", True), ("7.1", False), ("分区", False), ("ab.", True), ("12", True)]
    assert T.match_terms(" ! ") == [] and T.clauses_of("ab, 出境审批；xyz z") == ["出境审批", "xyz z"]


def test_parsers():
    md = "intro\ntext\n# One\n| a | b |\n| - | - |\nafter\n\n## Two  words\n#no\n####### no"
    assert parsers.markdown_blocks(md) == [("paragraph", "intro\ntext", None), ("heading", "One", 1), ("table", "| a | b |\n| - | - |", None), ("paragraph", "after", None), ("heading", "Two  words", 2), ("paragraph", "#no\n####### no", None)]
    assert [b[1] for b in parsers.text_blocks("a\nb\n \n c \r\n\r\n\n")] == ["a\nb", "c"]
    html = "<h2>T <b>x</b></h2><script>no</script>loose<p>one<li>two</li><table><tr><td>a</td><th> b </th></tr><tr></tr></table><p>lost"
    assert parsers.html_blocks(html) == [("heading", "T x", 2), ("paragraph", "one", None), ("paragraph", "two", None), ("table", "a | b", None)]
    assert parsers.decode("﻿é".encode()) == "é" and parsers.decode("中".encode("gb18030")) == "中" and parsers.decode(b"\xff\xff") == "ÿÿ"
    assert [parsers.pdf_heading_level(x) for x in ("Chapter 3", "2.3 Title", "A Short Title of Things", "Not a heading.", "plain text line here")] == [1, 2, 2, None, None]
    pages = parsers.pdf_page_blocks(["Guide To Things\nfirst line\nsecond\n\n12", "Guide To Things\nmore"])
    assert pages == [(1, "heading", "Guide To Things", 2), (1, "paragraph", "first line second", None), (2, "paragraph", "more", None)]


def test_canonical_and_chunks(spark):
    text = "# Top\n\nAlpha paragraph here.\n\n## Sub\n\n| k | v |\n| 1 | 2 |\n\n# Next\n\nBeta paragraph here."
    docs = spark.createDataFrame([("v1", text), ("v2", "no heading at all"), ("v3", ""), ("v4", None)], "document_version_id string, text string")
    blocks = D.canonical(docs)
    rows = blocks.filter("document_version_id = 'v1'").orderBy("ord").collect()
    assert [(r.block_type, ".".join(r.section_path)) for r in rows] == [("heading", "1"), ("paragraph", "1"), ("heading", "1.1"), ("table", "1.1"), ("heading", "2"), ("paragraph", "2")]
    assert rows[1].block_id == T.stable_id_of("blk", "v1", 2, "Alpha paragraph here.")
    got = D.chunks(blocks).orderBy("document_version_id", "chunk_ord").collect()
    assert [(r.document_version_id, r.text) for r in got] == [("v1", "Top\n\nAlpha paragraph here."), ("v1", "Sub\n\n| k | v |\n| 1 | 2 |"), ("v1", "Next\n\nBeta paragraph here.")]
    assert got[0].evidence_ids == [rows[0].evidence_id, rows[1].evidence_id] and got[0].chunk_id == T.stable_id_of("chunk", "v1", got[0].text)
    assert D.chunks(blocks, drop_unsectioned=False).filter("document_version_id = 'v2'").count() == 1
    direct = D.chunk_documents(docs).select(*D.chunks(blocks).columns)
    assert sorted(map(repr, direct.collect())) == sorted(map(repr, D.chunks(blocks).collect()))
    titles = {tuple(r.section_path): r.title for r in D.sections(blocks).filter("document_version_id = 'v1'").collect()}
    assert titles == {("1",): "Top", ("1", "1"): "Sub", ("2",): "Next"}
    gate = {r.document_version_id: r.allowed for r in D.gate(D.generic_quality(blocks)).collect()}
    assert gate == {"v1": True, "v2": False}


def block(kind, text, *path, i=None):
    return {"block_type": kind, "text": text, "section_path": list(path), "evidence_id": i}


def test_packing_rules():
    long = " ".join(f"Word{n} goes here." for n in range(400))
    got = D.pack([block("heading", "H", "1", i="h"), block("paragraph", long, "1", i="p")], max_tokens=64)
    assert len(got) > 5 and all(T.chunk_tokens_of(c["text"]) <= 64 + 41 for c in got)
    assert got[1]["text"].startswith(got[0]["text"][-160:]) and got[1]["evidence_ids"] == ["p"]
    apart = D.pack([block("paragraph", "x" * 300, "1", i="a"), block("heading", "Second", "2", i="b"), block("paragraph", "y" * 30, "2", i="c")], overlap=32)
    assert apart[1]["text"] == "Second\n\n" + "y" * 30
    assert D.pack([block("paragraph", "tiny", "1")]) == [] and D.pack([block("paragraph", "Page 12", "1")]) == []
    assert D.pack([block("heading", "A trailing heading", "1")])[0]["text"] == "A trailing heading"


@pytest.mark.parametrize("line,budget", [("x" * 1000, 50), ("中" * 500, 100), ("中a" * 300, 30)])
def test_hard_cuts(line, budget):
    cuts = D.hard_cut(line, budget)
    assert "".join(cuts) == line and all(T.chunk_tokens_of(c) <= budget and len(c) <= 4 * budget for c in cuts)


def test_sentences():
    assert D.sentences("See fig. A here. Next one e.g. This stays. 7. No.\n\nA。B！ C") == ["See fig. A here.", "Next one e.g.", "This stays. 7. No.", "A。", "B！", "C"]


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.md").write_text("no")
    (tmp_path / "my_doc.md").write_text("# Hi\n\nthere")
    (tmp_path / "b.xyz").write_text("?")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"my_doc.md", "b.xyz", "c.pdf"} and rows["my_doc.md"].text.startswith("# Hi")
    assert rows["b.xyz"].error == "unsupported document format: .xyz" and rows["c.pdf"].error == "no parser installed for .pdf"
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.reason) for r in files.inventory(files.list_files(spark, str(tmp_path)), max_bytes=1000, exclude=("PDF",)).collect()}
    assert got == {"my_doc.md": ("my doc", None), "b.xyz": ("b", "unsupported_extension"), "c.pdf": ("c", "excluded_keyword")}
    (tmp_path / "m.csv").write_text("﻿sample_id,slot_type,file_path,document_title,document_version,owner,is_scanned,has_tables,has_multicolumn,confidentiality,status,notes\n1,a,my_doc.md,T,v1,unknown,,,,,,\n2,a,N/A,,,,,,,,,\n")
    m = files.read_manifest(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.ingest_status, r.owner) for r in m] == [("ready", None), ("skipped", None)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n# note\nbroken{\n\n{"a": 2}\n')
    assert [r.a for r in files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, 2]
