import pytest
from pyspark.sql import functions as F

from quillspark.operators.retrieval import Query
from quillspark.session import Workspace


def test_from_folder_to_active_release(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "rules.md").write_text("# Transfer\n\nAn outbound transfer must pass a safety assessment first.\n\n## Limits\n\nNo more than ten units in a day.")
    (docs / "cook.html").write_text("<h1>Pasta</h1><p>Boil the pasta for nine minutes in salted water.</p>")
    (docs / "odd.xyz").write_text("?")
    w = Workspace(spark, str(tmp_path / "work"))
    versions = {r.path.rsplit("/", 1)[1]: r for r in w.ingest_folder(str(docs)).collect()}
    assert versions["odd.xyz"].error and versions["rules.md"].allowed and versions["rules.md"].title == "rules"
    assert {r.code for r in w.validate().collect()} == {"no_chunks"}
    assert {r.reason_code for r in w.evaluate_quality().collect()} == {"document.integrity.canonical_missing", "document.integrity.no_chunks", "document.parse.unsupported", "document.content.text_too_short"}
    assert w.excluded_chunks().count() == 0 and w.quality_records().count() == 2
    w.build_indexes()
    pack = w.context_pack(Query("outbound transfer assessment", top_k=2))
    assert pack.chunks[0]["title"] == "rules" and w.trace(pack.chunks[0]["evidence_ids"][0]).first().title == "rules"
    assert w.search("boil pasta", 1)[0]["title"] == "cook"
    with pytest.raises(ValueError, match="no unit"):
        w.context_pack(Query("pasta"), filters={"project": ["none"]})
    with pytest.raises(ValueError, match="unknown filter"):
        w.context_pack(Query("pasta"), filters={"colour": ["red"]})
    release = w.build_release()
    assert release["status"] == "ready" and w.build_release() == release
    w.activate_release(release["release_id"])
    assert w.active_release() == release
    assert w.dependencies(lambda m: None) == dict.fromkeys(("pdf", "docx", "ocr", "dense_vectors"), False)
    assert w.inventory(str(docs), max_bytes=10**6).filter(F.col("reason").isNull()).count() == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# A\n\nSome text that is long enough to count here.")
    (tmp_path / "m.csv").write_text("sample_id,slot_type,file_path,document_title,document_version,owner,is_scanned,has_tables,has_multicolumn,confidentiality,status,notes\n1,spec,a.md,Alpha,v2,me,,,,,,\n")
    w = Workspace(spark, str(tmp_path / "w"))
    r = w.ingest_manifest(str(tmp_path / "m.csv"), str(tmp_path / "d")).collect()
    assert [(x.title, x.source_type, x.document_version, x.owner) for x in r] == [("Alpha", "spec", "v2", "me")]
