import zlib

import duckdb
import pytest

from quillspark.llm.common import read_table
from quillspark.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "held_out", "lang_pred", "score"],
    "op7": ["page_id", "host", "path", "rule", "verdict"],
    "op8": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10": ["doc_id", "text", "n_chunks", "n_duplicate"],
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {name: query(spark, sf_dir).cache() for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_a_row_for_every_input_row(spark, sf_dir, results, name):
    table, key = ("pages", "page_id") if name.split("_")[0] in ("op7", "op8") else ("documents", "doc_id")
    want = sorted(r[0] for r in read_table(spark, sf_dir, table).select(key).collect())
    assert sorted(r[0] for r in results[name].select(key).collect()) == want
    assert results[name].columns[: len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(sf_dir, results, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    columns = results[name].columns
    want = c.execute(f"select {', '.join(columns)} from ({ORACLES[name]}) q").fetchall()
    assert sorted(map(repr, map(tuple, results[name].collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name,modulus,rest", [("op3_compression_quality", 4, 2), ("op5_counterfactual_toxicity", 5, 0), ("op6_marginalised_language", 3, 1)])
def test_held_out_rows(results, name, modulus, rest):
    for r in results[name].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1
