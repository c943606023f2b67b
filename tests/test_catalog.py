import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import CATALOG

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    clean = lambda v: ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    return sorted(repr(tuple(map(clean, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_sql(spark, sf_dir, name):
    query, sql = CATALOG[name]
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    spark.catalog.clearCache()
    if sql is None:
        assert got or name in ("text_facts", "merged_windows", "context_pack", "artefact_signals")
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    assert plain(got) == plain(c.execute(f"select {', '.join(columns)} from ({sql}) q").fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    """__spark_entry__ imports, and keeps the other queries, where the llm package and the pipeline are gone."""
    code = "import sys; sys.modules['quillspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert 'bm25_topk' in n and 'pipeline' not in n and not [x for x in n if x.startswith('op1')]; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
