from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixture
from quillspark.llm.common import read_table

from .cases import documents

NAMES = ["doc_id", "size", "source_size", "target", "taken", "copies"]


def by_sql(rows):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    if rows:
        c.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    return c.execute(f"select {', '.join(NAMES)} from ({mixture.SQL})").fetchall()


def check(spark, rows):
    got = [tuple(r) for r in mixture.mix(documents(spark, rows, ["size", "rank", "bin"])).select(NAMES).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == [pytest.approx(r) for r in sorted(by_sql(rows), key=key)]
    return got


def test_against_sql_and_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", f"s{i % 7 if i % 3 else 0}") for i in range(900)]
    got = check(spark, rows)
    of = {r[0]: r[3] for r in rows}
    taken, target = defaultdict(int), {}
    for i, size, _, t, words, copies in got:
        taken[of[i]] += words
        target[of[i]] = t
        assert words in (0, size, 2 * size) and words == copies * size
    assert all(abs(taken[s] - target[s]) <= 45 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r[1] for r in got))


def test_odd_rows(spark):
    check(spark, [(1, None, "en", None), (2, "", "en", "b"), (3, "a b", "en", "c"), (3, "a b", "en", "c"), (None, "x y z", "en", "c"), (None, None, "en", "a"), (4, "one two", None, None), (5, "w " * 50_000, "en", "d")])
    check(spark, [(1, None, "en", "a"), (2, "", "en", "b")])
    check(spark, [])


def test_few_bins_give_the_same(spark, monkeypatch):
    rows = documents(spark, [(i, "w " * (1 + i % 9), "en", "ab"[i % 5 == 0]) for i in range(300)])
    want = sorted(map(tuple, mixture.mix(rows).collect()))
    monkeypatch.setattr(mixture, "BINS", 3)
    assert sorted(map(tuple, mixture.mix(rows).collect())) == want


def test_inclusion_is_fair(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("source", F.lit("one"))
    out = mixture.mix(docs)
    r = out.agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).first()
    assert r.t == pytest.approx(1.5 * r.s, rel=0.05)


def test_passed_columns_with_names_of_own_ones(spark):
    docs = documents(spark, [(k, "a b c", "en", f"s{k % 3}") for k in range(12)], ["size", "Target", "a.b"])
    out = mixture.mix(docs, passed=["size", "Target", "a.b", "text"])
    assert out.columns == ["size", "Target", "a.b", "text", "doc_id", "size_", "source_size", "target_", "taken", "copies"]
    assert {(r["size"], r.size_, r["a.b"]) for r in out.collect()} == {("x", 3, "x")}
