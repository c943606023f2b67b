import random

import numpy as np
import pytest

from quillspark.llm.common import read_table
from quillspark.llm.components import connected_components
from quillspark.llm.neardup import fast_sketches, near_duplicates, one_of_each, shared_counts

from .cases import documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def expected(docs, size=3, percent=85):
    sets = [shingles(d[1], size) for d in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[top(i)] = min(least.get(top(i), d[0]), d[0])
    return [(d[0], len(s), least.get(top(i)) if d[0] is not None else None, d[0] is None or least[top(i)] == d[0]) for i, (d, s) in enumerate(zip(docs, sets, strict=True))]


def check(spark, docs, **options):
    got = [tuple(r) for r in near_duplicates(documents(spark, docs, ["component_id", "key"]), **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    known = {"size": options.get("shingle", 3), "percent": options.get("percent", 85)}
    assert sorted(got, key=key) == sorted(expected(docs, **known), key=key)


def copies(seed, groups=6, most=25):
    """Groups of texts whose members differ from the group's first by up to some words each."""
    rng, docs = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, most)):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            docs.append(" ".join(words) + (" END" if rng.random() < 0.2 else ""))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, copies(seed))


def test_small_blocks_and_other_thresholds(spark):
    check(spark, copies(3, groups=3, most=60), block=4)
    check(spark, copies(4), shingle=5, percent=80, bands=40, rows=5)


def test_on_the_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in read_table(spark, sf_dir, "documents").collect()])


def test_odd_rows(spark):
    long = "word " * 30_000 + " ".join(str(i) for i in range(3000))
    check(spark, [(9, None), (8, ""), (7, " \t"), (6, "One"), (5, "one"), (4, "two words"), (3, "words two"), (2, "Two Words"), (11, long), (10, long), (10, long), (None, "one"), (None, None), (1, "É a b"), (12, "é a b")])
    check(spark, [])


def test_one_of_each_keeps_whole_rows(spark):
    docs = documents(spark, [(1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (3, None)])
    kept = one_of_each(docs, near_duplicates(docs))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:1200])  # 800 of 1200
    s = fast_sketches([a, b, a[:1], a[:3]], 512)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.08
    assert abs((s[2] == s[3]).mean() - 1 / 3) < 0.08


def test_shared_counts():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    got = shared_counts(sets[:4], sets[4:], slab=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60, 2)] + [(i + 1, i + 2) for i in range(0, 40, 2)] + [(5, 5), (1, 0)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 42)}, **{i + 1: i for i in range(42, 60, 2)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
