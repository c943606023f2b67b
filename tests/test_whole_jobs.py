from collections import Counter

from quillspark.plans import CATALOG


def rows(spark, sf_dir, name):
    return CATALOG[name][0](spark, sf_dir).collect()


def test_searches_answer_every_fiftieth_row(spark, sf_dir):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    dense = Counter(r.query_id for r in rows(spark, sf_dir, "dense_cosine_search"))
    assert len(ids) == 10 and dense == {i: 10 for i in ids}
    items = {r.item_id for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id % 50 = 0").collect()}
    sparse = Counter(r.item_id for r in rows(spark, sf_dir, "sparse_cosine_search"))
    assert set(sparse) == items and max(sparse.values()) == 10


def test_dense_search_over_several_blocks(spark, sf_dir, monkeypatch):
    from quillspark.plans import search

    want = sorted(map(tuple, rows(spark, sf_dir, "dense_cosine_search")))
    monkeypatch.setattr(search, "BLOCK", 7)
    assert sorted(map(tuple, rows(spark, sf_dir, "dense_cosine_search"))) == want


def test_searches_take_more_queries_and_ties(spark, tmp_path):
    """Two items and 120 vectors, of which many are alike: each query has its own hits, ties by number."""
    spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(120)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows(spark, tmp_path, "dense_cosine_search")
    assert sorted((r.query_id, r.vec_id) for r in got) == [(q, i) for q in (0, 50, 100) for i in range(0, 20, 2)]
    spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha"), (50, "gamma"), (51, "beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.item_id, r.doc_id) for r in rows(spark, tmp_path, "sparse_cosine_search")) == [(0, 1), (50, 2)]


def test_coverage_counts_terms_of_every_language(spark, tmp_path):
    docs = [(1, "alpha", "fr"), (2, "beta", "en"), (3, "gamma", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha beta gamma delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    [r] = rows(spark, tmp_path, "corpus_term_coverage")
    assert (r.n_terms, r.n_known, r.covered) == (4, 3, True)


def test_slugs_are_of_whole_texts(spark, tmp_path):
    same = "word " * 12
    docs = [(1, same + "one"), (2, same + "two"), (3, "!!"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.slug for r in rows(spark, tmp_path, "normalized_text")}
    assert got == {1: "word-" * 12 + "one", 2: "word-" * 12 + "two", 3: "item", 4: None}
