import corpus_pipeline as P
from quillspark.llm.common import read_table

from .cases import documents
from .test_chunks import expected as cut_texts
from .test_decontaminate import expected as hits
from .test_mixture import by_sql
from .test_neardup import expected as near


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept."""
    docs = read_table(spark, sf_dir, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substrings", "decontamination", "mixture"]
    one = stages["toxicity"](spark, docs, sf_dir).cache()
    labels = {r.doc_id: r.toxic for r in read_table(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in one.collect()}
    known = [i for i in labels if (i in kept) == (labels[i] == 0)]
    assert one.columns == docs.columns and len(known) > 0.95 * len(labels)

    two = stages["near_duplicates"](spark, one, sf_dir).cache()
    want = {r[0] for r in near(rows_of(one), 5, 80) if r[3]}
    assert two.columns == docs.columns and sorted(r[0] for r in rows_of(two)) == sorted(want)

    three = stages["substrings"](spark, two, sf_dir).cache()
    texts = {r[0]: r[1] for r in cut_texts(rows_of(two))}
    got = rows_of(three)
    assert three.columns == docs.columns and {r[0]: r[1] for r in got} == texts and all(r[4] == len(r[1]) for r in got)

    four = stages["decontamination"](spark, three, sf_dir).cache()
    items = [tuple(r) for r in read_table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    clean = {r[0] for r in hits(got, items) if not r[5]}
    assert four.columns == docs.columns and {r[0] for r in rows_of(four)} == clean and len(clean) < len(got)

    five = stages["mixture"](spark, four, sf_dir)
    want = sorted((r[0], r[4], r[5]) for r in by_sql(rows_of(four)) if r[5] > 0)
    assert sorted((r.doc_id, r.taken, r.copies) for r in five.collect()) == want


def test_stages_take_odd_rows(spark, sf_dir):
    odd = documents(spark, [(1, None, None, None), (2, ""), (3, "one"), (None, "no id here"), (None, None), (4, "word " * 30_000), (5, "twice twice twice"), (5, "twice twice twice"), (6, "ONE")], ["size", "digest"])
    for rows in (odd, odd.limit(0)):
        docs = rows
        for k, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, sf_dir).cache()
            if k < len(P.STAGES) - 1:
                assert docs.columns == rows.columns
        assert docs.count() <= rows.count()


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.filter("taken > 0").count() > 100 and out.filter("taken > 2 * size").count() == 0


def test_mix_carries_texts(spark):
    """Rows that repeat an id or have none keep texts of their own."""
    rows = [(i, f"word {i} of many", "en", "s") for i in range(40)] + [(7, "another seven", "en", "s"), (None, "no id", "en", "s")]
    out = P.mix_sources(spark, documents(spark, rows), "").collect()
    have = {(r[0], r[1]) for r in rows}
    assert len(out) == len(rows) and {(r.doc_id, r.text) for r in out} == have and all(r.n_chars == len(r.text) for r in out)
