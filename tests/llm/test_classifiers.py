import math
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from quillspark.llm import quality, toxicity
from quillspark.llm.common import labelled_sample, read_table, remainder

from .cases import documents


@pytest.fixture(scope="module")
def small(spark):
    docs = documents(spark, [(i, ("you idiot " if i % 3 == 0 else "a calm day ") + f"number word{i}") for i in range(60)], ["score", "at"])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 != 0 as int) quality", "cast(doc_id % 3 = 0 as int) toxic")
    return docs, labels


ODD = [(None, None), (1, None), (2, ""), (2, ""), (3, "12 345 !!"), (4, "idiot " * 60_000), (5, "fine"), (5, "fine")]


def test_toxicity_learns_and_takes_odd_rows(spark, small):
    model = toxicity.learn_toxicity(*small, F.lit(True))
    out = toxicity.score_toxicity(documents(spark, ODD), model).collect()
    assert len(out) == len(ODD)
    assert {r.doc_id: r.predicted for r in out} == {None: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 0}
    assert all(0 <= r.score <= 1 for r in out)


def test_swapping_identity_terms_hardly_moves_a_score():
    rows = [(i, t, y) for i, (t, y) in enumerate([("these muslim people are scum", 1), ("stupid muslim clown", 1), ("muslim trash", 1), ("a christian choir sang", 0), ("christian bakers meet", 0), ("the choir was kind", 0)] * 30)]
    totals = {0: 90, 1: 90}
    free = toxicity.fit_toxicity(rows, totals, swap_penalty=0.0)
    held = toxicity.fit_toxicity(rows, totals, swap_penalty=8.0)
    gap = lambda m: m.score_words({"a", "muslim", "choir"}) - m.score_words({"a", "christian", "choir"})
    assert gap(free) > 0.15
    assert abs(gap(held)) < 0.05
    assert held.score_words({"muslim", "scum"}) > 0.5 > held.score_words({"muslim", "choir"})


@pytest.mark.parametrize("learn,label,score", [(toxicity.learn_toxicity, "toxic", toxicity.score_toxicity), (quality.learn_quality, "quality", quality.score_quality)])
def test_without_labels_or_documents(spark, small, learn, label, score):
    docs, labels = small
    model = learn(docs, labels.limit(0), F.lit(True))
    assert score(docs, model).select("score").distinct().count() == 1
    assert score(docs.limit(0), model).count() == 0


def test_quality_held_out_accuracy(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir.replace("0.001", "0.01"), "documents"), read_table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    model = quality.learn_quality(docs, labels, F.col("doc_id") % 4 != 2)
    out = quality.score_quality(docs, model).filter("doc_id % 4 = 2").join(labels, "doc_id")
    assert out.filter("predicted = quality").count() > 0.9 * out.count()


def test_quality_takes_odd_rows(spark, small):
    model = quality.learn_quality(*small, F.lit(True))
    out = quality.score_quality(documents(spark, ODD, ["quality"]), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("learn,score", [(toxicity.learn_toxicity, toxicity.score_toxicity), (quality.learn_quality, quality.score_quality)])
def test_documents_with_names_of_added_columns(spark, small, learn, score):
    model = learn(*small, F.lit(True))
    docs = documents(spark, [(1, "you idiot number")], ["score", "Predicted", "predicted_"])
    out = score(docs, model)
    assert out.columns == [*docs.columns, "score_", "predicted__"] and out.first().score == "x"


def test_toxicity_held_out_accuracy_and_brute_force(spark, sf_dir):
    """Accuracy on rows not learned from; every score is the sum of the weights of a text's word features."""
    folder = sf_dir.replace("0.001", "0.1")
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = toxicity.learn_toxicity(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    out = toxicity.score_toxicity(docs.filter(remainder(F.col("doc_id"), 5) == 0), model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in out) > 0.96 * len(out) and sum(r.predicted for r in out) > 30
    for r in out[:200]:
        assert r.score == pytest.approx(model.score_words(set(toxicity.LETTERS.findall((r.text or "").lower()))), rel=1e-9)


def test_neutral_mentions_are_not_toxic():
    """A model that sees groups mentioned mostly in abuse: without the penalty it flags neutral mentions, with it hardly any."""
    rng, terms = random.Random(3), [t for group in toxicity.IDENTITY_TERMS[:5] for t in group]
    abuse, calm = ("scum", "trash", "idiot", "moron"), ("choir", "bakers", "garden", "letters", "river", "school")
    rows = [(i, f"{rng.choice(terms[:6])} {rng.choice(abuse)} {rng.choice(calm)} x{rng.randrange(99)}", 1) for i in range(300)]
    rows += [(i, f"{rng.choice(calm)} {rng.choice(calm)} {rng.choice(terms[6:]) if i % 9 == 0 else ''} x{rng.randrange(99)}", 0) for i in range(300, 600)]
    neutral = [f"the {t} {c} sang" for t in terms for c in calm]
    flagged = []
    for penalty in (0.0, 8.0):
        score = toxicity.fit_toxicity(rows, {0: 300, 1: 300}, swap_penalty=penalty).scorer()
        flagged.append(int((score(neutral) >= 0.5).sum()))
        assert (score([f"{t} scum" for t in terms]) >= 0.5).mean() > 0.95
    assert flagged[1] <= 0.01 * len(neutral) < flagged[0]


def test_quality_against_brute_force(spark, small):
    """The score rises with the difference of the compressed sizes for a byte, and with nothing else."""
    model = quality.learn_quality(*small, F.lit(True))
    texts = ["a calm day number", "you idiot " * 300, "é" * 700, "x"]
    out = {r.doc_id: r.score for r in quality.score_quality(documents(spark, list(enumerate(texts))), model).collect()}
    for n, text in enumerate(texts):
        raw, sizes = text.encode(), []
        for content in (model.good, model.bad):
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[a : a + quality.BLOCK])) for a in range(0, len(raw), quality.BLOCK)))
        z = model.curve[0] + model.curve[1] * (sizes[1] - sizes[0]) / len(raw)
        assert out[n] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_an_id_that_repeats_is_learned_from_once(spark):
    docs = documents(spark, [(1, f"text {n}") for n in range(50)] + [(2, "good"), (3, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, toxic int, quality int")
    rows, totals = labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert rows == [(1, "text 0", 1), (2, "good", 0), (3, "", 0)] and totals == {0: 2, 1: 1}
