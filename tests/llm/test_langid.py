import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid
from quillspark.llm.common import read_table
from quillspark.llm.queries import VOCABULARY

from .cases import documents


def brute(word, pieces, p, unknown):
    """Sum over all segmentations, one by one."""
    s, total = langid.MARK + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
        chance = 1.0
        for a, b in itertools.pairwise(edges):
            piece = s[a:b]
            chance *= p[pieces.index(piece)] if piece in pieces else p[unknown] if len(piece) == 1 else 0.0
        total += chance
    return total


def test_forward_sums_all_segmentations():
    pieces = sorted({"a", "b", "ab", "ba", "aba", langid.MARK + "a", langid.MARK, "é"})
    rng = np.random.default_rng(3)
    p = rng.random((len(pieces) + 1, 2))
    model = langid.LanguageModel(["x", "y"], pieces, p)
    words = ["a", "abba", "ababa", "éa", "zab", "bbbbbbb"]
    got = model.word_scorer()(words)
    for w, row in zip(words, got, strict=True):
        for k in (0, 1):
            assert row[k] == pytest.approx(math.log(brute(w, pieces, p[:, k], len(pieces))), rel=1e-9)


def test_long_words_keep_their_sum():
    pieces = ["a", "aa"]
    model = langid.LanguageModel(["x"], pieces, np.array([[1e-5], [1e-9], [1e-12]]))
    one, two = model.word_scorer()(["a" * 500])[0, 0], model.word_scorer()(["a" * 1000])[0, 0]
    # Sums of words of a grow by the larger root of x * x = 1e-5 * x + 1e-9.
    assert two - one == pytest.approx(500 * math.log((1e-5 + math.sqrt(1e-10 + 4e-9)) / 2), rel=1e-9)


def test_expected_counts_match_brute_force():
    pieces = sorted(["a", "b", "ab", langid.MARK])
    p = np.array([0.2, 0.3, 0.1, 0.4, 0.05])
    table, expected = langid.PieceTable(pieces), np.zeros(5)
    langid.expect(table, p, ["ab"], np.array([2.0]), expected)
    by = dict(zip(pieces, expected, strict=False))
    share = p[pieces.index("ab")] / (p[pieces.index("ab")] + p[pieces.index("a")] * p[pieces.index("b")])
    assert by["ab"] == pytest.approx(2 * share) and by["a"] == pytest.approx(2 - 2 * share) and by[langid.MARK] == pytest.approx(2)


def test_every_piece_is_found():
    pieces = langid.read_pieces(VOCABULARY)
    table = langid.PieceTable(pieces)
    assert (table.find(table.keys) == np.arange(len(pieces))).all()


def test_held_out_accuracy(spark, sf_dir):
    docs = read_table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    model = langid.learn_languages(docs, F.col("doc_id") % 3 != 1, VOCABULARY)
    out = langid.predict_languages(docs, model).filter("doc_id % 3 = 1")
    assert out.filter("lang_pred = lang").count() > 0.95 * out.count()


def test_odd_rows(spark):
    docs = documents(spark, [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "and the", None), (None, "und", "fr"), (4, None, "en")], ["score", "lang_pred_"])
    model = langid.learn_languages(docs, F.lit(True), VOCABULARY)
    odd = documents(spark, [(1, None), (2, ""), (3, "12 !? _"), (4, "the " * 40_000), (5, "DIE katze"), (5, "DIE katze"), (None, "and the cat"), (6, "字 x" + "y" * 3000)])
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(odd, model).collect()]
    assert len(got) == 8 and all(0 <= s <= 1 for _, _, s in got)
    by = dict((i, lang) for i, lang, _ in got)
    assert (by[1], by[2], by[3], by[4], by[5], by[None]) == ("und", "und", "und", "en", "de", "en") and by[6] in ("en", "de")
    none = langid.learn_languages(docs.limit(0), F.lit(True), VOCABULARY)
    assert {r.lang_pred for r in langid.predict_languages(odd, none).collect()} == {"und"}
    assert langid.predict_languages(odd.limit(0), model).count() == 0


def test_expected_counts_of_long_words():
    """Characters of all pieces add up to the word's, however small its probability is."""
    pieces = ["a", "aa", langid.MARK + "a"]
    table, expected = langid.PieceTable(pieces), np.zeros(4)
    langid.expect(table, np.array([1e-5, 1e-9, 1e-7, 1e-12]), ["a" * 700, "a" * 700], np.array([2.0, 1.0]), expected)
    by = dict(zip(pieces, expected, strict=False))
    assert by["a"] + 2 * by["aa"] + by[langid.MARK + "a"] == pytest.approx(2100) and by[langid.MARK + "a"] + expected[3] == pytest.approx(3)


def test_slabs_give_the_same(monkeypatch):
    pieces = sorted({"a", "b", "ab", "bab", "abba", langid.MARK + "ab"})
    model = langid.LanguageModel(["x"], pieces, np.random.default_rng(4).random((len(pieces) + 1, 1)))
    words = ["abbababbab" * 9, "babbabbabb" * 9]
    whole = model.word_scorer()(words)
    monkeypatch.setattr(langid, "SLAB", 10)
    assert np.allclose(model.word_scorer()(words), whole, rtol=1e-12)


def test_a_very_long_word_takes_linear_memory():
    """200,000 letters in a row, as in text without blanks."""
    pieces = langid.read_pieces(VOCABULARY)
    model = langid.LanguageModel(["x", "y"], pieces, np.full((len(pieces) + 1, 2), [[1e-5, 2e-5]], np.float32))
    score = model.scorer()
    tracemalloc.start()
    names, shares = score(["qxz" * 66_667, "字" * 200_000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == ["y", "y"] and most < 150e6


def test_numerals_are_no_letters(spark):
    docs = documents(spark, [(1, "the cat", "en"), (2, "der hund", "de")])
    model = langid.learn_languages(docs, F.lit(True), VOCABULARY)
    odd = documents(spark, [(1, "½ ² ① Ⅷ 12 ٣"), (2, "the²cat"), (3, "der ½")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(odd, model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en" and got[3][0] == "de"
    assert langid.words_of("The²Cat Ⅷ é1ß") == ["the", "cat", "é", "ß"]


def test_every_language_is_learned_and_an_id_counts_once(spark):
    rows = [(k, f"{chr(97 + k // 26)}{chr(97 + k % 26)} " * 3, f"l{k:03}") for k in range(60)] + [(5, "other text", "l005")] * 5 + [(5, None, "l005")]
    model = langid.learn_languages(documents(spark, rows), F.lit(True), VOCABULARY, per_language=1)
    assert model.languages == [f"l{k:03}" for k in range(60)]


def test_documents_with_names_of_added_columns(spark):
    docs = documents(spark, [(1, "the cat", "en")], ["score", "Lang_Pred"])
    out = langid.predict_languages(docs, langid.learn_languages(docs, F.lit(True), VOCABULARY))
    assert out.columns == [*docs.columns, "lang_pred_", "score_"] and out.first().lang_pred_ == "en"
