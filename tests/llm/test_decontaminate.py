import gc
import hashlib
import random
import re
import sys
import weakref

from quillspark.llm import decontaminate
from quillspark.llm.common import read_table
from quillspark.llm.decontaminate import mark_contaminated

from .cases import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, size=10):
    out = []
    of = {}
    for i, t in items:
        if i is not None and (w := words(t)):
            of.setdefault(str(i), set()).update(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for name, windows in of.items():
            for win in windows:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(name)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def check(spark, docs, items, **options):
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_hit int")
    got = [tuple(r) for r in mark_contaminated(documents(spark, docs, ["n_hit"]), bench, **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(expected(docs, items), key=key)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Only Three words"), (12, "two words"), (3, None), (4, " !! "), (None, "only three words"), (5, "only three words"), (6, "a a a a a a a a a a a a"), (7, "é1-ß2"), (8, "single")]
DOCS = [(1, f"pre {LONG} post"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8 x w9"), (3, "ONLY,three--words; only three"), (4, None), (5, ""), (None, "two words two words"), (6, "a " * 30), (6, "a " * 30), (7, "é1 ß2 SINGLE"), (8, "w31 " + " ".join(f"w{i}" for i in range(30, 40))), (9, "w5 w6 " + "filler " * 50_000 + " ".join(f"w{i}" for i in range(3, 14)))]


def test_against_brute_force(spark):
    check(spark, DOCS, ITEMS)


def test_blocks_give_the_same(spark):
    check(spark, DOCS, ITEMS, block_bytes=60)


def test_empty_tables(spark):
    check(spark, DOCS, [])
    check(spark, [], ITEMS)


def test_on_the_tables(spark, sf_dir):
    docs, items = ([(r[0], r[1]) for r in read_table(spark, sf_dir, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    docs = [d for d in docs if len(d[1]) < 3000]
    check(spark, docs, items)


def test_spans(spark):
    out = mark_contaminated(documents(spark, [(1, f"x {LONG} y only three words")]), spark.createDataFrame(ITEMS, "item_id long, text string"), spans=True).first()
    assert [tuple(s) for s in out.spans] == [(1, 41), (42, 45)] and out["items"] == ["1", "2", "5"]


def test_one_index_is_alive_at_a_time(spark, monkeypatch):
    alive, most = weakref.WeakValueDictionary(), []
    made = decontaminate.index_windows

    def counted(pieces, window):
        gc.collect()
        index = made(pieces, window)
        alive[len(most)] = index
        most.append(len(alive))
        return index

    monkeypatch.setattr(decontaminate, "index_windows", counted)
    check(spark, DOCS, ITEMS, block_bytes=2000)
    assert len(most) > 2 and max(most) == 1


def test_an_index_keeps_within_its_rate():
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30_000))) for _ in range(12)]
    pieces = [(str(n), p) for n, t in enumerate(texts) for p in decontaminate.pieces_of(t.encode().split(), 10)]
    index = decontaminate.index_windows(pieces, 10)
    index.order({k: (v, v * 0) for k, v in index.shingle_keys().items()})
    held = [index.ids, *(getattr(w, f) for w in index.by_length.values() for f in ("starts", "bounds", "items", "keys", "which", "offsets"))]
    size = sum(a.nbytes for a in held) + sys.getsizeof(index.vocabulary) + sum(map(sys.getsizeof, index.vocabulary)) + 32 * len(index.vocabulary)
    assert size < decontaminate.INDEX_RATE * sum(map(len, texts))


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    check(spark, DOCS, ITEMS)
    check(spark, DOCS, ITEMS, block_bytes=3000)


def test_kept_columns_with_names_of_added_ones(spark):
    docs = documents(spark, [(1, f"x {LONG}"), (2, "y")], ["n_hit", "items", "Contaminated", "a.b"])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (64 << 20, 60):
        out = mark_contaminated(docs, bench, keep=["doc_id", "n_hit", "items", "Contaminated"], block_bytes=size)
        assert out.columns == ["doc_id", "n_hit", "items", "Contaminated", "n_words", "n_hit_", "n_items", "items_sha256", "contaminated_"]
        assert {(r.doc_id, r.n_hit, r.n_hit_, r.contaminated_) for r in out.collect()} == {(1, "x", 40, True), (2, "x", 0, False)}


def test_words_of_a_slice_at_a_time(spark, monkeypatch):
    """Spark's batches have 10,000 rows; the words of so many texts would fill a worker."""
    found = decontaminate.WindowIndex.ids_of

    def bounded(self, words):
        if len(words) > 500 * 101:
            raise MemoryError(f"{len(words)} words at once")
        return found(self, words)

    monkeypatch.setattr(decontaminate.WindowIndex, "ids_of", bounded)
    docs = [(n, f"{LONG} " + f"t{n} " * 60) for n in range(1200)]
    for size in (64 << 20, 2000):
        out = mark_contaminated(documents(spark, docs).coalesce(1), spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=size).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit) for r in out) == [(n, 100, 40) for n in range(1200)]
