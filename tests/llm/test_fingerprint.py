import hashlib

from quillspark.llm.fingerprint import fingerprint, fingerprint_documents, half_replaced, likeness

from .cases import documents


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for n, (i, text, *_) in enumerate(rows):
        other = rows[(n + 1) % len(rows)][1] or ""
        edited = half_replaced(text or "", other)
        mark = fingerprint(text)
        out.append((i, len(text or ""), hashlib.sha256(edited.encode()).hexdigest(), mark, fingerprint(edited), likeness(mark, fingerprint(edited)), likeness(mark, fingerprint(other))))
    return out


def check(spark, rows, **options):
    got = [tuple(r) for r in fingerprint_documents(documents(spark, rows, ["at", "last"]), **options).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(got, key=order) == sorted(expected(rows), key=order)


def test_against_brute_force(spark):
    check(spark, [(i * 7 % 101, f"text {i} 😀 " * (i % 13)) for i in range(101)])
    check(spark, [(i, "abc" * i) for i in range(40)], buckets=30)


def test_odd_rows(spark):
    check(spark, [(3, None), (1, ""), (1, "b"), (1, "b"), (2, "x" * 90_000), (None, "n"), (None, None), (9, "é"), (9, "abcd")], buckets=3)
    check(spark, [(5, "alone")])
    check(spark, [])


def test_likeness():
    a, b, c = fingerprint("the quick brown fox jumps over the lazy dog " * 9), fingerprint("the quick brown fox jumps over the lazy cat " * 9), fingerprint("0123456789 #### zzzz " * 30)
    assert likeness(a, a) == 1 and likeness(a, b) > likeness(a, c) and 0 <= likeness(a, fingerprint("")) <= 1
