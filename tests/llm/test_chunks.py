import random

from quillspark.llm.chunks import GEAR, MAX_BYTES, dedup_substrings

from .cases import documents

BLANKS = {0x20, *range(9, 14)}


def naive_chunks(text, mean_words):
    raw = b" " * 16 + text.encode()
    cuts, last = [], 16
    for i in range(17, len(raw)):
        if raw[i] in BLANKS or raw[i - 1] not in BLANKS:
            continue
        h = 0
        for b in raw[i - 16 : i]:
            h = (h << 1) + int(GEAR[b])
        h = (h & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
        if (h >> 16) % mean_words == 0 or i - last >= MAX_BYTES:
            cuts.append(i)
            last = i
    edges = [16, *cuts, len(raw)] if len(raw) > 16 else []
    return [raw[a:b] for a, b in zip(edges, edges[1:])]


def expected(rows, mean_words=5, min_words=16):
    owner, parts = {}, []
    for i, text, *_ in rows:
        parts.append(naive_chunks(text or "", mean_words))
        if i is not None:
            for c in parts[-1]:
                owner[c] = min(owner.get(c, i), i)
    out = []
    for (i, text, *_), own in zip(rows, parts, strict=True):
        seen, marks = set(), []
        for c in own:
            marks.append(i is not None and (owner[c] < i or c in seen))
            seen.add(c)
        kept, k = [], 0
        while k < len(own):
            e = k
            while e < len(own) and marks[e]:
                e += 1
            if e - k >= 2 and sum(len(c.split()) for c in own[k:e]) >= min_words:
                k = e
            else:
                kept += own[k : e + 1]
                k = e + 1
        out.append((i, None if text is None else b"".join(kept).decode(), len(own), sum(marks)))
    return out


def check(spark, rows, **options):
    df = dedup_substrings(documents(spark, rows, ["digest", "owner"]), **options)
    got = [(r.doc_id, r.text, r.n_chunks, r.n_duplicate) for r in df.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(expected(rows, **options), key=key)
    return df


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_against_naive_version(spark):
    rng = random.Random(7)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = [(i, f"{prose(rng, rng.randrange(80))}\n{rng.choice(shared)}  {prose(rng, rng.randrange(50))}") for i in range(60)]
    check(spark, rows)
    check(spark, rows, mean_words=3, min_words=5)


def test_repeated_passages_go_but_for_one_and_shifts_do_not_matter(spark):
    rng = random.Random(8)
    caught = 0
    rows, passages = [], [prose(rng, 55) for _ in range(60)]
    for k, p in enumerate(passages):
        rows += [(2 * k, f"{prose(rng, 30)} {p} {prose(rng, 20)}"), (2 * k + 1, f"{prose(rng, rng.randrange(1, 40))} x {p}\n{prose(rng, 30)}")]
    out = {r.doc_id: r for r in dedup_substrings(documents(spark, rows)).collect()}
    for k, p in enumerate(passages):
        assert out[2 * k].text == rows[2 * k][1]
        caught += p not in out[2 * k + 1].text and 2 * k in out[2 * k + 1].sources
    assert caught >= 57


def test_removed_places_are_in_the_old_text(spark):
    rng = random.Random(9)
    p = prose(rng, 70)
    rows = [(1, p), (2, f"é {prose(rng, 9)} {p} tail of it")]
    r = next(r for r in dedup_substrings(documents(spark, rows)).collect() if r.doc_id == 2)
    old, new, at = rows[1][1], "", 0
    for s in r.removed:
        new, at = new + old[at : s.start], s.stop
    assert r.removed and new + old[at:] == r.text and len(old) - len(r.text) == r.removed_chars


def test_odd_rows(spark):
    rng = random.Random(10)
    p = prose(rng, 40)
    check(spark, [(3, None), (4, ""), (None, p), (None, p), (1, p), (1, p), (2, "same " * 4000), (5, f"{p} {p}"), (6, "x" * 9000 + " " + p), (7, "one"), (8, "\x00 a\x00b ﻿"), (9, " " * 3000)])
    check(spark, [])




def glyphs(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))


def test_passages_without_blanks_go_too(spark):
    rng = random.Random(11)
    p, thai = glyphs(rng, 400), "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(400))
    rows = [(1, glyphs(rng, 90) + p + glyphs(rng, 60)), (2, glyphs(rng, 70) + p + glyphs(rng, 80)), (3, p), (4, thai), (5, thai), (6, thai[:200] + "x" + thai[201:])]
    out = {r.doc_id: r for r in dedup_substrings(documents(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[4].text == thai
    assert out[1].n_chunks > 20
    for i, n in ((2, 300), (3, 300), (5, 300), (6, 250)):
        assert out[i].removed_chars >= n and len(out[i].text) + out[i].removed_chars == len(rows[i - 1][1])
    assert out[2].text.startswith(rows[1][1][:70]) and out[2].text.endswith(rows[1][1][-80:])


def test_short_passages_without_blanks_stay(spark):
    rng = random.Random(12)
    p = glyphs(rng, 20)
    rows = [(i, glyphs(rng, 60) + p + glyphs(rng, 60)) for i in range(20)] + [(99, "的" * 3000)]
    out = {r.doc_id: r for r in dedup_substrings(documents(spark, rows)).collect()}
    assert all(out[i].text == t for i, t in rows[:20]) and out[99].n_chunks > 10


def test_encoded_data_without_blanks_goes_too(spark):
    rng = random.Random(13)
    code = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    p = code(3000)
    rows = [(1, f"head {code(400)}{p}{code(100)} tail"), (2, f"other words {code(333)}{p}{code(200)}"), (3, code(2000))]
    out = {r.doc_id: r for r in dedup_substrings(documents(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1] and out[1].n_chunks > 30
    assert out[2].removed_chars >= 2700 and out[2].text.startswith(rows[1][1][:345]) and out[2].text.endswith(rows[1][1][-200:])


def test_documents_with_names_of_added_columns(spark):
    rng = random.Random(14)
    p = prose(rng, 80)
    names = ["_copies", "copies", "n_chunks", "n_duplicate", "Removed", "removed_chars", "sources", "digest", "owner", "a.b", "c0"]
    out = dedup_substrings(documents(spark, [(1, p), (2, p)], names))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *names, "n_chunks_", "n_duplicate_", "removed_chars_", "removed_", "sources_"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "" and got[2].sources_ == [1] and got[2].sources == "x" and got[1].text == p
