"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash of the last 16 bytes rolls over the text; a chunk ends before a word where the hash says so, on
average after mean_words words, so an insertion moves only the cuts beside it. In runs without blanks chunks end
inside too, at places with no blank in the RUN bytes before them: before characters beyond ASCII (Chinese,
Japanese, Thai), of which PER_WORD count as a word, and before ASCII ones (encoded data, minified code), of which
PER_ASCII_WORD do. Where no cut comes for MAX_BYTES, one is made at the next word or character beyond ASCII; ASCII runs
are cut by the hash alone, so a run of one byte over and over may stay whole. A chunk's digest is kept by the
smallest doc_id that holds it, and there by its first place; elsewhere the chunk is a duplicate. Runs of at least two
neighbouring duplicate chunks with min_words words or more are cut out of the text; shorter ones, such as common
phrases, stay. Every distinct chunk thus survives at least once, and cuts fall between words or code points.

Digests are 64 bits wide. As a run needs two duplicate chunks in a row, a false cut takes two collisions in neighbours.

The distinct digests of each document are written once; from that table come the smallest id of each (combined
before its shuffle, so a chunk that all documents share is one row a task) and, in a join that the engine can
split, the duplicates of each document. The texts are shuffled once.

Defined results: null texts stay null and empty ones empty; rows without doc_id stay as they are and own
nothing; rows that repeat a doc_id count as one document, each cut by itself; extra columns pass through, and an added
column gets an underscore where one has its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, numbered, tidied, written

GAP = b" " * 16
MAX_BYTES = 256
RUN = 48
PER_WORD, PER_ASCII_WORD = 2, 8
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def gear_table() -> np.ndarray:
    """256 fixed numbers of 32 bits from a multiplicative generator."""
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append(x >> 32)
    return np.array(out, np.uint32)


GEAR = gear_table()


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] of the 16 bytes that end at each place, by doubling."""
    h = GEAR[data]
    for s in (1, 2, 4, 8):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    return h


def marked(rolling: np.ndarray, places: np.ndarray, every: int) -> np.ndarray:
    """Those places before which the hash ends a chunk, one in so many."""
    mark = (rolling[places - 1] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return places[mark % np.uint32(every) == 0]


def chunked(texts: list[bytes], mean_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the ends of its chunks, and the words in each."""
    if not texts:
        return
    joined = GAP + GAP.join(texts) + GAP
    data = np.frombuffer(joined, np.uint8)
    blank = BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    rolling = rolled(data)
    cuts = marked(rolling, starts, mean_words)
    # A word start closer than RUN bytes is a blank closer than that: whether a byte is a place depends on these bytes alone.
    long = np.flatnonzero(np.diff(np.append(np.flatnonzero(blank), len(data))) > RUN)
    chars = plain = np.zeros(0, np.int64)
    if len(long):
        gaps = np.flatnonzero(blank)
        ends = np.append(gaps, len(data))
        inner = np.concatenate([np.arange(gaps[k] + 1 + RUN, ends[k + 1]) for k in long.tolist()])
        chars, plain = inner[data[inner] >= 0xC0], inner[data[inner] < 0x80]
        cuts = np.union1d(cuts, np.concatenate([marked(rolling, chars, mean_words * PER_WORD), marked(rolling, plain, mean_words * PER_ASCII_WORD)]))
    places = np.union1d(starts, chars) if len(chars) else starts
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + len(GAP)) - sizes
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        lo, hi = np.searchsorted(cuts, [begin, begin + size], "right")
        own = cuts[lo:hi]
        own = own[own < begin + size]
        words, wide, ascii_, at = (x[slice(*np.searchsorted(x, [begin, begin + size]))] for x in (starts, chars, plain, places))
        ends = np.append(own, begin + size) if size else own
        edges = np.concatenate([[begin], ends])
        if len(ends) and np.diff(edges).max() > MAX_BYTES:
            extra = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                while b - a > MAX_BYTES:
                    k = np.searchsorted(at, a + MAX_BYTES)
                    if k >= len(at) or at[k] >= b:
                        break
                    a = int(at[k])
                    extra.append(a)
            edges = np.unique(np.concatenate([edges, extra])).astype(np.int64)
            ends = edges[1:]
        yield ends - begin, np.diff(np.searchsorted(words, edges) + np.searchsorted(wide, edges) // PER_WORD + np.searchsorted(ascii_, edges) // PER_ASCII_WORD)


def digests(text: bytes, ends: np.ndarray) -> list[int]:
    out, a = [], 0
    for b in ends.tolist():
        out.append(xxhash.xxh3_64_intdigest(text[a:b]) - (1 << 63))
        a = b
    return out


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def chunk_digests(documents: DataFrame, *, mean_words: int) -> DataFrame:
    """digest and doc_id of the distinct chunks of every document."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = encoded(batch.column(1).to_pylist())
                found, owners, ids = [], [], batch.column(0).to_pylist()
                for i, text, (ends, _) in zip(ids, texts, chunked(texts, mean_words), strict=True):
                    own = set(digests(text, ends))
                    found += own
                    owners.append(np.full(len(own), i, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.concatenate(owners) if owners else [], pa.int64())], names=["digest", "doc_id"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text <> ''")
    return rows.mapInArrow(run, "digest long, doc_id long")


def duplicate_runs(marks: list[bool], words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Chunk ranges [first, past the last) of neighbouring duplicates that are long enough."""
    out, first = [], None
    for k, mark in enumerate([*marks, False]):
        if mark and first is None:
            first = k
        elif not mark and first is not None:
            if k - first >= 2 and sum(words[first:k]) >= min_words:
                out.append((first, k))
            first = None
    return out


#: Columns that dedup_substrings() adds.
ADDED = {"n_chunks": pa.int64(), "n_duplicate": pa.int64(), "removed_chars": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "sources": pa.list_(pa.int64())}
ADDED_SQL = "n_chunks long, n_duplicate long, removed_chars long, removed array<struct<start:long,stop:long>>, sources array<long>"


def cut_text(i: int | None, text: bytes, ends: np.ndarray, words: np.ndarray, copies: list | None, min_words: int) -> tuple:
    """The text without its runs of duplicates, and the values of the added columns. copies: digest and owner."""
    owner = {c["digest"]: c["owner"] for c in copies or ()}
    own = digests(text, ends)
    seen: set[int] = set()
    marks, keepers = [], []
    for d in own:
        keepers.append(owner.get(d, i))
        marks.append(i is not None and (d in owner or d in seen))
        seen.add(d)
    edges = [0, *ends.tolist()]
    pieces, removed, sources, at, chars = [], [], set(), 0, 0
    for a, b in duplicate_runs(marks, words.tolist(), min_words):
        start, stop = edges[a], edges[b]
        kept = text[at:start].decode("utf-8", "surrogatepass")
        gone = len(text[start:stop].decode("utf-8", "surrogatepass"))
        pieces.append(kept)
        removed.append({"start": chars + len(kept), "stop": chars + len(kept) + gone})
        chars += len(kept) + gone
        sources.update(keepers[a:b])
        at = stop
    pieces.append(text[at:].decode("utf-8", "surrogatepass"))
    return "".join(pieces), len(own), sum(marks), sum(r["stop"] - r["start"] for r in removed), removed, sorted(sources)


def dedup_substrings(documents: DataFrame, *, mean_words: int = 5, min_words: int = 16) -> DataFrame:
    """documents' columns with text cut, then n_chunks, n_duplicate, removed_chars, removed (places in the old
    text, in code points) and sources (ids of the documents that keep what was removed)."""
    rows = written(chunk_digests(documents, mean_words=mean_words), "digests")
    owners = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last")
    copies = rows.join(owners, "digest").filter("doc_id > owner")
    listed = copies.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "owner")).alias("copies"))
    own, columns = numbered(documents), documents.columns
    kept = own.columns
    key, body = f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    joined = own.join(listed.withColumnRenamed("doc_id", key), key, "left").select(*kept, "copies")
    schema = ", ".join([*(f"{c} {t}" for c, t in own.dtypes), ADDED_SQL])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                plain = batch.column(body).to_pylist()
                texts = encoded(plain)
                chunks = chunked(texts, mean_words)
                found = [cut_text(i, text, ends, words, copies, min_words) for i, text, (ends, words), copies in zip(batch.column(key).to_pylist(), texts, chunks, batch.column("copies").to_pylist(), strict=True)]
                new = pa.array([None if p is None else f[0] for p, f in zip(plain, found, strict=True)], pa.string())
                arrays = [new if c == body else batch.column(c) for c in kept]
                arrays += [pa.array([f[k] for f in found], t) for k, t in enumerate(ADDED.values(), 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *ADDED])

    return joined.mapInArrow(run, schema).toDF(*columns, *free_names(columns, ADDED).values())
