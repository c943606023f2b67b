"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is window consecutive words of an item (a shorter item is one window). Its shingles of up to three
words are ordered by rarity, counted over all documents. A document holds the whole window only if it holds
every shingle, so the prefix that a join needs is one shingle: the rarest. Documents are probed with their
shingles for such prefixes alone; the shingle's offset in the window fixes where the window must begin
(positional bound), a window that would begin before the text or end after it is dropped (length bound), and
the rest are compared word by word.

Words are found as whole strings in the benchmark's own vocabulary, so nothing depends on hashes.

Memory. Items are dealt into blocks whose index takes about block_bytes (long items as pieces that overlap by
a window less a word, so every window lies in one piece). One block at a time is on the driver and shared; its
hits are written before the next one is read, so neither driver nor tasks ever hold two. Beside it a task holds the
words of one slice of a batch: a text, or several of 1 MB together. A benchmark of one block marks documents in a
single map; for more, hits are kept by the digest of a text and join the documents.

Defined results: null and empty texts have no words and no hits; null item ids are ignored, as are items
without words; repeated rows each get a row and equal items count once for each item_id; columns that aren't kept are
ignored, and an added column gets an underscore where a kept one has its name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, in_slices, numbered, received, share, tidied, written

#: Bytes that part words (in UTF-8) as a space, capitals as small letters.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SHINGLE = 3
#: Bytes of index to a byte of item text, at most, and words to a piece of a long item.
INDEX_RATE, PIECE = 32, 4096
#: Candidates that are compared at once.
SLAB = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), then those of first[1], and so on."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


@dataclass
class Windows:
    """The distinct windows of one length."""

    #: Where each begins among the block's word ids, and its items: those of window n are items[bounds[n]:bounds[n + 1]].
    starts: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    #: Sorted prefix keys, and the window and offset of each.
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    which: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


@dataclass
class WindowIndex:
    """Windows of a block of items as places in one run of word ids (0: not in the block)."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray
    item_names: list[str]
    by_length: dict[int, Windows]

    def key(self, ids: np.ndarray, k: int) -> np.ndarray:
        """One number for each run of k ids; 0 where a word isn't in the block. Equal runs have equal numbers."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        base = len(self.vocabulary) + 1
        out, known = ids[:n].astype(np.int64), ids[:n] > 0
        for j in range(1, k):
            part = ids[j : j + n]
            out = out * base + part
            known = known & (part > 0)
        return np.where(known, np.where(out == 0, 1, out), 0)

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def shingle_keys(self) -> dict[int, np.ndarray]:
        """By size, the sorted keys of the shingles in windows."""
        found = defaultdict(list)
        for length, w in self.by_length.items():
            k = min(SHINGLE, length)
            inside = np.zeros(len(self.ids) + 1, np.int64)
            np.add.at(inside, w.starts, 1)
            np.add.at(inside, w.starts + length - k + 1, -1)
            found[k].append(self.key(self.ids, k)[np.flatnonzero(np.cumsum(inside[:-1])[: len(self.ids) - k + 1])])
        return {k: np.unique(np.concatenate(v)) for k, v in found.items()}

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Choose each window's rarest shingle by the counts (sorted keys, how often), and index the windows by it."""
        for length, w in self.by_length.items():
            k = min(SHINGLE, length)
            keys, many = counts[k]
            rank = np.empty(len(keys), np.int64)
            rank[np.lexsort((keys, many))] = np.arange(len(keys))
            own = self.key(self.ids, k)
            place = rank[np.minimum(np.searchsorted(keys, own), len(keys) - 1)]
            offsets = np.empty(len(w.starts), np.int32)
            view = sliding_window_view(place, length - k + 1)
            for at in range(0, len(w.starts), SLAB):
                offsets[at : at + SLAB] = view[w.starts[at : at + SLAB]].argmin(1)
            prefix = own[w.starts + offsets]
            order = np.argsort(prefix, kind="stable")
            w.keys, w.which, w.offsets = prefix[order], order.astype(np.int32), offsets[order]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray | None, set[str]]:
        """Which words of a run of word ids a window covers (None: none), and the items with windows there."""
        change, found, made = None, set(), {}
        for length, w in self.by_length.items():
            k = min(SHINGLE, length)
            if k not in made:
                run = self.key(ids, k)
                at = np.flatnonzero(run)
                made[k] = at, run[at]
            at, run = made[k]
            low = np.searchsorted(w.keys, run, "left")
            many = np.searchsorted(w.keys, run, "right") - low
            some = np.flatnonzero(many)
            ends = np.cumsum(many[some])
            first = 0
            while first < len(some):
                past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLAB, "right")))
                part = some[first:past]
                first = past
                entry = ranges(low[part], many[part])
                begin = np.repeat(at[part], many[part]) - w.offsets[entry]
                within = (begin >= 0) & (begin + length <= len(ids))
                begin, which = begin[within], w.which[entry[within]]
                for j in range(length):
                    same = ids[begin + j] == self.ids[w.starts[which] + j]
                    begin, which = begin[same], which[same]
                if not len(begin):
                    continue
                if change is None:
                    change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length, -1)
                which = np.unique(which)
                owners = w.items[ranges(w.bounds[which], w.bounds[which + 1] - w.bounds[which])]
                found.update(self.item_names[o] for o in np.unique(owners).tolist())
        return None if change is None else np.cumsum(change[:-1]) > 0, found


def pieces_of(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    """The words of an item in pieces of PIECE windows each."""
    for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
        yield words[at : at + PIECE + window - 1]


def index_windows(pieces: list[tuple[str, list[bytes]]], window: int) -> WindowIndex:
    """pieces: item and words, of at least window words or a whole item."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in pieces})
    number = {name: n for n, name in enumerate(names)}
    sizes = np.array([len(words) for _, words in pieces], np.int64)
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for _, words in pieces for w in words), np.int32, int(sizes.sum()))
    owner = np.array([number[name] for name, _ in pieces], np.int64)
    first = np.cumsum(sizes) - sizes
    by_length = {}
    for length in np.unique(np.minimum(sizes, window)).tolist():
        own = np.flatnonzero(np.minimum(sizes, window) == length)
        many = sizes[own] - length + 1
        starts = ranges(first[own], many)
        rows = np.ascontiguousarray(sliding_window_view(ids, length)[starts]).view(np.dtype((np.void, 4 * length))).ravel()
        _, some, same = np.unique(rows, return_index=True, return_inverse=True)
        owned = np.unique(same.ravel() * len(names) + np.repeat(owner[own], many))
        by_length[length] = Windows(starts[some], np.searchsorted(owned, np.arange(len(some) + 1) * len(names)), (owned % len(names)).astype(np.int32))
    return WindowIndex(vocabulary, ids, names, by_length)


def count_shingles(documents: DataFrame, text: str, index: WindowIndex) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size, the windows' shingles and how often each occurs in all documents: at most one row a shingle comes back."""
    keys = index.shingle_keys()
    if not keys:
        return {}
    shared = share(documents.sparkSession, (index.vocabulary, keys))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, keys = received(shared)
        index = WindowIndex(vocabulary, np.zeros(0, np.int32), [], {})
        totals = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in (part for whole in batches for part in in_slices(whole, 0)):
            # Texts are joined by a word outside the vocabulary, so no shingle spans two of them.
            ids = index.ids_of(b" \xff ".join(t.encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist() if t).translate(TABLE).split())
            for k, v in keys.items():
                run = index.key(ids, k)
                run = run[run != 0]
                at = np.minimum(np.searchsorted(v, run), len(v) - 1)
                totals[k] += np.bincount(at[v[at] == run], minlength=len(v))
        for k, v in totals.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(v[some])], names=["k", "at", "n"])

    rows = documents.select(text).mapInArrow(run, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    k, at, n = (rows.column(c).to_numpy() for c in ("k", "at", "n"))
    counts = {size: (v, np.zeros(len(v), np.int64)) for size, v in keys.items()}
    for size, (_, many) in counts.items():
        many[at[k == size]] = n[k == size]
    shared.destroy()
    return counts


def dealt_pieces(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """item, words and block of the items' pieces, and how many blocks there are; of several, the pieces are written once."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, piece in enumerate(pieces_of(words_of(text), window)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int32()), pa.array([b" ".join(piece)], pa.binary())], names=["item", "n", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    pieces = items.mapInArrow(run, "item string, n int, words binary")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, min(-(-size.bytes * INDEX_RATE // block_bytes), size.n))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "n"), F.lit(parts)))
    return (written(pieces, "pieces") if parts > 1 else pieces), parts


def one_block(pieces: DataFrame, block: int) -> list[tuple[str, list[bytes]]]:
    return [(r.item, bytes(r.words).split(b" ")) for r in pieces.filter(F.col("block") == block).select("item", "words").collect()]


ADDED = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))}
ADDED_SQL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:long,last:long>>"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def runs_of(covered: np.ndarray | None) -> list[dict[str, int]]:
    if covered is None:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).reshape(-1, 2)
    return [{"first": a, "last": b} for a, b in edges.tolist()]


def merged(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """Spans as they are together: overlapping and touching ones as one."""
    out: list[dict[str, int]] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def described(n_words: list[int], items: list, spans: list) -> list[pa.Array]:
    """The added columns of rows."""
    names, hit = [sorted(i) for i in items], [sum(s["last"] - s["first"] for s in x) for x in spans]
    digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in names]
    values = (n_words, hit, [len(i) for i in names], digests, [n > 0 for n in hit], names, spans)
    return [pa.array(v, t) for v, t in zip(values, ADDED.values(), strict=True)]


def text_digest(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _one_block(rows: DataFrame, index: WindowIndex, kept: list[str], text: str, schema: str) -> DataFrame:
    shared = share(rows.sparkSession, index)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared)
        for batch in (part for whole in batches for part in in_slices(whole, text)):
            n_words, items, spans = [], [], []
            for t in batch.column(text).to_pylist():
                words = words_of(t)
                covered, found = index.hits(index.ids_of(words))
                n_words.append(len(words))
                items.append(found)
                spans.append(runs_of(covered))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + described(n_words, items, spans), names=[*kept, *ADDED])

    return rows.mapInArrow(run, schema)


def _block_hits(rows: DataFrame, index: WindowIndex, text: str) -> DataFrame:
    """digest, items and spans of the texts with hits, each text once, as a written table."""
    shared = share(rows.sparkSession, index)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared)
        for batch in (part for whole in batches for part in in_slices(whole, 0)):
            digests, items, spans = [], [], []
            for t in batch.column(0).to_pylist():
                covered, found = index.hits(index.ids_of(words_of(t)))
                if covered is not None:
                    digests.append(text_digest(t))
                    items.append(sorted(found))
                    spans.append(runs_of(covered))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)], names=["digest", "items", "spans"])

    found = rows.select(text).mapInArrow(run, "digest binary, items array<string>, spans array<struct<first:long,last:long>>")
    out = written(found.groupBy("digest").agg(F.first("items").alias("items"), F.first("spans").alias("spans")), "hits")
    shared.destroy()
    return out


def _joined(rows: DataFrame, hits: DataFrame, kept: list[str], text: str, kept_schema: list[str], schema: str) -> DataFrame:
    """rows with the hits of all blocks, which hold a text once each."""

    @tidied
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole, text)):
            texts = batch.column(text).to_pylist()
            digests, n = pa.array(map(text_digest, texts), pa.binary()), pa.array([len(words_of(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), digests, n], names=[*kept, "digest", "n_words"])

    @tidied
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, spans = ([x or [] for x in batch.column(c).to_pylist()] for c in ("items", "spans"))
            names = [{i for part in x for i in part} for x in items]
            covered = [merged([s for part in x for s in part]) for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + described(batch.column("n_words").to_pylist(), names, covered), names=[*kept, *ADDED])

    measured = rows.mapInArrow(measure, ", ".join([*kept_schema, "digest binary, n_words long"]))
    together = hits.groupBy("digest").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    return measured.join(together, "digest", "left").mapInArrow(finish, schema)


def mark_contaminated(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 64 << 20, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Hit words and found items of every document.

    keep: columns of documents to return besides (doc_id alone if not given). spans: also return the found items and
    the hit words as merged (first, past the last) word positions. block_bytes: index that is held at once.
    """
    keep = ["doc_id"] if keep is None else list(keep)
    names = free_names(keep, ADDED)
    columns = list(dict.fromkeys([*keep, "text"]))
    rows = numbered(documents.select(*columns))
    kept, text = [f"c{columns.index(c)}" for c in keep], f"c{columns.index('text')}"
    kept_schema = [f"{c} {t}" for c, t in rows.select(*kept).dtypes]
    schema = ", ".join([*kept_schema, ADDED_SQL])
    pieces, blocks = dealt_pieces(benchmark, window, block_bytes)
    if blocks == 1:
        index = index_windows(one_block(pieces, 0), window)
        index.order(count_shingles(rows, text, index))
        out = _one_block(rows, index, kept, text, schema)
    else:
        hits = []
        for block in range(blocks):
            if held := one_block(pieces, block):
                index = index_windows(held, window)
                index.order(count_shingles(rows, text, index))
                hits.append(_block_hits(rows, index, text))
                del index
        out = _joined(rows, reduce(DataFrame.unionByName, hits), kept, text, kept_schema, schema)
    out = out.toDF(*keep, *names.values())
    return out if spans else out.drop(names["items"], names["spans"])


#: SQL for mark_contaminated() with its default parameters.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark WHERE item_id IS NOT NULL
), k AS (
  SELECT DISTINCT item_id, least(len(l), 10) AS n, unnest(list_transform(range(1, greatest(len(l) - 9, 1) + 1), lambda j: array_to_string(l[j:j + 9], ' '))) AS g FROM i WHERE len(l) > 0
), p AS (
  SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM k) WHERE len(l) >= n
), h AS (
  SELECT doc_id, item_id, p.n, j FROM p JOIN k ON k.n = p.n AND k.g = array_to_string(p.l[j:j + p.n - 1], ' ')
), x AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS w FROM h) GROUP BY doc_id
), y AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h) GROUP BY doc_id
)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
