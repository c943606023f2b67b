"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch. In round i every shingle is hashed to a bin and a value; a bin keeps its least (round, value). The
first t rounds place shingles at random bins, the next t rounds fill bin i - t with certainty, so every
coordinate fills, and two sketches agree in a coordinate with probability equal to the similarity, with
concentration as of independent draws. A document stops once all its bins are full, mostly in a round or two.

Candidates. Documents of equal shingle sets form a class, of which the smallest doc_id goes on. Bands of the
sketch make buckets. In each bucket all members are compared with the smallest id (the hub); links found
there join members into components. Then, in buckets that still hold several components, the members outside
the hub's component are compared with all others, block against block, inside a task: the pairs are never rows, and
a task returns at most one link for each component that it sees. Every pair that shares a bucket is thus either
known to be connected or compared on its full sets.

Blocks have up to about block texts and SHINGLES shingles; a task holds one block and streams the other. With n members of
which m are outside the hub's component, a bucket ships n * ceil(m / block) + m * ceil(n / block) texts: n + m up to
block members, beyond that a text for every block it meets. Comparisons are n * m. Blocks are dealt to tasks by ranges, which
Spark draws so that tasks have like numbers of rows, whatever the sizes of buckets.

A pair at the threshold shares no bucket with probability (1 - s**rows)**bands: 2.8e-7 for 0.85, 6 and 32.
Links are confirmed on the full sets of 64-bit hashes of shingles, not on their words.

Defined results: texts without words, and nulls, have empty sets and link with nothing; rows without doc_id
are never linked, have a null component and are kept; repeated rows are one class; rows that repeat a doc_id with
another text each have their own set, and any of them may link it; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, tidied, written
from .components import connected_components

U = np.uint64
#: Shingles in a block, and texts of the other block that are compared with it at once.
SHINGLES, STREAMED = 1 << 20, 256


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str | None], size: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of size words (fewer words: all of them as one)."""
    out = []
    for text in texts:
        # Bytes lower-case A-Z alone and split at the six ASCII blanks alone.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        w = np.fromiter(map(hashes.__getitem__, words), U, len(words))
        n = len(w) - size + 1
        if n > 0:
            h = w[:n].copy()
            for k in range(1, size):
                h = mixed(h + U(0x9E3779B97F4A7C15)) + w[k : k + n]
            out.append(np.unique(mixed(h)))
        elif len(w):
            h = w[:1].copy()
            for k in range(1, len(w)):
                h = mixed(h + U(0x9E3779B97F4A7C15)) + w[k : k + 1]
            out.append(mixed(h + U(len(w) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)))
        else:
            out.append(np.zeros(0, U))
    return out


def fast_sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each set; sets must not be empty."""
    full = np.full(len(sets) * t, U(0xFFFFFFFFFFFFFFFF))
    sizes = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(elements):
            break
        h = mixed(elements + U((i + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        where = ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(full, owner * t + where, (U(i) << U(48)) | (mixed(h) >> U(16)))
        if i < 8 or i % 8 == 7:
            open_ = (full.reshape(-1, t) == U(0xFFFFFFFFFFFFFFFF)).any(1)
            stay = open_[owner]
            elements, owner = elements[stay], owner[stay]
    return full.reshape(len(sets), t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (len(sketches), bands))
    for r in range(rows):
        key = mixed(key + U(0x2545F4914F6CDD1D)) ^ parts[:, :, r]
    return mixed(key).view(np.int64)


def sketch_documents(documents: DataFrame, *, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and the keys of its bands."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column(1).to_pylist(), shingle, hashes)
                some = [n for n, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                for n, row in zip(some, band_keys(fast_sketches([sets[n] for n in some], bands * rows), bands, rows), strict=True):
                    keys[n] = row
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, slab by slab of the values that occur twice."""
    if len(left) == 1:
        one = left[0]
        return np.array([[(one[np.minimum(np.searchsorted(one, r), len(one) - 1)] == r).sum() if len(one) else 0 for r in right]])
    sets = left + right
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rank = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[inverse]
    keep = rank >= 0
    owner, rank = owner[keep], rank[keep]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, slab):
        lo, hi = np.searchsorted(rank, [at, at + slab])
        m = np.zeros((len(sets), slab), np.float32)
        m[owner[lo:hi], rank[lo:hi] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return np.rint(out).astype(np.int64)


def links_between(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """left, right: (id, component, set). A spanning set of the components' links between left and right."""
    sizes_l, sizes_r = np.array([len(x[2]) for x in left]), np.array([len(x[2]) for x in right])
    both = shared_counts([x[2] for x in left], [x[2] for x in right])
    union = sizes_l[:, None] + sizes_r[None, :] - both
    apart = np.array([x[1] for x in left])[:, None] != np.array([x[1] for x in right])[None, :]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            x = above[x]
        return x

    out = []
    for i, j in zip(*np.nonzero((100 * both >= percent * union) & apart & (both > 0)), strict=True):
        a, b = left[i][1], right[j][1]
        if (p := top(a)) != (q := top(b)):
            above[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def compared(tests: DataFrame, texts: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """tests: k1, k2, left, id, component. Links (a, b) of components between the left and the other members of each (k1, k2)."""
    rows = tests.join(texts, "id").select("k1", "k2", (~F.col("left")).alias("right"), "id", "component", "text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, left, right, found, size = None, [], [], [], 0

        def compare() -> None:
            nonlocal size
            if left and right:
                found.extend(links_between(left, right, percent))
            right.clear()
            size = 0

        for batch in batches:
            for k1, k2, of_right, i, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) != held:
                    compare()
                    held, left = (k1, k2), []
                own = shingle_sets([text], shingle, hashes)[0]
                (right if of_right else left).append((i, component, own))
                size += len(own) if of_right else 0
                if len(right) >= STREAMED or size >= SHINGLES:
                    compare()
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
        compare()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2", "right").mapInArrow(run, "a long, b long")


def in_block(column: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks)


def near_duplicates(documents: DataFrame, *, shingle: int = 3, percent: int = 85, bands: int = 32, rows: int = 6, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links have 100 * |both| >= percent * |either|."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    sketches = written(sketch_documents(documents, shingle=shingle, bands=bands, rows=rows), "sketches")
    named = sketches.filter("n_shingles > 0 and doc_id is not null")
    # As a table, classes aren't dealt by digest, and joins may split the rows of a digest that many documents share.
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("first")), "digests")
    firsts = named.alias("n").join(classes.alias("c"), (F.col("n.digest") == F.col("c.digest")) & (F.col("n.doc_id") == F.col("c.first")), "left_semi")
    firsts = written(firsts.select(F.col("doc_id").alias("id"), "n_shingles", "keys"), "classes")
    banded = firsts.select("id", "n_shingles", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min(F.struct("id", "n_shingles")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = buckets.select("key", F.col("hub.id").alias("hub"), F.col("hub.n_shingles").alias("hub_size"))
    members = written(banded.join(buckets, "key"), "members")
    # Blocks that so many texts of so many shingles take.
    blocks_of = lambda n, size: F.ceil(F.greatest(n / block, size / SHINGLES))

    # The hub of a bucket with every other member; sizes too far apart can't reach the threshold.
    near_size = F.least("n_shingles", "hub_size") * 100 >= F.greatest("n_shingles", "hub_size") * percent
    pairs = members.filter(near_size & (F.col("id") != F.col("hub"))).select("hub", "id", "n_shingles").distinct()
    hubs = pairs.groupBy("hub").agg(blocks_of(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    others = pairs.join(hubs, "hub").select(F.col("hub").alias("k1"), in_block(F.col("id"), F.col("blocks")).alias("k2"), F.lit(False).alias("left"), "id")
    hub_rows = hubs.select(F.col("hub").alias("k1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k2"), F.lit(True).alias("left"), F.col("hub").alias("id"))
    tests = others.unionByName(hub_rows).withColumn("component", F.col("id"))
    first_links = written(compared(tests, texts, shingle=shingle, percent=percent), "hub-links")
    first = connected_components(first_links)

    # Buckets that still hold several components.
    of = lambda df, column, name: df.join(first.select(F.col("id").alias(column), F.col("component").alias("_c")), column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")
    rest = of(of(members, "id", "component"), "hub", "hub_component").withColumn("outside", F.col("component") != F.col("hub_component"))
    rest = written(rest.select("key", "id", "n_shingles", "component", "outside", "hub"), "rest")
    outside = F.when(F.col("outside"), F.col("n_shingles"))
    open_ = rest.groupBy("key").agg(F.count("*").alias("n"), F.count(outside).alias("n_out"), F.sum("n_shingles").alias("size"), F.sum(outside).alias("size_out"), F.min("hub").alias("hub"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids"))
    open_ = open_.filter("n > 2 and n_out > 0").groupBy("hub", "n", "n_out", "size", "size_out", "ids").agg(F.min("key").alias("key"))
    open_ = open_.select("key", blocks_of(F.col("n_out"), F.col("size_out")).alias("left_blocks"), blocks_of(F.col("n"), F.col("size")).alias("right_blocks"))
    many = rest.drop("hub").join(open_, "key")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    lefts = many.filter("outside").withColumn("i", in_block(F.col("id"), F.col("left_blocks"))).withColumn("j", F.explode(spread("right_blocks"))).withColumn("left", F.lit(True))
    rights = many.withColumn("j", in_block(F.col("id"), F.col("right_blocks"))).withColumn("i", F.explode(spread("left_blocks"))).withColumn("left", F.lit(False))
    tests = lefts.unionByName(rights).select(F.col("key").alias("k1"), (F.col("i") * F.col("right_blocks") + F.col("j")).alias("k2"), "left", "id", "component")
    more = compared(tests, texts, shingle=shingle, percent=percent)
    final = connected_components(first_links.unionByName(more))
    for done in (firsts, members, first_links, first, rest):
        discard(spark, done)

    joined = sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    joined = joined.join(final.withColumnRenamed("id", "first"), "first", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents without the rows of ids that near_duplicates() doesn't keep; rows that repeat a kept doc_id all stay."""
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)


#: SQL for near_duplicates() with its default parameters, for small tables: it joins all shingles.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)
), b AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.reach = b.x
), m AS (
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
