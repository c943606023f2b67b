"""Document fingerprints: a quartile bucket digest.

Byte triplets drawn from a sliding window of five bytes are hashed into buckets and counted. A fingerprint
holds, for each bucket, the quartile (0 to 3) in which its count lies among the text's own counts, and the
length on a logarithmic scale; texts of under five bytes are padded. Equal texts have equal fingerprints.
Two fingerprints differ by the bucket steps between their quartiles (two or three steps count double, as
they can't come from rounding) and by the steps between their lengths; the difference is bounded, so
likeness = 1 - difference / bound lies between 0 and 1.

Making fingerprints is a map over whole texts. with_next() hands every document the next one's text in one
range-partitioned shuffle: bucket edges are true ids, and the rows at an edge go to the bucket before it too.

Defined results: a null text counts as empty; null ids come first; rows of equal id are ordered by their
text (null as empty); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 128
SHIFT = 32 - (BUCKETS - 1).bit_length()
#: Offsets of the triplets within a window of five bytes that begin with its first byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
LENGTH_STEPS = 255
#: The cost of a difference of so many quartiles.
COST = np.array([0, 1, 4, 6])
#: A length step costs as much as so many bucket steps, up to LENGTH_BOUND.
LENGTH_COST, LENGTH_BOUND = 12, 256
BOUND = int(COST[3]) * BUCKETS


def bucket_counts(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw if len(raw) >= 5 else raw.ljust(5, b"\0"), np.uint8).astype(np.uint32)
    first, second, third = (data * np.uint32(m) for m in MULTIPLIERS)
    second, third = second >> np.uint32(3), third >> np.uint32(5)
    n = len(data) - 4
    counts = np.zeros(BUCKETS, np.int64)
    for k, (x, y, z) in enumerate(TRIPLETS):
        h = first[x : x + n] ^ second[y : y + n] ^ third[z : z + n]
        h = (h + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(SHIFT), minlength=BUCKETS)
    return counts


def fingerprint(text: str | None) -> str:
    """Two hexadecimal digits of length, then two bits a bucket."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    step = min(LENGTH_STEPS, round(8 * np.log2(1 + len(raw))))
    if not raw:
        return f"{step:02x}" + "0" * (BUCKETS // 2)
    counts = bucket_counts(raw)
    edges = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts > edges[0]).astype(np.uint8) + (counts > edges[1]) + (counts > edges[2])
    q = quartile.reshape(-1, 4)
    packed = (q[:, 0] << 6) | (q[:, 1] << 4) | (q[:, 2] << 2) | q[:, 3]
    return f"{step:02x}" + packed.astype(np.uint8).tobytes().hex()


def _unpacked(mark: str) -> tuple[int, np.ndarray]:
    b = np.frombuffer(bytes.fromhex(mark[2:]), np.uint8)
    return int(mark[:2], 16), np.stack([b >> 6, (b >> 4) & 3, (b >> 2) & 3, b & 3], 1).ravel().astype(np.int64)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, falling to 0 as the bounded difference grows."""
    (la, qa), (lb, qb) = _unpacked(a), _unpacked(b)
    apart = int(COST[np.abs(qa - qb)].sum()) + min(LENGTH_BOUND, LENGTH_COST * abs(la - lb))
    return max(0.0, 1 - apart / (BOUND + LENGTH_BOUND))


def half_replaced(text: str, other: str) -> str:
    """text with its last floor(n/2) code points replaced by as many of other's first (or all of them)."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def bucket_edges(documents: DataFrame, buckets: int) -> list[int]:
    """Ids at which range buckets of about equal row counts begin; at most one for each bucket."""
    ids = documents.select("doc_id").filter("doc_id is not null")
    starts = ids.repartitionByRange(buckets, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first"))
    return sorted(r.first for r in starts.select(F.col("first")).collect())


def fingerprint_documents(documents: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """Every document's fingerprint, that of its text half replaced by the next one's, and their likenesses.

    Each task streams over its buckets in order of doc_id, holding one text back, so memory is bounded by the
    longest texts whatever a bucket's size.
    """
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = bucket_edges(documents, buckets or 4 * partitions)
    first = edges[0] if edges else None
    shared = spark.sparkContext.broadcast(edges)

    @F.pandas_udf("array<int>")
    def placed(ids: pd.Series) -> pd.Series:
        starts = shared.value
        where = set(starts[1:])
        found = []
        for i in ids.astype(object).where(ids.notna(), None):
            own = max(0, bisect_right(starts, i) - 1) if i is not None else 0
            found.append([own, own - 1] if i in where else [own])
        return pd.Series(found)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    null_ids = bool(rows.filter("doc_id is null").take(1))
    home = rows.select("doc_id", "text", F.posexplode(placed(F.col("doc_id"))).alias("copy", "at"))
    home = home.select("doc_id", "text", "at", (F.col("copy") > 0).alias("borrowed"))
    # The last document's next one is the first: it goes to the last bucket, marked to stand after all others.
    opening = rows.filter("doc_id is null" if null_ids else F.col("doc_id") == first if edges else F.lit(False))
    opening = opening.orderBy(F.coalesce("text", F.lit(""))).limit(1)
    opening = opening.select("doc_id", "text", F.lit(max(0, len(edges) - 1)).alias("at"), F.lit(True).alias("borrowed"))
    home = home.withColumn("last", F.lit(False)).unionByName(opening.withColumn("last", F.lit(True)))
    dealt = home.repartition(partitions, "at").sortWithinPartitions("at", "last", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for i, text, at, borrowed, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "borrowed", "last")), strict=True):
                text = text or ""
                mark = fingerprint(text)
                if held is not None and held[2] == at and not held[3]:
                    edited = half_replaced(held[1], text)
                    edited_mark = fingerprint(edited)
                    for k, v in zip(out, (held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), held[4], edited_mark, likeness(held[4], edited_mark), likeness(held[4], mark)), strict=True):
                        out[k].append(v)
                held = (i, text, at, borrowed, mark)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=list(out))

    return dealt.mapInArrow(run, schema)
