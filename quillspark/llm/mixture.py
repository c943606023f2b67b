"""Mixing sources to target weights by Pareto order sampling.

Targets. Sources share total_percent of all words by their weights; a target stops at max_copies times its
source's size and the excess goes to the others by weight, until none is above (water filling).
Copies. A document of a source with target / size = r is taken floor(r) times for certain; the rest of the
target is filled by a Pareto order sample with inclusion probability r - floor(r): documents are ranked by
(u / (1 - u)) / (p / (1 - p)) with u from a hash of doc_id, and the first ones are taken, as many as come
nearest to the target in words. A source's taken words thus miss its target by at most half of one document.

Ranks are dealt into BINS bins of a known order, of which sums are made before anything is shuffled; only the
bin in which a source's sample ends is ordered row by row, so no task sees a hot source's rows together.

Defined results: null texts have size 0; a null source is a source of its own, the last; null ids rank by
the hash of the empty text; rows of equal rank are ordered by size, and those of equal size are alike; where a passed column
has the name of one of the result's own, that one gets an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written

BINS = 1 << 16
#: Bins to a coarse bin.
COARSE = 1 << 8
WORD = r"[^\x20\x09-\x0D]+"


def uniform(column: Column, seed: str) -> Column:
    """A number in (0, 1) from the md5 of the value as text."""
    digits = F.substring(F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, *, weights: Sequence[int], total_percent: int, max_copies: int) -> DataFrame:
    """A row for each source: source, source_size, target. sizes: source, size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    per = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_copies)
    # Hundredfold words keep every sum whole.
    per = per.withColumn("total", F.sum("source_size").over(everything) * total_percent).withColumn("w_all", F.sum("w").over(everything))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    below, w_below = F.coalesce(F.sum("cap").over(by_cap), F.lit(0)), F.coalesce(F.sum("w").over(by_cap), F.lit(0))
    per = per.withColumn("capped", 100 * F.col("cap") * (F.col("w_all") - w_below) <= F.col("w") * (F.col("total") - 100 * below))
    left = F.col("total") - 100 * F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    w_left = F.col("w_all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * left).cast("double") / (100 * w_left).cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def _first_beyond(bins: DataFrame, order: str) -> DataFrame:
    """bins: of, an order, words, rest and from. Of each source the first bin that goes beyond rest, with the words before it."""
    earlier = Window.partitionBy("of").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.col("from") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    first = bins.filter(F.col("before") + F.col("words") > F.col("rest")).groupBy("of").agg(F.min(F.struct(order, "before")).alias("e"))
    return first.select("of", f"e.{order}", "e.before")


#: Columns after the passed ones.
ADDED = ("doc_id", "size", "source_size", "target", "taken", "copies")


def mix(documents: DataFrame, *, weights: Sequence[int] = (5, 2, 1), total_percent: int = 150, max_copies: int = 2, seed: str = "mix", passed: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row, after the passed columns of documents."""
    sizes = documents.select("doc_id", "source", F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in passed)).alias("passed"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), uniform(F.col("doc_id"), seed).alias("u"))
    sizes = written(sizes, "sizes")
    targets = source_targets(sizes, weights=weights, total_percent=total_percent, max_copies=max_copies)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = written(targets.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "of"), "targets")
    same = F.col("source").eqNullSafe(F.col("of"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rank = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0)
    ranked = sizes.join(targets, same).withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)))
    bins = ranked.groupBy("of", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    bins = written(bins.withColumn("coarse", F.floor(F.col("bin") / COARSE)), "bins")
    # The sample ends in the first bin that doesn't fit whole: found among the coarse bins, then within one.
    coarse = _first_beyond(bins.groupBy("of", "coarse").agg(F.sum("words").alias("words"), F.first("rest").alias("rest")).withColumn("from", F.lit(0).cast("long")), "coarse")
    fine = bins.join(coarse.select(F.col("of").alias("_of"), F.col("coarse").alias("_coarse"), F.col("before").alias("from")), F.col("of").eqNullSafe(F.col("_of")) & (F.col("coarse") == F.col("_coarse")))
    ends = _first_beyond(fine.select("of", "bin", "words", "rest", "from"), "bin")
    ends = written(ends.select(F.col("of").alias("end_of"), F.col("bin").alias("end"), "before"), "ends")
    placed = ranked.join(ends, F.col("of").eqNullSafe(F.col("end_of")), "left")
    # A source whose target is a whole number of copies has no sample, so none of its rows need an order.
    apart = (F.col("p") <= 0) | F.col("end").isNull() | (F.col("bin") != F.col("end"))
    rest = placed.filter(apart).withColumn("more", (F.col("p") > 0) & (F.col("end").isNull() | (F.col("bin") < F.col("end"))))
    row_order = Window.partitionBy("of", "bin").orderBy("rank", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(row_order) - F.col("size") / 2
    edge = placed.filter(~apart).withColumn("more", (F.col("p") > 0) & (middle <= F.col("rest")))
    copies = F.col("whole") + F.col("more").cast("long")
    out = rest.unionByName(edge).withColumn("copies", copies)
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    names = free_names(passed, ADDED)
    return out.select(*(F.col(f"passed.`{c}`") for c in passed), *(F.col(c).alias(names[c]) for c in ADDED))


#: SQL for mix() with its default parameters.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w, 2 * source_size AS cap FROM s
), c AS (
  SELECT *, sum(source_size) OVER () * 150 AS total, sum(w) OVER () AS w_all,
         coalesce(sum(cap) OVER o, 0) AS below, coalesce(sum(w) OVER o, 0) AS w_below
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (
  SELECT *, 100 * cap * (w_all - w_below) <= w * (total - 100 * below) AS capped FROM c
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (w * (total - 100 * coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)))::DOUBLE / (100 * (w_all - coalesce(sum(w) FILTER (WHERE capped) OVER (), 0)))::DOUBLE END AS target
  FROM k
), r AS (
  SELECT d.doc_id, d.size, d.u, t.*, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM r
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 1e300 END AS odds FROM p
), m AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, size, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM q
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN p > 0 AND middle <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       CAST(whole + CASE WHEN p > 0 AND middle <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM m
"""
