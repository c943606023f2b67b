"""Connected components of a graph in a table of links, by alternating large and small stars.

Every step is a grouped minimum (combined before its shuffle) and a join that the engine can split where a
vertex is hot; each round is written to the shared folder, so a lost executor costs no more than that round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a and b, in any order, repeats and loops allowed. Returns id and component (the smallest id
    reachable) for every id that isn't the smallest of its component itself. Nulls link nothing."""
    spark = links.sparkSession
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(links.distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == seen or not state.n:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = (state.n, state.s)
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        middle = written(large, "links")
        discard(spark, now)
        least = middle.groupBy("a").agg(F.min("b").alias("m"))
        small = middle.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b")
        now = written(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        discard(spark, middle)
