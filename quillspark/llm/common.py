"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..slices import in_slices as in_slices
from ..slices import tidied as tidied


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the setting is missing, a session of one process takes a folder of this machine; a cluster has none in common, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that written() made and no later step reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Send a value of bounded size to the executors, classes of this package with their code."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> Any:
    return cloudpickle.loads(shared.value)


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo modulus; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def among_first(key: Column, wanted: int, n: Column) -> Column:
    """True for the wanted keys of n distinct ones with the smallest hashes, and for few others: about twice as many in all.

    What follows can then pick the first exactly without ever seeing a group's other rows. That fewer than wanted pass is
    ruled out by over ten standard deviations.
    """
    return F.xxhash64(key).cast("double") / F.lit(2.0**64) + 0.5 <= (2 * wanted + 200) / n


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[list, dict]:
    """At most per_class labelled texts of each class, and each class's count of labelled rows.

    The sample is the rows with the smallest hashes of doc_id, so a rerun draws the same ones.
    Ids are chosen first; one text (the first in order) of each chosen one comes to the driver, however often its id repeats.
    Null ids, labels other than 0 and 1 and ids that aren't in documents don't count; of repeated labels the largest holds.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in (0, 1):
        few = among_first(F.col("doc_id"), per_class, F.lit(float(totals.get(y, 1))))
        part = known.filter((F.col("y") == y) & few).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    picked = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
    rows = [(r.doc_id, r.text or "", r.y) for r in picked.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()]
    rows.sort(key=lambda r: (r[0], r[1]))
    return rows, totals


def free_names(taken: Iterable[str], added: Iterable[str]) -> dict[str, str]:
    """A name for each added column: its own, with underscores after it where a column has that name already, whatever its case."""
    have, out = {c.lower() for c in taken}, {}
    for name in added:
        new = name
        while new.lower() in have:
            new += "_"
        have.add(new.lower())
        out[name] = new
    return out


def numbered(documents: DataFrame) -> DataFrame:
    """documents with columns c0, c1, ... in place of names that might clash."""
    return documents.toDF(*(f"c{n}" for n in range(len(documents.columns))))


#: Columns that a classifier adds.
SCORES = ("score", "predicted")


def with_scores(documents: DataFrame, score: Column, threshold: float) -> DataFrame:
    """documents' columns, then score and predicted (1 from threshold on); a name that documents have already gets an underscore."""
    names = free_names(documents.columns, SCORES)
    out = documents.select("*", score.alias(names["score"]))
    return out.select("*", (F.col(names["score"]) >= threshold).cast("int").alias(names["predicted"]))
