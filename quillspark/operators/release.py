"""Releases: a pinned set of document versions with hashes, checked before use; and ingest state.

A release's artefacts are one table; its id is a hash of that table, so creating it again changes nothing.
Only the manifest and the pointer to the active release are files of the driver's own, written beside and renamed.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id
from .quality import fingerprint


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file whole: write beside it, then rename over it in one step, so a reader finds the old one or the new one."""
    fs, target = _fs(spark, path)
    _, beside = _fs(spark, path + ".new")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(target), over)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def artefacts(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_version_id, file_hash and chunks_hash of every version; the hash of chunks doesn't depend on their order."""
    h = F.sha2(F.concat_ws("\n", "chunk_id", F.col("chunk_ord").cast("string"), "text", F.array_join("evidence_ids", ",")).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    per = chunks.groupBy("document_version_id").agg(F.sha2(F.concat_ws(":", F.count("*"), *parts).cast("binary"), 256).alias("chunks_hash"), F.count("*").alias("n_chunks"))
    return versions.select("document_version_id", "file_hash").join(per, "document_version_id", "left")


def create_candidate(pinned: DataFrame, folder: str) -> dict:
    """Write artefacts() of the versions to release; the same content has the same id and isn't written again."""
    spark = pinned.sparkSession
    mark = fingerprint(pinned, "document_version_id", "file_hash", "chunks_hash").first().fingerprint
    release = {"schema_version": "release.v1", "release_id": f"release_{mark[:16]}", "fingerprint": mark, "status": "candidate", "indexes": {}}
    path = f"{folder}/{release['release_id']}"
    fs, manifest = _fs(spark, f"{path}/manifest.json")
    if fs.exists(manifest):
        return read_manifest(spark, f"{path}/manifest.json")
    pinned.write.mode("overwrite").parquet(f"{path}/artefacts")
    write_text(spark, f"{path}/manifest.json", json.dumps(release, sort_keys=True, indent=2))
    return release


def validate(now: DataFrame, path: str) -> DataFrame:
    """problem and document_version_id wherever what is there differs from what the release pins."""
    spark = now.sparkSession
    pinned = spark.read.parquet(f"{path}/artefacts")
    joined = pinned.alias("p").join(now.alias("n"), "document_version_id", "left")
    missing = F.when(F.col("n.file_hash").isNull() & F.col("n.chunks_hash").isNull(), "missing")
    differs = lambda c: F.when(~F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")), f"{c}_mismatch")
    problems = F.when(missing.isNotNull(), F.array(missing)).otherwise(F.array_compact(F.array(differs("file_hash"), differs("chunks_hash"))))
    return joined.select("document_version_id", F.explode(problems).alias("problem"))


def index_fingerprint(index: DataFrame) -> str:
    return fingerprint(index, *sorted(index.columns)).first().fingerprint


def finalize(now: DataFrame, path: str, indexes: dict[str, DataFrame]) -> dict:
    """Bind the indexes to a sound candidate. A ready release with the same indexes stays; with others it is an error."""
    spark = now.sparkSession
    manifest = read_manifest(spark, f"{path}/manifest.json")
    problems = validate(now, path).limit(5).collect()
    if problems:
        raise ValueError(f"release isn't sound: {[f'{r.problem}:{r.document_version_id}' for r in problems]}")
    bound = {name: index_fingerprint(df) for name, df in sorted(indexes.items())}
    if manifest["status"] == "ready":
        if manifest["indexes"] != bound:
            raise ValueError("a ready release has other indexes")
        return manifest
    manifest |= {"status": "ready", "indexes": bound}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
    return manifest


def activate(spark: SparkSession, path: str, pointer: str) -> None:
    manifest = read_manifest(spark, f"{path}/manifest.json")
    if manifest["status"] != "ready":
        raise ValueError("only a ready release can be active")
    body = json.dumps(manifest, sort_keys=True).encode()
    write_text(spark, pointer, json.dumps({"release": path, "release_id": manifest["release_id"], "sha256": hashlib.sha256(body).hexdigest()}))


def active(spark: SparkSession, pointer: str) -> dict:
    """The active release's manifest; an error where it isn't the one that was activated."""
    found = json.loads(read_text(spark, pointer))
    manifest = read_manifest(spark, f"{found['release']}/manifest.json")
    if hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest() != found["sha256"]:
        raise ValueError("the active release was changed")
    return manifest


def pinned_rows(rows: DataFrame, path: str) -> DataFrame:
    """rows of the versions that a release pins."""
    return rows.join(rows.sparkSession.read.parquet(f"{path}/artefacts").select("document_version_id"), "document_version_id", "left_semi")


def processing_records(versions: DataFrame) -> DataFrame:
    """document_version_id, file_hash, parser and a run id that content and parser determine."""
    return versions.withColumn("run_id", stable_id("run", F.col("document_version_id"), F.col("file_hash"), F.col("parser")))


def next_state(found: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """found: path, file_hash, error; state: path, file_hash. (path, status) of this run, and the state after it.

    Content as before is unchanged; a failure leaves the old state as it is; paths not found keep theirs.
    """
    joined = found.select("path", "file_hash", "error").join(state.select("path", F.col("file_hash").alias("_old")), "path", "full_outer")
    status = (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.col("file_hash").isNull(), "absent")
        .when(F.col("_old").isNull(), "processed")
        .when(F.col("file_hash") == F.col("_old"), "unchanged")
        .otherwise("changed")
    )
    rows = joined.withColumn("status", status)
    kept = F.when(F.col("status").isin("failed", "absent"), F.col("_old")).otherwise(F.col("file_hash"))
    return rows.filter("status <> 'absent'").select("path", "status"), rows.select("path", kept.alias("file_hash")).filter("file_hash is not null")
