"""Files as tables: a folder of documents, manifests, JSON lines and what earlier runs wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_placeholder, stable_id
from .parsers import PARSERS, decoded

EXCLUDED = (".git", ".venv", "node_modules", "__pycache__")
SUFFIXES = ("md", "markdown", "txt", "html", "htm", "pdf", "docx", "png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "gif")
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "slot_type", "file_path", "document_title", "document_version", "owner", "is_scanned", "has_tables", "has_multicolumn", "confidentiality", "status", "notes")])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's path as the paths of its files begin."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modified of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.filter(~F.exists(F.split("path", "/"), lambda p: p.isin(*EXCLUDED)))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind, modified, file_hash, text and error of every file; text is null where no parser is at hand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter(~F.exists(F.split("path", "/"), lambda p: p.isin(*EXCLUDED))).withColumn("kind", suffix(F.col("path")))
    readable = F.col("kind").isin(*PARSERS)
    error = F.when(~F.col("kind").isin(*SUFFIXES), F.concat(F.lit("unsupported document format: ."), F.col("kind"))).when(~readable, F.concat(F.lit("no parser installed for ."), F.col("kind")))
    return files.select("path", "kind", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"), F.when(readable, decoded(F.col("content"))).alias("text"), error.alias("error"))


def inventory(files: DataFrame, *, max_bytes: int, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_files: int | None = None) -> DataFrame:
    """files with title, sample_id and reason (null: taken), the first reason that fits; max_files counts what is left in order."""
    low = F.lower("path")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    reason = F.when(~suffix(F.col("path")).isin(*SUFFIXES), "unsupported_extension")
    if exclude:
        reason = reason.when(has([w.lower() for w in exclude]), "excluded_keyword")
    if include:
        reason = reason.when(~has([w.lower() for w in include]), "no_include_keyword")
    reason = reason.when(F.col("length") > max_bytes, "too_large")
    out = files.withColumn("reason", reason)
    if max_files is not None:
        taken = F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy("path"))
        out = out.withColumn("reason", F.when(F.col("reason").isNull() & (taken > max_files), "over_max_files").otherwise(F.col("reason")))
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), "[_-]+", " ")
    return out.withColumn("title", title).withColumn("sample_id", stable_id("sample", F.col("path")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with status: ready, or skipped where the path is missing or a placeholder."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST, encoding="UTF-8", multiLine=True, escape='"')
    cells = [F.when(~is_placeholder(F.col(c)), F.trim(c)).alias(c) for c in MANIFEST.names if c != "status"]
    return rows.select(*cells).withColumn("ingest_status", F.when(F.col("file_path").isNull(), "skipped").otherwise("ready"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines, those with # before them and those that aren't JSON objects are skipped."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.filter(F.try_parse_json("value").isNotNull() & F.col("value").startswith("{")).select(F.from_json("value", schema).alias("r")).select("r.*")
