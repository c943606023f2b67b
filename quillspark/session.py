"""One object with the verbs of the engine: ingest, validate, index, ask, trace, release, evaluate.

A workspace is a folder of Parquet tables. Every verb reads tables and writes tables or returns a DataFrame, so
each can run again after a failure; small results (packs, manifests) come back as plain objects.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import stable_id
from .operators import documents as D
from .operators import evaluation as E
from .operators import quality as Q
from .operators import release as R
from .operators import retrieval as S
from .plans.relational import filter_metadata
from .sources import files

METADATA = ("source_type", "project", "supplier", "document_version")
#: What optional formats need.
CAPABILITIES = {"pdf": ("pypdf",), "docx": ("docx",), "ocr": ("rapidocr_onnxruntime",), "dense_vectors": ("FlagEmbedding",)}


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    # --- ingest ---

    def ingest(self, found: DataFrame, *, drop_unsectioned: bool = True, **chunking) -> DataFrame:
        """found: path, kind, file_hash, text, error and any of modified, title, source_type, project, supplier, document_version, owner."""
        defaults = {"title": F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), "source_type": F.lit("unknown"), "project": F.lit("unknown"), "supplier": F.lit("unknown"), "document_version": F.lit("v1"), "owner": F.lit("unknown"), "modified": F.lit(None).cast("timestamp")}
        for name, value in defaults.items():
            found = found.withColumn(name, F.coalesce(F.col(name), value) if name in found.columns else value)
        found = found.withColumn("document_id", stable_id("doc", F.col("title"), F.col("source_type"), F.col("path")))
        found = found.withColumn("document_version_id", stable_id("docver", F.col("document_id"), F.col("document_version"), F.col("file_hash")))
        versions = self._write(found, "ingested")
        blocks = self._write(D.canonical(versions.filter("text is not null"), kind=F.col("kind")), "blocks")
        self._write(D.sections(blocks), "sections")
        self._write(D.chunks(blocks, drop_unsectioned=drop_unsectioned, **chunking), "chunks")
        gates = D.gate(D.generic_quality(blocks)).select("document_version_id", F.col("score").alias("quality_score"), "allowed")
        return self._write(versions.drop("text").join(gates, "document_version_id", "left"), "versions")

    def ingest_folder(self, path: str, **options) -> DataFrame:
        return self.ingest(files.read_documents(self.spark, path), **options)

    def ingest_manifest(self, manifest: str, root: str, **options) -> DataFrame:
        rows = files.read_manifest(self.spark, manifest).filter("ingest_status = 'ready'")
        rows = rows.select(F.col("file_path").alias("_f"), F.col("document_title").alias("title"), F.col("slot_type").alias("source_type"), "document_version", "owner")
        found, folder = files.read_documents(self.spark, root), files.qualified(self.spark, root)
        path = F.concat(F.lit(f"{folder}/"), F.regexp_replace("_f", r"^(\./)+", ""))
        return self.ingest(found.join(rows.withColumn("path", path), "path").drop("_f"), **options)

    def inventory(self, path: str, **options) -> DataFrame:
        return files.inventory(files.list_files(self.spark, path), **options)

    # --- checks ---

    def _evidence(self) -> DataFrame:
        return self.table("blocks").select("document_version_id", "evidence_id", "block_id", "text", "text_hash")

    def validate(self) -> DataFrame:
        return Q.contract_issues(self.table("sections"), self.table("blocks"), self._evidence(), self.table("chunks"), self.table("versions"))

    def evaluate_quality(self, policy: Sequence[tuple[str, str, str]] | None = None) -> DataFrame:
        """Decisions on all signals. Versions may carry warnings (a count), fallback_used and page_count, blocks their pages; where they don't, nothing is said of these."""
        versions, blocks = self.table("versions"), self.table("blocks")
        optional = {"warnings": F.lit(0), "fallback_used": F.lit(False), "page_count": F.lit(None).cast("int")}
        versions = versions.withColumns({name: F.coalesce(name, value) if name in versions.columns else value for name, value in optional.items()})
        versions = versions.select("document_version_id", *optional, F.when(F.col("error").startswith("unsupported"), "unsupported").when(F.col("error").isNotNull(), "failed").alias("error"))
        blocks = blocks.withColumns({name: F.lit(None).cast("int") for name in ("page_start", "page_end") if name not in blocks.columns})
        evidence = blocks.select("document_version_id", "evidence_id", "block_id", "text", "text_hash", F.col("page_start").alias("page"))
        chunks = self.table("chunks")
        signals = Q.united([Q.release_signals(versions), Q.document_signals(versions, blocks, chunks, evidence), Q.page_signals(versions, blocks, evidence), Q.block_signals(blocks, evidence), Q.chunk_signals(chunks, evidence)])
        return self._write(Q.decisions(signals, policy), "decisions")

    def excluded_chunks(self) -> DataFrame:
        return Q.excluded_chunks(self.table("decisions"), self.table("chunks"))

    def quality_records(self) -> DataFrame:
        return Q.quality_record(self.table("blocks"), self.table("chunks"), self._evidence())

    # --- search ---

    def latest_versions(self) -> DataFrame:
        """The last version of each path, whatever its case, by time of change and then by id."""
        last = self.table("versions").groupBy(F.lower("path").alias("_k")).agg(F.max(F.struct("modified", "document_version_id")).alias("m"))
        return self.table("versions").join(last.select("m.document_version_id"), "document_version_id", "left_semi")

    def build_indexes(self, release: str | None = None) -> DataFrame:
        """The units of search with their tokens, postings and sparse features; of a release's versions where one is named."""
        versions = R.pinned_rows(self.table("versions"), release) if release else self.latest_versions()
        versions = versions.select("document_version_id", "title", *METADATA, "allowed", "quality_score")
        units = self._write(S.search_units(self.table("chunks"), self.table("sections"), versions), "units")
        self._write(S.postings(units), "postings")
        self._write(S.sparse_index(units), "features")
        return units

    def context_pack(self, query: S.Query, *, budget: int | None = None, filters: dict[str, list[str]] | None = None) -> S.ContextPack:
        units = self.table("units")
        if filters:
            units = filter_metadata(units, filters, METADATA)
            if not units.take(1):
                raise ValueError("no unit matches the filters")
        vectors = S.sparse_hits(self.table("features"), self.table("units").count(), query.text, query.probe_limit)
        vectors = vectors.join(units.select("chunk_id"), "chunk_id", "left_semi")
        signals = ("list", "overview", "清单", "列表") if S.intent_of(query.text) == "inventory" else ()
        return S.context_pack(units, query, budget=budget, vectors=vectors, rerank=(lambda rows: S.reranked(rows, signals)) if signals else None)

    def search(self, text: str, top_k: int = 8) -> list[dict]:
        return self.context_pack(S.Query(text, top_k=top_k)).chunks

    def trace(self, evidence_id: str) -> DataFrame:
        return S.trace(self._evidence(), self.table("chunks"), self.table("versions").select("document_version_id", "document_id", "title", "path"), evidence_id)

    def gap_report(self, items: DataFrame, pack: S.ContextPack) -> DataFrame:
        return S.gap_report(items, pack)

    # --- releases and evaluation ---

    def build_release(self) -> dict:
        pinned = R.artefacts(self.latest_versions(), self.table("chunks")).filter("chunks_hash is not null")
        release = R.create_candidate(pinned, f"{self.folder}/releases")
        path = f"{self.folder}/releases/{release['release_id']}"
        self.build_indexes(path)
        return R.finalize(R.artefacts(self.table("versions"), self.table("chunks")), path, {"postings": self.table("postings"), "features": self.table("features")})

    def activate_release(self, release_id: str) -> None:
        R.activate(self.spark, f"{self.folder}/releases/{release_id}", f"{self.folder}/releases/active.json")

    def active_release(self) -> dict:
        return R.active(self.spark, f"{self.folder}/releases/active.json")

    def score_answers(self, cases: DataFrame, outputs: DataFrame) -> DataFrame:
        return E.paired(E.score_answers(cases, outputs))

    def dependencies(self, find_spec=importlib.util.find_spec) -> dict[str, bool]:
        """Which optional capabilities this installation has."""
        return {name: all(find_spec(m) is not None for m in modules) for name, modules in CAPABILITIES.items()}
