"""Dense vectors: a resumable index build with any encoder, and exact search by dot product."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .release import _fs, read_manifest, write_text

LEAST_NORM = 1e-12


def unit(vector: Column) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(LEAST_NORM))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def encoded(units: DataFrame, encode: Callable[[list[str]], np.ndarray], *, batch: int = 64) -> DataFrame:
    """chunk_id and vector (of length one). encode gets batches of texts; it is sent to the executors once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                made = np.asarray(encode(part["text"].fillna("").tolist()), np.float32)
                if made.shape[:1] != (len(part),) or made.ndim != 2:
                    raise ValueError(f"the encoder made {made.shape} for {len(part)} texts")
                made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), LEAST_NORM)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vector": list(made)})

    return units.select("chunk_id", "text").mapInPandas(run, "chunk_id string, vector array<float>")


def build_index(units: DataFrame, encode: Callable[[list[str]], np.ndarray], path: str, *, model: str, parts: int = 16, batch: int = 64) -> DataFrame:
    """Encode in parts by a hash of chunk_id. A build that broke off goes on with the parts that aren't there.

    The folder's manifest names the model and the number of parts; another build's folder is an error.
    """
    spark = units.sparkSession
    mine = {"model": model, "parts": parts}
    fs, manifest = _fs(spark, f"{path}/manifest.json")
    if fs.exists(manifest):
        if read_manifest(spark, f"{path}/manifest.json") != mine:
            raise ValueError("the folder holds parts of another build")
    else:
        write_text(spark, f"{path}/manifest.json", json.dumps(mine))
    for part in range(parts):
        done = _fs(spark, f"{path}/part={part}/_SUCCESS")[1]
        if not fs.exists(done):
            own = units.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)) == part)
            encoded(own, encode, batch=batch).write.mode("overwrite").parquet(f"{path}/part={part}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/part={p}" for p in range(parts))).drop("part")


def nearest(index: DataFrame, query: list[float], limit: int) -> DataFrame:
    """chunk_id and similarity of the nearest vectors, ties by id."""
    asked = unit(F.array(*(F.lit(float(x)) for x in query)))
    return index.select("chunk_id", F.round(dot(F.transform("vector", lambda x: x.cast("double")), asked), 6).alias("similarity")).orderBy(F.desc("similarity"), "chunk_id").limit(limit)
