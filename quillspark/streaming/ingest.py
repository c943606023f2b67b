"""Streams: files into document versions, conversation memory with expiry, and late-tolerant event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import stable_id
from ..operators.release import next_state
from ..sources.files import suffix
from ..sources.parsers import PARSERS, decoded

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new files: path, kind, file_hash and text."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    kind = suffix(F.col("path"))
    return files.select("path", kind.alias("kind"), F.sha2("content", 256).alias("file_hash"), F.when(kind.isin(*PARSERS), decoded(F.col("content"))).alias("text"))


def ingest_stream(files: DataFrame, table: str, state: str, checkpoint: str) -> StreamingQuery:
    """Append versions whose content changed to table; state keeps each path's last hash, batch by batch.

    A batch that runs again writes the same folder of the table, so nothing is doubled.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = f"{state}/batch={number - 1}"
        old = spark.read.parquet(known) if number else spark.createDataFrame([], "path string, file_hash string")
        found = batch.withColumn("error", F.when(F.col("text").isNull(), "unsupported"))
        status, new = next_state(found, old)
        fresh = batch.join(status.filter("status in ('processed', 'changed')"), "path")
        fresh.withColumn("document_version_id", stable_id("docver", F.col("path"), F.col("file_hash"))).write.mode("overwrite").parquet(f"{table}/batch={number}")
        new.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remember_turns(turns: DataFrame, *, keep: int = 6, cut: int = 500, hours: int = 6) -> DataFrame:
    """turns: conv_id, turn, role, text, as a stream or not. After each batch a conversation's last messages, in order.

    State of a conversation goes once it was silent for so many hours. A limit on the number of all conversations
    has no counterpart in keyed state; expiry bounds it.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            held += [(int(t), r, x[:cut] if r == "assistant" else x) for t, r, x in zip(batch["turn"], batch["role"], batch["text"], strict=True)]
        held = sorted(held)[-keep:]
        state.update(tuple([h[k] for h in held] for k in range(3)))
        state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [len(held)], "last_turn": [held[-1][0]], "memory": ["\n".join(f"{r}: {x}" for _, r, x in held)]})

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, n_messages int, last_turn long, memory string", "turns array<long>, roles array<string>, texts array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, *, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events by type and window; those later than the watermark are dropped. An extension of ours."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def distinct_traces(traces: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """A stream of shown evidence without repeats of title, page and section within the watermark."""
    return traces.withWatermark("ts", late).dropDuplicatesWithinWatermark(["title", "page", "section"])
