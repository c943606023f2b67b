from pyspark.sql import functions as F

from quillspark.streaming import ingest as S


def test_files_come_in_once(spark, tmp_path):
    folder, at = tmp_path / "in", str(tmp_path)
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\nbody")
    (folder / "b.bin").write_bytes(b"\x00")

    def run():
        S.ingest_stream(S.watch_folder(spark, str(folder)), f"{at}/table", f"{at}/state", f"{at}/check").awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], r.status) for r in spark.read.parquet(f"{at}/table").collect())

    assert run() == [("a.md", "processed")]
    (folder / "c.txt").write_text("more")
    assert run() == [("a.md", "processed"), ("c.txt", "processed")]
    assert run() == [("a.md", "processed"), ("c.txt", "processed")]


def test_conversation_memory(spark, tmp_path):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t}" * 600) for t in range(8)] + [(2, 0, "user", "hi")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "t"))
    q = S.remember_turns(stream).writeStream.outputMode("update").format("memory").queryName("memory_of_turns").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    q.awaitTermination()
    got = {r.conv_id: r for r in spark.table("memory_of_turns").collect()}
    assert got[1].n_messages == 6 and got[1].last_turn == 7 and got[2].memory == "user: hi"
    assert [len(x) for x in got[1].memory.split("\n")] == [len("user: ") + 600, len("assistant: ") + 500] * 3


def test_windowed_counts(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = S.windowed_counts(ev)
    assert out.agg(F.sum("n")).first()[0] == ev.count()
