import os

import pyarrow as pa

from quillspark.llm.common import in_slices, tidied


def test_slices_hold_every_row_in_order():
    texts = ["a" * 10, None, "", "b" * 95, "c" * 300, "é" * 40, *["d"] * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["n", "text"])
    for whole in (batch, batch.slice(2, 9), batch.slice(0, 0)):
        parts = list(in_slices(whole, "text", rows=7, size=100))
        assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist()
        assert all(p.num_rows <= 7 and (p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 100) for p in parts)
    assert [p.num_rows for p in in_slices(batch, 1, rows=7, size=100)] == [3, 1, 1, 7, 7, 7, 7, 3]


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6


def test_a_task_gives_memory_back():
    last = []

    @tidied
    def run(batches):
        many = [b"x" * 3000 + str(n).encode() for n in range(40_000)]
        last.append(bytes(3000))  # stays above the others, so the heap doesn't shrink by itself
        assert resident() - before > 80
        yield from (len(many) + b for b in batches)

    before = resident()
    assert list(run(iter([1, 2]))) == [40_001, 40_002]
    assert resident() - before < 40
