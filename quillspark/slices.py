"""Bounds on what a Python worker holds at a time, and what it keeps between tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def in_slices(batch: pa.RecordBatch, text: int | str, *, rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """All rows of the batch, in order, in slices of at most so many rows, and of one row or at most so many bytes of the text column.

    Spark's batches have 10,000 rows, whatever their texts; what Python makes of the texts (words above all) takes many times their size.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
    first = 0
    while first < batch.num_rows:
        past = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right"))
        past = max(first + 1, min(past, first + rows))
        yield batch.slice(first, past - first)
        first = past


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after whose last batch the worker gives the memory that it freed back to the system.

    Python workers live on from task to task and count with their executor; what they keep would add to the next stage's needs.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return tidy


def schema_of(frame: DataFrame) -> str:
    """The columns of frame, each of which may be null, as mapInArrow takes them."""
    return ", ".join(f"`{name}` {kind}" for name, kind in frame.dtypes)
