"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from varlake.session import FILE_ROWS, in_files, scratch_path, ship_package


def stored(df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """Write once and read back: later jobs start from the files, also after a lost executor.

    Where ``rows`` bounds what the last step reads and gives, a file holds about ``each`` or more.
    """
    path = scratch_path(df.sparkSession, name)
    in_files(df, rows, each).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system, so that a worker waiting for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def released(run: Callable) -> Callable:
    """``run``, a function of batches for ``mapInArrow``, that gives memory back after its last one."""

    def run_and_release(batches):
        yield from run(batches)
        give_back()

    return run_and_release


def map_batches_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, most: int | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one batch; the package is shipped to the workers.

    With ``most``, a batch of more bytes is handed over in slices, so that what ``fn`` makes of it
    is never held for the whole batch.
    """
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if most and rows:
                rows = max(1, rows * most // max(most, batch.nbytes))
            for start in range(0, batch.num_rows, max(1, rows)):
                out = fn(batch.slice(start, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(released(run), schema)
