"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of the text column, or one row."""
    for batch in batches:
        sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(text)] if batch.num_rows else []
        begin, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def give_back() -> None:
    """Hand memory that is no longer used back to the system; a process keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def per_worker(name: str, make: Callable):
    """What ``make`` gives, kept in the worker process from task to task until another name is asked for: a worker that
    goes on to another stage drops what the last one remembered."""
    shelf = sys.modules.setdefault("_pliego_worker", types.ModuleType("_pliego_worker")).__dict__
    if shelf.get("name") != name:
        shelf.update(name=None, value=None)
        give_back()
        shelf.update(name=name, value=make())
    return shelf["value"]


def unused(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``rows`` is called so."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
