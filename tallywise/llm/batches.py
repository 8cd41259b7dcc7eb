"""Adding computed columns to Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS = 1024  # whose computed columns a task holds at a time


def quoted(name: str) -> Column:
    """The column of that very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_computed(
    docs: DataFrame, fields: str, start: Callable[[], Callable[[pa.RecordBatch], list]], keeps: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` with the columns of ``fields`` (DDL). ``start`` runs once a task and gives the function of a batch.

    Columns of ``docs`` with the names of ``fields`` are replaced, all others pass unchanged. No shuffle. Of what the
    worker keeps from earlier tasks (``kept_by_worker``), kinds other than ``keeps`` are dropped.
    """
    added = T.StructType.fromDDL(fields)
    docs = docs.drop(*added.names)
    schema = T.StructType(docs.schema.fields + added.fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(*keeps)
        compute = start()
        for whole in batches:
            for low in range(0, whole.num_rows, _ROWS):
                b = whole.slice(low, _ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns, *compute(b)], names=names)

    return docs.mapInArrow(run, schema)


def kept_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in each Python worker process and kept for its later tasks.

    Functions travel by value, so a module's own variables would start anew with every task. One value a kind (the
    first part of ``key``) is kept, until a task of another operator drops it.
    """
    kept = sys.modules.setdefault("_tallywise_worker", ModuleType("_tallywise_worker")).__dict__
    if kept.get(key[0], (None,))[0] != key:
        kept[key[0]] = (key, make())
    return kept[key[0]][1]


def drop_kept(*but: str) -> None:
    """Give back the memory of what this worker keeps, but for these kinds: workers live on when their stage has ended."""
    kept = getattr(sys.modules.get("_tallywise_worker"), "__dict__", {})
    gone = [kind for kind, value in kept.items() if isinstance(value, tuple) and kind not in but]
    for kind in gone:
        del kept[kind]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc: freed memory goes back to the system
        if trim:
            trim(0)
