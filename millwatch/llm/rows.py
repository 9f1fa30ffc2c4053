"""Adding columns to rows, and choosing rows, in Arrow batches without a shuffle."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import small_batches


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back the memory that allocators keep when a task ends: its worker lives on for later tasks."""

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return freeing


def chosen(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], np.ndarray], limit: int = 4 << 20) -> DataFrame:
    """The rows of ``df`` for which ``fn``, called with some MB of rows, is true; all columns stay as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, at, limit):
                yield batch.filter(pa.array(fn(batch)))

    return df.mapInArrow(freed(run), df.schema)


def append(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.Array], list], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields`` added; ``fn`` gives their values for an array of texts.

    An input column whose name equals a new one (in any case) is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*names, text])])
    out = T.StructType([source.schema[c] for c in names] + fields)
    arrow = to_arrow_schema(out)
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, at):
                extra = fn(batch.column(at))
                kept = [batch.column(batch.schema.names.index(c)) for c in names]
                added = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(f.name).type) for x, f in zip(extra, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + added, names=out.names)

    return source.mapInArrow(freed(run), out)
