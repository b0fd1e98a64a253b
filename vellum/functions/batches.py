"""Rows between Arrow batches and Python: few at a time, so that memory is bounded, and not one by one, as each batch has its cost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Most rows and about the most bytes that are held as Python objects.
ROWS, BYTES = 64, 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches hold at most 8 MB: packages may be large, and a batch is held several times over."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, of which few at a time are Python objects."""
    for batch in batches:
        step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield from batch.slice(i, step).to_pylist()


def batches_of(rows: Iterable[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, given with about the bytes that each holds."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
