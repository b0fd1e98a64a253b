"""Keyed exchange between blocks of documents, by packed arrays instead of rows.

A block is one row of a written table: some documents, and the distinct 64-bit keys (of words, of shingles) that they hold.
What all blocks know of a key is put together in the bucket that the key belongs to, and each block gets the answer for its
own keys back, in their order. What moves grows with the distinct keys of the blocks, each key is in one bucket and no
bucket holds more than about BUCKET_KEYS, so no key, however frequent, makes a bucket large: it comes once from each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, tidy_table

BUCKET_KEYS = 500_000


def bucket_count(blocks: DataFrame) -> int:
    """Buckets for all keys of a table of blocks, from its column n_keys."""
    total = blocks.agg(F.sum("n_keys")).first()[0] or 0
    return max(8, math.ceil(total / BUCKET_KEYS))


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def split_keys(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, in their order) for each bucket that has any."""
    of = buckets_of(keys, buckets)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(of[part[0]]), part


def requests(blocks: DataFrame, buckets: int, unpack: Callable[[dict], tuple[int, np.ndarray, list[np.ndarray]]], columns: list[str], payloads: int) -> DataFrame:
    """Rows (bucket, block, keys, payload_0..): what each block says of its keys, packed by bucket."""
    names = ["keys", *[f"payload_{i}" for i in range(payloads)]]
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *[(n, pa.binary()) for n in names]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, keys, values = unpack(batch.slice(i, 1).to_pylist()[0])
                rows = [(b, block, *[x[at].tobytes() for x in (keys, *values)]) for b, at in split_keys(keys, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return blocks.select(*columns).mapInArrow(tidy(pack), "bucket int, block long, " + ", ".join(f"{n} binary" for n in names))


def answer(asked: DataFrame, reduce: Callable[[np.ndarray, np.ndarray, list[list[bytes]]], list[np.ndarray]], payloads: int, answers: int) -> DataFrame:
    """Rows (block, bucket, answer_0..), aligned with the keys that the block sent to the bucket.

    `reduce` gets the distinct keys of a bucket, the number of each asked key among them, and the payloads as sent; it
    returns an array by distinct key for each answer.
    """
    names = [f"answer_{i}" for i in range(answers)]
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in names]])

    def meet(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        sent = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        distinct, number = np.unique(np.concatenate(sent), return_inverse=True)
        found = reduce(distinct, number, [table.column(f"payload_{i}").to_pylist() for i in range(payloads)])
        cuts = np.cumsum([0, *map(len, sent)])
        bucket = table.column("bucket")[0].as_py()
        rows = [(b, bucket, *[f[number[lo:hi]].tobytes() for f in found]) for b, lo, hi in zip(blocks, cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return asked.groupBy("bucket").applyInArrow(tidy_table(meet), "block long, bucket int, " + ", ".join(f"{n} binary" for n in names))


def aligned(answers: pa.Table, keys: np.ndarray, buckets: int, column: str, dtype: type, width: int = 1) -> np.ndarray:
    """The answers to a block's keys, in the order of the keys: [key] or [key, width]."""
    parts = dict(split_keys(keys, buckets))
    out = np.zeros((len(keys), width), dtype)
    for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column(column).to_pylist(), strict=True):
        out[parts[bucket]] = np.frombuffer(blob, dtype).reshape(-1, width)
    return out[:, 0] if width == 1 else out


def pack_ids(ids: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of their significance, deflated: small numbers take little room."""
    import zlib

    return zlib.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_ids(blob: bytes) -> np.ndarray:
    import zlib

    flat = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()
