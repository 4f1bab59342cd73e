"""Helpers of the training-data operators: shared tables, byte buffers, bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandweave.session import shared_dir, written  # noqa: F401  for the operators


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end (null: empty), and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    a = column.cast(pa.large_binary())
    n = len(a)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64, count=a.offset + n + 1)[a.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about most_bytes of the column (one row at least): memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = byte_buffer(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + most_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, dealt anew into batches of at least `rows` rows that never cut a group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        if held and n >= rows:
            other = k != held[-1].column(key)[-1].as_py()
            same = int(np.argmax(other)) if other.any() else len(k)
            if same:
                held.append(b.slice(0, same))
            if same == len(k):
                continue
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            b, held, n = b.slice(same), [], 0
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
