"""Arrow batches of strings as flat numpy arrays: the texts end to end, so that one vector step serves all rows of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MOST_BYTES = 1 << 19  # a scan makes about two hundred bytes of arrays a base; more bases at once are no faster
NONE = 4  # the digit of anything that is no plain base
DIGIT = np.full(256, NONE, np.uint8)
for _i, _c in enumerate("ACGT"):
    DIGIT[[ord(_c), ord(_c.lower())]] = _i
DIGIT[[ord("U"), ord("u")]] = 3


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings end to end (null: empty) and n + 1 offsets."""
    a = column.fill_null("") if column.null_count else column
    a = a.cast(pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64, count=a.offset + len(a) + 1)[a.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def cut(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of about MOST_BYTES of the column (one row at least), rows with a null in it left out."""
    for b in batches:
        if b.column(column).null_count:
            b = b.filter(pc.is_valid(b.column(column)))
        if not b.num_rows:
            continue
        _, off = flat(b.column(column))
        at = 0
        while at < b.num_rows:
            end = min(max(int(np.searchsorted(off, off[at] + MOST_BYTES, side="right")) - 1, at + 1), b.num_rows)
            yield b.slice(at, end - at)
            at = end


def arrow_type(name: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[name]


def emit(df: DataFrame, key: str, column: str, work: Callable[[np.ndarray, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """Rows (key, *values): `work` gets the bytes and offsets of a batch and gives each row's text number and the columns of `schema`."""
    fields = [p.split() for p in schema.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, column):
            got = work(*flat(b.column(column)))
            if got is None or not len(got[0]):
                continue
            for i in range(0, len(got[0]), 1 << 18):  # rows leave in bounded batches
                part = [np.asarray(g[i : i + (1 << 18)]) if isinstance(g, np.ndarray) else g[i : i + (1 << 18)] for g in got]
                cols = [x if isinstance(x, pa.Array) else pa.array(x, arrow_type(t)) for x, (_, t) in zip(part[1:], fields, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(part[0])), *cols], names=[key, *(f for f, _ in fields)])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{f}` {t}" for f, t in fields))
