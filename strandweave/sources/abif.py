"""Chromatogram (ABIF) files as rows: calls, qualities, peak places and the four channels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "calls string, quality array<int>, peaks array<int>, dye_order string, a array<int>, c array<int>, g array<int>, t array<int>, reverse boolean, status string"
MOST_BYTES, MOST_CALLS, MOST_SAMPLES = 10 << 20, 100_000, 2_000_000
WIDTH = {1: 1, 2: 1, 4: 2, 5: 4}


def directory(raw: bytes) -> dict[tuple[str, int], tuple[int, int, bytes]]:
    """(tag, number) -> element type, count and bytes."""
    if raw[:4] != b"ABIF":
        raise ValueError("not an ABIF file")
    _, _, _, _, n, _, at = struct.unpack_from(">4sihhiii", raw, 6)
    out = {}
    for i in range(n):
        tag, number, kind, _, count, size, _ = struct.unpack_from(">4sihhiii", raw, at + 28 * i)
        where = at + 28 * i + 20 if size <= 4 else struct.unpack_from(">i", raw, at + 28 * i + 20)[0]
        if where < 0 or where + size > len(raw):
            raise ValueError("an entry lies outside the file")
        out[(tag.decode("latin-1"), number)] = (kind, count, raw[where : where + size])
    return out


def parse_abif(raw: bytes) -> dict:
    if len(raw) > MOST_BYTES:
        raise ValueError("larger than the limit")
    d = directory(raw)
    first = lambda *tags: next((d[t] for t in tags if t in d), None)

    def numbers(e) -> list[int]:
        if e is None:
            return []
        kind, count, body = e
        code = {1: "B", 2: "b", 4: "h", 5: "i"}[kind]
        return list(struct.unpack(f">{count}{code}", body[: count * WIDTH[kind]]))

    calls = first(("PBAS", 2), ("PBAS", 1))
    order = first(("FWO_", 1))
    text = calls[2].decode("latin-1") if calls else ""
    if len(text) > MOST_CALLS:
        raise ValueError("more calls than the limit")
    dyes = order[2].decode("latin-1")[:4] if order else "GATC"
    channels = {b.lower(): numbers(d.get(("DATA", 9 + i))) for i, b in enumerate(dyes)}
    if sum(map(len, channels.values())) > MOST_SAMPLES:
        raise ValueError("more samples than the limit")
    reverse = d.get(("RevC", 1))
    return {"calls": text, "quality": numbers(first(("PCON", 2), ("PCON", 1))), "peaks": numbers(first(("PLOC", 2), ("PLOC", 1))), "dye_order": dyes, **{b: channels.get(b, []) for b in "acgt"}, "reverse": bool(reverse and any(reverse[2])), "status": "ok"}


def parse_traces(files: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """key and the fields of TRACE; a file that cannot be read has only its reason as status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, raw in zip(b[key], b[column], strict=True):
                try:
                    rows.append({key: k, **parse_abif(bytes(raw))})
                except (ValueError, struct.error, KeyError) as e:
                    rows.append({key: k, **dict.fromkeys(("calls", "quality", "peaks", "dye_order", "a", "c", "g", "t", "reverse")), "status": str(e)})
            if rows:
                yield pd.DataFrame(rows)

    return files.select(key, column).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, {TRACE}")


def read_abif(spark: SparkSession, path: str) -> DataFrame:
    return parse_traces(spark.read.format("binaryFile").load(path).select("path", "content"))


def trimmed_calls(traces: DataFrame) -> DataFrame:
    """Traces whose calls, qualities and peaks have one length each; others are marked."""
    return traces.withColumn("status", F.when((F.size("quality") != F.length("calls")) & (F.size("quality") > 0), "quality_length").when((F.size("peaks") != F.length("calls")) & (F.size("peaks") > 0), "peaks_length").otherwise(F.col("status")))


def trace_warnings(traces: DataFrame) -> DataFrame:
    """traces (calls, quality, peaks, a, c, g, t, record: the sequence they belong to) with warnings: calls unlike the record, unequal lengths, more samples than the limit."""
    n = F.length("calls")
    sizes = F.array(*[F.size(b) for b in "acgt"])
    said = F.array(
        F.when(F.upper("calls") != F.upper("record"), "calls_differ"), F.when((F.size("quality") > 0) & (F.size("quality") != n), "quality_length"), F.when((F.size("peaks") > 0) & (F.size("peaks") != n), "peaks_length"),
        F.when(F.size(F.array_distinct(F.filter(sizes, lambda x: x > 0))) > 1, "channels_unequal"), F.when(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) > MOST_SAMPLES, "too_many_samples"))
    return traces.withColumn("warnings", F.array_compact(said))
