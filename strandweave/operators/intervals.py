"""Intervals: normalised spans, containment, overlap, edits, lanes, bins."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_span(start: Column, end: Column, length: Column, circular: bool) -> Column:
    """Half-open spans on a line (clamped) or a circle (one or two spans)."""
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    if not circular:
        a, b = F.greatest(F.lit(0), F.least(start, length)), F.greatest(F.lit(0), F.least(end, length))
        return F.when(b > a, F.array(span(a, b))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    a, size = F.pmod(start, length), F.least(end - start, length)
    b = a + size
    return (
        F.when(size <= 0, F.array().cast("array<struct<start:bigint,end:bigint>>"))
        .when(b <= length, F.array(span(a, b)))
        .otherwise(F.array(span(a, length), span(F.lit(0), b - length)))
    )


def reverse_features(features: DataFrame) -> DataFrame:
    """Features (start, end, strand, n) as they lie on the reverse complement."""
    return features.withColumns({"start": F.col("n") - F.col("end"), "end": F.col("n") - F.col("start"), "strand": -F.col("strand")})


def edited(start: Column, end: Column, at: Column, removed: Column, inserted: Column) -> tuple[Column, Column, Column]:
    """A span after `removed` bases at `at` are replaced by `inserted`: start, end, status (kept, shifted, review, detached)."""
    cut, delta = at + removed, inserted - removed
    place = lambda p: F.when(p <= at, p).when(p >= cut, p + delta).otherwise(at)
    a, b = place(start), F.when((end > at) & (end < cut), at).otherwise(place(end))
    status = F.when(b <= a, "detached").when((end <= at) | (removed + inserted == 0), "kept").when(start >= cut, "shifted").otherwise("review")
    return a, b, status


def contained(inner: DataFrame, outer: DataFrame, key: str, bin_size: int = 1024) -> DataFrame:
    """Rows of `inner` (key, id, start, end) with the first span of `outer` (key, span, s, e) that holds them whole; null if none does.

    Spans are filed under the bins that they touch and looked up in the bin of the inner start, so the join has an equality.
    """
    filed = outer.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / bin_size), F.floor((F.col("e") - 1) / bin_size)))).where("e > s")
    at = inner.withColumn("bin", F.floor(F.col("start") / bin_size))
    hit = at.join(filed, [key, "bin"]).where("s <= start AND end <= e").groupBy(key, "id").agg(F.min(F.struct("s", "span")).alias("m"))
    return inner.join(hit, [key, "id"], "left").select(*inner.columns, F.col("m.span").alias("span"))


def overlaps(spans: DataFrame, key: str) -> DataFrame:
    """key, id, n: how many other half-open spans of the key each one overlaps: those that start before its end, less those that end by its start.

    Starts and ends are counted by place first; only places are put in order, and spans look their two places up, so a hot key is as wide as its coordinates.
    """
    s = spans.where("end > start")
    marks = s.groupBy(key, F.col("start").alias("pos")).agg(F.count("*").alias("a"), F.lit(0).cast("long").alias("z")).unionByName(s.groupBy(key, F.col("end").alias("pos")).agg(F.lit(0).cast("long").alias("a"), F.count("*").alias("z")))
    marks = marks.groupBy(key, "pos").agg(F.sum("a").alias("a"), F.sum("z").alias("z"))
    w = Window.partitionBy(key).orderBy("pos")
    marks = marks.select(key, "pos", F.coalesce(F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("z").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ended"))
    j = s.join(marks.select(key, F.col("pos").alias("end"), "before"), [key, "end"]).join(marks.select(key, F.col("pos").alias("start"), "ended"), [key, "start"])
    return j.select(key, "id", (F.col("before") - F.col("ended") - 1).alias("n"))


def pack_lanes(spans: DataFrame, key: str) -> DataFrame:
    """key, id, lane: greedy first-fit lanes by start, falling length, end, id.

    Equal spans are counted first and lanes are dealt to the counts; and each key is cut where no earlier span is still open, since
    first-fit begins again at lane 0 there. So a task holds the different spans of one such island, whatever the number of rows.
    """
    kind = spans.schema[key].dataType.simpleString()
    one = spans.groupBy(key, "start", "end").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("start", F.desc("end"))
    open_ = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("new", F.when(F.col("start") >= F.coalesce(open_, F.col("start")), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: list[int] = []
        busy: list[tuple[int, int]] = []
        top, last = 0, None
        for t in batches:
            lanes = []
            for k, island, s, e, n in zip(*(t.column(c).to_pylist() for c in (key, "island", "start", "end", "_n")), strict=True):
                if (k, island) != last:
                    free, busy, top, last = [], [], 0, (k, island)
                own = []
                for _ in range(n):
                    while busy and busy[0][0] <= s:  # an empty span leaves its lane at once
                        heapq.heappush(free, heapq.heappop(busy)[1])
                    if not free:
                        heapq.heappush(free, top)
                        top += 1
                    lane = heapq.heappop(free)
                    heapq.heappush(busy, (e, lane))
                    own.append(lane)
                lanes.append(own)
            yield pa.RecordBatch.from_arrays([t.column(key), t.column("start").cast(pa.int64()), t.column("end").cast(pa.int64()), pa.array(lanes, pa.list_(pa.int32()))], names=[key, "start", "end", "lanes"])

    # Islands follow one another in a task, so that short ones cost no call of their own.
    dealt = one.select(key, "island", "start", "end", "_n").repartition(key, "island").sortWithinPartitions(key, "island", "start", F.desc("end"))
    lanes = dealt.mapInArrow(run, f"{key} {kind}, start long, end long, lanes array<int>")
    place = F.row_number().over(Window.partitionBy(key, "start", "end").orderBy("id"))
    return spans.withColumn("place", place).join(lanes, [key, "start", "end"]).select(key, "id", F.element_at("lanes", F.col("place")).alias("lane"))


def overview_bins(spans: DataFrame, key: str, bins: int) -> DataFrame:
    """key, bin, n: a span counts in every bin that it touches. spans: key, n (length), start, end."""
    first, last = F.floor(F.col("start") * bins / F.col("n")), F.least(F.lit(bins - 1), F.floor((F.col("end") - 1) * bins / F.col("n")))
    return spans.where("end > start").withColumn("bin", F.explode(F.sequence(first, last))).groupBy(key, "bin").agg(F.count("*").alias("n"))
