"""Suffix-array dedup: cut every byte that a repeated 200-byte string covers.

Every 200-byte window is filed under its anchor, the leftmost smallest hash among the window's 24-byte
grams. Equal windows have equal anchors at equal places, so only windows of one anchor can be equal.
Neighbouring windows with one anchor form one stretch (a few hundred bytes), about one for every 90 bytes
of text, and stretches take the place of the suffixes of a full suffix array: it is sparse, yet loses no
window.

1. Stretches of all texts, with the gram's hash and a hash of the stretch's bytes.
2. Anchors that occur once are dropped. Where all stretches of an anchor are one string, that string is
   its own sorted run, with its number of occurrences. For the other anchors one copy of each different
   stretch is fetched from the texts, with the number of its occurrences.
3. In each anchor's group the parts right of the anchor and the reversed parts left of it are sorted
   deep-shallow (multikey quicksort to 32 bytes, blind tries below). Windows that start a bytes before
   the anchor are equal where neighbours share a bytes to the left and 200 - a to the right; classes
   with two or more occurrences are repeated.
4. Repeated windows go back to their occurrences, are united per document and cut.

Scale. Texts are read for the stretches, joined by row once with the stretches wanted of them and once with
the ranges to cut; everything else that moves is 8-byte hashes and places of
stretches and the differing stretches of shared anchors. Hot anchors: occurrences are counted before the
shuffle and joined (Spark splits such joins); an anchor with more than GROUP_MOST different stretches
(a line in a third of all documents) is not sorted in one task: its windows are dealt out one by one
and counted, which gives the same result.

Null texts are empty; texts under 200 bytes keep all bytes. Repeated rows repeat each other's windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import byte_buffer, documents, slices, whole_groups, written
from strandweave.llm.deepshallow import neighbours_common, suffix_order
from strandweave.llm.shingles import mix

SPAN, GRAM = 200, 24
GROUP_MOST = 4096
BATCH_STRETCHES = 20_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from every place on."""
    w = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel()
    n = len(data) - GRAM + 1
    return mix(w[:n] * np.uint64(0x9E3779B97F4A7C15) + w[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F) + w[16 : 16 + n] * np.uint64(0x165667B19E3779F9))


def stretches(data: np.ndarray, off: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """text, start in it, windows, anchor's place in the stretch, gram hash, stretch hash: all stretches of the batch."""
    sizes = np.diff(off)
    none = (np.zeros(0, np.int64),) * 6
    if not (sizes >= span).any():
        return none
    h = gram_hashes(data)
    w = span - GRAM + 1
    low = np.uint64((1 << 32) - 1)  # fixed, so that equal windows of any two batches take one anchor: equal high halves go to the left
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pad = (-len(key)) % w + w
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(data) - span + 1
    anchor = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)
    n = np.maximum(sizes - span + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + off[:-1][text]
    anchor = anchor[place]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(first, len(text)))
    begin, at = place[first], anchor[first]
    end = begin + windows + span - 1
    x = mix(windows.astype(np.uint64))
    for j in range(-(-2 * span // GRAM)):
        p = np.minimum(begin + GRAM * j, end - GRAM)
        more = begin + GRAM * (j - 1) < end - GRAM
        x = np.where(more, mix(x * np.uint64(0x2545F4914F6CDD1D) + h[p]), x)
    return text[first], begin - off[:-1][text[first]], windows, at - begin, h[at].view(np.int64), x.view(np.int64)


def find_stretches(docs: DataFrame) -> DataFrame:
    """row, grams, contents, places: of every text the gram hash, stretch hash and packed place of its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            data, off = byte_buffer(b.column("text"))
            text, start, windows, rel, gram, content = stretches(data, off)
            ends = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (gram, content, start << 20 | windows << 10 | rel)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *lists], names=["row", "grams", "contents", "places"])

    return docs.select("row", "text").mapInArrow(run, "row long, grams array<long>, contents array<long>, places array<long>")


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated(group: np.ndarray, strings: list[bytes], rel: np.ndarray, windows: np.ndarray, times: np.ndarray, span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each stretch the runs [p, q) of its windows that occur twice or more in its group; group is sorted."""
    right = [s[r:] for s, r in zip(strings, rel.tolist(), strict=True)]
    left = [s[:r][::-1] for s, r in zip(strings, rel.tolist(), strict=True)]
    r_order, l_order = suffix_order(group, right), suffix_order(group, left)
    r_common, l_common = neighbours_common(r_order, group, right), neighbours_common(l_order, group, left)
    n = len(strings)
    hit = np.zeros((n, int(windows.max(initial=1))), bool)
    cls_r, cls_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(rel.max(initial=0)) + 1):
        on = np.flatnonzero((a <= rel) & (a > rel - windows))
        if not len(on):
            continue
        cls_r[r_order] = np.cumsum(r_common < span - a)
        cls_l[l_order] = np.cumsum((l_common < a) | (l_common < 0))
        _, which = np.unique(cls_r[on] * (n + 1) + cls_l[on], return_inverse=True)
        many = np.bincount(which, weights=times[on]) >= 2
        hit[on, rel[on] - a] = many[which]
    return [runs_of(hit[i, : windows[i]]) for i in range(n)]


def sort_groups(found: DataFrame) -> DataFrame:
    """gram, content, starts, ends: repeated byte ranges of each different stretch, counted from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "gram", BATCH_STRETCHES):
            gram, place = b.column("gram").to_numpy(), b.column("place").to_numpy()
            got = repeated(gram, b.column("bytes").to_pylist(), place & 1023, place >> 10 & 1023, b.column("times").to_numpy())
            starts = pa.array([[p for p, _ in r] for r in got], pa.list_(pa.int32()))
            ends = pa.array([[q + SPAN - 1 for _, q in r] for r in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("gram"), b.column("content"), starts, ends], names=["gram", "content", "starts", "ends"])

    return found.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "gram long, content long, starts array<int>, ends array<int>")


def count_windows(found: DataFrame) -> DataFrame:
    """The same for anchors with very many different stretches: windows counted one by one over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes", 1 << 20):
            n = (b.column("place").to_numpy() >> 10) & 1023
            keys = [hashlib.blake2b(s[p : p + SPAN], digest_size=16).digest() for s, k in zip(b.column("bytes").to_pylist(), n.tolist(), strict=True) for p in range(k)]
            of = pa.array(np.repeat(np.arange(b.num_rows), n))
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column("gram").take(of), b.column("content").take(of), b.column("times").take(of), pa.array(at.astype(np.int32)), pa.array(keys, pa.binary())], names=["gram", "content", "times", "at", "key"])

    each = found.mapInArrow(run, "gram long, content long, times long, at int, key binary")
    twice = each.groupBy("key").agg(F.sum("times").alias("n")).where("n >= 2").select("key")
    return each.join(twice, "key").groupBy("gram", "content").agg(F.sort_array(F.collect_list("at")).alias("starts")).withColumn("ends", F.transform("starts", lambda x: x + SPAN))


def repeated_ranges(docs: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """row, ranges: repeated byte ranges (start, end) of every row that has any. docs: doc_id, text, row."""
    found = written(find_stretches(docs), "op1-stretches")
    each = found.select("row", F.explode(F.arrays_zip("grams", "contents", "places")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.contents").alias("content"), F.col("x.places").alias("place"))
    shared = each.groupBy("gram").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed"))
    shared = written(shared, "op1-grams")  # so that both sides of the join are plain exchanges and Spark can split a hot gram
    each = written(each.join(shared, "gram"), "op1-shared")
    start, windows = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023)
    alike = each.where("NOT mixed").select("row", start.alias("start"), (start + windows + SPAN - 1).alias("end"))
    mixed = each.where("mixed").select("row", "gram", "content", "place")
    kinds = written(mixed.groupBy("gram", "content").agg(F.count("*").alias("times"), F.min(F.struct("row", "place")).alias("one")).select("gram", "content", "times", F.col("one.row").alias("row"), F.col("one.place").alias("place")), "op1-kinds")
    wanted = kinds.groupBy("row").agg(F.collect_list(F.struct("gram", "content", "times", "place")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            out = {k: [] for k in ("gram", "content", "times", "place", "bytes")}
            for text, want in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                for w in want:
                    s = w["place"] >> 20
                    for k in ("gram", "content", "times", "place"):
                        out[k].append(w[k])
                    out["bytes"].append(raw[s : s + (w["place"] >> 10 & 1023) + SPAN - 1])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "bytes" else pa.int64()) for k, v in out.items()], names=list(out))

    texts = docs.dropDuplicates(["row"]).join(wanted, "row").select("doc_id", "text", "wanted").mapInArrow(fetch, "gram long, content long, times long, place long, bytes binary")
    bytes_ = written(texts, "op1-bytes")
    hot = bytes_.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > group_most).select("gram")
    masks = sort_groups(bytes_.join(hot, "gram", "left_anti")).unionByName(count_windows(bytes_.join(hot, "gram", "left_semi")))
    masks = written(masks.where(F.size("starts") > 0), "op1-masks")
    part = mixed.join(masks, ["gram", "content"]).select("row", start.alias("s"), F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("row", (F.col("s") + F.col("x.starts")).alias("start"), (F.col("s") + F.col("x.ends")).alias("end"))
    return alike.unionByName(part).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans: every document without its repeated bytes."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    ranges = repeated_ranges(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            kept, spans, n = [], [], []
            for text, r in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                raw, cut = (text or "").encode(), _merged(r or [])
                ends = [0, *[e for _, e in cut]]
                kept.append(b"".join([raw[x:y] for x, y in zip(ends, [*[s for s, _ in cut], len(raw)], strict=True)]))
                spans.append([{"start": s, "end": e} for s, e in cut])
                n.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([x - len(k) for x, k in zip(n, kept, strict=True)], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return rows.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
