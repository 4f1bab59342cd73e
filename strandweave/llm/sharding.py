"""Minimax contiguous partition: shards of nearly equal bytes, equal texts together.

Order and atoms. A text's key is xxhash64 of its bytes; its top `atom_bits` bits name its atom, so
equal texts always share an atom and atoms are ordered. The smallest capacity for which greedy filling
needs no more than the shards given is found by binary search. An atom above a fair share (one text copied
very often) cannot be divided: it is a shard by itself, in its place, and the capacity is that of the rest. Shards
are contiguous in atom order; within the capacity their cuts are levelled, so that none is left half full.

Scale. The driver sees at most 2**atom_bits sums (65,536 by default, at any input size), never texts
or documents. The texts are read once, for sizes and hashes, which are written. Slots come from counts of bounded
cells of each shard, so no task sorts a whole shard.

Null texts count as empty (size 16) and share an atom. Repeated rows are kept. An empty table gives
an empty result. More shards than atoms leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.common import documents, written

CELL_ROWS = 20_000


def fill(sizes: np.ndarray, capacity: int, most: int | None = None) -> list[int]:
    """Greedy check: where each shard starts if none but a single larger atom, which is alone, passes `capacity`; stops beyond `most` shards."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    starts, at = [], 0
    while at < len(sizes) and (most is None or len(starts) <= most):
        starts.append(at)
        at = max(at + 1, int(np.searchsorted(total, total[at] + capacity, side="right")) - 1)
    return starts


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """Smallest capacity, by binary search, whose greedy filling needs at most `shards` shards; a larger atom is a shard alone in its place.

    The largest shard is then max(capacity, largest atom), which is the minimax over all contiguous partitions.
    """
    low, high = 1, int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        if len(fill(sizes, mid, shards)) > shards:
            low = mid + 1
        else:
            high = mid
    return low


def levelled(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Starts of exactly min(shards, atoms) shards within `capacity`, each cut nearest to an equal share of what is left."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n, starts, at = len(sizes), [], 0
    for left in range(min(shards, n), 0, -1):
        starts.append(at)
        if left == 1:
            break
        goal = total[at] + (total[n] - total[at]) / left
        high = min(int(np.searchsorted(total, total[at] + capacity, side="right")) - 1, n - left + 1)
        cut = int(np.searchsorted(total, goal))
        cut = cut - 1 if cut > at + 1 and goal - total[cut - 1] <= total[min(cut, n)] - goal else cut
        cut = min(max(cut, at + 1), max(high, at + 1))
        far = max(high, cut)
        while cut < far:  # the first place from which the rest still fits
            mid = (cut + far) // 2
            if len(fill(sizes[mid:], capacity, left - 1)) > left - 1:
                cut = mid + 1
            else:
                far = mid
        at = cut
    return starts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """Largest shard of the minimax contiguous partition, and where its shards start.

    Atoms over the capacity stand alone where they are; the runs between them share the other shards
    (each as many as greedy filling needs, spare ones to the runs that are fullest) and are levelled.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0, []
    capacity = least_capacity(sizes, shards)
    alone = np.flatnonzero(sizes > capacity)
    edges = np.concatenate([[-1], alone, [len(sizes)]])
    runs = [(int(a) + 1, int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a + 1]
    need = [len(fill(sizes[a:b], capacity)) for a, b in runs]
    spare = shards - len(alone) - sum(need)
    while spare > 0 and any(k < b - a for k, (a, b) in zip(need, runs, strict=True)):
        fullest = max((i for i, (a, b) in enumerate(runs) if need[i] < b - a), key=lambda i: sizes[slice(*runs[i])].sum() / need[i])
        need[fullest] += 1
        spare -= 1
    starts = sorted([int(i) for i in alone] + [a + s for (a, b), k in zip(runs, need, strict=True) for s in levelled(sizes[a:b], capacity, k)])
    return max(capacity if len(runs) else 0, int(sizes.max())), starts


def atom_of(text: Column, atom_bits: int) -> Column:
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.shiftrightunsigned(key, 64 - atom_bits).cast("int")


def plan_shards(sums: list[tuple[int, int, int]], shards: int) -> tuple[list[int], np.ndarray]:
    """(atom, bytes, rows) -> first atom of every shard after the first, rows of each shard."""
    sums = sorted(sums)
    _, starts = minimax_cuts(np.array([s[1] for s in sums], dtype=np.int64), shards)
    rows = np.zeros(shards, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum([s[2] for s in sums])]).astype(np.int64)
    ends = [*starts[1:], len(sums)] if starts else []
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        rows[k] = total[b] - total[a]
    return [sums[i][0] for i in starts[1:]], rows


def shard_documents(docs: DataFrame, shards: int = 40, atom_bits: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        atom_of(F.col("text"), atom_bits).alias("atom"),
    )
    base = written(base, "op6-sizes")  # else the texts would be read for every pass
    sums = base.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    cuts, rows = plan_shards([(r["atom"], r["bytes"], r["rows"]) for r in sums], shards)
    shard = F.lit(0)
    for first in cuts:
        shard = shard + (F.col("atom") >= first).cast("int")
    cells = F.array(*[F.lit(max(1, -(-int(n) // CELL_ROWS))) for n in rows])
    placed = base.withColumn("shard", shard.cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.get(cells, F.col("shard"))).cast("int")
    )
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(rank))
        .join(offsets, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
