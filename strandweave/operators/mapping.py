"""Reads mapped to their references: seeds, votes, banded alignment in batches, and an exact scan for what seeds cannot prove.

1. Words of WORD bases of each read (side by side, both strands) are joined with the words of its reference by (construct, word). A hit votes for its diagonal
   (place on the reference less place in the read); diagonals meet in buckets of two slots, each E bases wide at least, that overlap by one.
2. A read with m seeds that no word of its reference repeats too often keeps m - E of them in every alignment with E errors or less. Buckets with as many votes are
   candidates, but for those whose slots a neighbour's window holds too; the stretch of reference around them is put together from chunks, so a task never holds a whole reference.
3. A batch of candidates is aligned at once, a read row a step, diagonals as columns. Beside the best alignment, the best is found that leaves its band on either side: a runner-up
   with another path.
4. An alignment that is no candidate has more than E errors, so it scores below 3 n - 4 E. If best and runner-up limit lie above that, the seeds have proven the mapping. All other
   reads are aligned to all of their reference, in windows of diagonals that overlap by more than any alignment with a positive score can drift: with a bases alone and d of the
   reference alone it scores 3 (n - a) - 4 a - 4 d at most, so a < 3 n / 7 and d < 3 n / 4, and no base of it lies beyond the ends.

So results are those of the full matrix wherever a score is above nothing, while clean reads never meet more than a few hundred diagonals. Rows of one construct are joined by word, chunk or read, never gathered;
both sides of a join grow with the reads and pack well, so joins ask for a merge: a small file would else be a large broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import sequence as S
from strandweave.operators.batches import cut
from strandweave.operators.scans import CODON_MASK
from strandweave.session import written

# --- fixed values: scores ---
MATCH, PARTLY, MISMATCH, GAP = 3, 1, -3, -4

WORD, MOST_PLACES = 11, 64
BUCKET = 8
SPARE = 64
CHUNK = 4096
CELLS = 32 << 20
TASK = 4 * CELLS
OUTSIDE = 16  # the symbol for places beyond the ends of a reference
FAR = -(1 << 28)

def masks(text: str) -> np.ndarray:
    return CODON_MASK[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].astype(np.uint8)


def laid_out(reads: list[np.ndarray], stretches: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reads and stretches of a batch as matrices, a column each (places without a letter: OUTSIDE), and the reads' lengths."""
    n = np.array([len(r) for r in reads])
    x = np.ones((len(reads), int(n.max())), np.uint8)  # what follows a read is never looked at
    y = np.full((len(reads), width + x.shape[1]), OUTSIDE, np.uint8)
    for i, (r, s) in enumerate(zip(reads, stretches, strict=True)):
        x[i, : len(r)] = r
        y[i, : min(len(s), y.shape[1])] = s[: y.shape[1]]
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), n


def matrix_rows(x: np.ndarray, y: np.ndarray, width: int, starts: np.ndarray, shut: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Per base of the reads: scores by diagonal (rows) and read (columns), and which steps give them (bit 1: along, bit 2: a base of the read alone, none: one of the reference alone); without the steps if diagonals are shut.

    starts: diagonals where a path may begin; shut: diagonals that may not be used. Values are 16 bits wide where no score can leave them.
    """
    small = len(x) <= 2000 and width <= 4096
    kind, far = (np.int16, -16000) if small else (np.int32, FAR)
    far = kind(far)
    climb = (np.arange(width, dtype=kind) * kind(-GAP))[:, None]
    outside = y == OUTSIDE
    ends = np.concatenate([[0], np.cumsum(outside.any(axis=1))])
    beyond = np.where(outside, far, kind(0))
    row = np.where(starts, kind(0), far)
    open_ = None if shut is None else np.where(shut, far, np.iinfo(kind).max).astype(kind)
    if open_ is not None:
        row = np.minimum(row, open_)
    alone, other = np.full_like(row, far), np.empty_like(row)
    for i in range(len(x)):
        below = y[i : i + width]
        met = (below & x[i]) > 0
        score = met.view(np.int8) * np.int8(PARTLY - MISMATCH) + (met & (below == x[i])).view(np.int8) * np.int8(MATCH - PARTLY) + np.int8(MISMATCH)
        along = row + score
        if ends[i + width] > ends[i]:
            along += beyond[i : i + width]
        np.add(row[1:], kind(GAP), out=alone[:-1])
        best = np.maximum(along, alone)
        np.maximum(best, far, out=best)  # never below, so that sums stay far from the ends of the type
        if open_ is not None:
            np.minimum(best, open_, out=best)
        best += climb
        step = 1
        while step < width:  # the best of all diagonals before, by doubling
            np.maximum(best[step:], best[:-step], out=other[step:])
            other[:step] = best[:step]
            best, other = other, best
            step *= 2
        row = best - climb
        if open_ is not None:
            np.minimum(row, open_, out=row)
            yield row, None
        else:
            yield row, (row == along).view(np.uint8) + (row == alone).view(np.uint8) * np.uint8(2)


def ending(n: np.ndarray) -> dict[int, np.ndarray]:
    """The reads of a batch by their lengths."""
    return {int(k): np.flatnonzero(n == k) for k in np.unique(n)}


def wide(values: np.ndarray) -> np.ndarray:
    """Scores as 64 bits, FAR where no path leads."""
    v = values.astype(np.int64)
    return np.where(v <= -10000, FAR, v) if values.dtype == np.int16 else v


def end_scores(x: np.ndarray, y: np.ndarray, n: np.ndarray, width: int, starts: np.ndarray, shut: np.ndarray) -> np.ndarray:
    """The best score of each read without the diagonals in shut; those shut for all reads, on either side, are not looked at."""
    out = np.full(x.shape[1], FAR, np.int64)
    free = np.flatnonzero(~shut.all(axis=1))
    if not len(free):
        return out
    a, b = int(free[0]), int(free[-1]) + 1
    done = ending(n)
    for i, (row, _) in enumerate(matrix_rows(x, y[a : b + len(x)], b - a, starts[a:b], shut[a:b]), 1):
        if i in done:
            out[done[i]] = wide(row[:, done[i]].max(axis=0))
    return out


def aligned_batch(x: np.ndarray, y: np.ndarray, n: np.ndarray, width: int, starts: np.ndarray, circle: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Score, the runner-up's score (another path), the place in the stretch where the path begins, and its steps (1 along, 2 a base of the read alone, 3 one of the reference alone), of every read.

    circle: lengths of circular references (0: none), on which a path that only leaves this one for its copy a lap away is no other path.
    """
    count, steps = x.shape[1], np.zeros((len(x) + 1, width, x.shape[1]), np.uint8)
    score, second, at = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    ends = ending(n)
    for i, (row, step) in enumerate(matrix_rows(x, y, width, starts), 1):
        steps[i] = step
        if i in ends:
            last = row[:, ends[i]]
            best = last.max(axis=0)
            score[ends[i]], at[ends[i]] = wide(best), last.argmax(axis=0)
            second[ends[i]] = np.where((last == best).sum(axis=0) > 1, wide(best), FAR)
    row, diagonal, low, high = n.copy(), at.copy(), at.copy(), at.copy()
    taken = []
    which = np.arange(count)
    named = np.array([3, 1, 2, 1], np.uint8)
    while (row > 0).any():
        step = np.where(row > 0, named[steps[row, diagonal, which]], 0)
        taken.append(step)
        row = row - ((step == 1) | (step == 2))
        diagonal = diagonal + (step == 2) - (step == 3)
        low, high = np.minimum(low, diagonal), np.maximum(high, diagonal)
    paths = np.array(taken, np.uint8).reshape(-1, count)[::-1]
    places = np.arange(width)[:, None]
    lap = np.where(np.asarray(circle) > 0, circle, 1 << 40)
    for shut in ((places <= low) | (places >= high + lap), (places >= high) | (places <= low - lap)):
        second = np.maximum(second, end_scores(x, y, n, width, starts, shut))
    return score, second, diagonal, [p[p > 0] for p in paths.T]


def spelled(x: np.ndarray, y: np.ndarray, begin: int, steps: np.ndarray) -> str:
    """The steps as letters: m equal plain bases, s other pairs, i a base of the read alone, d one of the reference alone."""
    i, j = np.cumsum(steps != 3) - 1, begin + np.cumsum(steps != 2) - 1
    pair = steps == 1
    a, b = x[np.where(pair, i, 0)], y[np.where(pair, j, 0)]
    same = pair & (a == b) & (a > 0) & (a & (a - 1) == 0)
    return np.where(same, ord("m"), np.where(pair, ord("s"), np.where(steps == 2, ord("i"), ord("d")))).astype(np.uint8).tobytes().decode()


def scored(windows: DataFrame) -> DataFrame:
    """construct, read, strand, circle, n, score, second, place (of the path's first base or boundary), path, segment (the reference below it) of every window.

    windows: construct, read, strand, calls (oriented), first (the reference place of the first diagonal), width (diagonals), begins and ends (those where a path may begin), lead (places of it before the reference begins), text, circle (length of a circular reference, or 0).
    """
    kept = ["construct", "read", "strand", "circle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            same: dict[tuple, list[int]] = {}  # reads of the same letters in the same window are aligned once
            for i, key in enumerate(zip(*(whole.column(c).to_pylist() for c in ("calls", "text", "lead", "first", "width", "begins", "ends", "circle")), strict=True)):
                same.setdefault(key, []).append(i)
            rows = list(same.values())
            alone = np.array([r[0] for r in rows], np.int64)
            width, size = whole.column("width").to_numpy()[alone], np.array([len(key[0]) for key in same], np.int64)
            order = np.lexsort((size, width))
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and width[order[end]] == width[order[at]] and (end + 1 - at) * (size[order[end]] + 1) * width[order[end]] <= CELLS:
                    end += 1
                b = whole.take(pa.array(alone[order[at:end]]))
                own = [rows[k] for k in order[at:end].tolist()]
                at, w = end, int(width[order[at]])
                reads = [masks(c) for c in b.column("calls").to_pylist()]
                texts = ["." * lead + t for lead, t in zip(b.column("lead").to_pylist(), b.column("text").to_pylist(), strict=True)]
                stretches = []
                for t in texts:
                    m = masks(t)
                    m[np.frombuffer(t.encode("latin-1", "replace"), np.uint8) == 46] = OUTSIDE
                    stretches.append(m)
                x, y, n = laid_out(reads, stretches, w)
                begins, ends = (b.column(c).to_numpy() for c in ("begins", "ends"))
                starts = (np.arange(w)[:, None] >= begins) & (np.arange(w)[:, None] < ends)
                circle = b.column("circle").to_numpy()
                score, second, begin, steps = aligned_batch(x, y, n, w, starts, circle)
                paths = [spelled(x[:, i], y[:, i], int(begin[i]), s) for i, s in enumerate(steps)]
                used = [len(p) - p.count("i") for p in paths]
                place = b.column("first").to_numpy() + begin
                place = np.where(circle > 0, place % np.maximum(circle, 1), place)
                cols = [pa.array(n.astype(np.int32)), pa.array(score), pa.array(second), pa.array(place), pa.array(paths), pa.array([t[i : i + k] for t, i, k in zip(texts, begin.tolist(), used, strict=True)])]
                of, each = pa.array(np.repeat(np.arange(len(own)), [len(r) for r in own])), pa.array([i for r in own for i in r])
                yield pa.RecordBatch.from_arrays([*(whole.column(c).take(each) for c in kept), *(c.take(of) for c in cols)], names=[*kept, "n", "score", "second", "place", "path", "segment"])

    kinds = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in kept)
    columns = [*kept, "calls", "first", "width", "begins", "ends", "lead", "text"]
    return windows.select(*columns).mapInArrow(run, f"{kinds}, n int, score long, second long, place long, path string, segment string")


def word_places(texts: DataFrame, key: list[str], column: str, step: int) -> DataFrame:
    """key, place, word of every step-th word of plain bases."""
    code = np.full(256, -1, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in cut(iter([whole]), column):
                texts_ = [t.encode("latin-1", "replace") for t in b.column(column).to_pylist()]
                size = np.array([len(t) for t in texts_])
                c = code[np.frombuffer(b"".join(texts_), np.uint8)]
                odd = np.concatenate([[0], np.cumsum(c < 0)])
                count = np.maximum((size - WORD) // step + 1, 0)
                begin, first = np.cumsum(size) - size, np.cumsum(count) - count
                for s in range(0, int(count.sum()), 1 << 18):
                    k = np.arange(s, min(s + (1 << 18), int(count.sum())))
                    text = np.searchsorted(first + count, k, side="right")
                    place = (k - first[text]) * step
                    at = begin[text] + place
                    on = odd[at + WORD] == odd[at]
                    text, place, at = text[on], place[on], at[on]
                    word = sum(c[at + i] << (2 * i) for i in range(WORD))
                    yield pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(text)) for x in key), pa.array(place), pa.array(word)], names=[*key, "place", "word"])

    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in key)
    return texts.select(*key, column).mapInArrow(run, f"{kinds}, place long, word long")


def stretches(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """windows (construct, read, strand, calls, first, width, circle) with lead and text: the reference from `first` on, put together from its chunks (construct, chunk, text)."""
    size = F.col("width") + F.length("calls")
    w = windows.withColumn("lead", F.when(F.col("first") < 0, F.least(-F.col("first"), size)).otherwise(0).cast("int")).withColumn("window", F.monotonically_increasing_id())
    w = written(w, "mapping-windows")  # the same letters in the same window go to one task, which aligns them once
    work = w.agg(F.sum(F.col("width") * F.length("calls").cast("double"))).first()[0] or 0.0  # one number: cells to fill, by which the windows are dealt
    begin = F.greatest(F.col("first"), F.lit(0))
    parts = w.select("window", "construct", "first", begin.alias("begin"), F.explode(F.sequence(F.floor(begin / CHUNK), F.floor((F.greatest(F.col("first") + size, begin + 1) - 1) / CHUNK))).alias("chunk"))
    pieces = parts.join(chunks.hint("merge"), ["construct", "chunk"]).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("p"), F.first("begin").alias("begin"))
    text = F.array_join(F.transform("p", lambda p: p["text"]), "").substr((F.col("begin") - F.col("p")[0]["chunk"] * CHUNK + 1).cast("int"), F.lit(2**30))
    return w.join(pieces.select("window", text.alias("text")).hint("merge"), "window", "left").withColumn("text", F.coalesce(F.substring("text", F.lit(1), (size - F.col("lead")).cast("int")), F.lit(""))).repartition(1 + int(work / TASK), "construct", "first", "calls").drop("window")


def best_of(rows: DataFrame) -> DataFrame:
    """One row a read of scored(): the best alignment (ties: forward, first place), and `second`: the best score of any other path."""
    own = F.struct("score", "strand", (-F.col("place")).alias("back"), "path", "segment", "second", "n", "circle", "place")
    best = rows.groupBy("construct", "read").agg(F.max(own).alias("b"))
    same = (F.col("strand") == F.col("b.strand")) & (F.col("place") == F.col("b.place")) & (F.col("path") == F.col("b.path"))
    other = rows.join(best.hint("merge"), ["construct", "read"]).groupBy("construct", "read").agg(F.max(F.when(same, F.col("second")).otherwise(F.col("score"))).alias("other"))
    return best.join(other.hint("merge"), ["construct", "read"]).select("construct", "read", "b.strand", "b.place", "b.path", "b.segment", "b.n", "b.circle", "b.score", F.col("other").alias("second"))


def alignments(reads: DataFrame, references: DataFrame, margin: float) -> DataFrame:
    """construct, read, strand, place, path, segment, n, circle, score, second, seeded of every read (construct, read, calls: upper case, not empty) that has a reference (construct, seq: upper case, circular).

    seeded: whether seeds have proven it; margin: the share of the best possible score by which a runner-up must stay behind.
    """
    names = ["construct", "read"]
    reads = written(reads.select(*names, "calls"), "mapping-reads")
    refs = references.select("construct", "seq", "circular", F.length("seq").alias("n"), (~F.col("seq").rlike("[^ACGT]")).alias("plain"))
    # A circle goes on for as long as any window of its own reads can be: the widest has 4 n or 1024 diagonals and n + 0.75 n + 3 / 7 n beyond a lap, and reaches n bases further.
    most = reads.groupBy("construct").agg(F.max(F.length("calls")).alias("most"))
    refs = refs.join(most.hint("merge"), "construct")
    more = 7 * F.col("most") + 2048
    refs = written(refs.withColumn("text", F.when(F.col("circular"), F.rpad("seq", (F.col("n") + more).cast("int"), F.col("seq"))).otherwise(F.col("seq"))).drop("most"), "mapping-references")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / CHUNK)))
    chunks = written(refs.select("construct", "text", chunk.alias("chunk")).select("construct", "chunk", F.col("text").substr((F.col("chunk") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("text")), "mapping-chunks")
    both = F.explode(F.array(F.struct(F.lit(1).alias("strand"), F.col("calls").alias("calls")), F.struct(F.lit(-1).alias("strand"), S.reverse_complement(F.col("calls")).alias("calls"))))
    turned = written(reads.join(refs.select("construct", "n", "plain", "circular").hint("merge"), "construct").select(*names, "n", "plain", "circular", both.alias("b")).select(*names, "n", "plain", "circular", "b.strand", "b.calls"), "mapping-turned")
    looped = F.when(F.col("circular"), F.left("text", F.col("n") + WORD - 1)).otherwise(F.col("text"))
    places = written(word_places(refs.select("construct", looped.alias("looped")), ["construct"], "looped", 1), "mapping-words")
    often = written(places.groupBy("construct", "word").agg(F.count("*").alias("k")).where(F.col("k") > MOST_PLACES).select("construct", "word"), "mapping-often")
    seeds = written(word_places(turned, [*names, "strand"], "calls", WORD).withColumnRenamed("place", "offset"), "mapping-seeds")
    lost = seeds.join(often.hint("merge"), ["construct", "word"]).groupBy(*names, "strand").agg(F.count("*").alias("lost"))
    usable = seeds.groupBy(*names, "strand").agg(F.count("*").alias("m")).join(lost.hint("merge"), [*names, "strand"], "left").select(*names, "strand", (F.col("m") - F.coalesce("lost", F.lit(0))).alias("m"))
    # Both strands give one bound: the weaker one.
    bound = usable.groupBy(*names).agg(F.min("m").alias("m"), F.count("*").alias("strands")).withColumn("errors", F.when((F.col("strands") == 2) & (F.col("m") >= 2), F.floor(F.col("m") * 0.75).cast("int")))
    # No more errors than it takes to prove a read that has lost SPARE of the best possible score.
    bound = bound.join(reads.select(*names, F.ceil((margin * MATCH * F.length("calls") + SPARE) / 4).cast("int").alias("enough")).hint("merge"), names).withColumn("errors", F.when(F.col("errors").isNotNull(), F.least("errors", "enough")))
    power = F.pow(2, F.ceil(F.log2(F.col("errors").cast("double"))))
    bound = bound.where("errors IS NOT NULL").withColumn("bucket", F.greatest(F.lit(BUCKET), F.when(F.col("errors") <= 0.75 * power, 0.75 * power).otherwise(power)).cast("int"))  # few sizes, so that windows share a batch
    bound = written(bound.select(*names, "m", "errors", F.col("bucket").alias("size")), "mapping-bounds")
    hits = seeds.join(bound.hint("merge"), names).join(places.join(often, ["construct", "word"], "left_anti").hint("merge"), ["construct", "word"]).join(refs.select("construct", "n", "circular").hint("merge"), "construct")
    way = F.col("place") - F.col("offset")
    ways = F.when(F.col("circular"), F.array_distinct(F.array(F.pmod(way, F.col("n")), F.pmod(way, F.col("n")) + F.when(F.pmod(way, F.col("n")) < 4 * F.col("size"), F.col("n")).otherwise(0)))).otherwise(F.array(way))
    slot = F.floor(F.col("way") / F.col("size"))
    told = [*names, "strand", "m", "errors", "size"]
    # The window of a bucket reaches a slot beyond both of its own. So hits in its lower slot alone are looked at with the bucket before, hits in its upper slot alone with the next one, if that has more.
    part = F.explode(F.array(*[F.struct((slot - i).alias("bucket"), F.lit(i).alias("part")) for i in range(3)])).alias("p")
    buckets = hits.select(*told, F.explode(ways).alias("way")).select(*told, part).select(*told, "p.bucket", "p.part").groupBy(*told, "bucket").agg(*[F.count_if(F.col("part") == i).alias(c) for i, c in enumerate(["lower", "upper", "after"])])
    votes = buckets.where((F.col("lower") + F.col("upper") >= F.col("m") - F.col("errors")) & (F.col("upper") > 0) & ((F.col("lower") > 0) | (F.col("after") == 0))).drop("lower", "upper", "after")
    circle = F.when(F.col("circular"), F.col("n")).otherwise(0).cast("int").alias("circle")
    first = (F.col("bucket") - 1) * F.col("size")
    first = F.when(F.col("circular"), F.pmod(first, F.col("n"))).otherwise(first)
    wide = 4 * F.col("size")
    near = votes.select(*names, "strand", "bucket", "size").join(turned.hint("merge"), [*names, "strand"]).where((F.col("n") >= wide) | ~F.col("circular")).select(*names, "strand", "calls", first.alias("first"), wide.alias("width"), F.lit(0).alias("begins"), wide.alias("ends"), circle)
    quick = best_of(written(scored(stretches(near, chunks)), "mapping-scored"))
    limit = MATCH * F.col("n") - 4 * F.col("errors")
    proven = quick.join(bound.select(*names, "errors").hint("merge"), names).join(refs.select("construct", "plain").hint("merge"), "construct").join(reads.select(*names, (~F.col("calls").rlike("[^ACGT]")).alias("clean")).hint("merge"), names)
    proven = written(proven.where(F.col("plain") & F.col("clean") & (F.col("score") - margin * MATCH * F.col("n") >= limit)).drop("errors", "plain", "clean").withColumn("seeded", F.lit(True)), "mapping-proven")
    rest = turned.join(proven.select(*names).hint("merge"), names, "left_anti")
    size = F.length("calls")
    drift, fall = F.ceil(0.75 * size).cast("int"), F.ceil(3 * size / 7).cast("int")
    power = lambda k: F.greatest(F.lit(1024), F.pow(2, F.ceil(F.log2(k.cast("double")))).cast("int"))
    even = lambda k: (F.ceil(k / 32) * 32).cast("int")  # noqa: E731  few different widths, so that many windows share a batch
    # A circle that a window passes whole is one window, in which paths begin within one lap; so is a line whose diagonals fit.
    lap = F.col("circular") & (power(2 * size) > F.col("n"))
    low, high = -fall.cast("long"), F.greatest(F.col("n") - F.floor(4 * size / 7), -fall).cast("long")
    line = ~F.col("circular") & (high - low < power(2 * size))
    tiles = rest.withColumn("width", F.when(lap, even(F.col("n") + drift + fall)).when(line, even(high - low + 1)).otherwise(power(2 * size)))
    begin, end = F.when(F.col("circular"), F.lit(0).cast("long")).otherwise(low), F.when(F.col("circular"), F.col("n").cast("long") - 1).otherwise(high)
    first = F.when(lap, F.array(F.pmod(-fall, F.col("n")).cast("long"))).when(line, F.array(low)).otherwise(F.sequence(begin, end, (F.col("width") - drift).cast("long")))
    tiles = tiles.select(*names, "strand", "calls", "width", F.when(lap, fall).otherwise(0).alias("begins"), F.when(lap, fall + F.col("n")).otherwise(F.col("width")).cast("int").alias("ends"), circle, F.explode(first).alias("first"))
    slow = best_of(written(scored(stretches(tiles, chunks)), "mapping-scored-all")).withColumn("seeded", F.lit(False))
    return proven.unionByName(slow.select(proven.columns))


def leftmost(indels: DataFrame, references: DataFrame, size: int = CHUNK) -> DataFrame:
    """indels (construct, type, start, allele) with to_start and to_allele: as far to the left as the reference (construct, seq) repeats the allele; on a circle the origin is the far end.

    The number of places an indel can move is one run: how far the reference before it, read backwards, equals the allele repeated backwards. Chunks of reference are looked at one after the other,
    for indels whose run fills a chunk; a deletion over a circle's origin that would still pass it stays where it is.
    """
    key = ["construct", "type", "start", "allele"]
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / size)))
    lengths = references.select("construct", F.length("seq").alias("n"))
    chunks = written(references.where(F.length("seq") > 0).select("construct", "seq", chunk.alias("chunk")).select("construct", "chunk", F.upper(F.col("seq").substr((F.col("chunk") * size + 1).cast("int"), F.lit(size))).alias("text")), "leftmost-chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, on = [], []
            for start, allele, moved, chunk_, text in zip(*(b.column(c).to_pylist() for c in ("start", "allele", "moved", "chunk", "text")), strict=True):
                left = np.frombuffer(text[: start - moved - chunk_ * size].encode("latin-1", "replace"), np.uint8)[::-1]
                back = np.frombuffer(allele.encode("latin-1", "replace"), np.uint8)[::-1]
                differ = np.flatnonzero(left != back[(np.arange(len(left)) + moved) % len(back)])
                step = int(differ[0]) if len(differ) else len(left)
                out.append(moved + step)
                on.append(step == len(left) and start - moved - step > 0)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), pa.array(out, pa.int64()), pa.array(on, pa.bool_())], names=[*key, "moved", "more"])

    kinds = ", ".join(f"{k} {indels.schema[k].dataType.simpleString()}" for k in key)
    open_, done = indels.select(*key).distinct().withColumn("moved", F.lit(0).cast("long")), None
    while True:
        at = F.floor((F.col("start") - F.col("moved") - 1) / size)
        looked = written(open_.where("start > moved").withColumn("chunk", at).join(chunks.hint("merge"), ["construct", "chunk"]).mapInArrow(run, f"{kinds}, moved long, more boolean"), "leftmost")
        still = open_.where("start <= moved").select(*key, "moved")
        ended = looked.where("NOT more").select(*key, "moved").unionByName(still)
        done = ended if done is None else done.unionByName(ended)
        open_ = looked.where("more").select(*key, "moved")
        if open_.isEmpty():
            break
    size_ = F.length("allele")
    fits = (F.col("type") == "insertion") | (F.col("start") - F.col("moved") + size_ <= F.col("n"))
    turn = F.when(fits, F.col("moved")).otherwise(0)
    r = done.join(lengths.hint("merge"), "construct").withColumn("moved", turn)
    cut = (size_ - F.pmod(F.col("moved"), size_)).cast("int")
    rotated: Column = F.concat(F.col("allele").substr(cut + 1, size_), F.col("allele").substr(F.lit(1), cut))
    return r.select(*key, (F.col("start") - F.col("moved")).cast("int").alias("to_start"), rotated.alias("to_allele"))
