"""Alignments as tables: column statistics, logos, consensus, gapped translation; pairwise alignment kernels.

An alignment is rows (alignment, row, aligned). Cells are counted in the task that reads a row and summed
per (alignment, column, symbol), so what is shuffled has the size of the columns, not of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.operators.batches import cut, emit, flat
from strandweave.session import written


def column_counts(rows: DataFrame) -> DataFrame:
    """alignment, column, symbol, n, first_row over non-gap cells; counted a batch of rows at a time, so what is summed is columns."""
    kind = rows.schema["alignment"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "aligned"):
            data, off = flat(b.column("aligned"))
            names = b.column("alignment").dictionary_encode()
            group, row = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64), b.column("row").to_numpy()
            n = np.diff(off)
            of = np.repeat(np.arange(len(n)), n)
            on = np.flatnonzero(data != 45)
            key = group[of[on]] << 40 | (on - off[:-1][of[on]]) << 8 | data[on]
            order = np.lexsort((row[of[on]], key))
            key, first = key[order], row[of[on]][order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            if len(at):
                k = key[at]
                which = pa.array(k >> 40)
                none = pc.equal(which, len(names.dictionary))
                yield pa.RecordBatch.from_arrays([
                    names.dictionary.take(pc.if_else(none, pa.scalar(None, pa.int64()), which)), pa.array((k >> 8 & 0xFFFFFFFF).astype(np.int32)),
                    pa.array([chr(c) for c in (k & 255).tolist()]), pa.array(np.diff(np.append(at, len(key)))), pa.array(first[at]),
                ], names=["alignment", "column", "symbol", "n", "first_row"])

    part = rows.select("alignment", F.col("row").cast("long").alias("row"), "aligned").mapInArrow(run, f"alignment {kind}, column int, symbol string, n long, first_row long")
    return part.groupBy("alignment", "column", "symbol").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))


def column_stats(rows: DataFrame, alphabet: int = 4) -> DataFrame:
    """alignment, column, occupancy, consensus, consensus_count, entropy, conservation, fully_conserved; ties to the smallest symbol."""
    total = rows.groupBy("alignment").agg(F.count("*").alias("rows"))
    best = F.min_by("symbol", F.struct(-F.col("n"), "symbol"))
    s = column_counts(rows).groupBy("alignment", "column").agg(F.sum("n").alias("k"), best.alias("consensus"), F.max("n").alias("consensus_count"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    h = F.log2("k") - F.col("nlogn") / F.col("k")
    s = s.join(total, "alignment").withColumn("entropy", F.greatest(h, F.lit(0.0)))
    keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("entropy") / F.log2(F.lit(float(alphabet)))))
    return s.select(
        "alignment", "column", (F.col("k") / F.col("rows")).alias("occupancy"), "consensus", "consensus_count", "entropy",
        (F.col("k") / F.col("rows") * keep).alias("conservation"), (F.col("consensus_count") == F.col("rows")).alias("fully_conserved"),
    )


def logo(rows: DataFrame) -> DataFrame:
    """alignment, column, stack: symbols by falling share, then by symbol, joined as symbol:count."""
    c = column_counts(rows).groupBy("alignment", "column").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "symbol"))).alias("s"))
    return c.select("alignment", "column", F.array_join(F.transform("s", lambda x: F.concat(x["symbol"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("stack"))


def logo_heights(rows: DataFrame, alphabet: int = 4, start: int = 0, end: int | None = None) -> DataFrame:
    """alignment, column, information, symbol, fraction, place: the stack of each column of the window, tallest first; information is occupancy times what the column's spread leaves of the alphabet's."""
    c = column_counts(rows).where((F.col("column") >= start) & (F.lit(True) if end is None else F.col("column") < end))
    s = column_stats(rows, alphabet).select("alignment", "column", F.col("conservation").alias("information"), F.col("occupancy"))
    k = c.groupBy("alignment", "column").agg(F.sum("n").alias("k"))
    place = F.row_number().over(Window.partitionBy("alignment", "column").orderBy(F.desc("n"), "symbol"))
    return c.join(k, ["alignment", "column"]).join(s, ["alignment", "column"]).select("alignment", "column", "information", "symbol", (F.col("n") / F.col("k")).alias("fraction"), place.alias("place"))


def identities(rows: DataFrame) -> DataFrame:
    """alignment, row, identity: percent (one decimal) of the columns with a majority residue in which a row fits it; a gap does not, an ambiguous symbol that may stand for it does."""
    major = consensus(rows).groupBy("alignment").agg(F.array_sort(F.collect_list(F.struct("column", "symbol"))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["symbol"]), "")
    j = rows.join(major.select("alignment", F.transform("m", lambda x: x["column"]).alias("at"), text.alias("major")), "alignment")
    mask = F.create_map(*[F.lit(x) for k, v in NUCLEOTIDE_SETS.items() for x in (k, sum(1 << "ACGT".index(b) for b in v))])
    own = F.array_join(F.transform("at", lambda i: F.rpad(F.substring("aligned", i + 1, F.lit(1)), 1, "-")), "")
    j = j.withColumn("own", own)
    fits = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("at"), F.lit(1))), lambda i: F.coalesce(F.try_element_at(mask, F.substring("own", i, F.lit(1))).bitwiseAND(F.try_element_at(mask, F.substring("major", i, F.lit(1)))) != 0, F.lit(False))))
    return j.select("alignment", "row", (F.floor(fits / F.size("at") * 1000 + 0.5) / 10).alias("identity"))


def consensus(rows: DataFrame) -> DataFrame:
    """alignment, column, symbol: the majority of non-gap symbols; ties to the one that the first row shows."""
    return column_counts(rows).groupBy("alignment", "column").agg(F.max_by("symbol", F.struct("n", -F.col("first_row"))).alias("symbol"))


# --- fixed values: symbols of alignments and what they may stand for; scores; work limits ---
SYMBOLS = {"dna": "ACGTRYSWKMBDHVN?", "rna": "ACGURYSWKMBDHVN?", "protein": "ACDEFGHIKLMNPQRSTVWYOUJBXZ*?"}
NUCLEOTIDE_SETS = facts.IUPAC | {"U": "T", "?": "ACGT"}
RESIDUE_SETS = {"B": "DN", "Z": "EQ", "J": "IL", "X": "ACDEFGHIKLMNPQRSTVWY", "?": "ACDEFGHIKLMNPQRSTVWY"}
MATCH, MISMATCH, GAP = 2, -1, -2
FULL_CELLS, LINEAR_CELLS, MOST_CELLS, SEGMENT_CELLS = 25_000_000, 100_000_000, 250_000_000, 4_000_000
SEED, SEED_PLACES = 12, 32
BATCH_CELLS, FULL_BATCH = 1 << 16, 1 << 23

#: Rows of one length that are ranked together when the median row of a large group is looked for.
CELL = 10_000


def symbol_masks(molecule: str) -> np.ndarray:
    """What each symbol may stand for, as bits, by its code."""
    m = np.zeros(256, np.int64)
    for c in SYMBOLS[molecule]:
        m[ord(c)] = sum(1 << (ord(x) - 32) for x in (RESIDUE_SETS.get(c, c) if molecule == "protein" else NUCLEOTIDE_SETS[c]))
    return m


MASKS = {m: symbol_masks(m) for m in SYMBOLS}


def molecule_of(a: str, b: str) -> str | None:
    """The first alphabet that both sequences fit: RNA if there is a U, else DNA, else protein; None if none."""
    for m in (["rna"] if "U" in a + b else ["dna"]) + ["protein"]:
        if set(a + b) <= set(SYMBOLS[m]):
            return m
    return None


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1", "replace"), np.uint8)


def score_rows(x: np.ndarray, y: np.ndarray, keep: bool) -> np.ndarray:
    """Score matrix of a global alignment (keep), or its last row, in linear space. x, y: masks."""
    steps = np.arange(len(y) + 1, dtype=np.int32) * GAP
    out = np.empty((len(x) + 1, len(y) + 1), np.int32) if keep else None
    row = steps.copy()
    if keep:
        out[0] = row
    for i in range(1, len(x) + 1):
        best = np.maximum(row[:-1] + np.where(y & x[i - 1], MATCH, MISMATCH), row[1:] + GAP)
        row = (np.maximum.accumulate(np.concatenate([[i * GAP], best]) - steps) + steps).astype(np.int32)  # gaps in a, all at once
        if keep:
            out[i] = row
    return out if keep else row


def full_matrices(pairs: list[tuple[str, str]], masks: np.ndarray) -> list[tuple[str, str]]:
    """Global alignments, pairs of like size filled together; the way back prefers the diagonal, then a gap in b, then in a."""
    out: list[tuple[str, str]] = [(a or "-" * len(b), b or "-" * len(a)) for a, b in pairs]
    todo = [i for i, (a, b) in enumerate(pairs) if a and b]
    n, m = (np.array([len(pairs[i][side]) for i in todo], np.int64) for side in (0, 1))
    for part in grouped(m, n, BATCH_CELLS // 4) if todo else ():
        for few in np.array_split(part, -(-len(part) * int(n[part].max() * m[part].max()) // FULL_BATCH)) if len(part) > 1 else [part]:
            if not len(few):
                continue
            own = [pairs[todo[i]] for i in few.tolist()]
            way = np.zeros((len(own[0][0]), len(own), int(m[few].max())), np.uint8)
            for i, new, old, pair in batch_rows([masks[codes(a)] for a, _ in own], [masks[codes(b)] for _, b in own]):
                way[i - 1, : len(new)] = np.where(new[:, 1:] == old[:, :-1] + pair, 1, np.where(new[:, 1:] == old[:, 1:] + GAP, 2, 0))
            for k, (at, (a, b)) in enumerate(zip(few.tolist(), own, strict=True)):
                out[todo[at]] = traced(a, b, way[: len(a), k, : len(b)].tobytes())
    return out


def traced(a: str, b: str, way: bytes) -> tuple[str, str]:
    """Both rows of the path back through the steps (1 diagonal, 2 a gap in b, 0 a gap in a), row by row."""
    i, j, m, out_a, out_b = len(a), len(b), len(b), [], []
    while i and j:
        step = way[(i - 1) * m + j - 1]
        if step == 1:
            i, j = i - 1, j - 1
            out_a.append(a[i])
            out_b.append(b[j])
        elif step == 2:
            i -= 1
            out_a.append(a[i])
            out_b.append("-")
        else:
            j -= 1
            out_a.append("-")
            out_b.append(b[j])
    return a[:i] + "-" * j + "".join(out_a[::-1]), "-" * i + b[:j] + "".join(out_b[::-1])


def full_matrix(a: str, b: str, masks: np.ndarray) -> tuple[str, str]:
    return full_matrices([(a, b)], masks)[0]


def grouped(widths: np.ndarray, heights: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Problems of like size together, at most `most` symbols on either side (one at least); within a group the highest come first."""
    order, at = np.lexsort((heights, widths)), 0
    while at < len(order):
        end, high = at + 1, int(heights[order[at]])
        while end < len(order) and (end + 1 - at) * (max(int(widths[order[end]]), high := max(high, int(heights[order[end]]))) + 1) <= most:
            end += 1
        part = order[at:end]
        yield part[np.argsort(-heights[part], kind="stable")]
        at = end


def batch_rows(xs: list[np.ndarray], ys: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Score rows of several global alignments at once, highest first: (i, their rows i, rows i - 1, and the scores of the pairs of symbols). A row ends where its y does; what follows is padding."""
    width = max(map(len, ys))
    steps = np.arange(width + 1, dtype=np.int32) * GAP
    x, y = np.zeros((len(xs), len(xs[0])), np.int64), np.zeros((len(xs), width), np.int64)
    for k, (p, q) in enumerate(zip(xs, ys, strict=True)):
        x[k, : len(p)], y[k, : len(q)] = p, q
    heights = np.array([len(p) for p in xs])
    row = np.repeat(steps[None], len(xs), axis=0)
    for i in range(1, len(xs[0]) + 1):
        on = int(np.searchsorted(-heights, -i, side="right"))
        row = row[:on]
        pair = np.where(y[:on] & x[:on, i - 1, None], np.int32(MATCH), np.int32(MISMATCH))
        new = np.empty_like(row)
        new[:, 0] = i * GAP
        np.maximum(row[:, :-1] + pair, row[:, 1:] + np.int32(GAP), out=new[:, 1:])
        new -= steps
        np.maximum.accumulate(new, axis=1, out=new)  # gaps in a, all at once
        new += steps
        yield i, new, row, pair
        row = new


def last_rows(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """The last score row of each alignment."""
    out = np.zeros((len(xs), max(map(len, ys)) + 1), np.int32)
    for _, new, _, _ in batch_rows(xs, ys):
        out[: len(new)] = new
    return out


def linear_spaces(pairs: list[tuple[str, str]], masks: np.ndarray) -> list[tuple[str, str]]:
    """The same score by halving a and splitting b where both halves' rows sum highest (leftmost); the halves of all pairs are looked at together, a depth at a time."""
    coded = [(masks[codes(a)], masks[codes(b)]) for a, b in pairs]
    ends: list[list[tuple[int, int, str, str]]] = [[] for _ in pairs]
    todo = [(k, 0, len(a), 0, len(b)) for k, (a, b) in enumerate(pairs)]
    while todo:
        halved = []
        for k, p, p_, q, q_ in todo:
            (a, b), (x, y) = pairs[k], coded[k]
            if p == p_ or q == q_:
                ends[k].append((p, q, a[p:p_] or "-" * (q_ - q), b[q:q_] or "-" * (p_ - p)))
            elif p_ - p == 1 or q_ - q == 1:  # one symbol stands against the last that it fits, or else the last
                fit = np.flatnonzero(x[p:p_] & y[q:q_])
                n = max(p_ - p, q_ - q)
                at = int(fit[-1]) if len(fit) else n - 1
                one = lambda s: s if len(s) == n else "-" * at + s + "-" * (n - 1 - at)  # noqa: E731, B023
                ends[k].append((p, q, one(a[p:p_]), one(b[q:q_])))
            else:
                halved.append((k, p, (p + p_) // 2, p_, q, q_))
        todo = []
        if halved:
            place = np.array(halved)
            for part in grouped(place[:, 5] - place[:, 4], place[:, 3] - place[:, 1], BATCH_CELLS):
                own = [halved[i] for i in part.tolist()]
                n = np.array([h[5] - h[4] for h in own])
                down = last_rows([coded[k][0][p:h] for k, p, h, _, _, _ in own], [coded[k][1][q:q_] for k, _, _, _, q, q_ in own])
                up = last_rows([coded[k][0][h:p_][::-1] for k, _, h, p_, _, _ in own], [coded[k][1][q:q_][::-1] for k, _, _, _, q, q_ in own])
                back = n[:, None] - np.arange(down.shape[1])[None, :]
                total = np.where(back >= 0, down + np.take_along_axis(up, np.maximum(back, 0), 1), np.iinfo(np.int32).min)
                for (k, p, h, p_, q, q_), at in zip(own, total.argmax(axis=1).tolist(), strict=True):
                    todo += [(k, p, h, q, q + at), (k, h, p_, q + at, q_)]
    for e in ends:
        e.sort(key=lambda t: t[:2])
    return [("".join(t[2] for t in e), "".join(t[3] for t in e)) for e in ends]


def linear_space(a: str, b: str, masks: np.ndarray) -> tuple[str, str]:
    return linear_spaces([(a, b)], masks)[0]


def words(x: np.ndarray, k: int, size: int) -> np.ndarray:
    """A number for each k symbols in a row; x: symbols as numbers below size."""
    out = np.zeros(max(len(x) - k + 1, 0), np.uint64)
    for i in range(k):
        out = out * np.uint64(size) + x[i : i + len(out)].astype(np.uint64)
    return out


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Symbols that x and y begin with alike, looked at in growing blocks."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def seed_anchors(a: str, b: str) -> list[tuple[int, int, int]]:
    """Exact runs (start in a, start in b, length), in order in both.

    Words of both are joined by sorting b's; a word has its SEED_PLACES first places in b. Words of a that are free take, from the left, the first of
    their places that is free, with the whole run of equal symbols on that diagonal, if all of the run is free.
    """
    k = min(SEED, len(a), len(b))
    if k < 4:
        return []
    symbols, both = np.unique(np.concatenate([codes(a), codes(b)]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    wa, wb = (words(v, k, len(symbols)) for v in (x, y))
    places = np.argsort(wb, kind="stable")
    first, last = (np.searchsorted(wb[places], wa, side) for side in ("left", "right"))
    last = np.minimum(last, first + SEED_PLACES)
    known = np.flatnonzero(first < last)
    out, free_a, free_b, n = [], 0, 0, 0
    while (n := max(n, int(np.searchsorted(known, free_a)))) < len(known):
        i = int(known[n])
        own = places[first[i] : last[i]]
        n += 1
        at = int(np.searchsorted(own, free_b))
        if at == len(own):
            continue
        j = int(own[at])
        back = common(x[i - 1 :: -1] if i else x[:0], y[j - 1 :: -1] if j else y[:0])
        if i - back >= free_a and j - back >= free_b:
            size = back + common(x[i:], y[j:])
            out.append((i - back, j - back, size))
            free_a, free_b = i - back + size, j - back + size
    return out


def seeded(a: str, b: str, masks: np.ndarray, segment: int = SEGMENT_CELLS) -> tuple[str, str, int]:
    """Anchors, with what lies between them aligned one by one; segments of too many cells are written side by side and counted."""
    anchors = np.array([*seed_anchors(a, b), (len(a), len(b), 0)])
    ends = np.concatenate([[[0, 0]], anchors[:-1, :2] + anchors[:-1, 2:]])
    rows, left_out = [], 0
    for (p, q), (i, j, n) in zip(ends.tolist(), anchors.tolist(), strict=True):
        gap = (a[p:i], b[q:j])
        if all(gap) and len(gap[0]) * len(gap[1]) > segment:
            left_out += 1
            gap = (gap[0] + "-" * len(gap[1]), "-" * len(gap[0]) + gap[1])
        else:
            gap = full_matrix(*gap, masks)
        rows.append((gap[0] + a[i : i + n], gap[1] + b[j : j + n]))
    return "".join(r[0] for r in rows), "".join(r[1] for r in rows), left_out


class Limits(NamedTuple):
    """Cells up to which a pair is aligned in full, in linear space, or at all; and up to which a segment between anchors is."""

    full: int = FULL_CELLS
    linear: int = LINEAR_CELLS
    most: int = MOST_CELLS
    segment: int = SEGMENT_CELLS


def aligned_pairs(pairs: list[tuple[str, str]], molecule: str | None = None, limits: Limits = Limits()) -> list[tuple[str | None, str | None, str, str, int]]:
    """Both rows, method, molecule and number of unresolved segments of global comparisons; rows are null beyond the work limit or for symbols of no alphabet."""
    out: list = []
    together: dict[tuple[str, str], list[int]] = {}
    upper = [(a.upper(), b.upper()) for a, b in pairs]
    for i, (a, b) in enumerate(upper):
        kind = molecule or molecule_of(a, b)
        cells = len(a) * len(b)
        if kind is None or not set(a + b) <= set(SYMBOLS[kind]):
            out.append((None, None, "invalid", "", 0))
        elif cells > limits.most:
            out.append((None, None, "work-limit", kind, 0))
        elif cells > limits.linear:
            s, t, unresolved = seeded(a, b, MASKS[kind], limits.segment)
            out.append((s, t, "seed-and-extend", kind, unresolved))
        else:
            out.append(None)
            together.setdefault(("needleman-wunsch" if cells <= limits.full else "linear-space", kind), []).append(i)
    for (method, kind), own in together.items():
        f = full_matrices if method == "needleman-wunsch" else linear_spaces
        for i, (s, t) in zip(own, f([upper[i] for i in own], MASKS[kind]), strict=True):
            out[i] = (s, t, method, kind, 0)
    return out


def aligned_pair(a: str, b: str, molecule: str | None = None, limits: Limits = Limits()) -> tuple[str | None, str | None, str, str, int]:
    return aligned_pairs([(a, b)], molecule, limits)[0]


def classified(a: np.ndarray, b: np.ndarray, molecule: str) -> np.ndarray:
    """Of two rows' columns: 0 match, 1 ambiguous, 2 substitution, 3 a gap in a, 4 a gap in b."""
    m = MASKS[molecule]
    same = m[a] == m[b] if molecule != "protein" else a == b
    wild = np.isin(a, codes("X?" if molecule == "protein" else "N?"))
    out = np.where(m[a] & m[b] == 0, 2, np.where(same & ~wild, 0, 1))
    return np.where(a == 45, 3, np.where(b == 45, 4, out))


def identity_of(hits: int, columns: int) -> float:
    return float(np.floor(1000 * hits / columns + 0.5) / 10) if columns else 0.0


def align_pairs(pairs: DataFrame, molecule: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Adds aligned_a, aligned_b, score, identity (percent of columns, ambiguous ones count), mismatches, insertions, deletions, ambiguous, method, unresolved to rows with a and b.

    Null or odd sequences are `invalid`; beyond the limit of cells a pair is only `work-limit`. unresolved counts segments between anchors that were too large to
    align: a warning. Pairs of great size are dealt by the caller's rows, one at a time.
    """
    names = ["aligned_a", "aligned_b", "score", "identity", "mismatches", "insertions", "deletions", "ambiguous", "method", "unresolved"]

    def one(s: str | None, t: str | None, method: str, kind: str, unresolved: int) -> tuple:
        if s is None:
            return (*(None,) * 8, method, 0)
        n = np.bincount(classified(codes(s), codes(t), kind), minlength=5).tolist()
        return s, t, MATCH * (n[0] + n[1]) + MISMATCH * n[2] + GAP * (n[3] + n[4]), identity_of(n[0] + n[1], len(s)), n[2], n[3], n[4], n[1], method, unresolved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.float64(), *[pa.int32()] * 4, pa.string(), pa.int32()]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                both = list(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True))
                got = iter(aligned_pairs([(x, y) for x, y in both if x is not None and y is not None], molecule, limits))
                rows = [one(None, None, "invalid", "", 0) if x is None or y is None else one(*next(got)) for x, y in both]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[*part.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{fields}, aligned_a string, aligned_b string, score int, identity double, mismatches int, insertions int, deletions int, ambiguous int, method string, unresolved int")


def fits(seq: Column, molecule: str) -> Column:
    return F.upper(seq).rlike("^[" + SYMBOLS[molecule].replace("*", r"\*").replace("?", r"\?") + "]*$")


def star_status(rows: DataFrame) -> DataFrame:
    """rows (group, row, seq) with status: `ok`, or why a row takes no part: `missing` (null), `empty`, `symbols` (of no alphabet), `mixed` (of another alphabet than the group's).

    A group is RNA if a good row has a U and every good row fits RNA, DNA if all fit, else protein.
    """
    kinds = {m: F.coalesce(fits(F.col("seq"), m), F.lit(False)) for m in ("dna", "rna", "protein")}
    odd = F.when(F.col("seq").isNull(), "missing").when(F.col("seq") == "", "empty").when(~kinds["dna"] & ~kinds["rna"] & ~kinds["protein"], "symbols")
    r = rows.withColumn("odd", odd)
    good = r.where("odd IS NULL").groupBy("group").agg(*[F.bool_and(k).alias(m) for m, k in kinds.items()])
    kind = F.when(F.col("dna"), "dna").when(F.col("rna"), "rna").otherwise("protein")
    r = r.join(good.select("group", kind.alias("molecule")), "group", "left")
    other = F.when((F.col("molecule") == "protein") & ~kinds["protein"], "mixed")
    return r.select("group", "row", "seq", "molecule", F.coalesce("odd", other, F.lit("ok")).alias("status"))


def dealt(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs over as many tasks as a shuffle has: their texts are small beside the work on them, so partitions are not joined by size."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def star_centres(rows: DataFrame, most_pairs: int = 10, limits: Limits = Limits()) -> DataFrame:
    """group, row, seq of each group's centre: the row most like all others in groups of up to most_pairs, of the median length in larger ones; ties to the smallest row.

    rows: good ones (star_status). A pair beyond the work limit counts as not alike. Only small groups are compared pair by pair; of large ones rows are counted
    by length and cell, and one cell is ranked, so that no task holds a group.
    """
    n = rows.groupBy("group").agg(F.count("*").alias("n"))
    small = rows.join(n.where(F.col("n").between(2, most_pairs)), "group")
    other = small.select("group", F.col("row").alias("row_b"), F.col("seq").alias("b"))
    pairs = small.select("group", F.col("row").alias("row_a"), F.col("seq").alias("a")).join(other, "group").where("row_a < row_b")
    likeness = align_pairs(dealt(pairs, "group", "row_a", "row_b"), None, limits).select("group", F.explode(F.array("row_a", "row_b")).alias("row"), F.coalesce("identity", F.lit(0.0)).alias("identity")).groupBy("group", "row").agg(F.round(F.sum("identity"), 6).alias("s"))
    best = likeness.groupBy("group").agg(F.min(F.struct((-F.col("s")).alias("m"), "row")).alias("x")).select("group", F.col("x.row").alias("row"))
    cells = rows.join(n.where(F.col("n") > most_pairs), "group").select("group", "row", "n", F.length("seq").alias("k"), F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / CELL)).alias("cell"))
    sizes = cells.groupBy("group", "n", "k", "cell").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("group").orderBy("k", "cell"))
    middle = sizes.withColumn("upto", upto).withColumn("place", F.floor(F.col("n") / 2) - (F.col("upto") - F.col("c"))).where("place >= 0 AND place < c").select("group", "k", "cell", "place")
    rank = F.row_number().over(Window.partitionBy("group").orderBy("row")) - 1
    median = cells.join(middle, ["group", "k", "cell"]).withColumn("rank", rank).where("rank = place").select("group", "row")
    return rows.join(best.unionByName(median), ["group", "row"]).select("group", "row", "seq")


def gap_runs(pairs: DataFrame) -> DataFrame:
    """group, at, k: each run of k gaps in the rows aligned_a, by the number of residues before it; the longest of a batch for each group and place."""
    kind = pairs.schema["group"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "aligned_a"):
            data, off = flat(b.column("aligned_a"))
            of = np.repeat(np.arange(b.num_rows), np.diff(off))
            residues = np.concatenate([[0], np.cumsum(data != 45)])
            gap = np.flatnonzero(data == 45)
            if not len(gap):
                continue
            names = b.column("group").dictionary_encode()
            key, k = np.unique(of[gap] << 32 | (residues[gap] - residues[off[of[gap]]]), return_counts=True)
            group = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)[key >> 32]
            order = np.lexsort((-k, key & 0xFFFFFFFF, group))
            key, k, group = key[order] & 0xFFFFFFFF, k[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
            which = pa.array(group[first], mask=group[first] == len(names.dictionary))
            yield pa.RecordBatch.from_arrays([names.dictionary.take(which), pa.array(key[first].astype(np.int32)), pa.array(k[first].astype(np.int32))], names=["group", "at", "k"])

    return pairs.select("group", "aligned_a").mapInArrow(run, f"group {kind}, at int, k int")


def widened(pairs: DataFrame) -> DataFrame:
    """group, row, centre, aligned: each aligned_b with the gaps that its group's slots (at: residues of aligned_a before it, k: columns) have beyond its own, at the end of its own run."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, "aligned_a"):
            (data, off), (other, _) = flat(b.column("aligned_a")), flat(b.column("aligned_b"))
            slots = b.column("slots")
            many = np.asarray(pc.fill_null(pc.list_value_length(slots), 0), np.int64)
            of = np.repeat(np.arange(b.num_rows), many)
            entry = slots.flatten()
            at, k = (np.asarray(pc.struct_field(entry, [i]), np.int64) for i in (0, 1))
            residue = np.append(np.flatnonzero(data != 45), len(data))  # where each residue is; a slot ends at the one behind it, or with its row
            before = np.concatenate([[0], np.cumsum(data != 45)])[off]
            here = before[of] + at
            place = np.where(here < before[of + 1], residue[np.minimum(here, len(residue) - 1)], off[of + 1])
            begin = np.where(at > 0, residue[np.maximum(here - 1, 0)] + 1, off[of])
            pad = k - (place - begin)
            added = np.zeros(len(data) + 1, np.int64)
            np.add.at(added, place, pad)
            out = np.full(len(data) + int(pad.sum()), 45, np.uint8)
            out[np.arange(len(data)) + np.cumsum(added)[:-1]] = other
            ends = off + np.concatenate([[0], np.cumsum(np.bincount(of, pad, b.num_rows).astype(np.int64))])
            text = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("row"), b.column("centre"), text.cast(pa.string())], names=["group", "row", "centre", "aligned"])

    return pairs.select("group", "row", "centre", "aligned_a", "aligned_b", "slots").mapInArrow(run, f"group {kinds['group']}, row {kinds['row']}, centre {kinds['centre']}, aligned string")


def star_alignments(rows: DataFrame, most_pairs: int = 10, limits: Limits = Limits()) -> DataFrame:
    """group, row, aligned, centre, status of every row (group, row, seq) of groups: each good row aligned to the centre, gaps merged by the widest at each place of the centre.

    Rows that take no part are there with their status and without a row: those of star_status, `alone` (no other good row) and `work-limit`. The centre is chosen among good rows only.
    Members meet their centre in a join, slots are a maximum by (group, place): a group of any size needs no task of its own.
    """
    told = written(star_status(rows), "star-rows")
    good = told.where("status = 'ok'").select("group", "row", "seq")
    centres = written(star_centres(good, most_pairs, limits).select("group", F.col("row").alias("centre"), F.col("seq").alias("a")), "star-centres")
    joined = written(align_pairs(dealt(good.withColumnRenamed("seq", "b").join(centres, "group"), "group", "row"), None, limits), "star-pairs")
    pairs = joined.where("aligned_a IS NOT NULL").select("group", "row", "aligned_a", "aligned_b", "centre")
    widest = gap_runs(pairs).groupBy("group", "at").agg(F.max("k").alias("k"))
    merged = widest.groupBy("group").agg(F.collect_list(F.struct("at", "k")).alias("slots"))
    done = widened(pairs.join(merged, "group", "left")).select("group", "row", "aligned", (F.col("row") == F.col("centre")).alias("centre"))
    done = told.select("group", "row", "status").join(done, ["group", "row"], "left").join(centres.select("group", F.lit(True).alias("two")), "group", "left")
    why = F.when((F.col("status") == "ok") & F.col("two").isNull(), "alone").when((F.col("status") == "ok") & F.col("aligned").isNull(), "work-limit").otherwise(F.col("status"))
    return done.select("group", "row", "aligned", F.coalesce("centre", F.lit(False)).alias("centre"), why.alias("status"))


def alignment_requests(records: DataFrame, most_rows: int = 10, longest: int = 50_000, most_work: int = MOST_CELLS) -> DataFrame:
    """group, issue: why a group of records (group, row, name, molecule, seq) is not aligned; a group without a row here may be.

    `too_few`, `too_many`, `unsupported_molecule`, `mixed_molecule`, `missing_name`, `duplicate_name` (trimmed, in any case), `too_long`, `work_budget` (cells of all pairs and of the
    pass against the longest). Names are counted a group at a time in aggregates; nothing is compared pair by pair.
    """
    r = records.select("group", "molecule", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"), F.length(F.regexp_replace(F.coalesce("seq", F.lit("")), r"\s+", "")).cast("double").alias("k"))
    twice = r.where("name <> ''").groupBy("group", "name").agg(F.count("*").alias("c")).groupBy("group").agg(F.max("c").alias("same"))
    g = r.groupBy("group").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("molecule").isin("dna", "rna", "protein"), F.lit(False))).alias("odd"), F.count_distinct(F.coalesce("molecule", F.lit(""))).alias("kinds"),
        F.count_if(F.col("name") == "").alias("bare"), F.max("k").alias("longest"), F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"),
    ).join(twice, "group", "left")
    work = (F.col("s") * F.col("s") - F.col("q")) / 2 + F.greatest(F.lit(0.0), F.col("longest") * F.col("s") - F.col("longest") * F.col("longest"))
    says = [(F.col("n") < 2, "too_few"), (F.col("n") > most_rows, "too_many"), (F.col("odd") > 0, "unsupported_molecule"), (F.col("kinds") > 1, "mixed_molecule"), (F.col("bare") > 0, "missing_name"), (F.coalesce(F.col("same"), F.lit(0)) > 1, "duplicate_name"), (F.col("longest") > longest, "too_long"), (work > most_work, "work_budget")]
    return g.select("group", F.explode(F.array_compact(F.array(*[F.when(c, name) for c, name in says]))).alias("issue"))


def summary(rows: DataFrame) -> DataFrame:
    """alignment, columns, rows, identity, gaps, conserved of aligned rows (alignment, row, aligned): mean identity with the majority (one decimal), gap cells, columns in which all rows agree."""
    gaps = F.length("aligned") - F.length(F.replace("aligned", F.lit("-"), F.lit("")))
    n = rows.groupBy("alignment").agg(F.count("*").alias("rows"), F.max(F.length("aligned")).alias("columns"), F.sum(gaps).alias("gaps"))
    # Rows that fit a column's majority, whichever symbol it is; columns are counted by them, and only the most can be all rows.
    fit = column_counts(rows).groupBy("alignment", "column").agg(F.max("n").alias("fit")).groupBy("alignment", "fit").agg(F.count("*").alias("c"))
    per = fit.groupBy("alignment").agg(F.sum(F.col("fit") * F.col("c")).alias("same"), F.sum("c").alias("filled"), F.max(F.struct("fit", "c")).alias("top"))
    identity = F.floor(F.col("same") / (F.col("filled") * F.col("rows")) * 1000 + 0.5) / 10
    return n.join(per, "alignment").select("alignment", "columns", "rows", identity.alias("identity"), "gaps", F.when(F.col("top.fit") == F.col("rows"), F.col("top.c")).otherwise(F.lit(0)).alias("conserved"))


def pattern_hits(rows: DataFrame, query: str, molecule: str = "dna") -> DataFrame:
    """row, start_column, end_column of every place where a query fits a row's ungapped residues, ambiguity on both sides; none for an empty query or one with gaps."""
    q = query.strip().upper()
    if molecule != "protein":
        q = q.replace("U", "T")
    m = MASKS["dna" if molecule == "rna" else molecule]
    needle = m[codes(q)] if q and "-" not in q and "." not in q else np.zeros(0, np.int64)

    def work(data: np.ndarray, off: np.ndarray) -> tuple | None:
        if not len(needle):
            return None
        up = data.copy()
        up[(up >= 97) & (up <= 122)] -= 32
        if molecule != "protein":
            up[up == 85] = 84
        of = np.repeat(np.arange(len(off) - 1), np.diff(off))
        on = np.flatnonzero((up != 45) & (up != 46))
        x, text = m[up[on]], of[on]
        k = len(needle)
        if len(on) < k:
            return None
        ok = text[: len(on) - k + 1] == text[k - 1 :]
        for j in range(k):
            ok &= (x[j : j + len(ok)] & needle[j]) != 0
        at = np.flatnonzero(ok)
        return text[at], on[at] - off[:-1][text[at]], on[at + k - 1] - off[:-1][text[at]]

    return emit(rows, "row", "aligned", work, "start_column int, end_column int")
