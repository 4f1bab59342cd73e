"""Structures of oligos and primer pairs: hairpins, dimers, the best pairs around a target, many oligos at a time.

Oligos of a batch are rows of one matrix of base codes; stems and paired runs are found for all rows, places and lengths by
shifting match matrices, energies come from prefix sums of stacks. Primers are designed for many templates together, from the two stretches
of each that can hold one. Pairs are looked at by a lower bound of their score, for all templates of a batch a slice of it at a time, and
only as far as that bound can still give one of the best, so structures are worked out for few of the many candidates; no side's
candidates are limited, and what comes out is what a look at all pairs gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.operators.batches import DIGIT, NONE, emit

STACK_H, STACK_S = (np.array([[facts.STACKS["ACGT"[a] + "ACGT"[b]][k] if a < 4 and b < 4 else 0.0 for b in range(5)] for a in range(5)]) for k in (0, 1))
END_H, END_S = (np.array([facts.END_AT[k], facts.END_GC[k], facts.END_GC[k], facts.END_AT[k], 0.0]) for k in (0, 1))
KELVIN = 310.15
# --- fixed values: weights of a pair's score: difference, distance from the target, balance of bases, dimer energy, paired 3' ends ---
PER_DIFFERENCE, PER_BASE, PER_PERCENT, PER_ENERGY, PER_END = 2.0, 0.05, 0.01, 0.1, 0.75
CHUNK = 256
TEMPLATES, CELLS, PAIRED = 256, 1 << 18, 1024  # templates together, pairs of candidates whose bounds are looked at together, pairs of oligos together
STEP = 0.25  # the first slice of bounds


def coded(oligos: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Base codes (padded by a column at least with one that pairs with nothing) and lengths."""
    n = np.array([len(o) for o in oligos], np.int64)
    data = DIGIT[np.frombuffer("".join(oligos).encode("latin-1", "replace"), np.uint8)]
    out = np.full((len(oligos), int(n.max(initial=1)) + 1), NONE, np.uint8)
    out[np.arange(out.shape[1]) < n[:, None]] = data
    return out, n


def turned(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Reverse complements, again from the first column on."""
    at = n[:, None] - 1 - np.arange(codes.shape[1])[None, :]
    back = np.take_along_axis(codes, np.maximum(at, 0), 1)
    return np.where((at >= 0) & (back < NONE), 3 - back, NONE).astype(np.uint8)


def energies(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the stacks' free energies at 37 C, and the energy of an end at each place (kcal/mol)."""
    g = (STACK_H - KELVIN * STACK_S / 1000)[codes[:, :-1], codes[:, 1:]]
    return np.concatenate([np.zeros((len(codes), 1)), np.cumsum(g, axis=1)], axis=1), (END_H - KELVIN * END_S / 1000)[codes]


def shifted(m: np.ndarray, i: int, j: int) -> np.ndarray:
    """m[:, a + i, b + j] at every (a, b); False outside."""
    out = np.zeros_like(m)
    h, w = m.shape[1:]
    if i < h and abs(j) < w:
        out[:, : h - i, max(0, -j) : w - max(0, j)] = m[:, i:, max(0, j) : w + min(0, j)]
    return out


def hairpin_energies(oligos: list[str], stem: int = 3, loop: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest energy, first base and length of a stem whose arms face each other over a loop; (0, -1, 0) if none is below zero. Ties go to the first base, then to the shorter stem."""
    codes, _ = coded(oligos)
    w = codes.shape[1]
    pair = (codes[:, :, None] + codes[:, None, :] == 3) & (codes[:, :, None] < NONE) & (codes[:, None, :] < NONE)
    prefix, end = energies(codes)
    best, where, size = np.zeros(len(codes)), np.full(len(codes), -1), np.zeros(len(codes), np.int64)
    run = pair.copy()
    gap = np.arange(w)[None, :] - np.arange(w)[:, None]
    for k in range(1, w // 2 + 1):
        if k > 1:
            run &= shifted(pair, k - 1, 1 - k)
        if k < stem:
            continue
        there = (run & (gap >= 2 * k + loop - 1)).any(axis=2)[:, : w - k + 1]
        if not there.any():
            break
        e = np.round(prefix[:, k - 1 :] - prefix[:, : w - k + 1] + end[:, : w - k + 1] + end[:, k - 1 :], 2)
        e = np.where(there, e, np.inf)
        at = e.argmin(axis=1)
        low = e[np.arange(len(e)), at]
        better = (low < best) | ((low == best) & (where >= 0) & (at < where))
        best, where, size = np.where(better, low, best), np.where(better, at, where), np.where(better, k, size)
    return best, where, size


def runs(x: np.ndarray, back: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in x, place in back and length of every whole run of `least` equal bases and more, by row. The last column of both holds no base, so a diagonal is a stride of the flat matrix."""
    same = x[:, :, None] == np.where(back < NONE, back, NONE + 1)[:, None, :]
    (h, w), s = same.shape[1:], same.ravel()
    d, last = w + 1, len(s) - (least - 1) * (w + 1)
    on = s[:last].copy()
    for j in range(1, least):
        on &= s[j * d : last + j * d]
    on[d:] &= ~s[: last - d]  # the first of its run
    at = np.flatnonzero(on)
    k, behind = np.full(len(at), least), at + least * d
    more = np.flatnonzero(s[behind])
    while len(more):
        k[more] += 1
        behind[more] += d
        more = more[s[behind[more]]]
    r, p = np.divmod(at, h * w)
    return r, *np.divmod(p, w), k


def cents(prefix: np.ndarray, end: np.ndarray, r: np.ndarray, p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Energies of runs in hundredths."""
    return np.rint((prefix[r, p + k - 1] - prefix[r, p] + end[r, p] + end[r, p + k - 1]) * 100).astype(np.int64)


def paired(x: np.ndarray, nx: np.ndarray, back: np.ndarray, least: int = 3, tail: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dimer_energies of codes; back: the partners turned."""
    best, ends, size = np.zeros(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(0, len(x), PAIRED):
        own = x[i : i + PAIRED]
        r, p, q, k = runs(own, back[i : i + PAIRED], least)
        if not len(r):
            continue
        held = np.minimum(k, tail) * ((p + k == nx[i + r]).astype(np.int64) + (q == 0))
        key = (cents(*energies(own), r, p, k) << 40) + ((0xFFFF - held) << 24) + (0xFFFFFF - k)
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        key, r = np.minimum.reduceat(key, first), i + r[first]
        r, key = r[key < 0], key[key < 0]
        best[r], ends[r], size[r] = (key >> 40) / 100, 0xFFFF - (key >> 24 & 0xFFFF), 0xFFFFFF - (key & 0xFFFFFF)
    return best, ends, size


def dimer_energies(a: list[str], b: list[str], least: int = 3, tail: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: the lowest energy of a whole paired run (0: none), how many of the last `tail` bases at 3' ends it holds, its length. Ties: more such bases, then the longer run."""
    return paired(*coded(a), turned(*coded(b)), least, tail)


def steady(x: np.ndarray, nx: np.ndarray, back: np.ndarray, least_hairpin: float, least_dimer: float, stem: int = 3, loop: int = 3) -> np.ndarray:
    """Whether neither the best hairpin nor the best dimer of each oligo with itself is too strong; back: the oligos turned.

    A stem is the part of a paired run that leaves room for the loop. All of that part is the best stem: every stack gives more than a worse end takes.
    """
    out = np.full(len(x), least_hairpin <= 0 and least_dimer <= 0)
    for i in range(0, len(x), PAIRED):
        own = x[i : i + PAIRED]
        r, p, q, k = runs(own, back[i : i + PAIRED], stem)
        energy = energies(own)
        bad = cents(*energy, r, p, k) / 100 < least_dimer
        arm = np.minimum(k, (nx[i + r] - p - q - loop) // 2)
        on = np.flatnonzero(arm >= stem)
        bad[on] |= cents(*energy, r[on], p[on], arm[on]) / 100 < least_hairpin
        out[i + r[bad]] = False
    return out


def structures(oligos: DataFrame) -> DataFrame:
    """oligo, hairpin, stem_start, stem, dimer, run of every oligo (column seq): its best hairpin, and its best dimer with itself."""

    def work(data: np.ndarray, off: np.ndarray) -> tuple:
        text = data.tobytes().decode("latin-1")
        own = [text[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        order = np.argsort(np.diff(off), kind="stable")
        h, s, k, d, r = (np.zeros(len(own), t) for t in (float, np.int64, np.int64, float, np.int64))
        for i in range(0, len(own), CHUNK):
            at = order[i : i + CHUNK]
            part = [own[x] for x in at.tolist()]
            h[at], s[at], k[at] = hairpin_energies(part)
            d[at], _, r[at] = dimer_energies(part, part)
        return np.arange(len(own)), pa.array(own), h, s.astype(np.int32), k.astype(np.int32), d, r.astype(np.int32)

    return emit(oligos.withColumnRenamed("seq", "_seq").selectExpr("_seq AS seq", "_seq AS key"), "key", "seq", work, "oligo string, hairpin double, stem_start int, stem int, dimer double, run int").drop("key")


class Wanted(NamedTuple):
    """What pairs are asked for."""

    lengths: tuple[int, int] = (18, 28)
    flank: int = 50
    target: float = 60.0
    tolerance: float = 3.0
    gc_range: tuple[float, float] = (0.3, 0.7)
    least_hairpin: float = -3.0
    least_dimer: float = -5.0
    most: int = 10
    most_difference: float = 5.0
    na_mm: float = 50.0
    primer_nm: float = 250.0


def melting(codes: np.ndarray, k: int, at: int, count: int, w: Wanted) -> tuple[np.ndarray, np.ndarray]:
    """Temperature (one decimal, half up) and share of G and C of the oligos of k bases from the columns at, at + 1, ... on, of every row; of plain ones only."""
    cut = lambda m, by: m[:, at + by : at + by + count]
    a, z = cut(codes, 0), cut(codes, k - 1)
    zero = np.zeros((len(codes), 1))
    h, s = (np.concatenate([zero, np.cumsum(t[codes[:, :-1], codes[:, 1:]], axis=1)], axis=1) for t in (STACK_H, STACK_S))
    strong = np.concatenate([zero, np.cumsum((codes == 1) | (codes == 2), axis=1)], axis=1)
    share = (cut(strong, k) - cut(strong, 0)) / k
    own = np.full(a.shape, k % 2 == 0)
    for i in range(k // 2):
        if not own.any():
            break
        own &= cut(codes, i) + cut(codes, k - 1 - i) == 3
    dh = (cut(h, k - 1) - cut(h, 0) + END_H[a] + END_H[z]) * 1000
    ds = cut(s, k - 1) - cut(s, 0) + END_S[a] + END_S[z] + np.where(own, facts.SYMMETRY_DS, 0.0)
    ln = np.log(w.na_mm / 1000)
    with np.errstate(all="ignore"):  # stretches without a base
        kelvin = dh / (ds + np.where(own, 1.987 * np.log(w.primer_nm * 1e-9), 1.987 * np.log(w.primer_nm * 1e-9 / 4)))
        tm = 1 / (1 / kelvin + (4.29 * share - 3.95) * 1e-5 * ln + 9.40e-6 * ln * ln) - 273.15
    return np.floor(np.round(tm * 10 + 0.5, 9)) / 10, share


class Side:
    """Candidates of one side of many targets that pass the tests of base content, clamp and temperature: by template, the best first. open: whether structures allow it (-1: not known)."""

    def __init__(self, texts: list[str], places: np.ndarray, forward: bool, w: Wanted):
        """texts: what can hold a primer; places: bases of it before the target begins or ends."""
        room, longest = w.flank if forward else w.lengths[1], w.lengths[1]
        self.forward, self.w = forward, w
        self.codes = np.full((len(texts), w.flank + longest + 1), NONE, np.uint8)
        for row, text, p in zip(self.codes, texts, places.tolist(), strict=True):
            row[room - p : room - p + len(text)] = DIGIT[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        zero = np.zeros((len(texts), 1), np.int64)
        odd = np.concatenate([zero, np.cumsum(self.codes == NONE, axis=1)], axis=1)
        clamp = np.concatenate([zero, np.cumsum((self.codes == 1) | (self.codes == 2), axis=1)], axis=1)
        parts = []
        for k in range(w.lengths[0], longest + 1):
            at, count = (0, w.flank + 1) if forward else (longest - k, min(w.flank, k - 1) + 1)
            tm, share = melting(self.codes, k, at, count, w)
            cut = lambda m, by: m[:, at + by : at + by + count]  # noqa: E731, B023
            five = cut(clamp, k) - cut(clamp, max(k - 5, 0)) if forward else cut(clamp, min(k, 5)) - cut(clamp, 0)
            keep = (cut(odd, k) == cut(odd, 0)) & (five > 0) & (share >= w.gc_range[0]) & (share <= w.gc_range[1]) & (np.abs(tm - w.target) <= w.tolerance + 1e-9)
            of, place = np.nonzero(keep)
            tm, share = tm[of, place], share[of, place]
            distance = w.flank - place if forward else place
            far = np.abs(tm - w.target) / 2 + distance * PER_BASE + np.abs(share * 100 - 50) * PER_PERCENT
            parts.append((of, at + place, np.full(len(of), k), tm, far))
        self.of, self.at, self.size, self.tm, self.far = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((self.size, self.at, self.far, self.of))
        self.of, self.at, self.size, self.tm, self.far = (x[order] for x in (self.of, self.at, self.size, self.tm, self.far))
        self.open = np.full(len(self.of), -1, np.int8)
        self.tenths = np.rint(self.tm * 10).astype(np.int64)
        count = np.bincount(self.of, minlength=len(texts))
        self.some = count > 0
        self.least, self.greatest = np.full(len(texts), np.inf), np.full(len(texts), -np.inf)
        last = np.cumsum(count)[self.some] - 1
        self.least[self.some], self.greatest[self.some] = self.far[last - count[self.some] + 1], self.far[last]

    def top(self, which: np.ndarray) -> np.ndarray:
        """Codes of the top strand under candidates."""
        i = np.arange(self.w.lengths[1] + 1)
        return np.where(i < self.size[which, None], self.codes[self.of[which, None], np.minimum(self.at[which, None] + i, self.codes.shape[1] - 1)], np.uint8(NONE))

    def tested(self, which: np.ndarray) -> None:
        new = np.unique(which[self.open[which] < 0])
        if len(new):
            top = self.top(new)
            other = turned(top, self.size[new])
            x, back = (top, other) if self.forward else (other, top)
            self.open[new] = steady(x, self.size[new], back, self.w.least_hairpin, self.w.least_dimer)


def bounded(f: Side, r: Side, above: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of candidates whose bound is over above[template] and at most upto[template], but for those known to be closed: both places, difference, bound; a bounded number is looked at at once."""
    i, j = (np.flatnonzero((x.open != 0) & (x.far <= (upto - y.least + 1e-5)[x.of])) for x, y in ((f, r), (r, f)))
    many = np.bincount(r.of[j], minlength=len(upto))
    first = np.cumsum(many) - many
    ends = np.cumsum(many[f.of[i]])
    at = 0
    while at < len(i):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")), at + 1)
        own = i[at:end]
        n = many[f.of[own]]
        a = np.repeat(own, n)
        b = j[np.arange(len(a)) + np.repeat(first[f.of[own]] - (np.cumsum(n) - n), n)]
        at = end
        delta = np.abs(f.tenths[a] - r.tenths[b]) / 10
        bound = delta * PER_DIFFERENCE + f.far[a] + r.far[b]
        on = np.flatnonzero((delta <= f.w.most_difference) & (bound <= upto[f.of[a]] + 1e-5))
        a, b, delta, bound = a[on], b[on], delta[on], np.round(bound[on], 6)
        on = np.flatnonzero((bound > above[f.of[a]]) & (bound <= upto[f.of[a]]))
        yield a[on], b[on], delta[on], bound[on]


def pairs_of(left: list[str], right: list[str], low: np.ndarray, high: np.ndarray, w: Wanted) -> tuple[np.ndarray, list]:
    """Template and columns of PAIRS of the best pairs around targets [low, high).

    left: template[max(low - flank, 0) : low + longest], right: template[max(high - longest, 0) : high + flank]. A pair's score is its bound or more, so a template is done when its
    `most` best pairs score no more than the bound that has been looked at.
    """
    f, r = Side(left, np.minimum(low, w.flank), True, w), Side(right, np.minimum(high, w.lengths[1]), False, w)
    live = f.some & r.some
    above, upto = np.full(len(low), -np.inf), np.where(live, f.least + r.least + STEP, -np.inf)
    end, step = 2 * w.most_difference + f.greatest + r.greatest + 1, STEP
    found = [np.zeros(0, t) for t in (np.int64, np.int64, float, float, float)]  # places of both, difference, energy, score
    while live.any():
        for i, j, delta, bound in bounded(f, r, above, upto):
            f.tested(i)
            r.tested(j)
            on = (f.open[i] > 0) & (r.open[j] > 0)
            i, j, delta, bound = i[on], j[on], delta[on], bound[on]
            energy, ends = np.zeros(len(i)), np.zeros(len(i), np.int64)
            for k in range(0, len(i), PAIRED):
                part = slice(k, k + PAIRED)
                energy[part], ends[part], _ = paired(f.top(i[part]), f.size[i[part]], r.top(j[part]))
            score = np.round(bound + np.maximum(0.0, -energy) * PER_ENERGY + ends * PER_END, 6)
            on = energy >= w.least_dimer
            found = [np.concatenate([x, y[on]]) for x, y in zip(found, (i, j, delta, energy, score), strict=True)]
            i, j, score = found[0], found[1], found[4]
            start, stop = low[f.of[i]] - w.flank + f.at[i], high[f.of[i]] - w.lengths[1] + r.at[j] + r.size[j]
            order = np.lexsort((-r.size[j], f.size[i], start, stop - start, score, f.of[i]))
            of = f.of[i][order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            found = [x[order[rank < w.most]] for x in found]
        many = np.bincount(f.of[found[0]], minlength=len(low))
        worst = np.full(len(low), np.inf)
        full = many >= w.most
        worst[full] = found[4][np.cumsum(many)[full] - 1] if w.most else -np.inf
        above = upto
        live &= (worst > upto) & (upto < end)
        step *= 1.5
        upto = np.where(live, np.minimum(upto + step, worst), -np.inf)
        above = np.where(live, above, np.inf)
    i, j, delta, energy, score = found
    of = f.of[i]
    rank = np.arange(len(of)) - np.searchsorted(of, of) + 1
    begin, size = f.at[i] - w.flank + np.minimum(low, w.flank)[of], f.size[i]
    forward = [left[t][a : a + k].upper() for t, a, k in zip(of.tolist(), begin.tolist(), size.tolist(), strict=True)]
    other = turned(r.top(j), r.size[j])
    reverse = [LETTERS[x[:k]].tobytes().decode() for x, k in zip(other, r.size[j].tolist(), strict=True)]
    start, stop = low[of] - w.flank + f.at[i], high[of] - w.lengths[1] + r.at[j] + r.size[j]
    return of, [rank, forward, reverse, start, stop, stop - start, delta, energy, score]


LETTERS = np.frombuffer(b"ACGT", np.uint8)
PAIRS = "rank int, forward string, reverse string, start int, end int, length int, tm_difference double, cross_dimer double, score double"


def best_pairs(seq: str, low: int, high: int, **how) -> list[tuple]:
    """The best pairs around [low, high) as rows of PAIRS; how: fields of Wanted."""
    w = Wanted(**how)
    if not 0 <= low < high <= len(seq):
        return []
    _, columns = pairs_of([seq[max(low - w.flank, 0) : low + w.lengths[1]]], [seq[max(high - w.lengths[1], 0) : high + w.flank]], np.array([low]), np.array([high]), w)
    return list(zip(*(c if isinstance(c, list) else c.tolist() for c in columns), strict=True))


def primer_pairs(templates: DataFrame, **how) -> DataFrame:
    """doc_id and PAIRS of templates (doc_id, seq, target_start, target_end): the best primer pairs around each target; how: fields of Wanted.

    Only the two stretches of a template that can hold a primer leave the scan; they are dealt over as many tasks as a shuffle has, as they are small beside the work on them.
    """
    w = Wanted(**how)
    kind = templates.schema["doc_id"].dataType.simpleString()
    types = [{"int": pa.int32(), "string": pa.string(), "double": pa.float64()}[p.split()[1]] for p in PAIRS.split(", ")]
    names = [p.split()[0] for p in PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column("inside"))
            for at in range(0, whole.num_rows, TEMPLATES):
                b = whole.slice(at, TEMPLATES)
                of, columns = pairs_of(b.column("left").to_pylist(), b.column("right").to_pylist(), *(b.column(c).to_numpy().astype(np.int64) for c in ("target_start", "target_end")), w)
                if len(of):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    low, high, longest = F.col("target_start").cast("int"), F.col("target_end").cast("int"), w.lengths[1]
    part = lambda place, before, size: F.col("seq").substr(F.greatest(place - before, F.lit(0)) + 1, F.least(place, F.lit(before)) + size)
    # What is asked of the target is no filter here: Spark would move it below the text's expression and work that out once for every time it is named.
    inside = (low >= 0) & (low < high) & (high <= F.length("seq"))
    t = templates.select("doc_id", part(low, w.flank, longest).alias("left"), part(high, longest, w.flank).alias("right"), low.alias("target_start"), high.alias("target_end"), inside.alias("inside"))
    return t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, f"doc_id {kind}, {PAIRS}")


def as_features(pairs: DataFrame) -> DataFrame:
    """Primer annotations of the pairs: doc_id, rank, name, type, start, end, strand, sequence; two rows a pair."""
    one = lambda name, start, end, strand: F.struct(F.concat(F.lit(f"{name} "), "rank").alias("name"), start.alias("start"), end.alias("end"), F.lit(strand).alias("strand"), F.col(name).alias("sequence"))
    both = F.array(one("forward", F.col("start"), F.col("start") + F.length("forward"), 1), one("reverse", F.col("end") - F.length("reverse"), F.col("end"), -1))
    return pairs.select("doc_id", "rank", F.explode(both).alias("p")).select("doc_id", "rank", "p.*", F.lit("primer_bind").alias("type"))
