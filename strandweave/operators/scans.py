"""Table-generating scans: patterns, open reading frames, translations, sliding composition, k-mers, bindings.

Each scan is one mapInArrow pass over the sequences, most of them over the bytes of a whole batch at once; hits leave as
rows. Nothing is shuffled, and work is linear in the sequence for a fixed catalogue.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandweave.functions import facts
from strandweave.operators.batches import DIGIT, NONE, emit


def scan(df: DataFrame, key: str, column: str, find: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows (key, *hit) for every hit that `find` yields in the column; null sequences have none. schema: of the hits."""
    kind = df.schema[key].dataType.simpleString()
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                at, rows = [], []
                for i, s in enumerate(part.column(column).to_pylist()):
                    if s is not None:
                        before = len(rows)
                        rows.extend(find(s))
                        at.extend([i] * (len(rows) - before))
                if not rows:
                    continue
                arrow = arrow or [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[p.split()[1]] for p in schema.split(", ")]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int64())), *cols], names=[key, *names])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, {schema}")


def pattern_matches(df: DataFrame, key: str, column: str, regex: str) -> DataFrame:
    """key, start, end, match: overlapping matches of a compiled pattern, case aside."""
    head = regex.startswith("^")
    pattern = re.compile(regex if head else f"(?=({regex}))", re.I)

    def find(s: str) -> Iterator[tuple]:
        for m in pattern.finditer(s):
            text = m[0] if head else m[1]
            if text:
                yield m.start(), m.start() + len(text), text

    return scan(df, key, column, find, "start int, end int, match string")


CODON_MASK = np.zeros(256, np.int64)
for _c, _s in (facts.IUPAC | {"U": "T"}).items():
    CODON_MASK[[ord(_c), ord(_c.lower())]] = sum(1 << "ACGT".index(x) for x in _s)


@lru_cache(maxsize=8)
def codon_tables(table_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every codon of base sets (16 sets a place): its residue if all its plain codons agree, else X; whether all are starts, and all stops."""
    plain = {"".join(c): aa for c, aa in zip(product(facts.BASES, repeat=3), facts.code_string(table_id), strict=True)}
    starts = set(facts.CODES[table_id][1].split())
    residue, start, stop = np.full(4096, ord("X"), np.uint8), np.zeros(4096, bool), np.zeros(4096, bool)
    bases = [[b for i, b in enumerate("ACGT") if m >> i & 1] for m in range(16)]
    for code in range(4096):
        own = [a + b + c for a in bases[code >> 8] for b in bases[code >> 4 & 15] for c in bases[code & 15]]
        if own:
            kinds = {plain[x] for x in own}
            residue[code] = ord(kinds.pop()) if len(kinds) == 1 else ord("X")
            start[code], stop[code] = all(x in starts for x in own), all(plain[x] == "*" for x in own)
    return residue, start, stop


def codons_at(masks: np.ndarray) -> np.ndarray:
    """Codon of base sets from every place on (the last two places have none: 0)."""
    out = np.zeros(len(masks), np.int64)
    out[: max(len(masks) - 2, 0)] = masks[:-2] << 8 | masks[1:-1] << 4 | masks[2:]
    return out


def orfs(seqs: DataFrame, min_aa: int = 30, table_id: int = 1, circular: bool = False) -> DataFrame:
    """doc_id, strand, frame, start, end, amino_acids, start_codon, stop_codon, status in six frames.

    Every definite start codon opens a frame to the next stop in it; without one it is partial, to the last whole codon. On a circle
    a frame may pass the origin (end beyond the length) and ends after one turn. Sequences with symbols of no base have none.
    All starts and stops of a batch are sorted by frame and looked up together.
    """
    _, is_start, is_stop = codon_tables(table_id)

    def work(data: np.ndarray, off: np.ndarray) -> tuple | None:
        n = np.diff(off)
        mask = CODON_MASK[data]
        bad = np.zeros(len(n), bool)
        of0 = np.repeat(np.arange(len(n)), n)
        bad[of0[mask == 0]] = True
        turns = 2 if circular else 1
        size = n * turns
        base = np.cumsum(size) - size
        of = np.repeat(np.arange(len(n)), size)
        within = np.arange(len(of)) - base[of]
        at = off[:-1][of] + within % np.maximum(n[of], 1)
        out = []
        for strand in (1, -1):
            if strand == 1:
                m = mask[at]
            else:
                back = mask[off[:-1][of] + n[of] - 1 - within % np.maximum(n[of], 1)]
                m = (back & 1) << 3 | (back & 2) << 1 | (back & 4) >> 1 | (back & 8) >> 3
            code = codons_at(m)
            inside = (within + 3 <= size[of]) & ~bad[of]
            frame = within % 3
            line = (of * 3 + frame) << 32 | within  # sorted by frame of a sequence, then by place
            starts, stops = np.flatnonzero(inside & is_start[code]), np.flatnonzero(inside & is_stop[code])
            stop_line = np.sort(line[stops])
            nxt = np.searchsorted(stop_line, line[starts], side="right")
            has = nxt < len(stop_line)
            key = stop_line[np.minimum(nxt, len(stop_line) - 1)] if len(stop_line) else np.zeros(len(starts), np.int64)
            text, p = of[starts], within[starts]
            q = key & 0xFFFFFFFF
            limit = np.where(circular, p + n[text], size[text])
            whole = has & (key >> 32 == line[starts] >> 32) & (q + 3 <= limit)
            aa = np.where(whole, (q - p) // 3, (limit - p) // 3)
            end = np.where(whole, q + 3, p + 3 * aa)
            keep = aa >= min_aa
            if circular:
                keep &= (p < n[text]) if strand == 1 else (2 * n[text] - end >= 0) & (2 * n[text] - end < n[text])
            text, p, q, aa, end, whole = (x[keep] for x in (text, p, q, aa, end, whole))
            letters = "".join({1 << i: c for i, c in enumerate("ACGT")}.get(x, "N") for x in range(16))
            word = lambda i: np.array([letters[a] + letters[b] + letters[c] for a, b, c in zip(m[i].tolist(), m[i + 1].tolist(), m[i + 2].tolist(), strict=True)], object)  # noqa: E731, B023
            first, last = word(base[text] + p), np.full(len(text), "", object)
            last[whole] = word((base[text] + q)[whole])
            a, b = (p, end) if strand == 1 else (turns * n[text] - end, turns * n[text] - p)
            out.append((text, np.full(len(text), strand), p % 3 + 1, a, b, aa, first, last, np.where(whole, "complete", "partial")))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return emit(seqs, "doc_id", "seq", work, "strand int, frame int, start int, end int, amino_acids int, start_codon string, stop_codon string, status string")


def translations(seqs: DataFrame, table_id: int = 1) -> DataFrame:
    """doc_id, frame1, frame2, frame3, first_start, from_start: residues of whole codons in three frames, and of the frame from the first definite start (null: none) to its stop, which opens with M."""
    residue, is_start, _ = codon_tables(table_id)

    def strings(code: np.ndarray, at: np.ndarray, count: np.ndarray) -> pa.Array:
        """Residues of count[i] codons from place at[i] on."""
        ends = np.concatenate([[0], np.cumsum(count)])
        of = np.repeat(np.arange(len(count)), count)
        place = at[of] + 3 * (np.arange(len(of)) - ends[of])
        return pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(residue[code[place]].tobytes())).cast(pa.string())

    def work(data: np.ndarray, off: np.ndarray) -> tuple:
        n = np.diff(off)
        mask = CODON_MASK[data]
        code = codons_at(np.append(mask, [0, 0]))[: len(mask)]
        frames = [strings(code, off[:-1] + f, np.maximum(n - f, 0) // 3) for f in range(3)]
        of = np.repeat(np.arange(len(n)), n)
        hit = np.flatnonzero(is_start[code] & (np.arange(len(of)) + 3 <= off[1:][of]))
        first = np.full(len(n), -1)
        first[of[hit][::-1]] = (hit - off[:-1][of[hit]])[::-1]
        has = first >= 0
        rest = strings(code, off[:-1] + np.maximum(first, 0), np.where(has, (n - first) // 3, 0))
        cut_ = pc.replace_substring_regex(rest, r"\*.*$", "*")
        opened = pc.if_else(pa.array(has), pc.binary_join_element_wise(pa.scalar("M"), pc.utf8_slice_codeunits(cut_, 1), ""), pa.scalar(None, pa.string()))
        return np.arange(len(n)), *frames, pa.array(first, pa.int32(), mask=~has), opened

    return emit(seqs, "doc_id", "seq", work, "frame1 string, frame2 string, frame3 string, first_start int, from_start string")


def sliding_gc(seqs: DataFrame, window: int = 100, step: int = 1) -> DataFrame:
    """doc_id, position, gc of every window; one row at 0 for a shorter sequence."""
    counted = np.zeros(256, bool)
    counted[np.frombuffer(b"ACGTU", np.uint8)] = True

    def work(data: np.ndarray, off: np.ndarray) -> tuple:
        gc, ok = (np.concatenate([[0], np.cumsum(x)]) for x in ((data == 71) | (data == 67), counted[data]))
        many = np.maximum(np.diff(off) - window, 0) // step + 1
        of = np.repeat(np.arange(len(many)), many)
        at = (np.arange(len(of)) - (np.cumsum(many) - many)[of]) * step
        begin = off[:-1][of] + at
        end = np.minimum(begin + window, off[1:][of])
        n = ok[end] - ok[begin]
        return of, at, np.divide(gc[end] - gc[begin], n, out=np.zeros(len(of)), where=n > 0)

    return emit(seqs, "doc_id", "seq", work, "position int, gc double")


def words_at(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and code (two bits a base) of every overlapping word of k plain bases."""
    digit = DIGIT[data].astype(np.int64)
    m = max(len(data) - k + 1, 0)
    code, ok = np.zeros(m, np.int64), np.ones(m, bool)
    for j in range(k):
        code = code << 2 | digit[j : j + m] & 3
        ok &= digit[j : j + m] < NONE
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    ok &= np.arange(m) + k <= off[1:][of]
    return of[ok], code[ok]


def spelled(code: np.ndarray, k: int) -> list[str]:
    letters = np.frombuffer(b"ACGT", np.uint8)[(code[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    return [w.decode() for w in np.ascontiguousarray(letters).view(f"S{k}").ravel()] if len(code) else []


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """doc_id, kmer, n: overlapping words of k plain bases (k up to 15), counted in each sequence before they leave the task."""

    def work(data: np.ndarray, off: np.ndarray) -> tuple:
        of, code = words_at(data, off, k)
        key, n = np.unique(of << 2 * k | code, return_counts=True)
        return key >> 2 * k, spelled(key & (1 << 2 * k) - 1, k), n.astype(np.int32)

    return emit(seqs, "doc_id", "seq", work, "kmer string, n int")


def strand_votes(pairs: DataFrame) -> DataFrame:
    """Adds k, forward, reverse, orientation to rows with read and template: how many words of the read (as it is, and turned) the template has; reverse only if strictly more.

    k is 7, or the shorter sequence's length down to 3. Only words of plain bases count. Nothing but the pair is compared, so there is no shuffle.
    """

    def words(s: str, k: int) -> np.ndarray:
        raw = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
        return words_at(raw, np.array([0, len(raw)]), k)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for read, template in zip(b.column("read").to_pylist(), b.column("template").to_pylist(), strict=True):
                if read is None or template is None:
                    out.append((None,) * 4)
                    continue
                k = max(3, min(7, len(read), len(template)))
                own = np.unique(words(template, k))
                up, down = (int(np.isin(words(x, k), own).sum()) for x in (read, facts.reverse_complement(read)))
                out.append((k, up, down, "reverse" if down > up else "forward"))
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))], names=[*b.schema.names, "k", "forward", "reverse", "orientation"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{fields}, k int, forward int, reverse int, orientation string")


def primer_bindings(templates: DataFrame, primers: list[tuple[str, str]], max_mismatches: int = 0, min_run: int = 10, tails: bool = False) -> DataFrame:
    """doc_id, primer, strand, start, end, mismatches, run, tail: where a primer anneals; ambiguity on both sides counts as a match.

    run is the matching stretch at the primer's 3' end, min_run at least. With tails a shorter 3' part may anneal (from min_run on), and
    tail is the rest's length; else the whole primer must. Every place is tried at its 3' end, all places of a batch at once.
    """
    sites = []
    for i, (_, p) in enumerate(primers):
        m = CODON_MASK[np.frombuffer(p.encode(), np.uint8)]
        sites.append((i, 1, m[::-1]))
        sites.append((i, -1, CODON_MASK[np.frombuffer(facts.reverse_complement(p).encode(), np.uint8)]))
    names = np.array([n for n, _ in primers], object)

    def work(data: np.ndarray, off: np.ndarray) -> tuple | None:
        mask, found = CODON_MASK[data], []
        of = np.repeat(np.arange(len(off) - 1), np.diff(off))
        place = np.arange(len(mask))
        for i, strand, m in sites:
            step = -strand  # from the 3' end inwards
            room = place - off[:-1][of] + 1 if strand == 1 else off[1:][of] - place
            at = place[room >= min_run]
            for j in range(min(min_run, len(m))):
                at = at[(mask[at + step * j] & m[j]) != 0]
            if len(m) < min_run:
                continue
            wrong, run, running = np.zeros(len(at), np.int64), np.full(len(at), min_run), np.ones(len(at), bool)
            for size in range(min_run, len(m) + 1):
                if size > min_run:
                    fits = room[at] >= size
                    at, wrong, run, running = at[fits], wrong[fits], run[fits], running[fits]
                    hit = (mask[at + step * (size - 1)] & m[size - 1]) != 0
                    wrong, running = wrong + ~hit, running & hit
                    run = run + running
                good = wrong <= max_mismatches
                if (size == len(m) or tails) and good.any():
                    x = at[good]
                    a = x - size + 1 if strand == 1 else x
                    found.append((of[x], np.full(len(x), i), np.full(len(x), strand), a - off[:-1][of[x]], a - off[:-1][of[x]] + size, wrong[good], run[good], np.full(len(x), len(m) - size)))
        if not found:
            return None
        text, primer, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        return text, names[primer], *rest

    return emit(templates, "doc_id", "seq", work, "primer string, strand int, start int, end int, mismatches int, run int, tail int")


def gapped_codons(rows: DataFrame, key: str, column: str, frame: int = 0, table_id: int = 1) -> DataFrame:
    """key, codon, residue, first_column, last_column, spans_gap: codons over the ungapped bases of aligned rows."""
    code = facts.code_string(table_id)

    def find(s: str) -> Iterator[tuple]:
        at = [i for i, c in enumerate(s) if c != "-"]
        for k in range(frame, len(at) - 2, 3):
            a, b, c = at[k : k + 3]
            digits = [facts.BASES.find(s[i]) for i in (a, b, c)]
            residue = "X" if min(digits) < 0 else code[16 * digits[0] + 4 * digits[1] + digits[2]]
            yield (k - frame) // 3, residue, a, c, c - a > 2

    return scan(rows, key, column, find, "codon int, residue string, first_column int, last_column int, spans_gap boolean")
