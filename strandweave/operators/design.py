"""Design of coding sequences and gels: domestication, spacers, orientation, isoschizomers, co-migrating bands.

What concerns one row is Columns; only codon edits and the bands of a lane run as small helpers over batches.
Null and empty sequences give no edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators.scans import scan

# --- fixed values: distance = a - b * log10(bp) by agarose percent; distance within which fragments share a band ---
AGAROSE = {0.8: (1.0, 0.22), 1.0: (1.1, 0.25), 1.5: (1.2, 0.28), 2.0: (1.3, 0.32)}
CO_MIGRATION = 0.008


def migration(size: Column, percent: float) -> Column:
    """Distance from the well, 0 to 1, four decimals; between two calibrated gels by proportion."""
    if not min(AGAROSE) <= percent <= max(AGAROSE):
        raise ValueError(f"agarose percent must lie between {min(AGAROSE)} and {max(AGAROSE)}")
    low, high = max(p for p in AGAROSE if p <= percent), min(p for p in AGAROSE if p >= percent)

    def at(p: float) -> Column:
        a, b = AGAROSE[p]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a - b * F.log10(size)))

    share = 0.0 if low == high else (percent - low) / (high - low)
    return S.round_half_up(at(low) + (at(high) - at(low)) * share, 4)


def co_migrating_bands(lanes: DataFrame, percent: float = 1.0) -> DataFrame:
    """lane, band, position, size, fragments of lanes (lane, size): from the well down, a fragment joins the band whose mean it is near.

    Equal sizes are counted first, so a lane holds at most one row for each different size.
    """
    kind = lanes.schema["lane"].dataType.simpleString()
    sized = lanes.where("size > 0").groupBy("lane", "size").agg(F.count("*").alias("n")).withColumn("y", migration(F.col("size"), percent))
    each = sized.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("y", (-F.col("size")).alias("s"), "n"))).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lane, ys, ss, ns in zip(b["lane"], b["y"], b["s"], b["n"], strict=True):
                bands: list[list[float]] = []  # fragments, sum of positions, sum of log sizes
                for y, s, n in zip(ys, ss, ns, strict=True):
                    for _ in range(int(n)):
                        if not bands or abs(y - bands[-1][1] / bands[-1][0]) > CO_MIGRATION:
                            bands.append([0, 0.0, 0.0])
                        last = bands[-1]
                        last[0], last[1], last[2] = last[0] + 1, last[1] + y, last[2] + np.log(-s)
                out += [(lane, i, np.floor(y / k * 1e4 + 0.5) / 1e4, max(1, int(np.floor(np.exp(g / k) + 0.5))), int(k)) for i, (k, y, g) in enumerate(bands)]
            yield pd.DataFrame(out, columns=["lane", "band", "position", "size", "fragments"])

    return each.select("lane", "x.y", "x.s", "x.n").mapInPandas(run, f"lane {kind}, band int, position double, size long, fragments long")


def selection_summary(stats: DataFrame) -> DataFrame:
    """alignment, columns, variable_columns, conserved_columns, gap_columns, mean_conservation of column statistics; columns of gaps alone count as such only."""
    full = F.col("occupancy") > 0
    return stats.groupBy("alignment").agg(
        F.count("*").alias("columns"), F.count_if(full & ~F.col("fully_conserved") & (F.col("consensus_share") < 1)).alias("variable_columns"),
        F.count_if(full & F.col("fully_conserved")).alias("conserved_columns"), F.count_if(~full).alias("gap_columns"),
        F.coalesce(F.avg(F.when(full, F.col("conservation"))), F.lit(0.0)).alias("mean_conservation"),
    )


def spacers_filled(seq: Column, recognition: str, spacer: int) -> Column:
    """N between a recognition site and its cut (either strand) becomes A; nothing else changes."""
    site, back = S.iupac_regex(recognition), S.iupac_regex(facts.reverse_complement(recognition))
    for k in range(spacer):
        seq = F.regexp_replace(seq, f"(?<={site}[A-Z]{{{k}}})N", "A")
        seq = F.regexp_replace(seq, f"N(?=[A-Z]{{{k}}}{back})", "A")
    return seq


def orientation(row: Column, calls: Column) -> Column:
    """forward, reverse or unknown: an aligned row's bases are the calls, or their reverse complement."""
    bare = F.upper(F.regexp_replace(row, "-", ""))
    return F.when(bare == F.upper(calls), "forward").when(bare == S.reverse_complement(F.upper(calls)), "reverse").otherwise("unknown")


def isoschizomers(enzymes: DataFrame, common: list[str]) -> DataFrame:
    """recognition, top_cut, bottom_cut, primary, names: enzymes (name, and those) that cut alike; common names come first, then by name, case aside."""
    order = F.struct((~F.col("name").isin(common)).alias("rare"), F.lower("name").alias("low"), "name")
    g = enzymes.groupBy("recognition", "top_cut", "bottom_cut").agg(F.array_sort(F.collect_list(order)).alias("x"))
    return g.select("recognition", "top_cut", "bottom_cut", F.element_at("x.name", 1).alias("primary"), F.array_join("x.name", ",").alias("names"))


def domesticated(seqs: DataFrame, words_out: list[str], table_id: int = 1, passes: int = 100) -> DataFrame:
    """doc_id, sites, mutations, remaining, complete, product: coding sequences (from base 0) without the words, on either strand.

    A site is undone by the first of its whole codons that has a synonym without it; the protein never
    changes. Passes go on until nothing is left or nothing helps.
    """
    code = dict(zip(map("".join, product(facts.BASES, repeat=3)), facts.code_string(table_id), strict=True))
    synonyms = {c: [d for d in code if code[d] == aa and d != c] for c, aa in code.items()}
    words = sorted({w for m in words_out for w in (m, facts.reverse_complement(m))})
    pattern = [(w, re.compile(f"(?={w})")) for w in words]

    def places(s: str) -> list[tuple[int, str]]:
        return sorted((m.start(), w) for w, p in pattern for m in p.finditer(s))

    def undo(s: bytearray, at: int, word: str) -> bool:
        for c in range(at // 3 * 3, min(at + len(word), len(s) - 2), 3):
            old = bytes(s[c : c + 3])
            for new in synonyms.get(old.decode(), ()):
                s[c : c + 3] = new.encode()
                if s[at : at + len(word)] != word.encode():
                    return True
            s[c : c + 3] = old
        return False

    def find(text: str) -> Iterator[tuple]:
        s, found = bytearray(text, "ascii", "replace"), places(text)
        left = found
        for _ in range(passes):
            if not left or not sum([s[p : p + len(w)] == w.encode() and undo(s, p, w) for p, w in left]):
                break
            left = places(s.decode())
        product_ = s.decode()
        yield len(found), sum(a != b for a, b in zip(text, product_, strict=True)), len(left), not left, product_

    return scan(seqs, "doc_id", "seq", find, "sites int, mutations int, remaining int, complete boolean, product string")
