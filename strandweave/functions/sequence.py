"""Sequence functions as Column expressions: no Python in the row path, linear in the sequence's length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import facts

LETTERS, CYCLE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("ACGT" * 7)[:26]


def as_bases(text: Column) -> Column:
    """The derived view: letters only, upper case, mapped onto A C G T in turn."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, CYCLE)


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, seq of every document with a text."""
    return docs.where("text IS NOT NULL").select("doc_id", as_bases(F.col("text")).alias("seq"))


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def count_of(seq: Column, symbol: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(symbol), F.lit("")))


def normalised(seq: Column) -> Column:
    """White space out, upper case, U as T."""
    return F.translate(F.upper(F.regexp_replace(seq, r"[\s ﻿   - 　]+", "")), "U", "T")


def invalid_symbols(seq: Column) -> Column:
    """Distinct symbols outside the IUPAC alphabet, in the order first seen."""
    return F.array_distinct(F.split(F.regexp_replace(normalised(seq), "[ACGTRYSWKMBDHVN]", ""), ""))


def complement(seq: Column) -> Column:
    return F.translate(seq, *facts.COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), *facts.COMPLEMENT)


def gc_fraction(seq: Column) -> Column:
    gc = count_of(seq, "G") + count_of(seq, "C")
    valid = gc + count_of(seq, "A") + count_of(seq, "T") + count_of(seq, "U")
    return F.coalesce(F.try_divide(gc, valid), F.lit(0.0))


def dna_mass(seq: Column, mode: str = "average", five_phosphate: bool = True, three_phosphate: bool = False, circular: bool = False) -> Column:
    m, water = facts.NUCLEOTIDE_MASS[mode], facts.NUCLEOTIDE_WATER[mode]
    total = reduce(lambda a, b: a + b, [count_of(seq, b) * F.lit(m[b]) for b in "ACGT"])
    n = F.length(seq)
    if circular:
        mass = total - n * F.lit(water)
    else:
        mass = total - (n - 1) * F.lit(water)
        if not five_phosphate:
            mass = mass - F.lit(facts.PHOSPHATE[mode])
        if three_phosphate:
            mass = mass + F.lit(facts.PHOSPHATE[mode])
    return F.when(n > 0, round_half_up(mass, 2)).otherwise(F.lit(0.0))


def mean_dna_mass(seq: Column, mode: str = "average") -> Column:
    """Mass of a linear 5' phosphate strand whose ambiguous bases count as the mean of what they may be; null for other symbols."""
    m, water = facts.NUCLEOTIDE_MASS[mode], facts.NUCLEOTIDE_WATER[mode]
    s = F.upper(seq)
    total = reduce(lambda a, b: a + b, [count_of(s, k) * F.lit(sum(m[x] for x in v) / len(v)) for k, v in facts.IUPAC.items()])
    mass = round_half_up(total - (F.length(s) - 1) * F.lit(water), 2)
    return F.when(s == "", 0.0).when(s.rlike("^[" + "".join(facts.IUPAC) + "]+$"), mass)


def protein_mass(letters: Column) -> Column:
    known = [count_of(letters, a) for a in facts.RESIDUE_MASS]
    total = reduce(lambda a, b: a + b, [c * F.lit(m) for c, m in zip(known, facts.RESIDUE_MASS.values(), strict=True)])
    other = F.length(letters) - reduce(lambda a, b: a + b, known)
    return F.when(F.length(letters) > 0, round_half_up(total + other * F.lit(facts.RESIDUE_OTHER) + F.lit(facts.RESIDUE_WATER), 2)).otherwise(F.lit(0.0))


def quick_tm(seq: Column) -> Column:
    at, gc = count_of(seq, "A") + count_of(seq, "T"), count_of(seq, "G") + count_of(seq, "C")
    n = at + gc
    return F.when(n == 0, None).when(n <= 20, (2 * at + 4 * gc).cast("double")).otherwise(64.9 + 41 * (gc - 16.4) / n)


def pair_count(seq: Column, pair: str) -> Column:
    """Overlapping occurrences of two bases; for a doubled base, its count less the number of its runs."""
    if pair[0] != pair[1]:
        return ((F.length(seq) - F.length(F.replace(seq, F.lit(pair), F.lit("")))) / 2).cast("long")
    runs = F.regexp_replace(seq, pair[0] + "+", "1")
    return count_of(seq, pair[0]) - count_of(runs, "1")


def duplex(seq: Column) -> tuple[Column, Column]:
    """Enthalpy (cal/mol) and entropy (cal/mol K) of an unambiguous duplex of two bases or more."""
    dh, ds = F.lit(0.0), F.lit(0.0)
    for pair, (h, s) in facts.STACKS.items():
        n = pair_count(seq, pair)
        dh, ds = dh + n * F.lit(h * 1000), ds + n * F.lit(s)
    for end in (F.substring(seq, 1, 1), F.right(seq, F.lit(1))):
        at = end.isin("A", "T")
        dh = dh + F.when(at, facts.END_AT[0] * 1000).otherwise(facts.END_GC[0] * 1000)
        ds = ds + F.when(at, facts.END_AT[1]).otherwise(facts.END_GC[1])
    own = seq == reverse_complement(seq)
    return dh, ds + F.when(own, facts.SYMMETRY_DS).otherwise(0.0)


def free_magnesium(mg: float, dntp: float) -> float:
    """Molar free Mg2+ beside dNTPs (equilibrium, association constant 3e4)."""
    if not mg or not dntp:
        return mg
    b = 1 + 3e4 * (dntp - mg)
    return min(mg, max(0.0, (-b + (b * b + 4 * 3e4 * mg) ** 0.5) / (2 * 3e4)))


def melting_temperature(seq: Column, na_mm: float = 50.0, mg_mm: float = 0.0, primer_nm: float = 250.0, dntp_mm: float = 0.0) -> Column:
    """Salt-corrected nearest-neighbour temperature, one decimal; short oligos (under 14) by the two-four rule."""
    import math

    dh, ds = duplex(seq)
    own = seq == reverse_complement(seq)
    kelvin = dh / (ds + F.when(own, 1.987 * math.log(primer_nm / 1e9)).otherwise(1.987 * math.log(primer_nm / 1e9 / 4)))
    gc, n = gc_fraction(seq), F.length(seq)
    na, mg = na_mm / 1000, free_magnesium(mg_mm / 1000, dntp_mm / 1000)
    ratio = math.sqrt(mg) / na
    if mg == 0 or ratio < 0.22:
        ln = math.log(na)
        inverse = 1 / kelvin + (4.29 * gc - 3.95) * F.lit(1e-5 * ln) + F.lit(9.40e-6 * ln * ln)
    else:
        ln, lm = math.log(na), math.log(mg)
        a, d, g = 3.92e-5, 1.42e-5, 8.31e-5
        if ratio < 6:
            a *= 0.843 - 0.352 * math.sqrt(na) * ln
            d *= 1.279 - 4.03e-3 * ln - 8.03e-3 * ln * ln
            g *= 0.486 - 0.258 * ln + 5.25e-3 * ln**3
        inverse = 1 / kelvin + F.lit(a - 9.11e-6 * lm) + gc * F.lit(6.26e-5 + d * lm) + (1 / (2 * (n - 1))) * F.lit(-4.82e-4 + 5.25e-4 * lm + g * lm * lm)
    at = count_of(seq, "A") + count_of(seq, "T")
    rule = (2 * at + 4 * (count_of(seq, "G") + count_of(seq, "C"))).cast("double")
    return F.when(n == 0, None).when(n < 14, rule).otherwise(round_half_up(1 / inverse - 273.15, 1))


def translate(seq: Column, frame: int = 0, table_id: int = 1) -> Column:
    """Residues of the frame's whole codons; X where a codon is not four plain bases' work."""
    code = facts.code_string(table_id)
    digit = lambda c, k: F.instr(F.lit(facts.BASES), F.substring(c, k, 1)) - 1

    def residue(c: Column) -> Column:
        return F.when(c.rlike("^[ACGT]{3}$"), F.lit(code).substr(1 + 16 * digit(c, 1) + 4 * digit(c, 2) + digit(c, 3), F.lit(1))).otherwise("X")

    codons = F.regexp_extract_all(F.substring(seq, frame + 1, 2**31 - 1), F.lit("..."), F.lit(0))
    return F.array_join(F.transform(codons, residue), "")


def gc_clamp(seq: Column) -> Column:
    return F.right(seq, F.lit(5)).rlike("[GC]")


def prosite_regex(pattern: str) -> str:
    """A PROSITE pattern as a regular expression; ValueError on a syntax error."""
    import re

    out = []
    body = pattern.rstrip(".")
    for part in body.split("-"):
        m = re.fullmatch(r"(<)?(x|[A-Z]|\[[A-Z]+\]|\{[A-Z]+\})(?:\(([0-9]+)(?:,([0-9]+))?\))?(>)?", part)
        if not m:
            raise ValueError(f"not PROSITE syntax: {part!r}")
        head, core, low, high, tail = m.groups()
        if low is not None and (int(low) == 0 or high is not None and int(high) < int(low)):
            raise ValueError(f"bad repeat in {part!r}")
        core = "." if core == "x" else f"[^{core[1:-1]}]" if core[0] == "{" else core
        out.append(("^" if head else "") + core + (f"{{{low}{',' + high if high else ''}}}" if low else "") + ("$" if tail else ""))
    return "".join(out)


def prosite_regex_or_none(pattern: str, most_repeat: int = 5000) -> str | None:
    """The same, but None for a syntax error or a repeat beyond the limit."""
    import re

    if any(int(n) > most_repeat for n in re.findall(r"[0-9]+", pattern)):
        return None
    try:
        return prosite_regex(pattern)
    except ValueError:
        return None


RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
ELEMENT = r"^<?(x|[A-Z]|\[[A-Z]+\]|\{[A-Z]+\})(?:\(([0-9]+)(?:,([0-9]+))?\))?>?$"


def _draw(key: Column, choices: Column) -> Column:
    """A number from 0 to choices - 1, the same for the same key everywhere: the first 32 bits of its MD5, scaled."""
    return F.floor(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2**32 * choices).cast("int")


def realised_window(pattern: Column, seed: Column, longest: Column) -> tuple[Column, Column]:
    """One window of a PROSITE pattern: the allowed residues place by place (`.` where all are), and one text of such residues, which the pattern matches.

    Repeats of a variable element are drawn by a hash of seed and element, so a row gives the same window on any partitioning; each leaves room for the least
    of the elements behind it, and no window passes `longest`. Null where the text is no pattern, a repeat is 0 or falling, or the least window does not fit.
    """
    parts = F.split(F.regexp_replace(pattern, r"\.+$", ""), "-")
    number = lambda e, k, other: F.coalesce(F.nullif(F.regexp_extract(e, ELEMENT, k), F.lit("")).cast("int"), other)
    low = lambda e: number(e, 2, F.lit(1))
    high = lambda e: number(e, 3, low(e))
    elements = F.transform(parts, lambda e: F.struct(F.regexp_extract(e, ELEMENT, 1).alias("core"), low(e).alias("low"), high(e).alias("high")))
    sound = F.forall(elements, lambda e: (e["core"] != "") & (e["low"] > 0) & (e["high"] >= e["low"]))
    least = F.aggregate(elements, F.lit(0), lambda n, e: n + e["low"])
    state = F.struct(F.lit(0).alias("i"), longest.cast("int").alias("room"), least.alias("later"), F.array().cast("array<int>").alias("counts"))

    def step(s: Column, e: Column) -> Column:
        later = s["later"] - e["low"]
        top = F.least(e["high"], s["room"] - later)
        n = e["low"] + _draw(F.concat(seed.cast("string"), F.lit(":"), s["i"].cast("string")), top - e["low"] + 1)
        return F.struct((s["i"] + 1).alias("i"), (s["room"] - n).alias("room"), later.alias("later"), F.array_append(s["counts"], n).alias("counts"))

    counts = F.aggregate(elements, state, step, lambda s: s["counts"])
    inner = lambda c: F.translate(c, "[]", "")
    without = lambda c: F.regexp_replace(F.lit(RESIDUES), F.translate(c, "{}", "[]"), F.lit(""))
    allowed = lambda c: F.when(c == "x", ".").when(c.startswith("["), inner(c)).when(c.startswith("{"), without(c)).otherwise(c)
    places = F.flatten(F.zip_with(elements, counts, lambda e, n: F.array_repeat(allowed(e["core"]), n)))
    good = sound & (least <= longest)
    places = F.when(good, places)
    pick = lambda p, i: F.substr(F.when(p == ".", RESIDUES).otherwise(p), _draw(F.concat(seed.cast("string"), F.lit("#"), i.cast("string")), F.when(p == ".", 20).otherwise(F.length(p))) + 1, F.lit(1))
    return places, F.array_join(F.transform(places, pick), "")


def iupac_regex(pattern: str) -> str:
    return "".join(b if len(b := facts.IUPAC[c]) == 1 else f"[{b}]" for c in pattern.upper())


def substituted(seq: Column, pos: Column, base: Column) -> Column:
    """The base at a 0-based place replaced; a place outside the sequence changes nothing."""
    inside = (pos >= 0) & (pos < F.length(seq))
    return F.when(inside, F.overlay(seq, base, (pos + 1).cast("int"), F.lit(1))).otherwise(seq)


def inserted(seq: Column, pos: Column, bases: Column) -> Column:
    """Bases put in after a place; -1 is the front. A place outside changes nothing."""
    inside = (pos >= -1) & (pos < F.length(seq))
    return F.when(inside, F.overlay(seq, bases, (pos + 2).cast("int"), F.lit(0))).otherwise(seq)


def deleted(seq: Column, pos: Column, count: Column) -> Column:
    """Up to `count` bases taken out from a place on. A place outside changes nothing."""
    inside = (pos >= 0) & (pos < F.length(seq)) & (count > 0)
    return F.when(inside, F.overlay(seq, F.lit(""), (pos + 1).cast("int"), F.least(count, F.length(seq) - pos).cast("int"))).otherwise(seq)


def variant_label(reference: Column, alternate: Column, start: Column) -> Column:
    """REF>ALT at a 1-based place; empty alleles read as '-'."""
    shown = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    return F.concat(shown(reference), F.lit(">"), shown(alternate), F.lit(" at "), (start + 1).cast("string"))


def residue_class(a: Column, b: Column, protein: bool = False) -> Column:
    """match (equal symbols that are no wild card), ambiguous (both may be the same residue) or substitution of two symbols; U and T are one in nucleotides."""
    sets = {"B": "DN", "Z": "EQ", "J": "IL", "X": "ACDEFGHIKLMNPQRSTVWY", "?": "ACDEFGHIKLMNPQRSTVWY"} if protein else facts.IUPAC | {"?": "ACGT"}
    letters = [chr(c) for c in range(65, 91)] + ["?", "*"] if protein else list(sets)
    masks = {k: sum(1 << (ord(c) - 32) for c in sets.get(k, k)) for k in letters}
    m = F.create_map(*[F.lit(x) for kv in masks.items() for x in (kv[0], F.lit(kv[1]).cast("long"))])
    one = lambda c: F.upper(c) if protein else F.translate(F.upper(c), "U", "T")
    x, y = F.try_element_at(m, one(a)), F.try_element_at(m, one(b))
    wild = one(a).isin("X" if protein else "N", "?")
    return F.when((one(a) == one(b)) & ~wild, "match").when(F.coalesce(x.bitwiseAND(y) != 0, F.lit(False)), "ambiguous").otherwise("substitution")
