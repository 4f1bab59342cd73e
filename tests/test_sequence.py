"""Scalar functions against published constants and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S


def one(spark, seq, *cols):
    r = spark.createDataFrame([(seq,)], "s string").select(*[c(F.col("s")) for c in cols]).first()
    return r[0] if len(cols) == 1 else tuple(r)


@pytest.mark.parametrize("seq,na,mg,dntp,tm", [("ACGTACGTACGTACGTACGT", 50, 0.01, 0.0, 55.2)])
def test_tm_constants(spark, seq, na, mg, dntp, tm):
    assert one(spark, seq, lambda s: S.melting_temperature(s, na, mg, 250, dntp)) == tm


def test_masses(spark):
    assert one(spark, "A", lambda s: S.dna_mass(s, five_phosphate=False)) == 251.26
    assert one(spark, "", S.dna_mass) == 0.0
    assert one(spark, "", S.protein_mass) == 0.0


def test_thermodynamics_against_python(spark):
    random.seed(4)
    seqs = ["".join(random.choice("ACGT") for _ in range(random.randint(2, 60))) for _ in range(40)] + ["AAAA", "ACGT"]
    dh, ds = S.duplex(F.col("s"))
    for s, h, e in spark.createDataFrame([(x,) for x in seqs], "s string").select("s", dh, ds).collect():
        want_h = sum(facts.STACKS[a + b][0] * 1000 for a, b in zip(s, s[1:], strict=False)) + sum((facts.END_AT if c in "AT" else facts.END_GC)[0] * 1000 for c in (s[0], s[-1]))
        want_s = sum(facts.STACKS[a + b][1] for a, b in zip(s, s[1:], strict=False)) + sum((facts.END_AT if c in "AT" else facts.END_GC)[1] for c in (s[0], s[-1]))
        want_s += facts.SYMMETRY_DS if s == facts.reverse_complement(s) else 0
        assert abs(h - want_h) < 1e-6 and abs(e - want_s) < 1e-6


def test_free_magnesium():
    assert S.free_magnesium(0.0, 1e-3) == 0.0
    assert S.free_magnesium(1e-3, 0.0) == 1e-3
    assert 0 < S.free_magnesium(1e-3, 1e-3) < 1e-3


def test_reverse_complement_is_an_involution(spark):
    s = "ACGTRYSWKMBDHVNacgtn-"
    assert one(spark, s, lambda c: S.reverse_complement(S.reverse_complement(c))) == s


def test_translation(spark):
    assert one(spark, "ATGGCCTAA", S.translate) == "MA*"
    assert one(spark, "ATGAAAAGATTTTAA", lambda s: S.translate(s, 0, 2)) == "MK*F*"
    assert one(spark, "AT", S.translate) == ""
    assert one(spark, "ATN", S.translate) == "X"
    assert one(spark, None, S.translate) is None


def test_prosite():
    assert S.prosite_regex("N-{P}-[ST]-{P}") == "N[^P][ST][^P]"
    assert S.prosite_regex("<A-x(2,3)-C>") == "^A.{2,3}C$"
    for bad in ("A--C", "x(0)", "[A", "A(3,2)"):
        with pytest.raises(ValueError):
            S.prosite_regex(bad)


def test_codes():
    assert len(facts.CODES) == 24 and all(len(facts.code_string(t)) == 64 for t in facts.CODES)
    assert facts.code_string(1).count("*") == 3 and facts.code_string(2).count("*") == 4


def test_realised_windows(spark):
    import re

    good = ["N-{P}-[ST]-{P}.", "<A-x(2,9)-C(1,4)-{DE}(2)-x>", "x(3,40)-[ACD](2,5)", "W"]
    rows = [(p, i, m) for p in good for i in range(60) for m in (7, 12, 30)]
    bad = [("A-(2)", 1, 9), ("", 1, 9), ("A(0)", 1, 9), ("A(3,2)", 1, 9), (None, 1, 9), ("A(5)", 1, 4), ("a-C", 1, 9)]
    f = spark.createDataFrame(rows + bad, "pattern string, seed int, longest int")
    places, text = S.realised_window(F.col("pattern"), F.col("seed"), F.col("longest"))
    got = {(r.pattern, r.seed, r.longest): (r.places, r.text) for r in f.select("*", places.alias("places"), text.alias("text")).collect()}
    assert all(got[x] == (None, None) for x in bad)
    seen = {p: set() for p in good}
    for p, i, m in rows:
        where, t = got[p, i, m]
        assert t is not None and len(t) == len(where) <= m and re.fullmatch(S.prosite_regex(p), t)
        assert all(c in (S.RESIDUES if s == "." else s) for s, c in zip(where, t, strict=True))
        seen[p].add(len(t))
    assert seen[good[0]] == {4} and len(seen[good[1]]) > 5 and max(seen[good[2]]) > 20  # lengths vary, within bounds
    again = {tuple(r) for r in f.repartition(7).select(text, "seed", "pattern").collect()}
    assert again == {(v[1], k[1], k[0]) for k, v in got.items()}
