"""Design operators against plain Python, round trips and planted answers."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators import cloning, constructs, design, mapping, oligos


def bases(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def translated(s):
    code = facts.code_string()
    return [code[16 * facts.BASES.index(s[i]) + 4 * facts.BASES.index(s[i + 1]) + facts.BASES.index(s[i + 2])] for i in range(0, len(s) - 2, 3)]


def test_domestication_keeps_the_protein(spark):
    seqs = [bases(300, i) + "GGTCTC" + bases(90, 99 + i) + "GAGACC" + bases(31, i) for i in range(12)] + ["", None, "GGTCT", "GGTCTC", bases(900, 5)]
    df = spark.createDataFrame(list(enumerate(seqs)), "doc_id long, seq string")
    got = {r.doc_id: r for r in design.domesticated(df, ["GGTCTC"]).collect()}
    assert set(got) == {i for i, s in enumerate(seqs) if s is not None}
    for i, r in got.items():
        assert translated(r["product"]) == translated(seqs[i])
        left = sum(r["product"].startswith(w, k) for w in ("GGTCTC", "GAGACC") for k in range(len(seqs[i])))
        assert (left, r.complete) == (r.remaining, left == 0)
        assert r.mutations == sum(a != b for a, b in zip(seqs[i], r["product"], strict=True))
    assert all(got[i].sites >= 2 and got[i].complete for i in range(12))


def test_bands(spark):
    sizes = [1000, 1000, 1010, 3000, 500, 100000, 120000]
    df = spark.createDataFrame([(1, s) for s in sizes] + [(2, 0)], "lane long, size long")
    got = [(r.band, r.position, r.size, r.fragments) for r in design.co_migrating_bands(df).orderBy("lane", "band").collect()]
    assert got == [(0, 0.0, 109545, 2), (1, 0.2307, 3000, 1), (2, 0.3496, 1003, 3), (3, 0.4253, 500, 1)]


def test_spacers_and_orientation(spark):
    df = spark.createDataFrame([("GAAGACNNTTTTNN", "AC-GT"), ("AANNGTCTTCNN", "AAC-C"), (None, None)], "s string, r string")
    got = df.select(design.spacers_filled(F.col("s"), "GAAGAC", 2).alias("s"), design.orientation(F.col("r"), F.lit("GGTT")).alias("o")).collect()
    assert [x.s for x in got] == ["GAAGACAATTTTNN", "AAAAGTCTTCNN", None]
    assert [x.o for x in got] == ["unknown", "reverse", "unknown"]


PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def stack_energy(s):
    h = sum((facts.END_AT if c in "AT" else facts.END_GC)[0] for c in (s[0], s[-1]))
    e = sum((facts.END_AT if c in "AT" else facts.END_GC)[1] for c in (s[0], s[-1]))
    for a, b in zip(s, s[1:], strict=False):
        h, e = h + facts.STACKS[a + b][0], e + facts.STACKS[a + b][1]
    return h - 310.15 * e / 1000


def plain_hairpin(s):
    best = 0.0
    for i in range(len(s)):
        for j in range(i + 8, len(s)):
            k = 0
            while i + k < j - k - 3 and PAIR.get(s[i + k]) == s[j - k]:
                k += 1
                if k >= 3 and j - i - 2 * k + 1 >= 3:
                    best = min(best, round(stack_energy(s[i : i + k]), 2))
    return best


def plain_dimer(a, b):
    back = facts.reverse_complement(b)
    best = (0.0, 0, 0)
    for shift in range(1 - len(back), len(a)):
        low, high = max(0, shift), min(len(a), len(back) + shift)
        p = low
        for q in range(low, high + 1):
            if q < high and a[q] == back[q - shift]:
                continue
            if q - p >= 3:
                best = min(best, (round(stack_energy(a[p:q]), 2), -min(q - p, 5) * ((q == len(a)) + (p == shift)), p - q))
            p = q + 1
    return best[0], -best[1]


def test_structures_against_plain_loops(spark):
    own = [bases(n, n + k) for n in range(4, 29) for k in range(6)]
    h, (d, ends, _) = oligos.hairpin_energies(own)[0], oligos.dimer_energies(own, own[::-1])
    assert all(abs(x - plain_hairpin(o)) < 0.011 for x, o in zip(h, own, strict=True))
    for i, (a, b) in enumerate(zip(own, own[::-1], strict=True)):
        assert (d[i], ends[i]) == plain_dimer(a, b)
    rows = oligos.structures(spark.createDataFrame([(o,) for o in own], "seq string")).collect()
    assert {r.oligo: r.hairpin for r in rows} == dict(zip(own, h.tolist(), strict=True))


def plain_pairs(s, low, high, lengths, flank, most):
    def melting(o):
        own = o == facts.reverse_complement(o)
        dh = sum(facts.STACKS[a + b][0] for a, b in zip(o, o[1:], strict=False)) + sum((facts.END_AT if c in "AT" else facts.END_GC)[0] for c in (o[0], o[-1]))
        ds = sum(facts.STACKS[a + b][1] for a, b in zip(o, o[1:], strict=False)) + sum((facts.END_AT if c in "AT" else facts.END_GC)[1] for c in (o[0], o[-1])) + (facts.SYMMETRY_DS if own else 0)
        gc, ln = sum(c in "GC" for c in o) / len(o), math.log(0.05)
        kelvin = dh * 1000 / (ds + 1.987 * math.log(250e-9 / (1 if own else 4)))
        return math.floor(round((1 / (1 / kelvin + (4.29 * gc - 3.95) * 1e-5 * ln + 9.4e-6 * ln * ln) - 273.15) * 10 + 0.5, 9)) / 10, gc

    def side(places):
        out = []
        for a, b, o, distance in places:
            tm, gc = melting(o)
            if 0.3 <= gc <= 0.7 and set(o[-5:]) & set("GC") and abs(tm - 60) <= 3 + 1e-9 and plain_hairpin(o) >= -3 and plain_dimer(o, o)[0] >= -5:
                out.append((a, b, o, tm, abs(tm - 60) / 2 + distance * 0.05 + abs(gc * 100 - 50) * 0.01))
        return out

    f = side([(a, a + k, s[a : a + k], low - a) for a in range(max(0, low - flank), low + 1) for k in range(lengths[0], lengths[1] + 1) if a + k <= len(s)])
    r = side([(b - k, b, facts.reverse_complement(s[b - k : b]), b - high) for b in range(high, min(len(s), high + flank) + 1) for k in range(lengths[0], lengths[1] + 1) if 0 <= b - k < high])
    out = []
    for a, b, o, tm, far in f:
        for c, e, p, tn, near in r:
            d = math.floor(round(abs(tm - tn) * 10 + 0.5, 9)) / 10
            if d <= 5 and e > a:
                energy, ends = plain_dimer(o, p)
                if energy >= -5:
                    out.append((round(d * 2 + far + near + max(0, -energy) * 0.1 + ends * 0.75, 6), e - a, a, e, b, c, o, p))
    return sorted(out)[:most]


def test_primer_pairs_against_all_pairs():
    for seed in range(3):
        s = bases(260, seed)
        got = oligos.best_pairs(s, 90, 170, lengths=(18, 21), flank=8, most=4)
        want = plain_pairs(s, 90, 170, (18, 21), 8, 4)
        assert [(round(p[8], 5), p[1], p[2]) for p in got] == [(round(w[0], 5), w[6], w[7]) for w in want]


def test_primer_pairs_of_a_table(spark):
    seqs = [bases(500, i) for i in range(4)] + ["", None, "ACGT"]
    df = spark.createDataFrame([(i, s, 150, 350) for i, s in enumerate(seqs)], "doc_id long, seq string, target_start int, target_end int")
    pairs = oligos.primer_pairs(df, most=4).collect()
    assert pairs and all(r.start <= 150 and r.end >= 350 and r.length == r.end - r.start and r.tm_difference <= 5 and r.cross_dimer >= -5 for r in pairs)
    f = oligos.as_features(oligos.primer_pairs(df, most=1)).collect()
    assert all((r.sequence if r.strand == 1 else facts.reverse_complement(r.sequence)) == seqs[r.doc_id][r.start : r.end] for r in f) and {r.strand for r in f} == {1, -1}


def slow_mapping(read, ref, circular, t=constructs.Thresholds()):
    """Status, strand and first place of a read by every start, band by band: plain loops over the whole reference."""
    n, size = len(read), len(ref)
    most = t.most_indel_fraction * n / (1 - t.most_indel_fraction)
    band = max(t.most_indel, -(-int(np.ceil(most)) // 2))
    at = lambda p: ref[p % size] if circular else ref[p] if 0 <= p < size else None

    def run(text, start):
        low, rows = start - band, [{c: (0, None) for c in range(start - band, start + band + 1) if circular or 0 <= c <= size}]
        for i, x in enumerate(text, 1):
            row = {}
            for c in range(low + i, low + i + 2 * band + 1):
                if not circular and not 0 <= c <= size:
                    continue
                best = (-(10**9), None)
                if c - 1 in rows[-1] and at(c - 1) is not None:
                    y = at(c - 1)
                    best = (rows[-1][c - 1][0] + (3 if x == y else -3), 1)
                if c in rows[-1] and rows[-1][c][0] - 4 > best[0]:
                    best = (rows[-1][c][0] - 4, 2)
                if c - 1 in row and row[c - 1][0] - 4 > best[0]:
                    best = (row[c - 1][0] - 4, 3)
                row[c] = best
            rows.append(row)
        if not rows[-1]:
            return None
        score = max(v for v, _ in rows[-1].values())
        c = min((abs(c - start - n), c) for c, (v, _) in rows[-1].items() if v == score)[1]
        i, path, end = n, [], c
        while i:
            step = rows[i][c][1]
            if step is None:
                return None
            path.append(("msid"[1 if step == 1 and text[i - 1] != at(c - 1) else {1: 0, 2: 2, 3: 3}[step]], (c - 1) % size if circular and step != 2 else c - 1 if step != 2 else -1))
            i, c = i - (step != 3), c - (step != 2)
        return score, path[::-1], c % size if circular else c, end

    found = []
    for strand, text in ((1, read), (-1, facts.reverse_complement(read))):
        for start in range(0 if circular else -min(band, n), size):
            got = run(text, start)
            if got:
                found.append((-got[0], -strand, start, got[1], got[2]))
    found.sort(key=lambda f: f[:3])
    score, strand, _, path, place = found[0]
    ops = "".join(o for o, _ in path)
    met = [p for o, p in path if o != "i"]
    runs = [len(x) for x in re.findall("i+|d+", ops)]
    if -score <= 0:
        return "unmapped_read", None, None
    if ops.count("m") / len(ops) < t.min_identity:
        status = "low_mapping_identity"
    elif max(runs, default=0) > t.most_indel or sum(runs) / len(ops) > t.most_indel_fraction:
        status = "excessive_indel"
    elif circular and len(set(met)) < len(met):
        status = "ambiguous_mapping"
    else:
        second = next((-f[0] for f in found if (f[1], f[3]) != (strand, path)), None)
        status = "ambiguous_mapping" if second is not None and (second == -score or (-score - second) / (3 * n) < t.min_margin) else "mapped"
    return status, -strand, place


def edited(text, rng, rate):
    out = []
    for c in text:
        r = rng.random()
        out.append(rng.choice("ACGT") if r < rate else "" if r < 1.3 * rate else c + rng.choice("ACGT") if r < 1.6 * rate else c)
    return "".join(out)


def test_reads_against_every_start(spark):
    """Planted reads of both strands, with edits, over origins, in repeats and from elsewhere, on lines and circles: the statuses, strands and places of plain loops."""
    rng = random.Random(12)
    t = constructs.Thresholds(trim_window=4)
    cases = []
    for k in range(26):
        ref = bases(rng.randrange(70, 160), 900 + k)
        if k % 5 == 4:
            ref = ref[:60] + ref[:60] + bases(20, k)  # a repeat
        circular = k % 2 == 1
        start, n = rng.randrange(len(ref) - 45), rng.randrange(44, 64)
        text = (ref + ref)[start : start + n] if circular else ref[start : start + n]
        text = bases(50, 2000 + k) if k == 7 else "A" * 50 if k == 9 else (ref * 3)[: len(ref) + 50] if k == 11 else edited(text, rng, [0, 0, 0.02, 0.05, 0.12][k % 5 if k % 5 < 4 else rng.randrange(5)])
        cases.append((k, facts.reverse_complement(text) if rng.random() < 0.5 else text, ref, circular))
    reads = spark.createDataFrame([(k, 1, x, None) for k, x, _, _ in cases], "construct int, read int, calls string, quality array<int>")
    refs = spark.createDataFrame([(k, ref, "circular" if c else "linear") for k, _, ref, c in cases], "construct int, seq string, topology string")
    got = {r.construct: r for r in constructs.map_reads(reads, refs, t).collect()}
    for k, x, ref, circular in cases:
        if len(x) < t.min_length:
            assert got[k].status == "trimmed_read_too_short"
            continue
        status, strand, place = slow_mapping(x, ref, circular, t)
        assert (got[k].status, got[k].strand) == (status, strand), (k, status, strand, got[k])
        if status == "mapped":
            assert min(c.pos for c in got[k].columns) == place or circular
    assert {r.status for r in got.values()} >= {"mapped", "ambiguous_mapping", "low_mapping_identity"}


def test_seeds_prove_clean_reads_on_long_references(spark):
    """Reads of a reference of 200,000 bases: found by seeds alone where they are clean, and then as the scan of the whole reference finds them; words that are everywhere are no seeds."""
    rng = random.Random(5)
    ref = bases(100_000, 1) + "ACGTTGCAAGC" * 100 + bases(100_000, 2)
    places = [10, 50_000, 99_900, 120_000, len(ref) - 400]
    texts = [edited(ref[p : p + 400], rng, 0.01) for p in places] + [edited(ref[70_000:70_400], rng, 0.1)]
    rows = [(1, i, facts.reverse_complement(x) if i % 2 else x) for i, x in enumerate(texts)]
    reads = spark.createDataFrame(rows, "construct int, read int, calls string")
    refs = spark.createDataFrame([(1, ref, False)], "construct int, seq string, circular boolean")
    got = {r.read: r for r in mapping.alignments(reads, refs, 0.03).collect()}
    assert [got[i].seeded for i in range(6)] == [True, True, False, True, True, False]  # the third lies in words that are everywhere
    for i, p in enumerate([*places, 70_000]):
        assert abs(got[i].place - p) <= 12 and got[i].strand == (-1 if i % 2 else 1) and got[i].score > got[i].second
    assert all(got[i].score > got[i].second + 36 for i in (0, 1, 3, 4))  # a drifting path has near rivals that leave its outermost diagonal
    circle = spark.createDataFrame([(1, ref, True)], "construct int, seq string, circular boolean")
    over = spark.createDataFrame([(1, 1, ref[-150:] + ref[:250])], "construct int, read int, calls string")
    r = mapping.alignments(over, circle, 0.03).first()
    assert (r.place, r.path, r.seeded) == (len(ref) - 150, "m" * 400, True)


def test_whole_reads_of_short_circles(spark):
    """A read of a whole circle has no rival in its own copy a lap away, whether seeds prove it or all of the circle is looked at."""
    cases = {k: bases(n, 70 + k) for k, n in enumerate([112, 131, 240])}
    texts = {(k, r): x for k, ref in cases.items() for r, x in enumerate([ref, ref[:31] + "GATTACA" + ref[31:]])}
    reads = spark.createDataFrame([(k, r, x, None) for (k, r), x in texts.items()], "construct int, read int, calls string, quality array<int>")
    refs = spark.createDataFrame([(k, ref, "circular") for k, ref in cases.items()], "construct int, seq string, topology string")
    got = {(r.construct, r.read): r for r in constructs.map_reads(reads, refs).collect()}
    assert {r.status for r in got.values()} == {"mapped"}
    for r in range(2):
        assert (got[0, r].status, got[0, r].strand) == slow_mapping(texts[0, r], cases[0], True)[:2]


def test_no_table_of_a_verification_is_a_broadcast(spark):
    ref = bases(300, 8)
    reads = spark.createDataFrame([(1, 1, ref, [40] * 300)], "construct int, read int, calls string, quality array<int>")
    refs = spark.createDataFrame([(1, ref, "linear")], "construct int, seq string, topology string")
    for df in (constructs.map_reads(reads, refs), constructs.verified(reads, refs)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def slow_left(kind, start, allele, ref, circular):
    """One place at a time, to the left; the smallest place that fits."""
    seen, n = [(start, allele)], len(ref)
    while len(seen) <= n:
        p, a = seen[-1]
        if (not circular and p == 0) or ref[(p - 1) % n] != a[-1]:
            break
        seen.append(((p - 1) % n, a[-1] + a[:-1]))
    fit = [s for s in seen if kind == "insertion" or s[0] + len(allele) <= n]
    return (min(fit) if circular else fit[-1]) if fit else seen[0]


def test_indels_are_moved_left(spark):
    rng = random.Random(3)
    refs = {k: "".join(rng.choices("ACA", k=rng.randrange(6, 40))) for k in range(60)} | {100: "A" * 50, 101: "AC" * 30, 102: "CAAAAT", 103: "CAAA"}
    rows = set()
    for k, ref in refs.items():
        for _ in range(6):
            start, size = rng.randrange(len(ref)), rng.randrange(1, 5)
            rows.add((k, "deletion", start, (ref + ref)[start : start + size] if k % 2 else ref[start : start + size]))
            rows.add((k, "insertion", start, "".join(rng.choices("AC", k=size))))
    indels = spark.createDataFrame([*rows], "construct int, type string, start int, allele string")
    got = mapping.leftmost(indels, spark.createDataFrame([*refs.items()], "construct int, seq string"), size=7).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.to_start, r.to_allele) == slow_left(r.type, r.start, r.allele, refs[r.construct], r.construct % 2 == 1), r


def test_values_beside_gaps():
    known = np.array([False, True, False, False, False, True, False])
    got = constructs.beside(known, np.array([0, 10.0, 0, 0, 0, 20.0, 0]))
    assert got.tolist() == [10, 10, 10, 15, 20, 20, 20] and np.isnan(constructs.beside(np.zeros(3, bool), np.zeros(3))).all()


def test_constructs_are_verified(spark):
    ref = bases(200, 40)
    sub = ref[:80] + ("A" if ref[80] != "A" else "C") + ref[81:]
    cut = ref[:100] + ref[103:]
    both = lambda s: [s, facts.reverse_complement(s)]
    reads = [(c, f"{c}{i}", s, [q] * len(s) if q else None) for c, texts, q in (("good", both(ref), 40), ("sub", both(sub), 40), ("wanted", both(sub), 40), ("cut", both(cut), 40), ("weak", [ref, sub], 40), ("bare", [ref], None), ("short", [ref[:30]], 40), ("part", [ref[:120]], 40), ("missed", both(ref), 40)) for i, s in enumerate(texts)]
    r = spark.createDataFrame(reads, "construct string, read string, calls string, quality array<int>")
    refs = spark.createDataFrame([(c, ref, "linear") for c in ("good", "sub", "wanted", "cut", "weak", "bare", "short", "part", "missed", "none")], "construct string, seq string, topology string")
    e = spark.createDataFrame([(c, "v", "substitution", 80, 81, ref[80], sub[80]) for c in ("wanted", "missed")], "construct string, id string, type string, start int, end int, ref string, alt string")
    g = spark.createDataFrame([("good", "r", 0, 50, 2, True), ("part", "r", 100, 140, 1, False)], "construct string, region string, start int, end int, min_depth int, both_strands boolean")
    got = {x.construct: x for x in constructs.verified(r, refs, e, g).collect()}
    assert {k: x.state for k, x in got.items()} == {"good": "consistent", "sub": "inconsistent", "wanted": "consistent", "cut": "inconsistent", "weak": "inconsistent", "bare": "needs_review", "short": "needs_review", "part": "needs_review", "missed": "inconsistent", "none": "needs_review"}
    assert got["good"].consensus == ref and got["wanted"].consensus == sub and got["cut"].consensus == cut
    assert got["sub"].reasons == ["unexpected_variant"] and got["missed"].reasons == ["expected_variant_not_observed"] and "required_region_uncovered" in got["part"].reasons
    assert got["weak"].consensus[80] == "N" and "no_usable_reads" in got["short"].reasons and got["bare"].reasons == ["missing_quality"]


def test_chains():
    assert cloning.chains([("A", "B"), ("C", "A"), ("B", "C")]) == ("unique", [0, 2, 1])
    assert cloning.chains([("A", "B"), ("B", "C")]) == ("unique", [0, 1]) and cloning.chains([("A", "B"), ("C", "D")])[0] == "no-chain"
    assert cloning.chains([("A", "A"), ("A", "A")])[0] == "ambiguous-self-ligation"
    assert cloning.chains([("A", "B"), ("B", "A"), ("A", "B"), ("B", "A")])[0] == "ambiguous-multiple-chains"
    assert cloning.chains([("A", "A")] * 12)[0] == "work-limit"


def test_melting_of_an_oligo(spark):
    assert spark.range(1).select(S.melting_temperature(F.lit("ACGTACGTACGTACGTACGT"), 50, 0.01)).first()[0] == 55.2


def test_primer_features_look_for_pairs_once(spark):
    s = spark.createDataFrame([(0, "ACGT" * 60, 80, 160)], "doc_id long, seq string, target_start int, target_end int")
    plan = oligos.as_features(oligos.primer_pairs(s, most=1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_primer_pairs_are_of_all_candidates():
    """More candidates a side than any fixed number: each that passes is in a pair, and the best pairs are those of a look at all of them."""
    s = bases(40, 1) + "GCATCAGTTGCACTGAGTCA" * 16
    got = oligos.best_pairs(s, 150, 200, tolerance=15.0, least_hairpin=-30.0, least_dimer=-40.0, most_difference=40.0, most=10**6)
    forward, reverse = {(p[1], p[3]) for p in got}, {(p[2], p[4]) for p in got}
    assert len(forward) > 240 and len(reverse) > 240 and len(got) == len(forward) * len(reverse)
    assert [p[1:] for p in oligos.best_pairs(s, 150, 200, tolerance=15.0, least_hairpin=-30.0, least_dimer=-40.0, most_difference=40.0)] == [p[1:] for p in got[:10]]


def test_templates_together_are_as_one_by_one(spark):
    seqs = [bases(60 + 37 * i, i) for i in range(40)] + [bases(300, 99).lower(), "N" * 90, bases(200, 7)[:100] + "N" + bases(200, 8), "ACGT" * 60]
    rows = [(i, s, len(s) // 3, -(-2 * len(s) // 3)) for i, s in enumerate(seqs)] + [(90, seqs[30], -1, 400), (91, seqs[30], 400, 300), (92, seqs[30], 300, 10**6), (93, seqs[30], None, 500), (94, None, 0, 1)]
    got = oligos.primer_pairs(spark.createDataFrame(rows, "doc_id long, seq string, target_start int, target_end int")).collect()
    want = [(i, *p) for i, s, a, b in rows[: len(seqs)] for p in oligos.best_pairs(s, a, b)]
    assert want and sorted(tuple(r) for r in got) == want
    o = [bases(k % 31 + 4, k) for k in range(400)]
    x, n = oligos.coded(o)
    assert oligos.steady(x, n, oligos.turned(x, n), -1.0, -2.0).tolist() == ((oligos.hairpin_energies(o)[0] >= -1.0) & (oligos.dimer_energies(o, o)[0] >= -2.0)).tolist()


def test_turns_are_turned_into_bases_once(spark):
    from strandweave.plans import design_queries

    for df in design_queries._constructs(spark, "/root/testdata/sf0.001"):
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_same_letters_in_the_same_window_are_aligned_once(spark, monkeypatch):
    ref = bases(300, 5)
    rows = [(1, i, 1, ref[40:200], 0, 128, 0, 128, 0, ref, 0) for i in range(5)] + [(1, 9, -1, ref[41:200], 0, 128, 0, 128, 0, ref, 0), (2, 1, 1, ref[40:200], 8, 128, 0, 128, 0, ref, 0)]
    names = "construct int, read int, strand int, calls string, first long, width int, begins int, ends int, lead int, text string, circle int"
    seen, real = [], mapping.aligned_batch

    def counted(x, *rest):
        seen.append(x.shape[1])
        return real(x, *rest)

    monkeypatch.setattr(mapping, "aligned_batch", counted)

    class Rows:  # the function runs here instead of in a worker, so that its calls are counted
        schema = spark.createDataFrame(rows, names).schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, kinds):
            return [r for b in run(iter(spark.createDataFrame(rows, names).toArrow().combine_chunks().to_batches())) for r in b.to_pylist()]

    got = {(r["construct"], r["read"]): r for r in mapping.scored(Rows())}
    assert len(got) == len(rows) and sum(seen) == 3
    assert all(got[1, i]["place"] == 40 and got[1, i]["score"] == 480 and got[1, i]["path"] == "m" * 160 for i in range(5)) and got[1, 9]["place"] == 41 and got[2, 1]["place"] == 48
