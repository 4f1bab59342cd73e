"""Scans, digests, alignments and intervals against plain Python on small inputs."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.operators import alignment, batches, cloning, intervals, records, relations, restriction, scans
from strandweave.sources import text as T


def frame(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "doc_id long, seq string")


def enzymes(*names):
    return restriction.catalogue(list(names))


def test_sites_geometry(spark):
    s = frame(spark, "AAGAATTCAA", "GGTCTC", "AAAAAAAAAAAGAGACC", None, "", "gaauuc", "GANTTC")
    got = {(r.doc_id, r.enzyme, r.position, r.strand, r.top_cut, r.bottom_cut, r.status) for r in restriction.sites(s, enzymes("EcoRI", "BsaI")).collect()}
    assert got == {(0, "EcoRI", 2, 1, 3, 7, "ok"), (1, "BsaI", 0, 1, 7, 11, "insufficient_flanking_bases"), (2, "BsaI", 11, -1, 6, 10, "ok"), (5, "EcoRI", 0, 1, 1, 5, "ok")}


def test_activity_of_sites(spark):
    s = frame(spark, "AAGATCAACCTCAGCAAAAAACCGGAA")
    kinds = lambda **how: {(r.enzyme, r.activity) for r in restriction.sites(s, enzymes("DpnI", "MboI", "MspI", "Nb.BbvCI", "Sau3AI"), **how).collect()}
    assert kinds() == {("DpnI", "conditional"), ("MboI", "conditional"), ("MspI", "conditional"), ("Nb.BbvCI", "nick-only"), ("Sau3AI", "active-double-strand")}
    assert kinds(methylation={"dam": "methylated", "cpg": "unmethylated"}) == {("DpnI", "active-double-strand"), ("MboI", "conditional"), ("MspI", "active-double-strand"), ("Nb.BbvCI", "nick-only"), ("Sau3AI", "active-double-strand")}
    nick = restriction.sites(s, enzymes("Nb.BbvCI")).first()
    assert nick.top_cut is None and nick.bottom_cut == nick.position + 9


def test_all_sites_against_plain_search(spark):
    random.seed(12)
    texts = ["".join(random.choice("ACGT" if random.random() < 0.99 else "N") for _ in range(700)) for _ in range(4)]
    got = {(r.doc_id, r.enzyme, r.position, r.strand) for r in restriction.sites(frame(spark, *texts)).collect()}
    want = set()
    for i, t in enumerate(texts):
        for e in restriction.catalogue():
            for strand, p in {1: e.recognition, -1: facts.reverse_complement(e.recognition)}.items():
                if strand == 1 or p != e.recognition:
                    want |= {(i, e.name, k, strand) for k in range(len(t) - len(p) + 1) if all(c in facts.IUPAC[x] for c, x in zip(t[k : k + len(p)], p, strict=True))}
    assert got == want and len(want) > 200


def test_circular_site_over_the_origin(spark):
    s = frame(spark, "TTCAAAAGAA")
    r = restriction.sites(s, enzymes("EcoRI"), circular=True).collect()
    assert [(x.position, x.top_cut, x.bottom_cut) for x in r] == [(7, 8, 2)]
    f = restriction.fragments(s, enzymes("EcoRI"), circular=True).first()
    assert (f.start, f.end, f.left_end, f.right_end, f.left_type) == (8, 18, "AATT", "AATT", "5prime")


def test_ends_of_fragments(spark):
    rows = {r.fragment: r for r in restriction.fragments(frame(spark, "AAACTGCAGTTTTGGTCTCAACGTTTT"), enzymes("PstI", "BsaI")).collect()}
    assert [(rows[i].start, rows[i].end, rows[i].left_end, rows[i].right_end, rows[i].left_type, rows[i].right_type) for i in (1, 2, 3)] == [
        (0, 8, "", "TGCA", "blunt", "3prime"), (8, 20, "TGCA", facts.reverse_complement("ACGT"), "3prime", "5prime"), (20, 27, "ACGT", "", "5prime", "blunt")]
    assert restriction.fragments(frame(spark, "AAGGTACCAA"), enzymes("KpnI")).count() == 2
    both = [restriction.Enzyme("one", "GGTACC", 1, 5), restriction.Enzyme("two", "GTACC", 0, 0)]
    assert restriction.fragments(frame(spark, "AAGGTACCAA"), both).count() == 0
    assert restriction.recipes(frame(spark, "AAGGTACCAA"), "KpnI nope").first().issues == "unknown_enzyme"


def test_fragments_make_up_the_source(spark):
    random.seed(2)
    seqs = ["".join(random.choice("ACGT") for _ in range(24 + i)) + "GAATTC" + "".join(random.choice("ACGT") for _ in range(24)) for i in range(12)]
    s = frame(spark, *seqs, "ACGT")
    f = restriction.fragments(s, enzymes("EcoRI")).collect()
    for i, x in enumerate([*seqs, "ACGT"]):
        own = sorted((r.start, r.end) for r in f if r.doc_id == i)
        assert own[0][0] == 0 and own[-1][1] == len(x) and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert len(own) == x.count("GAATTC") + 1
    ring = restriction.fragments(s, enzymes("EcoRI"), circular=True).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in ring} == {i: len(x) for i, x in enumerate([*seqs, "ACGT"])}


def test_clusters_over_the_origin(spark):
    s = restriction.sites(frame(spark, "GAATTCAAAA" + "A" * 60 + "GAATTC" + "A" * 40 + "GAATTCAA"), enzymes("EcoRI"), circular=True)
    n = spark.createDataFrame([(0, 124)], "doc_id long, n int")
    line = restriction.clusters(s, n, 20, 40).orderBy("cluster").collect()
    ring = restriction.clusters(s, n, 20, 40, circular=True).orderBy("cluster").collect()
    assert [r.n for r in line] == [1, 1, 1] and [r.n for r in ring] == [2, 1]


def test_fixed_values_of_enzymes():
    known = {"EcoRI": ("GAATTC", 1, 5), "PstI": ("CTGCAG", 5, 1), "SmaI": ("CCCGGG", 3, 3), "BsaI": ("GGTCTC", 7, 11), "BbsI": ("GAAGAC", 8, 12), "SapI": ("GCTCTTC", 8, 11), "NotI": ("GCGGCCGC", 2, 6), "BstXI": ("CCANNNNNNTGG", 8, 4), "AluI": ("AGCT", 2, 2), "HindIII": ("AAGCTT", 1, 5), "KpnI": ("GGTACC", 5, 1)}
    assert {k: facts.ENZYMES[k] for k in known} == known and len(facts.ENZYMES) == 152
    assert facts.STACKS["AA"] == (-7.9, -22.2) and facts.STACKS["CG"] == (-10.6, -27.2) and facts.STACKS["GC"] == (-9.8, -24.4)


def test_orf_tables(spark):
    s = frame(spark, "ATGAAAAGATTTTAA")
    got = {t: [(r.start, r.end, r.amino_acids, r.stop_codon) for r in scans.orfs(s, 1, t).where("strand = 1 AND frame = 1 AND start = 0").collect()] for t in (1, 2)}
    assert got == {1: [(0, 15, 4, "TAA")], 2: [(0, 9, 2, "AGA")]}


def test_batches_stay_small():
    b = pa.RecordBatch.from_pydict({"seq": ["A" * 50_000] * 60 + [None] + ["C" * 3_000_000] + ["G" * 9] * 5})
    parts = [x.column("seq").to_pylist() for x in batches.cut(iter([b]), "seq")]
    assert [x for p in parts for x in p] == [x for x in b.column("seq").to_pylist() if x is not None]
    assert all(len(p) == 1 or sum(map(len, p)) <= 1 << 20 for p in parts)


def test_sliding_gc_short_and_long(spark):
    got = {(r.doc_id, r.position): r.gc for r in scans.sliding_gc(frame(spark, "GGAA", "GC" * 60, ""), 100, 20).collect()}
    assert got == {(0, 0): 0.5, (1, 0): 1.0, (1, 20): 1.0, (2, 0): 0.0}


def test_sliding_gc_against_slices(spark, monkeypatch):
    monkeypatch.setattr(scans, "scan", None)  # no row of Python values a window
    texts = ["", "G", "GATTACA", "GCGNNxÄGC" * 5, "ACGT" * 9]
    out = scans.sliding_gc(frame(spark, *texts), 6, 4).collect()
    for i, t in enumerate(texts):
        b = t.encode()
        want = []
        for at in range(0, len(b) - 5, 4) if len(b) >= 6 else [0]:
            w = b[at : at + 6]
            n = sum(c in b"ACGTU" for c in w)
            want.append((at, sum(c in b"GC" for c in w) / n if n else 0.0))
        assert sorted((r.position, r.gc) for r in out if r.doc_id == i) == want


def test_orfs_of_circles(spark):
    s = frame(spark, "AAATAACCATGA", "ATGAAA")  # the first frame passes the origin, the second has no stop in a turn
    got = {(r.doc_id, r.start, r.end, r.amino_acids, r.status) for r in scans.orfs(s, 2, circular=True).where("strand = 1").collect()}
    assert got == {(0, 8, 18, 2, "complete")} | {(1, 0, 6, 2, "partial")} or (1, 0, 6, 2, "partial") in got


def test_translations(spark):
    got = {r.doc_id: r for r in scans.translations(frame(spark, "CCTTGGCCTAAGG", "", "AC", "GCNATHRAY")).collect()}
    assert (got[0].frame1, got[0].first_start, got[0].from_start) == ("PWPK", 2, "MA*")
    assert (got[1].frame1, got[1].first_start, got[1].from_start) == ("", None, None) and got[2].frame3 == ""
    assert got[3].frame1 == "AIX"


def test_strand_votes(spark):
    read, template = "ACGTTGCATTGACCA", "GGGTGGTCAATGCAACGTGGG"
    r = scans.strand_votes(spark.createDataFrame([(read, template), (read, None), ("AC", "ACGT")], "read string, template string")).collect()
    assert (r[0].k, r[0].forward, r[0].reverse, r[0].orientation) == (7, 0, 9, "reverse") and r[1].k is None and r[2].k == 3 and r[2].orientation == "forward"


def test_primer_bindings(spark):
    p = "ACGTTGCAACGT"
    got = scans.primer_bindings(frame(spark, "TT" + p + "GG", facts.reverse_complement(p)[:-1] + "A", "ttacgttgcaacgn"), [("p", p)], 1, 10).collect()
    assert {(r.doc_id, r.strand, r.start, r.mismatches) for r in got} >= {(0, 1, 2, 0), (2, 1, 2, 0)}
    tails = scans.primer_bindings(frame(spark, "CCGTTGCAACGTGG"), [("p", p)], 0, 8, tails=True).where("strand = 1").collect()
    assert {(r.start, r.end, r.tail) for r in tails} == {(2, 12, 2), (3, 12, 3), (4, 12, 4), (1, 12, 1)}


def brute_align(a, b):
    h = [[-2 * j for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        h.append([-2 * i])
        for j in range(1, len(b) + 1):
            h[i].append(max(h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2))
    return h[-1][-1]


def test_alignment_kernel(spark):
    random.seed(1)
    pairs = [("".join(random.choice("ACGT") for _ in range(random.randint(0, 15))), "".join(random.choice("ACGT") for _ in range(random.randint(0, 15)))) for _ in range(60)]
    for r in alignment.align_pairs(spark.createDataFrame([*pairs, (None, "A"), ("AC!", "A")], "a string, b string")).collect():
        if r.a is None or "!" in r.a:
            assert r.method == "invalid"
            continue
        assert r.score == brute_align(r.a, r.b)
        assert r.aligned_a.replace("-", "") == r.a and r.aligned_b.replace("-", "") == r.b and len(r.aligned_a) == len(r.aligned_b)


def test_other_ways_to_align():
    random.seed(6)
    m = alignment.MASKS["dna"]
    for _ in range(40):
        a, b = ("".join(random.choice("ACGTN") for _ in range(random.randint(1, 40))) for _ in "ab")
        full, linear = alignment.full_matrix(a, b, m), alignment.linear_space(a, b, m)
        score = lambda s, t: sum(-2 if "-" in (x, y) else 2 if m[ord(x)] & m[ord(y)] else -1 for x, y in zip(s, t, strict=True))
        assert score(*full) == score(*linear) and [x.replace("-", "") for x in linear] == [a, b]
    a = "".join(random.choice("ACGT") for _ in range(300))
    b = a[:100] + a[120:220] + "GATTACA" + a[220:]
    s, t, left_out = alignment.seeded(a, b, m)
    assert [s.replace("-", ""), t.replace("-", "")] == [a, b] and sum(x == y for x, y in zip(s, t, strict=True)) >= 275
    assert left_out == 0 and alignment.seeded(a[:100] + "C" * 40 + a[100:], a[:100] + "G" * 40 + a[100:], m, 100)[2] == 1
    assert alignment.seed_anchors("ACG", "ACG") == [] and alignment.seed_anchors(a, a) == [(0, 0, 300)]


def slow_anchors(a, b, k=12, most=32):
    """From the left, each free word of a takes the first free of its first places in b, with its whole run if all of that is free."""
    k = min(k, len(a), len(b))
    out, fa, fb, i = [], 0, 0, 0
    while k >= 4 and i + k <= len(a):
        places = [j for j in range(len(b) - k + 1) if b[j : j + k] == a[i : i + k]][:most]
        j = next((j for j in places if j >= fb), None)
        if j is not None:
            p, q, n = i, j, k
            while p and q and a[p - 1] == b[q - 1]:
                p, q, n = p - 1, q - 1, n + 1
            while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                n += 1
            if p >= fa and q >= fb:
                out.append((p, q, n))
                fa, fb = p + n, q + n
                i = fa
                continue
        i += 1
    return out


def test_pairs_aligned_together():
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) for _ in range(2)) for _ in range(60)]
    m = alignment.MASKS["dna"]
    for limits in (alignment.Limits(), alignment.Limits(full=0)):
        together = alignment.aligned_pairs(pairs, "dna", limits)
        assert together == [alignment.aligned_pair(a, b, "dna", limits) for a, b in pairs]
        for (a, b), (s, t, *_) in zip(pairs, together, strict=True):
            score = sum(-2 if "-" in x else 2 if x[0] == x[1] else -1 for x in zip(s, t, strict=True))
            assert (s.replace("-", ""), t.replace("-", "")) == (a, b) and score == alignment.score_rows(m[alignment.codes(a)], m[alignment.codes(b)], False)[-1]


def test_anchors_against_loops():
    random.seed(9)
    for _ in range(60):
        parts = ["".join(random.choices("AC", k=random.randint(3, 30))) for _ in range(6)]
        a, b = ("".join(random.choices(parts, k=random.randint(1, 9))) for _ in "ab")
        assert alignment.seed_anchors(a, b) == slow_anchors(a, b)


def test_star_keeps_every_row(spark):
    """A null, an empty and an odd row, rows of another alphabet, and pairs beyond the limit, in small and large groups: all are there, with a status."""
    random.seed(4)
    base = "".join(random.choices("ACGT", k=40))
    near = lambda: "".join(c for c in base if random.random() > 0.05)
    rows = [(1, 0, None), (1, 1, base), (1, 2, near()), (1, 3, "A#"), (1, 4, ""), (2, 0, "ACGT"), (2, 1, None), (3, 0, "MKL"), (3, 1, "MKQL"), (3, 2, "A" * 3000), (4, 0, "ACGU"), (4, 1, "ACG")]
    rows += [(5, i, None if i == 7 else near()) for i in range(30)]
    out = alignment.star_alignments(spark.createDataFrame(rows, "group int, row int, seq string"), limits=alignment.Limits(most=8000)).collect()
    got = {(r.group, r.row): r for r in out}
    assert len(got) == len(out) == len(rows)
    assert [got[1, i].status for i in range(5)] == ["missing", "ok", "ok", "symbols", "empty"] and [got[2, i].status for i in range(2)] == ["alone", "missing"]
    assert [got[3, i].status for i in range(3)] == ["ok", "ok", "work-limit"] and [got[4, i].status for i in range(2)] == ["ok", "ok"] and got[5, 7].status == "missing"
    for g in (1, 3, 4, 5):
        own = [(r, s) for k, r, s in rows if k == g and got[g, r].status == "ok"]
        assert len({len(got[g, r].aligned) for r, _ in own}) == 1 and all(got[g, r].aligned.replace("-", "") == s for r, s in own)
        assert sum(got[g, r].centre for r, _ in own) == 1
    assert all(got[g, r].aligned is None for g, r, _ in rows if got[g, r].status != "ok")


def test_ambiguity_in_alignments(spark):
    r = alignment.align_pairs(spark.createDataFrame([("ACGT", "ACNT"), ("ACGU", "ACGU"), ("MKB", "MKD"), ("MXK", "MXK")], "a string, b string")).collect()
    assert [(x.identity, x.ambiguous) for x in r[:2]] == [(100.0, 1), (100.0, 0)] and r[3].ambiguous == 1 and r[3].identity == 100.0


def plain_star(seqs):
    """Rows around the centre, by ids in order; one group in plain Python."""
    m = alignment.MASKS["dna"]
    n = len(seqs)
    if n <= 10:
        total = [0.0] * n
        for i in range(n):
            for j in range(i + 1, n):
                s, t = alignment.full_matrix(seqs[i], seqs[j], m)
                same = alignment.identity_of(sum(x == y for x, y in zip(s, t, strict=True)), len(s))
                total[i] += same
                total[j] += same
        c = total.index(max(total))
    else:
        c = sorted(range(n), key=lambda i: len(seqs[i]))[n // 2]
    pairs = [alignment.full_matrix(seqs[c], s, m) for s in seqs]
    slots = [0] * (len(seqs[c]) + 1)
    for top, _ in pairs:
        k = run = 0
        for ch in [*top, "end"]:
            if ch == "-":
                run += 1
            else:
                slots[k] = max(slots[k], run)
                k, run = k + 1, 0
    out = []
    for top, low in pairs:
        row, gap, k = [], [], 0
        for ch, v in [*zip(top, low, strict=True), ("end", "")]:
            if ch == "-":
                gap.append(v)
            else:
                row.append("".join(gap).ljust(slots[k], "-") + v)
                gap, k = [], k + 1
        out.append("".join(row))
    return out


def test_star_alignments_of_small_and_large_groups(spark):
    random.seed(9)
    base = "".join(random.choice("ACGT") for _ in range(24))

    def near():
        t = list(base)
        for _ in range(random.randint(0, 4)):
            k = random.randrange(len(t))
            t[k : k + random.randint(0, 2)] = random.choice(["", "A", "GG"])
        return "".join(t) or "A"

    groups = {"a": [near() for _ in range(2)], "b": [near() for _ in range(10)], "c": [near() for _ in range(37)], "d": ["ACGT"], "e": ["ACGTACGT", "ACGACGT", "ACGTTACGT", "CGTACG"]}
    df = spark.createDataFrame([(g, i, s) for g, ss in groups.items() for i, s in enumerate(ss)], "group string, row long, seq string")
    got = {(r.group, r.row): r.aligned for r in alignment.star_alignments(df).collect()}
    for g, ss in groups.items():
        if len(ss) > 1:
            assert [got[g, i] for i in range(len(ss))] == plain_star(ss), g
    assert got["d", 0] is None  # alone: there, without a row


def test_pattern_hits(spark):
    rows = spark.createDataFrame([(1, "A-C.GN"), (2, "aCgTACGU")], "row long, aligned string")
    got = {(r.row, r.start_column, r.end_column) for r in alignment.pattern_hits(rows, "cgr").collect()}
    assert got == {(1, 2, 5)}
    assert alignment.pattern_hits(rows, "ACGT").where("row = 2").count() == 2 and alignment.pattern_hits(rows, "A-C").count() == 0 and alignment.pattern_hits(rows, " ").count() == 0


def test_consensus_tie_rules(spark):
    rows = spark.createDataFrame([(0, 1, "T-"), (0, 2, "A-"), (0, 3, "-C")], "alignment int, row long, aligned string")
    assert {(r.column, r.symbol) for r in alignment.consensus(rows).collect()} == {(0, "T"), (1, "C")}
    assert {(r.column, r.consensus, r.fully_conserved) for r in alignment.column_stats(rows).collect()} == {(0, "A", False), (1, "C", False)}


def test_spans(spark):
    df = spark.createDataFrame([(8, 13, 10), (-2, 3, 10), (2, 5, 10), (4, 4, 10)], "a int, b int, n int")
    ring = [[(x.start, x.end) for x in r[0]] for r in df.select(intervals.normalise_span(F.col("a"), F.col("b"), F.col("n"), True)).collect()]
    line = [[(x.start, x.end) for x in r[0]] for r in df.select(intervals.normalise_span(F.col("a"), F.col("b"), F.col("n"), False)).collect()]
    assert ring == [[(8, 10), (0, 3)], [(8, 10), (0, 3)], [(2, 5)], []] and line == [[(8, 10)], [(0, 3)], [(2, 5)], []]


def test_lanes(spark):
    df = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 3, 8), (1, 3, 5, 6), (2, 4, 0, 1)], "k long, id long, start long, end long")
    assert {(r.id, r.lane) for r in intervals.pack_lanes(df, "k").collect()} == {(1, 0), (2, 1), (3, 0), (4, 0)}
    random.seed(3)
    spans = [(random.randrange(2), i, s, s + random.randint(1, 9)) for i, s in enumerate(random.choices(range(60), k=150))]
    got = {r.id: r.lane for r in intervals.pack_lanes(spark.createDataFrame(spans, "k long, id long, start long, end long"), "k").collect()}
    for k in (0, 1):
        ends: list[int] = []
        for _, i, s, e in sorted((x for x in spans if x[0] == k), key=lambda x: (x[2], -x[3], x[1])):
            lane = next((j for j, z in enumerate(ends) if z <= s), len(ends))
            ends[lane : lane + 1] = [e]
            assert got[i] == lane


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "node int, next int")
    assert {r.node for r in relations.closure(e, spark.createDataFrame([(1,)], "node int")).collect()} == {1, 2, 3}


def test_fasta_round_trip(spark):
    t = spark.createDataFrame([("f", "junk\n>a first one\nACGT\n;note\nAC-G.T\n>b\n\n>c x\nMK*\n")], "path string, value string")
    got = [(r.record, r.header, r.description, r.sequence, r.gaps_removed) for r in T.parse_fasta(t).orderBy("record").collect()]
    assert got == [(0, "a", "first one", "ACGTACGT", 2), (2, "c", "x", "MK*", 0)]
    s = "ACGT" * 45
    line = spark.createDataFrame([("x", s)], "h string, s string").select(T.to_fasta(F.col("h"), F.col("s"))).first()[0]
    assert line == ">x\n" + s[:80] + "\n" + s[80:160] + "\n" + s[160:]


def test_clustal_round_trip(spark):
    rows = spark.createDataFrame([(1, 1, "one", "ACGT" * 20), (1, 2, "two", "ACGA" * 20)], "alignment int, row long, name string, aligned string")
    lines = [r.line for r in T.to_clustal(rows).orderBy("alignment", "block", "row").collect()]
    text = "CLUSTAL\n\n" + "\n".join(lines)
    back = T.parse_clustal(spark.createDataFrame([("p", text)], "path string, value string")).collect()
    assert {(r.name, r.aligned) for r in back} == {("one", "ACGT" * 20), ("two", "ACGA" * 20)}


def test_tsv_cells(spark):
    df = spark.createDataFrame([("=1",), ('a"b',), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(T.tsv_cell(F.col("c"))).collect()] == ["'=1", '"a""b"', "x", ""]


def slow_append(old, new, edges):
    """Issues by closures over plain sets."""
    ids, twice = {i for i in new}, {i for i in new if new.count(i) > 1}
    issues = {(i, "duplicate_id") for i in twice | (ids & old)}
    fresh = ids - old
    own = {(a, b) for a, b in edges if a in fresh and b not in old}
    missing = {a for a, b in own if b not in fresh}
    reach = {a: {b for x, b in own if x == a} for a in fresh}
    for _ in fresh:
        reach = {a: r | {c for b in r for c in reach.get(b, ())} for a, r in reach.items()}
    circle = {a for a in fresh if a in reach[a]}
    between = {a for a in fresh if reach[a] & circle and any(a in reach[c] for c in circle)}
    issues |= {(a, "missing_dependency") for a in missing} | {(a, "cyclic") for a in circle | between}
    bad = {i for i, _ in issues if i in fresh}
    return issues | {(a, "refused_dependency") for a in fresh if reach[a] & bad and a not in bad}


def test_dependencies_by_peeling(spark):
    random.seed(2)
    for k in range(4):
        old, new = set(range(0, 20)), [random.randrange(15, 60) for _ in range(60)] if k % 2 else list(range(20, 60))
        edges = {(random.randrange(15, 60), random.randrange(0, 62)) for _ in range(20 + 10 * k)} | {(50 + i, 51 + i) for i in range(5)}
        c = spark.createDataFrame([(i, "old") for i in old], "id int, what string")
        n = spark.createDataFrame([(i, "new") for i in new], "id int, what string")
        out, issues = records.appended(c, n, spark.createDataFrame([*edges], "id int, needs int"))
        want = slow_append(old, new, edges)
        got = [tuple(r) for r in issues.collect()]
        assert set(got) == want and len(got) == len(set(got))
        assert sorted(r.id for r in out.collect()) == sorted(old | ({i for i in new} - {i for i, _ in want} - old))
    e = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (7, 6), (6, 7), (9, 8)], "id int, needs int")
    c = spark.createDataFrame([(i,) for i in range(1, 10)], "id int")
    kept, issues = records.removed(c, e, spark.createDataFrame([(i,) for i in (2, 3, 4, 6, 7, 8, 9, 99)], "id int"))
    assert sorted(r.id for r in kept.collect()) == [1, 4, 5, 6, 7] and {tuple(r) for r in issues.collect()} == {(4, "required"), (6, "required"), (7, "required"), (99, "unknown_id")}


def test_overlaps_against_slices(spark):
    random.seed(8)
    rows = []
    for i in range(200):
        a, b = ("".join(random.choices("ACGTacgt" if i % 3 else "ACN", k=random.randint(0, 40))) for _ in "ab")
        k = random.randint(8, 20)
        rows.append((i, a + b[:k] if i % 2 else a, b if i % 5 else b[:k] * 3))
    rows += [(900, None, "ACGTACGTACGT"), (901, "ACGTACGTA", None), (902, "A" * 30, "A" * 30)]
    sets = {k: set(v) for k, v in facts.IUPAC.items()}
    for r in cloning.with_overlaps(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b", 8, 20).collect():
        if r.a is None or r.b is None:
            assert r.o is None
            continue
        a, b = r.a.upper()[-20:], r.b.upper()[:20]
        ks = [k for k in range(min(len(a), len(b), 20), 7, -1) if a[-k:] == b[:k] and set(a[-k:]) <= set("ACGT")]
        maybe = not set(a + b) <= set("ACGT") and any(all(sets[x] & sets[y] for x, y in zip(a[-k:], b[:k], strict=True)) for k in range(8, min(len(a), len(b)) + 1))
        want = "exact" if len(ks) == 1 else "multiple_exact" if ks else "ambiguous_symbols" if maybe else "none"
        assert (r.o.lengths, r.o.length, r.o.unique, r.o.reason) == (ks, ks[0] if ks else None, len(ks) == 1, want)


def test_appended_rows_are_no_broadcast(spark):
    """Ids pack so well that a large table of them looks small: their joins are merges."""
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    out, issues = records.appended(ids(1, 2), ids(2, 3, 4), spark.createDataFrame([(3, 1), (4, 9)], "id long, needs long"))
    for df in (out, issues):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in out.collect()} == {1, 2, 3} and {tuple(r) for r in issues.collect()} == {(2, "duplicate_id"), (4, "missing_dependency")}


def test_star_centres_are_chosen_once(spark):
    rng = random.Random(17)
    rows = [(g, r, "".join(rng.choices("ACGT", k=rng.randrange(1, 30)))) for g in range(6) for r in range(3 * g)] + [(None, 1, "ACGT"), (None, 2, "AGT")]
    plan = alignment.star_alignments(spark.createDataFrame(rows, "group long, row long, seq string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "row_a" not in plan  # no pair is aligned where the rows are put together


def test_gaps_of_a_group_are_merged(spark):
    pairs = [(1, 1, "AC-GT--", "ACCGTAA"), (1, 2, "--ACGT", "TTA-GT"), (1, 3, "ACGT", "AC-T"), (2, 1, "AC", "AC"), (3, 1, "-A-", "CAC")]
    df = spark.createDataFrame(pairs, "group long, row long, aligned_a string, aligned_b string").withColumn("centre", F.lit(3).cast("long"))
    runs = alignment.gap_runs(df).groupBy("group", "at").agg(F.max("k").alias("k"))
    assert {tuple(r) for r in runs.collect()} == {(1, 0, 2), (1, 2, 1), (1, 4, 2), (3, 0, 1), (3, 1, 1)}
    got = alignment.widened(df.join(runs.groupBy("group").agg(F.collect_list(F.struct("at", "k")).alias("slots")), "group", "left"))
    assert {(r.group, r.row): r.aligned for r in got.collect()} == {(1, 1): "--ACCGTAA", (1, 2): "TTA--GT--", (1, 3): "--AC--T--", (2, 1): "AC", (3, 1): "CAC"}


def test_lanes_of_many_short_islands(spark):
    spans = [(k, 10 * i + j, 10 * i, 10 * i + 3 + j) for k in range(3) for i in range(40) for j in range(3)] + [(9, i, 5, 5 + i % 2) for i in range(5)]
    lanes = intervals.pack_lanes(spark.createDataFrame(spans, "k long, id long, start long, end long"), "k")
    assert "FlatMapGroups" not in lanes._jdf.queryExecution().optimizedPlan().toString()  # a call for every island
    got = {(r.k, r.id): r.lane for r in lanes.collect()}
    assert len(got) == len(spans) and all(got[k, 10 * i + j] == 2 - j for k in range(3) for i in range(40) for j in range(3))


def test_summary_counts_cells_once(spark):
    df = spark.createDataFrame([("x", 1, "AC-G"), ("x", 2, "AC-T"), ("x", 3, "AG--"), ("y", 1, "--A")], "alignment string, row long, aligned string")
    got = alignment.summary(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in got.collect()} == {("x", 4, 3, 66.7, 4, 1), ("y", 3, 1, 100.0, 2, 1)}


def test_star_status_reads_whole_turns(spark, tmp_path):
    from strandweave.plans import catalog

    texts = ["gattaca" * 40, "gattaca" * 39 + "gatt", "gattaca" * 3]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.row: r for r in catalog.QUERIES["star_status"](spark, str(tmp_path)).collect()}
    assert [len(got[i].seq) for i in range(3)] == [280, 277, 21] and {r.status for r in got.values()} == {"ok"}
