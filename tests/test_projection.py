"""Features on products: the bases that a feature has on a product are those that it had on its source."""

import hashlib
import random

from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.operators import assembly, cloning, projection, restriction, scans

FEATURES = "doc_id long, id long, start long, end long, strand int, n long, status string, operator string, segments array<struct<start:long,end:long,strand:int>>"


def bases(seq, segments):
    return "".join(seq[a:b] if d != -1 else facts.reverse_complement(seq[a:b]) for a, b, d in segments)


def random_features(rng, doc, n, count):
    out = []
    for i in range(count):
        parts = [(a, min(n, a + rng.randrange(1, 60)), rng.choice([1, -1])) for a in sorted(rng.randrange(n) for _ in range(rng.randrange(1, 4)))]
        out.append((doc, i, min(p[0] for p in parts), max(p[1] for p in parts), 1, n, "ok", "join", parts))
    return out


def circle(a, b, n):
    return [(a, b)] if b > a else [(a, n), (0, b)]


def test_digest_features_of_circles_and_lines(spark):
    rng = random.Random(5)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(3000)) for i in range(4)}
    s = spark.createDataFrame(list(seqs.items()), "doc_id long, seq string")
    rows = [r for i in seqs for r in random_features(rng, i, 3000, 40)]
    f = spark.createDataFrame(rows, FEATURES)
    for circular in (True, False):
        pieces = restriction.fragments(s, restriction.catalogue(["EcoRI", "PstI", "AluI"]), circular=circular)
        texts = {(p.doc_id, p.fragment): (p.start, p.end, (seqs[p.doc_id] * 2)[p.start : p.end]) for p in pieces.collect()}
        runs = projection.digest_runs(pieces)
        got = {(r.doc_id, r.product, r.id): [tuple(x) for x in r.segments] for r in projection.whole_features(f, runs, "doc_id", circular).collect()}
        want = set()
        for (doc, k), (a, b, _) in texts.items():
            spans = [(a, min(b, 3000)), (0, b - 3000)]
            want |= {(doc, k, r[1]) for r in rows if r[0] == doc and all(any(x <= p[0] and p[1] <= y for x, y in spans) for p in r[8])}
        assert set(got) == want and len(want) > 20
        source = {(r[0], r[1]): r[8] for r in rows}
        assert all(bases(texts[doc, k][2], x) == bases(seqs[doc], source[doc, i]) for (doc, k, i), x in got.items())


def test_envelopes_over_the_origin(spark):
    seq = "AAAAAGAATTCCCCCTTTTTGGGGG"  # one cut, behind G at 5
    s = spark.createDataFrame([(1, seq)], "doc_id long, seq string")
    rows = [(1, 0, 20, 5, 1, 25, "ok", "", None), (1, 1, 20, 5, -1, 25, "ok", None, None), (1, 2, 25, 0, 1, 25, "ok", "", None), (1, 3, 0, 5, 1, 25, "quarantined", "", None), (1, 4, 0, 5, 1, 25, "ok", "order", None), (1, 5, 12, 14, None, 25, "ok", "", None), (1, 6, 3, 3, 1, 25, "ok", "", None), (None, 7, 0, 2, 1, 25, "ok", "", None)]
    runs = projection.digest_runs(restriction.fragments(s, restriction.catalogue(["EcoRI"]), circular=True))
    got = {r.id: [tuple(x) for x in r.segments] for r in projection.whole_features(spark.createDataFrame(rows, FEATURES), runs, "doc_id", True).collect()}
    assert got == {0: [(14, 19, 1), (19, 24, 1)], 1: [(19, 24, -1), (14, 19, -1)], 5: [(6, 8, 1)]}  # a full circle is cut, others have no place
    clipped = {r.id: ([tuple(x) for x in r.segments], r.partial) for r in projection.clipped_features(spark.createDataFrame(rows, FEATURES), runs, "doc_id", True).collect()}
    assert clipped[2] == ([(19, 25, 1), (0, 19, 1)], False) and set(clipped) == {0, 1, 2, 5}


def test_amplicons_with_tails_and_over_the_origin(spark):
    rng = random.Random(8)
    seq = "".join(rng.choice("ACGT") for _ in range(900))
    fwd, rev = "TTTTTGGA" + seq[700:715], "CCC" + facts.reverse_complement(seq[185:200])
    s = spark.createDataFrame([(1, seq)], "doc_id long, seq string")
    found = scans.primer_bindings(s, [("f", fwd), ("r", rev)], 0, 12, tails=True)
    p = assembly.pcr_products(found, s, ("f", fwd), ("r", rev), circular=True)
    products = {x["rank"]: x for x in p.collect()}
    assert len(products) > 10 and all(x.wraps for x in products.values()) and len({x.tail for x in products.values()}) > 3  # every annealed length is a product
    rows = random_features(rng, 1, 900, 60)
    kept = projection.whole_features(spark.createDataFrame(rows, FEATURES), projection.amplicon_runs(p), "doc_id", True)
    got = {(r["product"], r.id): [tuple(x) for x in r.segments] for r in kept.collect()}
    inside = {(k, r[1]) for k, x in products.items() for r in rows if all(any(a <= q[0] and q[1] <= b for a, b in circle(x.start, x.end, 900)) for q in r[8])}
    assert set(got) == inside and inside
    assert all(bases(products[k]["product"], got[k, r[1]]) == bases(seq, r[8]) for k in products for r in rows if (k, r[1]) in got)


def assembled_designs(rng, n):
    out, products = [], {}
    for d in range(n):
        whole = "".join(rng.choice("ACGT") for _ in range(700))
        cuts = sorted(rng.sample(range(0, 700, 70), 3))
        ends = [*cuts[1:], cuts[0] + 700]
        out += [(d, i, (whole * 2)[a : b + 20 + d % 9]) for i, (a, b) in enumerate(zip(cuts, ends, strict=True))]
        products[d] = (whole * 2)[cuts[0] : cuts[0] + 700]
    return out, products


def test_gibson_runs_and_their_digest(spark):
    rng = random.Random(21)
    rows, products = assembled_designs(rng, 6)
    f = spark.createDataFrame([*rows, (90, 0, "ACGT" * 20), (90, 1, "GGGTTTCCCAAA" * 6), (91, 0, rows[0][2])], "design long, ord int, seq string")
    runs = projection.gibson_runs(f, circular=True)
    texts = {(d, i): s for d, i, s in rows}
    got = runs.collect()
    assert {r["product"] for r in got} == set(products)
    for r in got:
        assert texts[tuple(r.source)][r.start : r.end] == products[r["product"]][r.target : r.target + r.end - r.start]
    assert {k: sum(r.end - r.start for r in got if tuple(r.source) == k) for k in texts} == {k: len(s) for k, s in texts.items()}
    p = spark.createDataFrame(list(products.items()), "doc_id long, seq string")
    pieces = restriction.fragments(p, restriction.catalogue(["AluI", "EcoRI"]), circular=True)
    cut = projection.digest_runs(pieces).withColumn("product", F.struct("doc_id", "product"))
    both = projection.composed(runs, cut, "source", "doc_id", 64)
    circles = {(x.doc_id, x.fragment): (products[x.doc_id] * 2)[x.start : x.end] for x in pieces.collect()}
    got = both.collect()
    for r in got:
        assert texts[tuple(r.source)][r.start : r.end] == circles[tuple(r["product"])][r.target : r.target + r.end - r.start]
    assert sum(r.end - r.start for r in got) == sum(map(len, texts.values()))  # every base of every fragment goes on once


def test_golden_gate_runs_and_clipped_features(spark):
    rng = random.Random(3)
    ends = ["AATG", "GCTT", "CGCT", "TACA"]
    parts = [(1, i, f"p{i}", "TTTT" + "GGTCTCA" + ends[i] + "".join(rng.choice("AC") for _ in range(50)) + ends[(i + 1) % 4] + "TGAGACC" + "AAA") for i in (2, 0, 3, 1)]
    p = spark.createDataFrame(parts, "design long, ord long, name string, seq string")
    runs, product = projection.golden_gate_runs(p), cloning.golden_gate(p).first()["product"]
    texts = {(d, i): s for d, i, _, s in parts}
    for r in runs.collect():
        assert texts[tuple(r.source)][r.start : r.end] == product[r.target : r.target + r.end - r.start]
    rows = [((d, i), *x[1:]) for d, i, _, s in parts for x in random_features(rng, 0, len(s), 30)]
    kind = FEATURES.replace("doc_id long", "source struct<design:long,ord:long>")
    got = {(tuple(r.source), r.id): r for r in projection.clipped_features(spark.createDataFrame(rows, kind), runs, "source").collect()}
    for source, i, *_, segments in rows:
        kept = [(max(a, 11), min(b, 69), d) for a, b, d in segments if max(a, 11) < min(b, 69)]
        assert ((source, i) in got) == bool(kept)
        if kept:
            r = got[source, i]
            assert bases(product, r.segments) == bases(texts[source], kept) and r.partial == (kept != segments)


def test_nothing_in_nothing_out(spark):
    f = spark.createDataFrame([], FEATURES)
    runs = spark.createDataFrame([], "doc_id long, product int, ord int, start long, end long, target long")
    assert projection.whole_features(f, runs, "doc_id").count() == 0 and projection.clipped_features(f, runs, "doc_id").count() == 0


def test_audit_of_saved_children(spark):
    from strandweave.operators import materialise

    seqs = {1: "AAGAATTCAACCGAATTCTT", 2: "TTTTGAATTCTTTTTTTT", 3: "ACGTACGT"}
    s = spark.createDataFrame(list(seqs.items()), "doc_id long, seq string")
    fresh = materialise.digest_children(restriction.fragments(s, restriction.catalogue(["EcoRI"]), circular=True), s)
    assert {(r.parent, r.sha256) for r in fresh.collect() if r.parent == 3} == {(3, hashlib.sha256(b"ACGTACGT").hexdigest())}
    now = s.select(F.col("doc_id").alias("parent"), F.sha2("seq", 256).alias("sha256"))
    found = lambda saved, parents=now: {(r.parent, r.fragment, r.issue) for r in materialise.audited(saved, fresh, parents).collect()}
    assert found(fresh) == set() and found(fresh.limit(0)) == set()
    assert found(fresh.where("parent = 1 AND fragment = 1")) == {(1, 2, "missing_child")}  # parents without any saved child are not asked for
    lost = fresh.withColumn("sha256", F.when(F.col("parent") != 2, F.col("sha256")))
    assert found(lost) == {(2, 1, "changed_sequence")}
    assert found(fresh, now.where("parent <> 2")) == {(2, 1, "missing_parent")}
    odd = fresh.withColumn("parent_sha256", F.when(F.col("parent") == 1, F.lit("x")).otherwise(F.col("parent_sha256"))).withColumn("start", F.lit(None).cast("int"))
    assert found(odd) == {(1, 1, "stale_parent"), (1, 2, "stale_parent"), (2, 1, "changed_bounds"), (3, 1, "changed_bounds")}
    both = fresh.unionByName(fresh.where("parent = 2").withColumn("ends", F.lit("?")))
    assert found(both) == {(2, 1, "duplicate_child"), (2, 1, "changed_ends")}
