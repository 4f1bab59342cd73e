"""Features on products: what a digest, a PCR or an assembly makes of a source is a table of runs, and features follow the runs.

A run is (source, product, ord, start, end, target): the bases [start, end) of a source lie in the product from target on. Runs come
from the operators' own results, are composed by joins (a digest of an assembly), and features meet them in bins of the source, so a
source with any number of features or products is never one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators import cloning

BIN = 1024
SEGMENTS = "array<struct<start:bigint,end:bigint,strand:int>>"


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor((end - 1) / size)))


def located(features: DataFrame, source: str, circular: bool = False) -> DataFrame:
    """source, id, n, parts, size, i, a, b, strand: the segments of every feature that can be made into bases, clipped nowhere, with their number and length.

    features: source, id, start, end, strand, n (length of the source), status, operator, segments. Left out are features that could not be
    placed (status), those whose parts have no order (operator `order`) and empty segments. Without segments the envelope is one; on a circle
    an envelope that ends before it starts runs over the origin, which on the reverse strand is read from its head to its tail.
    """
    one = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.coalesce("strand", F.lit(1)).cast("int").alias("strand"))
    own = F.array(one(F.col("start"), F.col("end")))
    if circular:
        tail, head = one(F.col("start"), F.col("n")), one(F.lit(0), F.col("end"))
        over = F.when((F.col("start") == F.col("n")) & (F.col("end") == 0), F.array(one(F.lit(0), F.col("n")))).when(F.col("strand") == -1, F.array(head, tail)).otherwise(F.array(tail, head))
        own = F.when((F.col("end") < F.col("start")) & F.col("start").between(0, F.col("n")) & F.col("end").between(0, F.col("n")), over).otherwise(own)
    given = F.transform("segments", lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.coalesce(s["strand"], "strand", F.lit(1)).cast("int").alias("strand")))
    parts = F.filter(F.when(F.coalesce(F.size("segments"), F.lit(0)) > 0, given).otherwise(own.cast(SEGMENTS)), lambda s: s["end"] > s["start"])
    f = features.where("status = 'ok' AND coalesce(operator, '') <> 'order'").select(source, "id", "n", parts.alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return f.select(source, "id", "n", F.size("p").alias("parts"), size.alias("size"), F.posexplode("p").alias("i", "s")).select(source, "id", "n", "parts", "size", "i", F.col("s.start").alias("a"), F.col("s.end").alias("b"), F.col("s.strand").alias("strand"))


def _gathered(pieces: DataFrame, source: str) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("i", "place", "x", "y", "strand")))
    g = pieces.groupBy(source, "product", "id").agg(x.alias("x"), F.max("parts").alias("parts"), F.max("size").alias("size"), F.min("x").alias("start"), F.max("y").alias("end"), F.sum(F.col("y") - F.col("x")).alias("covered"), F.count("*").alias("found"))
    return g.withColumn("segments", F.transform("x", lambda s: F.struct(s["x"].alias("start"), s["y"].alias("end"), s["strand"].alias("strand")))).drop("x")


def whole_features(features: DataFrame, runs: DataFrame, source: str, circular: bool = False, bin_size: int = BIN) -> DataFrame:
    """source, product, id, start, end, segments: features whose every segment lies in one run of the product, as digests and amplicons keep them.

    A segment that several runs of a product hold goes by the first of them (ord); a feature that a cut divides is left out.
    """
    seg = located(features, source, circular).withColumn("bin", F.floor(F.col("a") / bin_size))
    filed = runs.where("end > start").select(source, "product", "ord", F.col("start").alias("s"), F.col("end").alias("e"), "target").withColumn("bin", _bins(F.col("s"), F.col("e"), bin_size))
    moved = F.col("target") - F.col("s")
    hit = seg.join(filed, [source, "bin"]).where("a >= s AND b <= e")
    hit = hit.groupBy(source, "product", "id", "i", "parts", "size").agg(F.min(F.struct("ord", "s", (F.col("a") + moved).alias("x"), (F.col("b") + moved).alias("y"), "strand")).alias("m"))
    pieces = hit.select(source, "product", "id", "parts", "size", "i", F.lit(0).alias("place"), "m.x", "m.y", "m.strand")
    return _gathered(pieces, source).where("found = parts").select(source, "product", "id", "start", "end", "segments")


def clipped_features(features: DataFrame, runs: DataFrame, source: str, circular: bool = False, bin_size: int = BIN) -> DataFrame:
    """source, product, id, start, end, segments, partial: the parts of features that reach the product, as assemblies keep them.

    partial: some of the feature's bases lie in no run. Pieces of a reverse segment come in reverse order, so the stored order stays that of
    reading. A feature of which nothing is left is left out.
    """
    seg = located(features, source, circular)
    inside = seg.select("*", F.greatest(F.lit(0), F.least("a", "n")).alias("lo"), F.greatest(F.lit(0), F.least("b", "n")).alias("hi"))
    met = _met(inside.where("hi > lo"), runs, source, bin_size)
    x = F.col("target") + F.col("u") - F.col("s")
    pieces = met.select(source, "product", "id", "parts", "size", "i", F.when(F.col("strand") == -1, -F.col("u")).otherwise(F.col("u")).alias("place"), x.alias("x"), (x + F.col("v") - F.col("u")).alias("y"), "strand")
    return _gathered(pieces, source).select(source, "product", "id", "start", "end", "segments", (F.col("covered") < F.col("size")).alias("partial"))


def _met(spans: DataFrame, runs: DataFrame, source: str, bin_size: int) -> DataFrame:
    """Spans (source, lo, hi, ...) with every run that they share bases with, and the shared bases u to v; a pair meets in the first bin that both touch."""
    filed = runs.where("end > start").select(source, "product", "ord", F.col("start").alias("s"), F.col("end").alias("e"), "target").withColumn("bin", _bins(F.col("s"), F.col("e"), bin_size))
    binned = spans.withColumn("bin", _bins(F.col("lo"), F.col("hi"), bin_size))
    u, v = F.greatest("s", "lo"), F.least("e", "hi")
    return binned.join(filed, [source, "bin"]).where((u < v) & (F.col("bin") == F.floor(u / bin_size))).withColumns({"u": u, "v": v})


def composed(first: DataFrame, second: DataFrame, source: str, between: str, bin_size: int = BIN) -> DataFrame:
    """Runs (source, product, ord, start, end, target) from the sources of `first` to the products of `second`.

    first: source, `product`, whose values are the sources of second, named `between` there. Where two runs share bases of the intermediate product,
    those bases go on; ord is the order in the last product.
    """
    f = first.select(source, F.col("product").alias(between), F.col("start").alias("from"), F.col("target").alias("lo"), (F.col("target") + F.col("end") - F.col("start")).alias("hi")).where("hi > lo")
    m = _met(f, second, between, bin_size)
    start = F.col("from") + F.col("u") - F.col("lo")
    m = m.select(source, "product", start.alias("start"), (start + F.col("v") - F.col("u")).alias("end"), (F.col("target") + F.col("u") - F.col("s")).alias("target"))
    return m.select(source, "product", F.col("target").alias("ord"), "start", "end", "target")


def _turned(runs: DataFrame, total: Column) -> DataFrame:
    """Runs whose target may pass the length of a circular product, cut at its origin."""
    size = F.col("end") - F.col("start")
    t = runs.withColumn("_p", total).withColumn("_t", F.explode(F.sequence(F.floor(F.col("target") / F.col("_p")), F.floor((F.col("target") + size - 1) / F.col("_p")))))
    lo, hi = F.greatest("target", F.col("_t") * F.col("_p")), F.least(F.col("target") + size, (F.col("_t") + 1) * F.col("_p"))
    t = t.withColumns({"_lo": lo, "_hi": hi})
    return t.withColumns({"start": F.col("start") + F.col("_lo") - F.col("target"), "end": F.col("start") + F.col("_hi") - F.col("target"), "target": F.col("_lo") - F.col("_t") * F.col("_p")}).drop("_p", "_t", "_lo", "_hi")


def _spans(rows: DataFrame, over: Column, n: Column, target: Column) -> DataFrame:
    """Runs of rows that span [start, end) of a source (doc_id, product) in one stretch, or in two over its origin (there end is the place behind it)."""
    run = lambda o, a, b, t: F.struct(F.lit(o).alias("ord"), a.cast("long").alias("start"), b.cast("long").alias("end"), t.cast("long").alias("target"))
    a, b = F.col("start"), F.col("end")
    runs = F.when(over, F.array(run(0, a, n, target), run(1, F.lit(0), b, target + n - a))).otherwise(F.array(run(0, a, b, target)))
    return rows.select("doc_id", "product", F.explode(runs).alias("r")).select("doc_id", "product", "r.*")


def digest_runs(fragments: DataFrame) -> DataFrame:
    """doc_id, product (the fragment), ord, start, end, target of a digest's fragments; one over the origin is two runs. A source is as long as its fragments together."""
    f = fragments.select("doc_id", F.col("fragment").alias("product"), "start", "end", F.sum("length").over(Window.partitionBy("doc_id")).alias("n"))
    over, n = F.col("end") > F.col("n"), F.col("n")
    return _spans(f.withColumns({"over": over, "end": F.when(over, F.col("end") - n).otherwise(F.col("end"))}), F.col("over"), n, F.lit(0))


def amplicon_runs(products: DataFrame) -> DataFrame:
    """doc_id, product (its rank), ord, start, end, target of the template bases that products of `assembly.pcr_products` span, behind the forward primer's tail."""
    return _spans(products.withColumn("product", F.col("rank")), F.col("wraps"), F.col("n"), F.col("tail"))


def gibson_runs(fragments: DataFrame, low: int = 15, high: int = 60, circular: bool = False) -> DataFrame:
    """source (design, ord), product (design), ord, start, end, target of the fragments of every Gibson assembly that succeeds.

    The bases of an overlap lie in the product once and in a run of both fragments; those of the closing overlap go to the product's beginning.
    """
    order = Window.partitionBy("design").orderBy("ord")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.lead("seq").over(order)
    f = fragments.withColumn("_next", F.coalesce(nxt, F.first("seq").over(every)) if circular else nxt)
    f = cloning.with_overlaps(f.withColumn("_last", nxt.isNull()), "seq", "_next", low, high, "_o")
    own = (F.length("seq") - F.coalesce("_o.length", F.lit(0))).cast("long")
    bad = ~F.coalesce(F.upper("seq").rlike("^[ACGT]+$"), F.lit(False)) | (F.col("_o.length").isNull() & (~F.col("_last") | F.lit(circular)))
    f = f.withColumns({"target": F.coalesce(F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum(own).over(every), "_bad": F.max(bad).over(every), "_n": F.count("*").over(every)})
    r = f.where("NOT _bad AND _n > 1 AND _total > 0").select(F.struct("design", "ord").alias("source"), F.col("design").alias("product"), F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), "target", "_total")
    return (_turned(r, F.col("_total")) if circular else r).drop("_total")


def golden_gate_runs(parts: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """source (design, ord of the part), product (design), ord (place in the circle), start, end, target of the inserts of every ready Golden Gate assembly.

    Both overhangs of an insert lie in its run; the last one closes the circle at the product's beginning. What lies outside the insert has no run.
    """
    e = cloning.type_iis(enzyme)
    wide = e.bottom - e.top
    chosen = cloning.golden_gate(parts, enzyme).where("status = 'ready'").select("design", F.posexplode(F.transform(F.split("ords", ","), lambda x: x.cast("long"))).alias("_place", "ord"))
    d = cloning.digested_parts(parts, enzyme).select("design", F.col("ord").cast("long").alias("ord"), F.col("released").cast("long").alias("start"), F.length("insert").cast("long").alias("_n"))
    w = Window.partitionBy("design").orderBy("_place")
    own = F.col("_n") - wide
    r = d.join(chosen, ["design", "ord"]).withColumns({"target": F.coalesce(F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    r = r.where("_total > 0").select(F.struct("design", "ord").alias("source"), F.col("design").alias("product"), F.col("_place").cast("long").alias("ord"), "start", (F.col("start") + F.col("_n")).alias("end"), "target", "_total")
    return _turned(r, F.col("_total")).drop("_total")
