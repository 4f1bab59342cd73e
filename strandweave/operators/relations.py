"""Joins, set operators and ordered neighbours in the shapes that sequence work needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import written


def lookup(asked: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """Every name asked for, with the catalogue's facts and whether it is known."""
    return asked.join(catalogue.withColumn("known", F.lit(True)), name, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def freshness(saved: DataFrame, now: DataFrame, record: str) -> DataFrame:
    """saved with state and reason: stale if its record is gone, unverified if nothing attests it, else fresh. now: record, attested."""
    j = saved.join(now.withColumn("there", F.lit(True)), record, "left")
    reason = F.when(F.col("there").isNull(), "missing").when(~F.col("attested"), "unattested")
    return j.withColumn("reason", reason).withColumn("state", F.when(F.col("there").isNull(), "stale").when(~F.col("attested"), "unverified").otherwise("fresh"))


def compare(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, state: found, missing or unexpected."""
    e, o = expected.select(key).distinct().withColumn("e", F.lit(1)), observed.select(key).distinct().withColumn("o", F.lit(1))
    return e.join(o, key, "full").select(key, F.when(F.col("o").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("found").alias("state"))


def downsample(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """At most `most` rows a key, evenly spaced by rank: floor(i (n - 1) / (most - 1))."""
    n, i = F.count("*").over(Window.partitionBy(key)), F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    r = rows.withColumn("n", n).withColumn("i", i)
    # rank i is picked if some k has floor(k (n - 1) / (most - 1)) = i
    k = F.ceil(F.col("i") * (most - 1) / (F.col("n") - 1))
    picked = (F.col("n") <= most) | (F.floor(k * (F.col("n") - 1) / (most - 1)) == F.col("i"))
    return r.where(picked).drop("n", "i")


def chain_closure(roots: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, root, reached: how many turns follow each root without a gap, itself included.

    The closure of "turn t needs turn t - 1" is a run of consecutive turns, so islands replace recursion.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    island = turns.withColumn("island", F.col("turn") - F.row_number().over(w))
    last = island.groupBy("conv_id", "island").agg(F.max("turn").alias("last"))
    at = roots.join(island.withColumnRenamed("turn", "root"), ["conv_id", "root"]).join(last, ["conv_id", "island"])
    return at.select("conv_id", "root", (F.col("last") - F.col("root") + 1).alias("reached"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: all nodes reachable from `start` (node) along edges (node, next). One join a step, until nothing is new; steps are written to the shared folder."""
    seen = written(start.select("node").distinct(), "closure")
    front = seen
    while True:
        front = written(front.join(edges, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"), "closure-front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def unpeeled(edges: DataFrame) -> DataFrame:
    """The edges (node, next) that stay when edges into nodes without an edge of their own are taken away, round by round, until none is left.

    What stays leads into a circle; a loop (node, node) keeps a node from ever being free. A round is one semi-join (a merge: ids pack well, so a file that looks small would be a large broadcast), written to the shared folder; rounds are as many as the longest way that ends.
    """
    left = written(edges.select("node", "next").distinct(), "unpeeled")
    size = left.count()
    while size:
        left = written(left.join(left.select(F.col("node").alias("next")).distinct().hint("merge"), "next", "left_semi").select("node", "next"), "unpeeled")
        before, size = size, left.count()
        if size == before:
            break
    return left


def quality_summary(reads: DataFrame) -> DataFrame:
    """doc_id, mean_q, q20 of arrays of qualities."""
    n = F.size("q")
    total = F.aggregate("q", F.lit(0), lambda a, x: a + x)
    good = F.size(F.filter("q", lambda x: x >= 20))
    return reads.select("doc_id", F.round(total / n, 6).alias("mean_q"), F.round(100.0 * good / n, 6).alias("q20"))


def ranked(rows: DataFrame, key: str, cell: Column, order: list) -> DataFrame:
    """rows with rank within the key by `order`, whose first parts are told by `cell` (larger cells come later).

    A key's rows are numbered cell by cell and the counts of earlier cells are added, so that a hot key is not one task.
    """
    r = rows.withColumn("_cell", cell)
    counts = r.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order))
    return r.withColumn("_within", within).join(counts.select(key, "_cell", before.alias("_before")), [key, "_cell"]).withColumn("rank", (F.col("_within") + F.col("_before")).cast("long")).drop("_cell", "_within", "_before")


def resolved_codons(code: DataFrame, iupac: dict[str, str]) -> DataFrame:
    """codon, residue, is_start of every codon of IUPAC symbols: a residue only if all of its plain codons agree, a start only if all are starts.

    code: codon, aa, is_start. Each plain codon is spread over the symbol codons that include it.
    """
    holds = {b: [k for k, v in iupac.items() if b in v] for b in "ACGT"}
    table = F.create_map(*[x for b, ks in holds.items() for x in (F.lit(b), F.array(*map(F.lit, ks)))])
    e = code
    for i in range(3):
        e = e.withColumn(f"s{i}", F.explode(F.try_element_at(table, F.substring("codon", i + 1, 1))))
    g = e.groupBy(F.concat("s0", "s1", "s2").alias("symbols")).agg(F.min("aa").alias("lo"), F.max("aa").alias("hi"), F.bool_and("is_start").alias("is_start"))
    return g.select(F.col("symbols").alias("codon"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("residue"), "is_start")


def reassigned(code: DataFrame, changes: DataFrame) -> DataFrame:
    """A genetic code (codon, aa, is_start) with changes (codon, new_aa); a start that becomes a stop is a start no longer."""
    aa = F.coalesce("new_aa", "aa")
    return code.join(changes, "codon", "left").select("codon", aa.alias("aa"), (F.col("is_start") & (aa != "*")).alias("is_start"))
