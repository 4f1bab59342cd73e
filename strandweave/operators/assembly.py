"""Products of primer pairs and ends that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequence import reverse_complement

LONGEST = 50_000


def pcr_products(bindings: DataFrame, templates: DataFrame, forward: tuple[str, str], reverse: tuple[str, str], longest: int = LONGEST, circular: bool = False) -> DataFrame:
    """doc_id, start, end, length, mismatches, wraps, tail, n, rank, rivals, conflict, product of every forward binding with every reverse binding behind it.

    Products are at most `longest`: bindings are filed under stretches of that length, so only near ones meet. On a circle a reverse
    binding before the forward one is reached over the origin. rank: longest annealed parts, fewest mismatches, shortest product, places;
    rivals are a template's other products; tail: bases of the forward oligo before its annealed part; n: length of the template. In the product the primers' own bases, tails included, take the template's place; conflict: overlapping primers disagree.
    forward, reverse: (name in bindings, oligo).
    """
    at = lambda c: F.floor(F.col(c) / longest)
    f = bindings.where((F.col("primer") == forward[0]) & (F.col("strand") == 1)).select("doc_id", "start", F.col("end").alias("f_end"), F.col("mismatches").alias("fm"), F.col("tail").alias("ft"))
    r = bindings.where((F.col("primer") == reverse[0]) & (F.col("strand") == -1)).select("doc_id", F.col("start").alias("r_start"), "end", F.col("mismatches").alias("rm"), F.col("tail").alias("rt"))
    n = templates.select("doc_id", "seq", F.length("seq").alias("n")).hint("merge")  # in a broadcast join a derived text is worked out once a match, not once a row
    f = f.join(n.select("doc_id", "n").hint("merge"), "doc_id").withColumn("bin", F.explode(F.array(at("start"), at("start") + 1, F.when(F.col("n") - F.col("start") <= longest, F.lit(-1).cast("long")))))
    last = F.col("end") - 1
    r = r.withColumn("bin", F.explode(F.array(F.floor(last / longest), F.when(F.col("end") <= longest, F.lit(-1).cast("long")))))
    wraps = F.col("end") <= F.col("start")
    j = f.where("bin IS NOT NULL").join(r.where("bin IS NOT NULL"), ["doc_id", "bin"]).withColumn("wraps", wraps)
    j = j.where((F.col("bin") == -1) == F.col("wraps"))
    if not circular:
        j = j.where("NOT wraps")
    inner = F.when(F.col("wraps"), F.col("n") - F.col("start") + F.col("end")).otherwise(F.col("end") - F.col("start"))
    j = j.withColumn("length", inner + F.col("ft") + F.col("rt")).where(F.col("length") <= longest)
    annealed = F.col("f_end") - F.col("start") + F.col("end") - F.col("r_start")
    order = Window.partitionBy("doc_id").orderBy(annealed.desc(), F.col("fm") + F.col("rm"), "length", "start", "r_start")
    j = j.withColumn("rank", F.row_number().over(order)).withColumn("rivals", (F.count("*").over(Window.partitionBy("doc_id")) - 1).cast("int")).join(n.select("doc_id", "seq"), "doc_id")
    product, conflict = amplicon(F.col("seq"), F.lit(forward[1]), F.lit(reverse[1]))
    return j.select("doc_id", "start", "end", "length", (F.col("fm") + F.col("rm")).alias("mismatches"), "wraps", F.col("ft").alias("tail"), "n", "rank", "rivals", conflict.alias("conflict"), product.alias("product"))


def amplicon(seq: Column, forward: Column, reverse: Column) -> tuple[Column, Column]:
    """The product of bindings [start, f_end) and [r_start, end): both oligos with what lies between; and whether overlapping oligos disagree."""
    back = reverse_complement(reverse)
    cut = lambda a, b: F.substring(seq, (a + 1).cast("int"), (b - a).cast("int"))
    between = F.when(F.col("wraps"), F.concat(cut(F.col("f_end"), F.col("n")), cut(F.lit(0), F.col("r_start")))).otherwise(cut(F.col("f_end"), F.greatest("f_end", "r_start")))
    shared = F.when(F.col("wraps"), 0).otherwise(F.greatest(F.lit(0), F.col("f_end") - F.col("r_start")))
    own = F.least(shared, F.col("end") - F.col("r_start")).cast("int")
    skip = F.greatest(F.lit(0), F.col("start") - F.col("r_start")).cast("int")
    conflict = (own > 0) & (F.substring(forward, F.length(forward) - (F.col("f_end") - F.greatest("start", "r_start")) + 1, own - skip) != F.substring(back, skip + 1, own - skip))
    return F.concat(forward, between, F.substring(back, own + 1, F.length(back))), conflict


def fitting_ends(ends: DataFrame) -> DataFrame:
    """doc_id, fragment, fits: how many left ends of the same source each right end could join. ends: doc_id, fragment, right_end, left_end."""
    lefts = ends.groupBy("doc_id", F.col("left_end").alias("want")).agg(F.count("*").alias("fits"))
    return ends.withColumn("want", reverse_complement(F.col("right_end"))).join(lefts, ["doc_id", "want"], "left").select("doc_id", "fragment", F.coalesce("fits", F.lit(0)).alias("fits"))


def ligations(parts: DataFrame, circular: bool = False) -> DataFrame:
    """design, ord, junction, ambiguous of ordered parts (design, ord, left, left_type, right, right_type): whether each right end joins its successor's left end.

    Two blunt ends join; sticky ones do if their types agree and one is the other's reverse complement. A junction is ambiguous if
    its end also fits another left end of the design, and always where it is blunt. The last part of a line is open.
    """
    w = Window.partitionBy("design").orderBy("ord")
    own = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(own)) if circular else F.lead(c).over(w) for c in ("left", "left_type")}
    p = parts.withColumn("next", nxt["left"]).withColumn("next_type", nxt["left_type"])
    blunt = lambda t: F.col(t) == "blunt"
    fits = F.when(F.col("next_type").isNull(), "open").when(blunt("right_type") & blunt("next_type"), "blunt").when((F.col("right_type") == F.col("next_type")) & ~blunt("right_type") & (F.col("next") == reverse_complement(F.col("right"))), "compatible").otherwise("incompatible")
    lefts = parts.groupBy("design", F.col("left").alias("want"), F.col("left_type").alias("right_type")).agg(F.count("*").alias("k"))
    p = p.withColumn("junction", fits).withColumn("want", reverse_complement(F.col("right"))).join(lefts, ["design", "want", "right_type"], "left")
    more = F.when(F.col("junction") == "blunt", True).when(F.col("junction") == "compatible", F.col("k") > 1).when(F.col("junction") == "incompatible", F.coalesce("k", F.lit(0)) > 0).otherwise(False)
    return p.select("design", "ord", "junction", more.alias("ambiguous"))
