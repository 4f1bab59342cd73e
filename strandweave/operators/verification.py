"""Evidence of reads on a reference: coverage, consensus, variants, required regions.

Read columns are rows (ref, pos, read, base, strand, q). Everything is a hash aggregation on (ref, pos, base):
counts are summed in the task that reads them, so a deep position costs no more than a shallow one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_call_per_read(columns: DataFrame) -> DataFrame:
    """The best call of each read at each position: highest quality, then smallest base."""
    best = F.min(F.struct((-F.col("q")).alias("m"), "base", "strand"))
    return columns.groupBy("ref", "pos", "read").agg(best.alias("x")).select("ref", "pos", "read", "x.base", "x.strand", (-F.col("x.m")).alias("q"))


def coverage(calls: DataFrame) -> DataFrame:
    """ref, pos, depth, forward, reverse."""
    return calls.groupBy("ref", "pos").agg(F.count("*").alias("depth"), F.count_if(F.col("strand") == 1).alias("forward"), F.count_if(F.col("strand") == -1).alias("reverse"))


def consensus(calls: DataFrame, least_share: float = 0.7) -> DataFrame:
    """ref, pos, call: the base with most weight (quality + 1); N if two tie or the best has less than the least share."""
    w = calls.groupBy("ref", "pos", "base").agg(F.sum(F.col("q") + 1).alias("w"))
    top = w.groupBy("ref", "pos").agg(F.sum("w").alias("total"), F.max("w").alias("best"), F.array_sort(F.collect_list(F.struct("w", "base"))).alias("all"))
    ties = F.size(F.filter("all", lambda x: x["w"] == F.col("best")))
    base = F.element_at("all", -1)["base"]
    return top.select("ref", "pos", F.when((ties > 1) | (F.col("best") < least_share * F.col("total")), "N").otherwise(base).alias("call"))


def variants(calls: DataFrame, reference: Column, min_support: int = 2) -> DataFrame:
    """ref, pos, base, support, depth, share (of weight), mean_q, confidence of every base unlike the reference. reference: an expression over ref and pos."""
    per = calls.groupBy("ref", "pos", "base").agg(F.count("*").alias("support"), F.sum(F.col("q") + 1).alias("w"), F.avg("q").alias("mean_q"))
    total = per.groupBy("ref", "pos").agg(F.sum("support").alias("depth"), F.sum("w").alias("total"))
    v = per.join(total, ["ref", "pos"]).where(F.col("base") != reference)
    high = (F.col("support") >= min_support) & (F.col("mean_q") >= 20)
    return v.select("ref", "pos", "base", "support", "depth", F.round(F.col("w") / F.col("total"), 6).alias("share"), F.round("mean_q", 6).alias("mean_q"), F.when(high, "high").otherwise("low").alias("confidence"))


def regions(cover: DataFrame, asked: DataFrame) -> DataFrame:
    """ref, start, end, covered, least, status of required regions (ref, start, end, min_depth, both_strands)."""
    each = asked.withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1)))
    j = each.join(cover, ["ref", "pos"], "left").fillna(0, ["depth", "forward", "reverse"])
    ok = (F.col("depth") >= F.col("min_depth")) & (~F.col("both_strands") | ((F.col("forward") > 0) & (F.col("reverse") > 0)))
    g = j.groupBy("ref", "start", "end").agg(F.count_if(ok).alias("covered"), F.min("depth").alias("least"), F.count("*").alias("n"))
    return g.select("ref", "start", "end", "covered", "least", F.when(F.col("covered") == F.col("n"), "met").otherwise("unmet").alias("status"))
