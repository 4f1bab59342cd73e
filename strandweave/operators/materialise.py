"""Child records of a digest and their audit: what is saved is held against what the recipe gives now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: what an audit can say, in the order in which it looks ---
ISSUES = ["missing_parent", "stale_parent", "missing_child", "unexpected_child", "duplicate_child", "changed_bounds", "changed_ends", "changed_enzymes", "changed_sequence"]


def digest_children(fragments: DataFrame, parents: DataFrame) -> DataFrame:
    """parent, fragment, start, end, ends, enzymes, sha256, parent_sha256: one record a fragment of `restriction.fragments`. parents: doc_id, seq.

    The parent's hash travels with its children, so a record says by itself from which bases it was made.
    """
    # the hash is worked out before the join's exchange, once a parent
    p = parents.select(F.col("doc_id").alias("parent"), F.concat("seq", "seq").alias("_twice"), F.sha2("seq", 256).alias("parent_sha256")).hint("merge")
    f = fragments.select(F.col("doc_id").alias("parent"), "fragment", "start", "end", F.concat_ws("/", F.concat_ws(":", "left_type", "left_end"), F.concat_ws(":", "right_type", "right_end")).alias("ends"), F.concat_ws("/", "left_enzymes", "right_enzymes").alias("enzymes"))
    bases = F.substring(F.col("_twice"), F.col("start") + 1, F.col("end") - F.col("start"))
    return f.join(p, "parent").select(*f.columns, F.sha2(bases, 256).alias("sha256"), "parent_sha256")


def audited(saved: DataFrame, fresh: DataFrame, parents: DataFrame) -> DataFrame:
    """parent, fragment, issue: every difference of saved children from those that the recipe gives now; no row for what is the same.

    saved, fresh: rows of `digest_children`; parents: parent, sha256 as they are today. missing_parent: it is gone; stale_parent: its bases have changed since
    (its children are then not compared further); missing_child: the recipe gives one that is not saved, for parents that have saved children;
    unexpected_child: the recipe does not give it; duplicate_child: saved more than once; changed_*: another value. A null is a value: two are the same.
    """
    same = lambda a, b: a.eqNullSafe(b)
    values = ["start", "end", "ends", "enzymes", "sha256"]
    s = saved.select("parent", "fragment", *values, "parent_sha256", (F.count("*").over(Window.partitionBy("parent", "fragment")) > 1).alias("_twice"))
    s = s.join(parents.select("parent", F.col("sha256").alias("_now"), F.lit(True).alias("_there")), "parent", "left")
    s = s.withColumns({"_stale": F.when(F.col("_there").isNull(), "missing_parent").when(~same(F.col("parent_sha256"), F.col("_now")), "stale_parent"), "_kept": F.lit(True)})
    new = fresh.select("parent", "fragment", *[F.col(c).alias("f_" + c) for c in values], F.lit(True).alias("_made"))
    own = Window.partitionBy("parent")
    j = s.join(new, ["parent", "fragment"], "full").withColumns({"_any": F.max("_kept").over(own), "_odd": F.max(F.col("_stale").isNotNull()).over(own)})
    both = F.col("_stale").isNull() & F.col("_kept") & F.col("_made")
    differs = lambda *cs: both & ~_all([same(F.col(c), F.col("f_" + c)) for c in cs])
    found = {
        "missing_parent": F.col("_stale") == "missing_parent", "stale_parent": F.col("_stale") == "stale_parent", "missing_child": F.col("_kept").isNull() & F.col("_any") & ~F.col("_odd"), "unexpected_child": F.col("_stale").isNull() & F.col("_kept") & F.col("_made").isNull() & ~F.col("_odd"),
        "duplicate_child": F.col("_twice"), "changed_bounds": differs("start", "end"), "changed_ends": differs("ends"), "changed_enzymes": differs("enzymes"), "changed_sequence": differs("sha256"),
    }
    return j.select("parent", "fragment", F.explode(F.array_compact(F.array(*[F.when(found[i], i) for i in ISSUES]))).alias("issue")).distinct()


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
