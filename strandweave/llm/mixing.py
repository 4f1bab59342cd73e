"""Temperature mixing of sources, realised as budgeted block permutations; DataFrame functions only.

Weights are the sources' token shares to the power alpha, normalised: alpha 1 is the corpus as it is,
alpha 0 gives all sources alike. alpha is bisected twice, for the entropy asked for and for the limit on
repetition, and the larger one holds. A source's quota is its weight of the token budget. It is realised
as whole epochs of the source and a part of one more: documents lie in blocks of about BLOCK_ROWS by a
hash, every epoch has its own permutation of the blocks, whole blocks are taken in that order while they
fit and the first that does not fit gives its documents in hash order as far as they fit.

Scale. Sources are a table like any other: alpha is bisected by aggregates over it (a row each for 100 tries
a round, three rounds), so the number of sources is not bounded by the driver. Rows meet the tables of sources
and blocks in plain joins: small tables are broadcast by their measured size, large ones are shuffled and hot
keys split. Blocks are summed and ordered, not rows, and their order is by ranges of its hash, so a source
with a third of all rows has no sort of its own; only the one cut block of each source is sorted. Texts
are read for their sizes and, where whole rows are asked for, once more, but are not shuffled for it.

A token is four bytes of text, and one for the document's end. A null source is the source ''; null and
empty texts count one token. Repeated rows are kept and counted, and go in or out together. A null doc_id is hashed as none.
Columns of any other name are no matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.common import documents, written

BLOCK_ROWS = 5000


TRIES, DIGITS = 100, 6
ORDER_CELLS = 1024


def tried(sources: DataFrame, alphas: list[float]) -> list:
    """For each alpha: entropy of the weights, and the largest repetition for a budget of all tokens and for the smallest whole budget."""
    each = sources.select("p", F.posexplode(F.array(*[F.lit(a) for a in alphas])).alias("i", "a")).select("i", "a", "p", F.pow("p", "a").alias("x"))
    sums = each.groupBy("i", "a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.max(F.pow("p", 1 - F.col("a"))).alias("least"))
    return sums.select("i", (F.log("z") - F.col("a") * F.col("s") / F.col("z")).alias("entropy"), (F.col("most") / F.col("z")).alias("repeats"), (F.col("most") * F.col("least")).alias("whole_repeats"), (F.col("least") * F.col("z")).alias("whole_budget")).orderBy("i").collect()


def bisect_alpha(sources: DataFrame, budget_share: float | None, flatten: float, most_repeats: float) -> float:
    """Smallest alpha in [0, 1], to six digits, whose entropy is at most natural + flatten * (uniform - natural) and whose repetition is within the limit; 1 if none is.

    sources: p, the token share of each. Both bounds fall as alpha grows, so each round keeps one of TRIES intervals.
    """
    uniform, natural = tried(sources, [0.0, 1.0])
    goal = natural["entropy"] + flatten * (uniform["entropy"] - natural["entropy"])

    def fits(r) -> bool:
        repeats = r["whole_repeats"] if budget_share is None else r["repeats"] * budget_share
        return r["entropy"] <= goal + 1e-12 and repeats <= most_repeats + 1e-12

    if fits(uniform):
        return 0.0
    low, width = 0, 10**DIGITS  # the answer lies in (low, low + width]
    while width > 1:
        step = -(-width // TRIES)
        at = [min(low + step * k, low + width) for k in range(1, -(-width // step) + 1)]
        good = next((k for k, r in enumerate(tried(sources, [x / 10**DIGITS for x in at])) if fits(r)), None)
        if good is None:
            return 1.0
        low, width = (at[good - 1] if good else low), at[good] - (at[good - 1] if good else low)
    return (low + 1) / 10**DIGITS


def hash32(*parts: Column | str) -> Column:
    """Alike in any SQL engine with md5: the first eight hex digits of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def copies(docs: DataFrame, budget_share: float | None = 1.0, flatten: float = 0.5, most_repeats: float = 4.0, block_rows: int = BLOCK_ROWS, seed: int = 7, whole_rows: bool = False) -> DataFrame:
    """doc_id, source, tokens, block, weight, copies of every row of `docs`; whole_rows: and the row itself as the struct `row`.

    budget_share: of the corpus's tokens; None: the smallest budget that leaves no document out.
    """
    size = (F.ceil(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) / 4) + 1).cast("long")
    every = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), size.alias("tokens"), *every).withColumn("pick", hash32(F.lit(str(seed)), F.col("doc_id").cast("string")))
    small = written(base.drop("row"), "op7-sizes")  # else the texts would be read for every pass
    if not whole_rows:
        base = small
    totals = written(small.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "op7-totals")
    total = totals.agg(F.sum("t")).first()[0]
    if not total:
        return base.select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("copies"), *(["row"] if whole_rows else []))
    shares = totals.withColumn("p", F.col("t") / F.lit(float(total)))
    alpha = bisect_alpha(shares, budget_share, flatten, most_repeats)
    at = tried(shares, [alpha])[0]
    power = F.pow("p", F.lit(alpha))
    norm = shares.agg(F.sum(power)).first()[0]
    if budget_share is None:
        quota = F.greatest("t", F.floor(F.col("weight") * F.lit(total * at["whole_budget"])))
    else:
        quota = F.floor(F.col("weight") * F.lit(int(total * budget_share)))
    plan = shares.withColumn("weight", power / F.lit(norm)).withColumn("quota", quota)
    plan = plan.select("source", "weight", F.expr("quota div t").alias("whole"), (F.col("quota") % F.col("t")).alias("rest"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    plan = written(plan, "op7-sources")  # joined by its measured size
    block = F.pmod(F.col("pick"), F.col("blocks"))
    order = hash32(F.lit(str(seed)), "source", F.col("block").cast("string"), F.col("whole").cast("string"))
    sums = small.join(plan, "source").withColumn("block", block).groupBy("source", "block", "whole", "rest").agg(F.sum("tokens").alias("t"))
    sums = written(sums.withColumn("order", order).withColumn("cell", F.shiftright("order", 32 - ORDER_CELLS.bit_length() + 1)), "op7-blocks")
    cells = sums.groupBy("source", "cell").agg(F.sum("t").alias("t"))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "cell", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "cell").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.join(cells, ["source", "cell"]).withColumn("before", F.col("base") + F.coalesce(F.sum("t").over(within), F.lit(0)))
    state = F.when(F.col("before") + F.col("t") <= F.col("rest"), "in").when(F.col("before") < F.col("rest"), "cut").otherwise("out")
    cut = written(cut.select("source", "block", "before", "rest", state.alias("state")), "op7-states")
    # Of each source's one cut block, the last document that still fits, in the order of (pick, doc_id); equal rows go together.
    edge = cut.where("state = 'cut'").select("source", "block", "before", "rest")
    upto = Window.partitionBy("source").orderBy("pick", "doc_id").rangeBetween(Window.unboundedPreceding, 0)
    edge = small.join(plan.select("source", "blocks"), "source").withColumn("block", block).join(edge, ["source", "block"]).withColumn("upto", F.col("before") + F.sum("tokens").over(upto))
    edge = written(edge.where("upto <= rest").groupBy("source").agg(F.max(F.struct("pick", "doc_id")).alias("last")), "op7-edges")
    # Every block's own row of the plan: one join by source gives the number of blocks, one by block its state.
    rows = base.join(plan, "source").withColumn("block", block).join(cut.select("source", "block", "state"), ["source", "block"]).join(edge, "source", "left")
    more = F.when(F.col("state") == "in", 1).when((F.col("state") == "cut") & F.coalesce(F.struct("pick", "doc_id") <= F.col("last"), F.lit(False)), 1).otherwise(0)
    return rows.select("doc_id", "source", "tokens", "block", "weight", (F.col("whole") + more).alias("copies"), *(["row"] if whole_rows else []))


def mixed(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """One row for each realised copy: doc_id, source, tokens, weight, epoch, block, block_order, row_order."""
    each = copies(docs, seed=seed, **how).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    epoch = F.col("epoch").cast("string")
    return each.select(
        "doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "epoch", "block",
        hash32(F.lit(str(seed)), "source", F.col("block").cast("string"), epoch).alias("block_order"),
        hash32(F.lit(str(seed)), F.col("doc_id").cast("string"), epoch).alias("row_order"),
    )


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


OP7_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) + 1 AS tokens,
         CAST('0x' || substr(md5('7|' || doc_id), 1, 8) AS BIGINT) AS pick FROM documents
), stats AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS t, count(*) AS n FROM base GROUP BY source),
tot AS (SELECT CAST(sum(t) AS BIGINT) AS total, count(*) AS k FROM stats),
shares AS (SELECT list(CAST(t AS DOUBLE) / total ORDER BY source) AS p FROM stats, tot),
goal AS (
  SELECT p, h + 0.5 * (ln(len(p)) - h) AS goal
  FROM (SELECT p, -list_sum(list_transform(p, lambda x: x * ln(x))) AS h FROM shares)
), ent AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, ln(z) - mid * list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) / z <= goal + 1e-12 AS ok FROM (
      SELECT i, lo, hi, p, goal, (lo + hi) / 2 AS mid, list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS z FROM ent, goal WHERE i < 50))
), rep AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, list_max(list_transform(p, lambda x: pow(x, mid - 1))) / z <= 4.0 + 1e-12 AS ok FROM (
      SELECT i, lo, hi, p, (lo + hi) / 2 AS mid, list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS z FROM rep, goal WHERE i < 50))
), flat AS (
  SELECT ln(len(p)) <= goal + 1e-12 AS ent_ok, list_max(list_transform(p, lambda x: 1 / x)) / len(p) <= 4.0 + 1e-12 AS rep_ok FROM goal
), alpha AS (
  SELECT ceil(greatest(CASE WHEN ent_ok THEN 0 ELSE (SELECT max_by(hi, i) FROM ent) END, CASE WHEN rep_ok THEN 0 ELSE (SELECT max_by(hi, i) FROM rep) END) * 1e6 - 1e-6) / 1e6 AS a FROM flat
), raw AS (SELECT source, t, n, total, pow(CAST(t AS DOUBLE) / total, a) AS x FROM stats, tot, alpha),
quota AS (SELECT source, t, n, x / (sum(x) OVER ()) AS weight, CAST(floor(x / (sum(x) OVER ()) * total) AS BIGINT) AS q FROM raw),
plan AS (SELECT source, weight, q // t AS whole, q % t AS rest, (n + 4999) // 5000 AS blocks FROM quota),
rws AS (SELECT b.*, weight, whole, rest, pick % blocks AS block FROM base b JOIN plan USING (source)),
sums AS (
  SELECT source, block, whole, rest, CAST(sum(tokens) AS BIGINT) AS t,
         CAST('0x' || substr(md5('7|' || source || '|' || block || '|' || whole), 1, 8) AS BIGINT) AS ord FROM rws GROUP BY ALL
), cut AS (
  SELECT source, block, t, rest, coalesce(sum(t) OVER (PARTITION BY source ORDER BY ord, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sums
), marked AS (
  SELECT r.*, before, CASE WHEN before + c.t <= c.rest THEN 1 WHEN before < c.rest THEN 2 ELSE 0 END AS state FROM rws r JOIN cut c USING (source, block)
), counted AS (
  SELECT *, whole + CASE WHEN state < 2 THEN state
    WHEN before + sum(tokens) OVER (PARTITION BY source, state ORDER BY pick, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM marked
), each AS (SELECT *, unnest(range(CAST(copies AS BIGINT))) AS epoch FROM counted WHERE copies > 0)
SELECT doc_id, source, tokens, round(weight, 9) AS weight, epoch, block,
       CAST('0x' || substr(md5('7|' || source || '|' || block || '|' || epoch), 1, 8) AS BIGINT) AS block_order,
       CAST('0x' || substr(md5('7|' || doc_id || '|' || epoch), 1, 8) AS BIGINT) AS row_order
FROM each
"""
