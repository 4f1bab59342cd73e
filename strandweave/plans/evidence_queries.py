"""Queries of verification, assembly, ranking and streaming operators; numbers in comments are rows of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators import alignment, assembly, relations, scans, verification
from strandweave.plans.catalog import register
from strandweave.plans.scalar_queries import OLIGOS, SEQS, n_sql, oligos, seqs
from strandweave.session import table
from strandweave.streaming import windows

# Order lines as read columns: a read is an order, its reference is a supplier group.
CALLS = """cols AS (SELECT l_suppkey % 7 AS ref, l_partkey % 300 AS pos, l_orderkey AS read, substr('ACGT', CAST(l_suppkey % 4 + 1 AS BIGINT), 1) AS base, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS strand, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
calls AS MATERIALIZED (SELECT ref, pos, read, x.base AS base, x.strand AS strand, -x.m AS q FROM (SELECT ref, pos, read, min({'m': -q, 'base': base, 'strand': strand}) AS x FROM cols GROUP BY ALL))"""


def calls(spark, d):
    li = table(spark, d, "lineitem")
    cols = li.select(
        (F.col("l_suppkey") % 7).alias("ref"), (F.col("l_partkey") % 300).alias("pos"), F.col("l_orderkey").alias("read"),
        F.lit("ACGT").substr((F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1)).alias("base"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1).alias("strand"), F.col("l_quantity").cast("int").alias("q"),
    )
    return verification.one_call_per_read(cols)


@register("read_coverage", f"WITH {CALLS} SELECT ref, pos, count(*) AS depth, count_if(strand = 1)::BIGINT AS forward, count_if(strand = -1)::BIGINT AS reverse FROM calls GROUP BY ref, pos")
def read_coverage(spark, d):  # 104
    return verification.coverage(calls(spark, d))


@register("read_consensus", f"WITH {CALLS}, w AS (SELECT ref, pos, base, sum(q + 1) AS w FROM calls GROUP BY ALL), t AS (SELECT ref, pos, sum(w) AS total, max(w) AS best FROM w GROUP BY ALL) SELECT ref, pos, CASE WHEN count(*) > 1 OR any_value(best) < 0.7 * any_value(total) THEN 'N' ELSE any_value(base) END AS call FROM w JOIN t USING (ref, pos) WHERE w = best GROUP BY ref, pos")
def read_consensus(spark, d):  # 105
    return verification.consensus(calls(spark, d))


@register("observed_variants", f"WITH {CALLS}, p AS (SELECT ref, pos, base, count(*) AS support, sum(q + 1) AS w, avg(q) AS mq FROM calls GROUP BY ALL), t AS (SELECT ref, pos, sum(support)::BIGINT AS depth, sum(w) AS total FROM p GROUP BY ALL) SELECT ref, pos, base, support, depth, round(w::DOUBLE / total, 6) AS share, round(mq, 6) AS mean_q, CASE WHEN support >= 2 AND mq >= 20 THEN 'high' ELSE 'low' END AS confidence FROM p JOIN t USING (ref, pos) WHERE base <> substr('ACGT', CAST(pos % 4 + 1 AS BIGINT), 1)")
def observed_variants(spark, d):  # 106
    return verification.variants(calls(spark, d), F.lit("ACGT").substr((F.col("pos") % 4 + 1).cast("int"), F.lit(1)))


@register("required_regions", f"""WITH {CALLS}, c AS (SELECT ref, pos, count(*) AS depth, count_if(strand = 1) AS f, count_if(strand = -1) AS r FROM calls GROUP BY ref, pos), a AS (SELECT ref, s * 25 AS start, s * 25 + 25 AS "end", unnest(range(s * 25, s * 25 + 25)) AS pos FROM (SELECT DISTINCT l_suppkey % 7 AS ref FROM lineitem), range(12) t(s)),
j AS (SELECT a.*, coalesce(depth, 0) AS depth, coalesce(depth, 0) >= 3 AND coalesce(f, 0) > 0 AND coalesce(r, 0) > 0 AS ok FROM a LEFT JOIN c USING (ref, pos)) SELECT ref, start, "end", count_if(ok)::BIGINT AS covered, min(depth) AS least, CASE WHEN bool_and(ok) THEN 'met' ELSE 'unmet' END AS status FROM j GROUP BY ref, start, "end" """)
def required_regions(spark, d):  # 104
    c = calls(spark, d)
    asked = c.select("ref").distinct().withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(275).cast("long"), F.lit(25).cast("long")))).selectExpr("ref", "start", "start + 25 AS end", "3 AS min_depth", "true AS both_strands")
    return verification.regions(verification.coverage(c), asked)


FORWARD, REVERSE = "GACTCA", "TGCATC"
_BACK = facts.reverse_complement(REVERSE)


@register("pcr_products", f"""WITH {SEQS}, h AS (SELECT doc_id, n, p, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w) AS g FROM (SELECT doc_id, length(seq) AS n, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, n, p FROM h WHERE g = '{FORWARD}'), r AS (SELECT doc_id, p FROM h WHERE g = '{_BACK}'),
j AS (SELECT doc_id, n, f.p AS s, r.p AS rs, r.p + 6 AS e, r.p + 6 <= f.p AS wraps FROM f JOIN r USING (doc_id)), k AS (SELECT *, CASE WHEN wraps THEN n - s + e ELSE e - s END AS len FROM j),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len, s, rs) AS rank, count(*) OVER (PARTITION BY doc_id) - 1 AS rivals FROM k WHERE len <= 2000)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", CAST(len AS INTEGER) AS length, 0 AS mismatches, wraps, CAST(rank AS INTEGER) AS rank, CAST(rivals AS INTEGER) AS rivals, sha256(CASE WHEN wraps THEN substr(seq, s + 1) || left(seq, e) ELSE substr(seq, s + 1, len) END) AS product FROM m JOIN seqs USING (doc_id) WHERE rank <= 20""")
def pcr_products(spark, d):  # 69, 70: the twenty best products of each circle, up to 2,000 bases
    s = seqs(spark, d)
    p = assembly.pcr_products(scans.primer_bindings(s, [("f", FORWARD), ("r", REVERSE)], 0, 6), s, ("f", FORWARD), ("r", REVERSE), longest=2000, circular=True).where("rank <= 20")
    return p.select("doc_id", "start", "end", "length", "mismatches", "wraps", "rank", "rivals", F.sha2("product", 256).alias("product"))


@register("primer_bindings", f"""WITH {SEQS}, c AS (SELECT doc_id, p, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w, lead(c, 6) OVER w, lead(c, 7) OVER w, lead(c, 8) OVER w, lead(c, 9) OVER w) AS g FROM (SELECT doc_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, p, g, right(g, 6) = 'CTAGAC' AS exact, list_sum(list_transform(range(1, 5), lambda i: CASE WHEN substr(g, i, 1) <> substr('GATTCTAGAC', i, 1) THEN 1 ELSE 0 END)) AS wrong, CASE WHEN substr(g, 4, 1) <> 'T' THEN 6 WHEN substr(g, 3, 1) <> 'T' THEN 7 WHEN substr(g, 2, 1) <> 'A' THEN 8 WHEN substr(g, 1, 1) <> 'G' THEN 9 ELSE 10 END AS run FROM c WHERE length(g) = 10)
SELECT doc_id, CAST(p AS INTEGER) AS start, CAST(wrong AS INTEGER) AS mismatches, CAST(run AS INTEGER) AS run FROM f WHERE exact AND wrong <= 2""")
def primer_bindings(spark, d):  # 69: two mismatches allowed behind six matching bases
    return scans.primer_bindings(seqs(spark, d), [("p", "GATTCTAGAC")], 2, 6).where("strand = 1").select("doc_id", "start", "mismatches", "run")


@register("codon_usage", f"WITH {SEQS}, c AS (SELECT lang, unnest(regexp_extract_all(seq, '...')) AS codon FROM seqs JOIN documents USING (doc_id)), n AS (SELECT lang, codon, count(*) AS n FROM c GROUP BY ALL) SELECT lang, codon, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang), 9) AS share FROM n")
def codon_usage(spark, d):  # 46
    s = table(spark, d, "documents").where("text IS NOT NULL").select("lang", S.as_bases(F.col("text")).alias("seq"))
    n = s.select("lang", F.explode(F.regexp_extract_all("seq", F.lit("..."), F.lit(0))).alias("codon")).groupBy("lang", "codon").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 9))


_TM = f"CASE WHEN length(seq) <= 20 THEN 2.0 * ({n_sql('seq', 'A')} + {n_sql('seq', 'T')}) + 4.0 * ({n_sql('seq', 'G')} + {n_sql('seq', 'C')}) ELSE 64.9 + 41 * ({n_sql('seq', 'G')} + {n_sql('seq', 'C')} - 16.4) / length(seq) END"
_TESTS = f"t AS (SELECT seq, ({n_sql('seq', 'G')} + {n_sql('seq', 'C')})::DOUBLE / length(seq) BETWEEN 0.3 AND 0.7 AS gc_ok, {_TM} BETWEEN 26 AND 40 AS tm_ok, regexp_matches(right(seq, 5), '[GC]') AS clamp_ok, {_TM} AS tm FROM oligos)"


def tests(spark, d):
    tm = S.quick_tm(F.col("seq"))
    return oligos(spark, d).select("seq", S.gc_fraction(F.col("seq")).between(0.3, 0.7).alias("gc_ok"), tm.between(26, 40).alias("tm_ok"), S.gc_clamp(F.col("seq")).alias("clamp_ok"), tm.alias("tm"))


@register("rejection_counts", f"WITH {OLIGOS}, {_TESTS}, r AS (SELECT CASE WHEN NOT gc_ok THEN 'gc' WHEN NOT tm_ok THEN 'tm' WHEN NOT clamp_ok THEN 'clamp' ELSE 'accepted' END AS first_reason, (NOT gc_ok)::INT + (NOT tm_ok)::INT + (NOT clamp_ok)::INT AS k FROM t) SELECT first_reason, count(*) AS n, count_if(k > 1)::BIGINT AS also_failed FROM r GROUP BY 1")
def rejection_counts(spark, d):  # 110
    first = F.when(~F.col("gc_ok"), "gc").when(~F.col("tm_ok"), "tm").when(~F.col("clamp_ok"), "clamp").otherwise("accepted")
    k = (~F.col("gc_ok")).cast("int") + (~F.col("tm_ok")).cast("int") + (~F.col("clamp_ok")).cast("int")
    return tests(spark, d).select(first.alias("first_reason"), k.alias("k")).groupBy("first_reason").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("also_failed"))


@register("primer_ranking", f"WITH {OLIGOS}, {_TESTS} SELECT seq, round(abs(tm - 34), 6)::DOUBLE AS score FROM t WHERE gc_ok AND tm_ok AND clamp_ok ORDER BY score, seq LIMIT 100")
def primer_ranking(spark, d):  # 120, 121: the best hundred is the feature
    t = tests(spark, d).where("gc_ok AND tm_ok AND clamp_ok").select("seq", F.round(F.abs(F.col("tm") - 34), 6).alias("score"))
    return t.orderBy("score", "seq").limit(100)


@register("duplicate_products", "SELECT doc_id, sha256(text) AS key, count(*) OVER (PARTITION BY text) > 1 AS duplicate FROM documents WHERE text IS NOT NULL")
def duplicate_products(spark, d):  # 89, 90: counts by key are joined back, so a hot key is split
    x = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("key"))
    n = x.groupBy("key").agg((F.count("*") > 1).alias("duplicate"))
    return x.join(n, "key").select("doc_id", "key", "duplicate")


@register("tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):  # an extension of ours
    return windows.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("rollup_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, d):  # 111
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


_IUPAC = ", ".join(f"('{k}', {sum(1 << 'ACGT'.index(c) for c in v)})" for k, v in facts.IUPAC.items())


@register("residue_classes", f"WITH m(s, x) AS (VALUES {_IUPAC}) SELECT a.s AS a, b.s AS b, CASE WHEN a.s = b.s AND a.s <> 'N' THEN 'match' WHEN a.x & b.x <> 0 THEN 'ambiguous' ELSE 'substitution' END AS class FROM m a, m b")
def residue_classes(spark, d):  # 55
    one = spark.createDataFrame([(k,) for k in facts.IUPAC], "a string")
    return one.withColumn("b", F.explode(F.array(*map(F.lit, facts.IUPAC)))).select("a", "b", S.residue_class(F.col("a"), F.col("b")).alias("class"))


_AMINO = "ACDEFGHIKLMNPQRSTVWYBZJX"


@register("protein_residue_classes", f"""WITH m AS (SELECT s, CASE s WHEN 'B' THEN ['D', 'N'] WHEN 'Z' THEN ['E', 'Q'] WHEN 'J' THEN ['I', 'L'] WHEN 'X' THEN string_split('ACDEFGHIKLMNPQRSTVWY', '') ELSE [s] END AS x FROM (SELECT unnest(string_split('{_AMINO}', '')) AS s)) SELECT a.s AS a, b.s AS b, CASE WHEN a.s = b.s AND a.s <> 'X' THEN 'match' WHEN list_has_any(a.x, b.x) THEN 'ambiguous' ELSE 'substitution' END AS class FROM m a, m b""")
def protein_residue_classes(spark, d):  # 55
    one = spark.createDataFrame([(k,) for k in _AMINO], "a string")
    return one.withColumn("b", F.explode(F.array(*map(F.lit, _AMINO)))).select("a", "b", S.residue_class(F.col("a"), F.col("b"), True).alias("class"))


def _code(spark, table_id):
    from itertools import product

    starts = set(facts.CODES[table_id][1].split())
    rows = [("".join(c), aa, "".join(c) in starts) for c, aa in zip(product(facts.BASES, repeat=3), facts.code_string(table_id), strict=True)]
    return spark.createDataFrame(rows, "codon string, aa string, is_start boolean")


_CODE = f"code AS (SELECT substr('TCAG', CAST(i // 16 + 1 AS BIGINT), 1) || substr('TCAG', CAST(i // 4 % 4 + 1 AS BIGINT), 1) || substr('TCAG', CAST(i % 4 + 1 AS BIGINT), 1) AS codon, substr('{facts.code_string(1)}', CAST(i + 1 AS BIGINT), 1) AS aa FROM range(64) t(i))"
_SYMBOLS = ", ".join(f"('{k}', '{v}')" for k, v in facts.IUPAC.items())


@register("resolved_codons", f"WITH {_CODE}, s AS (SELECT symbol, unnest(string_split(b, '')) AS base FROM (VALUES {_SYMBOLS}) v(symbol, b)), p AS (SELECT x.symbol || y.symbol || z.symbol AS codon, x.base || y.base || z.base AS plain FROM s x, s y, s z) SELECT p.codon, CASE WHEN min(aa) = max(aa) THEN min(aa) END AS residue, bool_and(plain IN ('TTG', 'CTG', 'ATG')) AS is_start FROM p JOIN code ON plain = code.codon GROUP BY p.codon")
def resolved_codons(spark, d):  # 41
    return relations.resolved_codons(_code(spark, 1), facts.IUPAC)


@register("reassigned_code", f"WITH {_CODE} SELECT codon, CASE codon WHEN 'TGA' THEN 'W' WHEN 'ATG' THEN '*' ELSE aa END AS aa, codon IN ('TTG', 'CTG') AS is_start FROM code")
def reassigned_code(spark, d):  # 45
    return relations.reassigned(_code(spark, 1), spark.createDataFrame([("TGA", "W"), ("ATG", "*")], "codon string, new_aa string"))


@register("edited_sequences", f"WITH {SEQS}, e AS (SELECT doc_id, seq, doc_id % 50 AS p FROM seqs) SELECT doc_id, sha256(CASE WHEN p < length(seq) THEN substr(seq, 1, p) || 'N' || substr(seq, p + 2) ELSE seq END) AS substituted, sha256(CASE WHEN p < length(seq) THEN substr(seq, 1, p + 1) || 'GATTACA' || substr(seq, p + 2) ELSE seq END) AS inserted, sha256(CASE WHEN p < length(seq) THEN substr(seq, 1, p) || substr(seq, p + 6) ELSE seq END) AS deleted FROM e")
def edited_sequences(spark, d):  # 135
    s, p = F.col("seq"), (F.col("doc_id") % 50).cast("int")
    return seqs(spark, d).select("doc_id", F.sha2(S.substituted(s, p, F.lit("N")), 256).alias("substituted"), F.sha2(S.inserted(s, p, F.lit("GATTACA")), 256).alias("inserted"), F.sha2(S.deleted(s, p, F.lit(5)), 256).alias("deleted"))


@register("variant_labels", f"WITH {CALLS} SELECT DISTINCT ref, pos, base, substr('ACGT', CAST(pos % 4 + 1 AS BIGINT), 1) || '>' || base || ' at ' || (pos + 1) AS label FROM calls WHERE base <> substr('ACGT', CAST(pos % 4 + 1 AS BIGINT), 1)")
def variant_labels(spark, d):  # 51
    r = F.lit("ACGT").substr((F.col("pos") % 4 + 1).cast("int"), F.lit(1))
    return calls(spark, d).where(F.col("base") != r).select("ref", "pos", "base", S.variant_label(r, F.col("base"), F.col("pos")).alias("label")).distinct()


GAPPED = f"gapped AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), '{S.LETTERS}', '{S.CYCLE}') AS aligned FROM documents WHERE text IS NOT NULL)"


@register("gapped_translation", f"""WITH {GAPPED}, c AS (SELECT doc_id, p, substr(aligned, p + 1, 1) AS b FROM (SELECT doc_id, aligned, unnest(range(length(aligned))) AS p FROM gapped)), n AS (SELECT doc_id, p, b, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i FROM c WHERE b <> '-'),
k AS (SELECT doc_id, i // 3 AS codon, string_agg(b, '' ORDER BY p) AS c, min(p) AS a, max(p) AS z, count(*) AS m FROM n GROUP BY doc_id, i // 3)
SELECT doc_id, CAST(codon AS INTEGER) AS codon, substr('{facts.code_string(1)}', CAST(16 * (instr('TCAG', substr(c, 1, 1)) - 1) + 4 * (instr('TCAG', substr(c, 2, 1)) - 1) + instr('TCAG', substr(c, 3, 1)) AS BIGINT), 1) AS residue, CAST(a AS INTEGER) AS first_column, CAST(z AS INTEGER) AS last_column, z - a > 2 AS spans_gap FROM k WHERE m = 3""")
def gapped_translation(spark, d):  # 48
    g = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")), S.LETTERS, S.CYCLE).alias("aligned"))
    return scans.gapped_codons(g, "doc_id", "aligned")


@register("star_alignments")
def star_alignments(spark, d):  # 145, 146: words of one length and the same ends form groups of any size
    o = oligos(spark, d).withColumn("group", F.concat(F.substring("seq", 1, 6), F.right("seq", F.lit(2))))
    return alignment.star_alignments(o.select("group", F.xxhash64("seq").alias("row"), "seq"))
