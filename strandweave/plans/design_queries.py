"""Queries of the design operators; numbers in comments are rows of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators import alignment, constructs, design
from strandweave.operators import oligos as oligos_
from strandweave.plans.catalog import register
from strandweave.plans.scalar_queries import OLIGOS, SEQS, oligos, seqs
from strandweave.plans.site_queries import FRAGMENTS, PANEL, fragments
from strandweave.plans.table_queries import ROWS, rows
from strandweave.session import table, written

_Y = "floor(greatest(0, least(1, 1.1::DOUBLE - 0.25::DOUBLE * log10(size))) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


@register("co_migrating_bands", f"""WITH RECURSIVE {FRAGMENTS}, f AS (SELECT doc_id, length AS size FROM fragments), y AS (SELECT doc_id, size, {_Y} AS y FROM f),
o AS MATERIALIZED (SELECT doc_id, size, y, row_number() OVER (PARTITION BY doc_id ORDER BY y, size DESC) AS i FROM y),
b AS (SELECT doc_id, i, 0 AS band, 1 AS k, y AS total, ln(size) AS logs FROM o WHERE i = 1 UNION ALL
 SELECT o.doc_id, o.i, CASE WHEN near THEN band ELSE band + 1 END, CASE WHEN near THEN k + 1 ELSE 1 END, CASE WHEN near THEN total + o.y ELSE o.y END, CASE WHEN near THEN logs + ln(o.size) ELSE ln(o.size) END
 FROM (SELECT b.*, o.y, o.size, o.i AS next, abs(o.y - total / k) <= 0.008 AS near FROM b JOIN o ON o.doc_id = b.doc_id AND o.i = b.i + 1) x JOIN o ON o.doc_id = x.doc_id AND o.i = x.next)
SELECT doc_id AS lane, band, floor(max_by(total, i) / max(k) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS position, CAST(greatest(1, floor(exp(max_by(logs, i) / max(k)) + 0.5)) AS BIGINT) AS size, CAST(max(k) AS BIGINT) AS fragments FROM b GROUP BY doc_id, band""")
def co_migrating_bands(spark, d):  # 102
    return design.co_migrating_bands(fragments(spark, d).select(F.col("doc_id").alias("lane"), F.col("length").alias("size")))


@register("selection_summary", f"""WITH {ROWS}, s AS (SELECT alignment, "column", sum(n) AS k, max(n) AS m, sum(n * log2(n)) AS nlogn FROM counts WHERE symbol <> '' GROUP BY ALL),
c AS (SELECT alignment, k, m, total, k::DOUBLE / total * greatest(0, least(1, 1 - greatest(0, log2(k) - nlogn / k) / 2)) AS conservation FROM s JOIN totals USING (alignment))
SELECT alignment, count(*) AS columns, count_if(m < total AND m < k)::BIGINT AS variable_columns, count_if(m = total)::BIGINT AS conserved_columns, 0::BIGINT AS gap_columns, round(avg(conservation), 6) AS mean_conservation FROM c GROUP BY alignment""")
def selection_summary(spark, d):  # 98
    s = alignment.column_stats(rows(spark, d).where("aligned <> ''").unionByName(rows(spark, d).where("aligned = ''").withColumn("aligned", F.lit("-"))))
    total = rows(spark, d).groupBy("alignment").agg(F.count("*").alias("rows"))
    s = s.join(total, "alignment").withColumn("consensus_share", F.col("consensus_count") / F.round(F.col("occupancy") * F.col("rows")))
    return design.selection_summary(s).withColumn("mean_conservation", F.round("mean_conservation", 6))


_MASKED = S.CYCLE[:13] + "N" + S.CYCLE[14:]


@register("filled_spacers", f"""WITH s AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{S.LETTERS}', '{_MASKED}') AS seq FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(regexp_replace(regexp_replace(seq, '(GACTC)N', '\\1A', 'g'), 'N(GAGTC)', 'A\\1', 'g')) AS filled_md5 FROM s""")
def filled_spacers(spark, d):  # 158
    s = table(spark, d, "documents").where("text IS NOT NULL")
    bases = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), S.LETTERS, _MASKED)
    return s.select("doc_id", F.md5(design.spacers_filled(bases, "GACTC", 1)).alias("filled_md5"))


@register("row_orientation", f"WITH {SEQS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR seq = reverse(translate(seq, 'ACGT', 'TGCA')) AND doc_id % 3 = 1 THEN 'forward' WHEN doc_id % 3 = 1 OR seq = '' THEN CASE WHEN seq = '' THEN 'forward' ELSE 'reverse' END ELSE 'unknown' END AS orientation FROM (SELECT * FROM seqs)")
def row_orientation(spark, d):  # 74: every third document's row is its own, the next one's is turned, the last one's is a base longer
    k = F.col("doc_id") % 3
    row = F.when(k == 0, F.col("seq")).when(k == 1, S.reverse_complement(F.col("seq"))).otherwise(F.when(F.col("seq") == "", "").otherwise(F.concat(F.col("seq"), F.lit("A"))))
    return seqs(spark, d).select("doc_id", design.orientation(F.concat(F.lit("-"), row), F.col("seq")).alias("orientation"))


_ENZYMES = ", ".join(f"('{n}', '{r}', {t}, {b})" for n, (r, t, b) in facts.ENZYMES.items())


@register("isoschizomers", f"SELECT recognition, top_cut, bottom_cut, arg_min(name, (name NOT IN {tuple(PANEL)}, lower(name))) AS \"primary\", string_agg(name, ',' ORDER BY name NOT IN {tuple(PANEL)}, lower(name)) AS names FROM (VALUES {_ENZYMES}) e(name, recognition, top_cut, bottom_cut) GROUP BY ALL")
def isoschizomers(spark, d):  # 123
    e = spark.createDataFrame([(n, r, t, b) for n, (r, t, b) in facts.ENZYMES.items()], "name string, recognition string, top_cut int, bottom_cut int")
    return design.isoschizomers(e, PANEL)


@register("domesticated_sequences")
def domesticated_sequences(spark, d):  # 159
    out = design.domesticated(seqs(spark, d), ["GGTCTC", "CGTCTC", "GAAGAC"])
    return out.withColumn("product", F.sha2("product", 256))


def _targets(spark, d):
    n = F.length("seq")
    return seqs(spark, d).withColumn("target_start", F.floor(n / 3).cast("int")).withColumn("target_end", F.ceil(2 * n / 3).cast("int"))


@register("primer_pairs")
def primer_pairs(spark, d):  # 120, 121: the target is the middle third of every sequence; the operator's own lengths, flanks and numbers
    return oligos_.primer_pairs(_targets(spark, d))


@register("primer_features")
def primer_features(spark, d):  # 168: the best pair's primers as annotations
    return oligos_.as_features(oligos_.primer_pairs(_targets(spark, d), most=1))


_G = lambda x: f"(list_sum(list_transform(range(1, length({x})), lambda t: CASE substr({x}, t, 2) " + " ".join(f"WHEN '{p}' THEN {h - 310.15 * e / 1000!r}::DOUBLE" for p, (h, e) in facts.STACKS.items()) + f" END)) + " + " + ".join(f"CASE WHEN {side}({x}, 1) IN ('A', 'T') THEN {facts.END_AT[0] - 310.15 * facts.END_AT[1] / 1000!r}::DOUBLE ELSE {facts.END_GC[0] - 310.15 * facts.END_GC[1] / 1000!r}::DOUBLE END" for side in ("left", "right")) + ")"


@register("hairpins", f"""WITH {OLIGOS}, a AS (SELECT seq, length(seq) AS n, unnest(range(length(seq))) AS i FROM oligos), b AS (SELECT *, unnest(range(i + 8, n)) AS j FROM a), c AS (SELECT *, unnest(range(3, (j - i - 2) // 2 + 1)) AS k FROM b),
e AS (SELECT seq, i, k, round({_G('w')}, 2) AS e FROM (SELECT *, substr(seq, i + 1, k) AS w FROM c) WHERE w = reverse(translate(substr(seq, j - k + 2, k), 'ACGT', 'TGCA'))), m AS (SELECT seq, min((e, i, k)) AS x FROM e WHERE e < 0 GROUP BY seq)
SELECT o.seq AS oligo, coalesce(x[1], 0)::DOUBLE AS hairpin, coalesce(x[2], -1)::INTEGER AS stem_start, coalesce(x[3], 0)::INTEGER AS stem FROM oligos o LEFT JOIN m USING (seq)""")
def hairpins(spark, d):  # 147
    return oligos_.structures(oligos(spark, d)).select("oligo", "hairpin", "stem_start", "stem")


@register("self_dimers", f"""WITH {OLIGOS}, o AS (SELECT seq, length(seq) AS n, reverse(translate(seq, 'ACGT', 'TGCA')) AS b FROM oligos), p AS (SELECT *, unnest(range(n)) AS p FROM o), q AS (SELECT *, unnest(range(n)) AS q FROM p), s AS (SELECT * FROM q WHERE substr(seq, p + 1, 1) = substr(b, q + 1, 1) AND (p = 0 OR q = 0 OR substr(seq, p, 1) <> substr(b, q, 1))),
k AS (SELECT *, unnest(range(3, n - greatest(p, q) + 1)) AS k FROM s), r AS (SELECT *, substr(seq, p + 1, k) AS w FROM k WHERE substr(seq, p + 1, k) = substr(b, q + 1, k) AND (p + k = n OR q + k = n OR substr(seq, p + k + 1, 1) <> substr(b, q + k + 1, 1))),
e AS (SELECT seq, k, least(k, 5) * ((p + k = n)::INT + (q = 0)::INT) AS held, round({_G('w')}, 2) AS e FROM r), m AS (SELECT seq, min((e, -held, -k)) AS x FROM e WHERE e < 0 GROUP BY seq)
SELECT o.seq AS oligo, coalesce(x[1], 0)::DOUBLE AS dimer, coalesce(-x[3], 0)::INTEGER AS run FROM oligos o LEFT JOIN m USING (seq)""")
def self_dimers(spark, d):  # 148
    return oligos_.structures(oligos(spark, d)).select("oligo", "dimer", "run")


def _constructs(spark, d):
    """Every turn of 60 bases and more is a construct; its reads are its bases from either end with edits by the conversation's number: none, a substitution, a deletion, an insertion."""
    text = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("construct"), "text").where(F.length("text") >= 60)
    # Dealt before the bases are worked out, and written: the file's few parts are no measure of the work, and many steps read these rows.
    t = written(alignment.dealt(text, "construct").select("construct", S.as_bases(F.col("text")).alias("seq")), "constructs-turns").where(F.length("seq") >= 60)
    k = F.floor(F.col("construct") / 1000) % 4
    edited = F.when(k == 1, S.substituted(F.col("seq"), F.lit(30), F.lit("A"))).when(k == 2, S.deleted(F.col("seq"), F.lit(30), F.lit(2))).when(k == 3, S.inserted(F.col("seq"), F.lit(30), F.lit("GATTACA"))).otherwise(F.col("seq"))
    calls = F.explode(F.array(F.struct(F.lit(1).alias("read"), edited.alias("calls"), F.lit(40).alias("q")), F.struct(F.lit(2).alias("read"), S.reverse_complement(edited).alias("calls"), F.lit(30).alias("q"))))
    r = t.select("construct", calls.alias("c")).select("construct", "c.read", "c.calls", F.when((F.col("construct") % 9 == 8) & (F.col("c.read") == 2), None).otherwise(F.array_repeat("c.q", F.length("c.calls"))).alias("quality"))
    return r, t.withColumn("topology", F.when(F.col("construct") % 2 == 1, "circular").otherwise("linear"))


@register("mapped_reads")
def mapped_reads(spark, d):  # 149, 115
    r, refs = _constructs(spark, d)
    return constructs.map_reads(r, refs).select("construct", "read", "status", "strand", "trim_start", "trim_end", F.round("identity", 6).alias("identity"), F.size("columns").alias("calls"), F.size("variants").alias("variants"))


@register("verified_constructs")
def verified_constructs(spark, d):  # 104, 105, 106, 150, 151
    r, refs = _constructs(spark, d)
    regions = refs.select("construct", F.lit("head").alias("region"), F.lit(0).alias("start"), F.lit(20).alias("end"), F.lit(2).alias("min_depth"), F.lit(True).alias("both_strands"))
    base = F.substring("seq", 31, 1)
    expected = refs.where((F.floor(F.col("construct") / 1000) % 4 == 1) & (F.col("construct") % 3 == 0) & (base != "A")).select("construct", F.lit("edit").alias("id"), F.lit("substitution").alias("type"), F.lit(30).alias("start"), F.lit(31).alias("end"), base.alias("ref"), F.lit("A").alias("alt"))
    return constructs.verified(r, refs, expected, regions).select("construct", "state", F.array_join("reasons", ",").alias("reasons"), "reads", "usable", "coverage", "mean_depth", F.sha2("consensus", 256).alias("consensus_sha256"), F.array_join("variants", ",").alias("variants"), "report")
