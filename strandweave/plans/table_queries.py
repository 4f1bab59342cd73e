"""Queries of the scans, digests, alignments, intervals, joins and set operators; numbers in comments are rows of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandweave.functions import sequence as S
from strandweave.operators import alignment, intervals, kernels, relations, scans
from strandweave.plans.catalog import register
from strandweave.plans.scalar_queries import LETTERS, SEQS, letters, seqs
from strandweave.session import table

@register("open_reading_frames", f"""WITH {SEQS}, both_strands AS (SELECT doc_id, 1 AS strand, seq FROM seqs UNION ALL SELECT doc_id, -1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs),
codons AS (SELECT doc_id, strand, length(seq) AS n, p, p % 3 AS f, substr(seq, p + 1, 3) AS c FROM (SELECT *, unnest(range(length(seq) - 2)) AS p FROM both_strands)),
nexts AS (SELECT *, min(CASE WHEN c IN ('TAA', 'TAG', 'TGA') THEN p END) OVER (PARTITION BY doc_id, strand, f ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM codons),
o AS (SELECT doc_id, strand, n, f, p, c, stop, CASE WHEN stop IS NULL THEN (n - p) // 3 ELSE (stop - p) // 3 END AS aa FROM nexts WHERE c IN ('TTG', 'CTG', 'ATG')),
e AS (SELECT *, CASE WHEN stop IS NULL THEN p + 3 * aa ELSE stop + 3 END AS q FROM o WHERE aa >= 30)
SELECT doc_id, strand, CAST(f + 1 AS INTEGER) AS frame, CAST(CASE WHEN strand = 1 THEN p ELSE n - q END AS INTEGER) AS start, CAST(CASE WHEN strand = 1 THEN q ELSE n - p END AS INTEGER) AS "end", CAST(aa AS INTEGER) AS amino_acids, e.c AS start_codon,
  coalesce(k.c, '') AS stop_codon, CASE WHEN stop IS NULL THEN 'partial' ELSE 'complete' END AS status
FROM e LEFT JOIN (SELECT doc_id, strand, p AS stop, c FROM codons) k USING (doc_id, strand, stop)""")
def open_reading_frames(spark, d):  # 68
    return scans.orfs(seqs(spark, d))


@register("kmer_counts", f"WITH {SEQS} SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, substr(seq, CAST(p + 1 AS BIGINT), 6) AS kmer FROM (SELECT doc_id, seq, unnest(range(length(seq) - 5)) AS p FROM seqs)) GROUP BY kmer")
def kmer_counts(spark, d):  # counts only: the strand vote (73) and seed anchors (75) are not built
    return scans.kmers(seqs(spark, d), 6).groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


ROWS = f"""{SEQS}, rws AS (SELECT lang AS alignment, doc_id AS row, seq FROM seqs JOIN documents USING (doc_id)),
cells AS (SELECT alignment, row, CAST(p AS INTEGER) AS "column", substr(seq, p + 1, 1) AS symbol FROM (SELECT *, unnest(range(length(seq))) AS p FROM rws)),
counts AS MATERIALIZED (SELECT alignment, "column", symbol, count(*) AS n, min(row) AS first_row FROM cells GROUP BY ALL), totals AS (SELECT alignment, count(*) AS total FROM rws GROUP BY 1)"""


def rows(spark, d):
    """The documents of each language as rows of one alignment; shorter rows end in gaps."""
    s = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("lang").alias("alignment"), F.col("doc_id").alias("row"), S.as_bases(F.col("text")).alias("aligned"))
    return s


@register("column_statistics", f"""WITH {ROWS}, s AS (SELECT alignment, "column", sum(n) AS k, arg_min(symbol, (-n, symbol)) AS consensus, max(n) AS m, sum(n * log2(n)) AS nlogn FROM counts WHERE symbol <> '' GROUP BY ALL)
SELECT alignment, "column", round(k::DOUBLE / total, 9) AS occupancy, consensus, m AS consensus_count, round(greatest(0, log2(k) - nlogn / k), 6) + 0.0 AS entropy, m = total AS fully_conserved FROM s JOIN totals USING (alignment)""")
def column_statistics(spark, d):  # 96
    s = alignment.column_stats(rows(spark, d).where("aligned <> ''").unionByName(rows(spark, d).where("aligned = ''").withColumn("aligned", F.lit("-"))))
    return s.select("alignment", "column", F.round("occupancy", 9).alias("occupancy"), "consensus", "consensus_count", (F.round("entropy", 6) + 0.0).alias("entropy"), "fully_conserved")


@register("sequence_logo", f"""WITH {ROWS} SELECT alignment, "column", string_agg(symbol || ':' || n, ',' ORDER BY n DESC, symbol) AS stack FROM counts GROUP BY ALL""")
def sequence_logo(spark, d):  # 97
    return alignment.logo(rows(spark, d).where("aligned <> ''"))


@register("majority_consensus", f"""WITH {ROWS} SELECT alignment, "column", arg_max(symbol, (n, -first_row)) AS symbol FROM counts GROUP BY ALL""")
def majority_consensus(spark, d):  # 99
    return alignment.consensus(rows(spark, d).where("aligned <> ''"))


QUALITY = f"{SEQS}, q AS (SELECT doc_id, p, CASE substr(seq, p + 1, 1) WHEN 'A' THEN 12 WHEN 'C' THEN 20 WHEN 'G' THEN 28 ELSE 36 END AS q FROM (SELECT doc_id, seq, unnest(range(length(seq))) AS p FROM seqs))"


def quality(spark, d):
    """Called qualities derived from the bases."""
    q = F.transform(F.split("seq", ""), lambda x: 4 + 8 * F.instr(F.lit("ACGT"), x))
    return seqs(spark, d).where("seq <> ''").select("doc_id", q.alias("q"))


@register("quality_summary", f"WITH {QUALITY} SELECT doc_id, round(avg(q), 6) AS mean_q, round(100.0 * count_if(q >= 20) / count(*), 6)::DOUBLE AS q20 FROM q GROUP BY doc_id")
def quality_summary(spark, d):  # 103
    return relations.quality_summary(quality(spark, d))


@register("quality_trim", f"""WITH {QUALITY}, w AS (SELECT doc_id, p, avg(q) OVER x AS m, count(*) OVER x AS k FROM q WINDOW x AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT doc_id, CAST(min(p) AS INTEGER) AS trim_start, CAST(max(p) + 12 AS INTEGER) AS trim_end FROM w WHERE k = 12 AND m >= 20 GROUP BY doc_id""")
def quality_trim(spark, d):  # 115
    return kernels.quality_trim(seqs(spark, d), 12, 20.0)


@register("sliding_gc", f"""WITH {SEQS}, b AS (SELECT doc_id, length(seq) AS n, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> ''), c AS (SELECT doc_id, n, p, sum(CASE WHEN c IN ('G', 'C') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS g FROM b)
SELECT doc_id, CAST(p AS INTEGER) AS position, round(g::DOUBLE / least(100, n), 9) AS gc FROM c WHERE p <= n - 100 OR p = 0 UNION ALL SELECT doc_id, 0, 0 FROM seqs WHERE seq = ''""")
def sliding_gc(spark, d):  # 112
    return scans.sliding_gc(seqs(spark, d)).withColumn("gc", F.round("gc", 9))


_SIX = f"""{SEQS}, g AS (SELECT doc_id, p, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w) AS m FROM (SELECT doc_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY p))"""


@register("pattern_scan", f"""WITH {_SIX} SELECT doc_id, CAST(p AS INTEGER) AS start, CAST(p + 6 AS INTEGER) AS "end", m AS match FROM g WHERE regexp_full_match(m, '[AG]GC[ACGT][CT]A')""")
def pattern_scan(spark, d):  # 52, 65
    return scans.pattern_matches(seqs(spark, d), "doc_id", "seq", S.iupac_regex("RGCNYA"))


@register("prosite_scan", f"""WITH {LETTERS}, g AS (SELECT doc_id, p, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w) AS m FROM (SELECT doc_id, unnest(range(length(s))) AS p, unnest(string_split(s, '')) AS c FROM letters WHERE s <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY p))
SELECT doc_id, CAST(p AS INTEGER) AS start, CAST(p + 4 AS INTEGER) AS "end", m AS match FROM g WHERE regexp_full_match(m, 'N[^P][ST][^P]')""")
def prosite_scan(spark, d):  # 53, 66
    return scans.pattern_matches(letters(spark, d), "doc_id", "s", S.prosite_regex("N-{P}-[ST]-{P}"))


@register("earliest_matches", f"""WITH {_SIX} SELECT CAST(p AS INTEGER) AS start, doc_id FROM g WHERE m = 'GAATTC' ORDER BY p, doc_id LIMIT 50""")
def earliest_matches(spark, d):  # 124
    return scans.pattern_matches(seqs(spark, d), "doc_id", "seq", "GAATTC").orderBy("start", "doc_id").select("start", "doc_id").limit(50)


# Words of the texts with dots as gaps: rows of an alignment by the query's own columns.
GAPS = f"gaps AS (SELECT doc_id AS row, translate(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), '{S.LETTERS}', '{S.CYCLE}') AS aligned FROM documents WHERE text IS NOT NULL)"


@register("aligned_pattern_hits", f"""WITH {GAPS}, c AS (SELECT row, unnest(range(length(aligned))) AS p, unnest(string_split(aligned, '')) AS c FROM gaps WHERE aligned <> ''), r AS (SELECT row, p, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w, lead(c, 6) OVER w) AS m, lead(p, 6) OVER w AS q FROM c WHERE c <> '-' WINDOW w AS (PARTITION BY row ORDER BY p))
SELECT row, CAST(p AS INTEGER) AS start_column, CAST(q AS INTEGER) AS end_column FROM r WHERE regexp_full_match(m, 'GA[AG]TC[ACGT][CT]')""")
def aligned_pattern_hits(spark, d):  # 67, 124
    g = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("row"), F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")), S.LETTERS, S.CYCLE).alias("aligned"))
    return alignment.pattern_hits(g, "gartcny")


EV = "ev AS (SELECT user_id AS k, event_id AS id, event_id % 997 * 3 AS start, event_id % 997 * 3 + event_id % 89 + 1 AS \"end\" FROM events)"


def spans(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), (F.col("event_id") % 997 * 3).alias("start"), (F.col("event_id") % 997 * 3 + F.col("event_id") % 89 + 1).alias("end"))


@register("normalised_spans", f"""WITH {EV} SELECT id, CAST(i AS INTEGER) AS part, CASE WHEN i = 0 THEN start % 500 ELSE 0 END AS s, CASE WHEN i = 0 THEN least(500, start % 500 + "end" - start) ELSE start % 500 + "end" - start - 500 END AS e FROM ev, range(2) t(i) WHERE i = 0 OR start % 500 + "end" - start > 500""")
def normalised_spans(spark, d):  # 132
    s = spans(spark, d)
    x = s.select("id", F.posexplode(intervals.normalise_span(F.col("start"), F.col("end"), F.lit(500), True)).alias("part", "x"))
    return x.select("id", "part", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@register("reverse_features", f'WITH {EV} SELECT id, 5000 - "end" AS start, 5000 - start AS "end", -CAST(id % 3 - 1 AS BIGINT) AS strand FROM ev')
def reverse_features(spark, d):  # 133
    f = spans(spark, d).withColumn("n", F.lit(5000)).withColumn("strand", F.col("id") % 3 - 1)
    return intervals.reverse_features(f).select("id", "start", "end", "strand")


@register("edited_spans", f"""WITH {EV}, x AS (SELECT *, 1500 AS a, 40 AS r, 15 AS i FROM ev), y AS (SELECT *, CASE WHEN start <= a THEN start WHEN start >= a + r THEN start + i - r ELSE a END AS s2, CASE WHEN "end" > a AND "end" < a + r THEN a WHEN "end" <= a THEN "end" ELSE "end" + i - r END AS e2 FROM x)
SELECT id, s2 AS start, e2 AS "end", CASE WHEN e2 <= s2 THEN 'detached' WHEN "end" <= a THEN 'kept' WHEN start >= a + r THEN 'shifted' ELSE 'review' END AS status FROM y""")
def edited_spans(spark, d):  # 134, 135
    a, b, st = intervals.edited(F.col("start"), F.col("end"), F.lit(1500), F.lit(40), F.lit(15))
    return spans(spark, d).select("id", a.alias("start"), b.alias("end"), st.alias("status"))


@register("span_overlaps", f'WITH {EV} SELECT a.k, a.id, count(b.id) AS n FROM ev a LEFT JOIN ev b ON a.k = b.k AND a.id <> b.id AND a.start < b."end" AND b.start < a."end" GROUP BY a.k, a.id')
def span_overlaps(spark, d):  # 83
    return intervals.overlaps(spans(spark, d), "k")


@register("packed_lanes", f"""WITH RECURSIVE {EV}, o AS MATERIALIZED (SELECT k, id, start, "end" AS e, row_number() OVER (PARTITION BY k ORDER BY start, start - "end", "end", id) AS i FROM ev),
w AS (SELECT k, id, i, [e] AS ends, 1 AS lane FROM o WHERE i = 1 UNION ALL SELECT k, id, i, CASE WHEN x IS NULL THEN list_append(ends, e) ELSE ends[:x - 1] || [e] || ends[x + 1:] END, coalesce(x, len(ends) + 1) FROM (SELECT o.k, o.id, o.i, o.e, w.ends, nullif(list_position(list_transform(w.ends, lambda z: z <= o.start), TRUE), 0) AS x FROM w JOIN o ON o.k = w.k AND o.i = w.i + 1))
SELECT k, id, CAST(lane - 1 AS INTEGER) AS lane FROM w""")
def packed_lanes(spark, d):  # 83
    return intervals.pack_lanes(spans(spark, d), "k")


@register("contained_spans", f"""WITH {EV}, o AS (SELECT DISTINCT k, start // 300 * 300 AS s, start // 300 * 300 + 320 AS e FROM ev) SELECT a.k, a.id, min(s) AS span FROM ev a LEFT JOIN o ON a.k = o.k AND s <= a.start AND a."end" <= e GROUP BY ALL""")
def contained_spans(spark, d):  # 80, 82
    s = spans(spark, d)
    outer = s.select("k", (F.floor(F.col("start") / 300) * 300).alias("s")).distinct().select("k", F.col("s").alias("span"), "s", (F.col("s") + 320).alias("e"))
    return intervals.contained(s, outer, "k").select("k", "id", "span")


@register("expected_and_observed", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'found' END AS state FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k")
def expected_and_observed(spark, d):  # 88
    li = table(spark, d, "lineitem")
    return relations.compare(li.where("l_quantity > 40").select(F.col("l_partkey").alias("k")), li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), "k")


@register("dependency_closure", """WITH RECURSIVE t AS (SELECT conv_id, turn, turn AS root FROM conversations WHERE role = 'system' OR turn = 0 UNION SELECT c.conv_id, c.turn, t.root FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, root, count(DISTINCT turn) AS reached FROM t GROUP BY ALL""")
def dependency_closure(spark, d):  # 129, 130
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    roots = c.where("role = 'system' OR turn = 0").select("conv_id", F.col("turn").alias("root")).distinct()
    return relations.chain_closure(roots, c.select("conv_id", "turn").distinct())


# Neighbouring turns of a conversation as pairs of short sequences: SQL fills the score matrix row by row.
PAIRS = f"""turn AS (SELECT conv_id, turn, left(translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{S.LETTERS}', '{S.CYCLE}'), 12) AS s FROM conversations),
pairs AS (SELECT conv_id, turn, s AS a, lead(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM turn)"""


def turn_pairs(spark, d, size):
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = F.substring(S.as_bases(F.coalesce("text", F.lit(""))), 1, size)
    t = table(spark, d, "conversations").select("conv_id", "turn", s.alias("a"))
    return t.withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL")


@register("alignment_scores", f"""WITH RECURSIVE {PAIRS}, h AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: CAST(-2 * j AS BIGINT)) AS r FROM pairs WHERE b IS NOT NULL
UNION ALL SELECT conv_id, turn, a, b, i + 1, list_transform(range(length(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: CASE WHEN k = 0 THEN -2 * (i + 1) ELSE greatest(r[k] + CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN 2 ELSE -1 END, r[k + 1] - 2) END - 2 * (j - k)))) FROM h WHERE i < length(a))
SELECT conv_id, turn, CAST(r[length(b) + 1] AS INTEGER) AS score FROM h WHERE i = length(a)""")
def alignment_scores(spark, d):  # 142
    return alignment.align_pairs(turn_pairs(spark, d, 12), "dna").select("conv_id", "turn", "score")


@register("pairwise_alignment")
def pairwise_alignment(spark, d):  # 142, 143, 144: whole neighbouring turns
    return alignment.align_pairs(turn_pairs(spark, d, 2**31 - 1))


@register("seeded_alignments", f"""WITH {PAIRS.replace(", 12) AS s", ") AS s").replace("left(translate", "(translate")} SELECT conv_id, turn, 'seed-and-extend' AS method, sha256(a) AS a, sha256(b) AS b, 0 AS unequal FROM pairs WHERE b IS NOT NULL AND length(a) * length(b) > 2000""")
def seeded_alignments(spark, d):  # 75, 144: seeds and segments between them, whole turns, for pairs that a lower limit sends there
    p = alignment.align_pairs(turn_pairs(spark, d, 2**31 - 1), "dna", alignment.Limits(full=1000, linear=2000, segment=10_000))
    unequal = F.abs(F.length("aligned_a") - F.length("aligned_b"))
    return p.where(F.length("a") * F.length("b") > 2000).select("conv_id", "turn", "method", *(F.sha2(F.replace(f"aligned_{c}", F.lit("-"), F.lit("")), 256).alias(c) for c in "ab"), unequal.alias("unequal"))


@register("linear_space_alignments", f"""WITH {PAIRS.replace(", 12) AS s", ") AS s").replace("left(translate", "(translate")} SELECT conv_id, turn, 'linear-space' AS method, 0 AS worse, sha256(a) AS a, sha256(b) AS b FROM pairs WHERE b IS NOT NULL AND length(a) * length(b) > 2000""")
def linear_space_alignments(spark, d):  # 143: the halving method against the whole matrix: the same score
    t = turn_pairs(spark, d, 2**31 - 1).where(F.length("a") * F.length("b") > 2000)
    both = alignment.align_pairs(t, "dna", alignment.Limits(full=1000))
    whole = alignment.align_pairs(t, "dna").select("conv_id", "turn", F.col("score").alias("best"))
    return both.join(whole, ["conv_id", "turn"]).select("conv_id", "turn", "method", (F.col("best") - F.col("score")).alias("worse"), *(F.sha2(F.replace(f"aligned_{c}", F.lit("-"), F.lit("")), 256).alias(c) for c in "ab"))


# Turns of a conversation as one group to align; every seventh turn has no sequence, every ninth an odd sign.
_TURNS = """turns AS (SELECT conv_id AS "group", turn AS "row", role, CASE WHEN (conv_id + turn) % 7 = 6 THEN NULL ELSE BASES || CASE WHEN (conv_id + turn) % 9 = 8 THEN '#' ELSE '' END END AS seq FROM conversations),
told AS (SELECT *, CASE WHEN seq IS NULL THEN 'missing' WHEN seq = '' THEN 'empty' WHEN contains(seq, '#') THEN 'symbols' ELSE 'ok' END AS status FROM turns), n AS (SELECT "group", count(*) AS n FROM told WHERE status = 'ok' GROUP BY 1)"""
_BASES = f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{S.LETTERS}', '{S.CYCLE}')"
_STAR, _STAR_60 = _TURNS.replace("BASES", _BASES), _TURNS.replace("BASES", f"left({_BASES}, 60)")


def star_rows(spark, d, most=None):
    """Whole turns, or their first `most` bases."""
    k = F.col("conv_id") + F.col("turn")
    bases = S.as_bases(F.coalesce("text", F.lit("")))
    seq = F.concat(bases if most is None else F.left(bases, F.lit(most)), F.when(k % 9 == 8, "#").otherwise(""))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("row"), "role", F.when(k % 7 == 6, None).otherwise(seq).alias("seq"))


@register("star_status", f"""WITH {_STAR} SELECT "group", "row", CASE WHEN status = 'ok' AND n = 1 THEN 'alone' ELSE status END AS status, CASE WHEN status = 'ok' AND n > 1 THEN seq END AS seq, CASE WHEN status = 'ok' AND n > 1 THEN 1 ELSE 0 END AS width FROM told LEFT JOIN n USING ("group")""")
def star_status(spark, d):  # 145: no row is lost; gaps are all that is added, and a group's rows are equally long
    a = alignment.star_alignments(star_rows(spark, d).select("group", "row", "seq"))
    wide = F.size(F.collect_set(F.length("aligned")).over(Window.partitionBy("group")))
    return a.select("group", "row", "status", F.replace("aligned", F.lit("-"), F.lit("")).alias("seq"), F.when(F.col("aligned").isNotNull(), wide).otherwise(0).alias("width"))


@register("alignment_requests", f"""WITH {_STAR_60}, r AS (SELECT "group", length(coalesce(seq, '')) AS k, CASE WHEN "row" % 11 = 10 THEN '' WHEN "row" % 4 = 3 THEN role ELSE role || ' ' || "row" END AS name, CASE WHEN "group" % 5 = 1 AND "row" > 2 THEN 'rna' WHEN "group" % 13 = 3 THEN 'plain' ELSE 'dna' END AS kind FROM turns),
g AS (SELECT "group", count(*) AS n, count_if(kind = 'plain') AS odd, count(DISTINCT kind) AS kinds, count_if(name = '') AS bare, count(name) FILTER (name <> '') - count(DISTINCT lower(name)) FILTER (name <> '') AS again, max(k)::DOUBLE AS top, sum(k)::DOUBLE AS s, sum(k * k)::DOUBLE AS q FROM r GROUP BY 1)
SELECT "group", unnest(list_filter([CASE WHEN n < 2 THEN 'too_few' END, CASE WHEN n > 10 THEN 'too_many' END, CASE WHEN odd > 0 THEN 'unsupported_molecule' END, CASE WHEN kinds > 1 THEN 'mixed_molecule' END, CASE WHEN bare > 0 THEN 'missing_name' END, CASE WHEN again > 0 THEN 'duplicate_name' END, CASE WHEN top > 50 THEN 'too_long' END, CASE WHEN (s * s - q) / 2 + greatest(0, top * s - top * top) > 40000 THEN 'work_budget' END], lambda x: x IS NOT NULL)) AS issue FROM g""")
def alignment_requests(spark, d):  # 146: what the wrapper refuses
    row, group = F.col("row"), F.col("group")
    name = F.when(row % 11 == 10, " ").when(row % 4 == 3, F.upper("role")).otherwise(F.concat("role", F.lit(" "), row.cast("string")))
    kind = F.when((group % 5 == 1) & (row > 2), "rna").when(group % 13 == 3, "plain").otherwise("dna")
    return alignment.alignment_requests(star_rows(spark, d, 60).select("group", "row", name.alias("name"), kind.alias("molecule"), "seq"), longest=50, most_work=40_000)


@register("alignment_summary", f"""WITH {ROWS}, j AS (SELECT c.*, arg_max(symbol, (n, -first_row)) OVER (PARTITION BY alignment, "column") AS major FROM counts c WHERE symbol <> ''), p AS (SELECT alignment, sum(n) FILTER (symbol = major) AS same, count(DISTINCT "column") AS filled FROM j GROUP BY 1),
w AS (SELECT j.alignment, count(*) AS k FROM j JOIN totals USING (alignment) WHERE symbol = major AND n = total GROUP BY 1), m AS (SELECT alignment, max(length(seq)) AS columns FROM rws GROUP BY 1)
SELECT alignment, CAST(columns AS INTEGER) AS columns, total AS rows, floor(same::DOUBLE / (filled * total) * 1000 + 0.5) / 10 AS identity, 0::BIGINT AS gaps, coalesce(k, 0)::BIGINT AS conserved FROM p JOIN totals USING (alignment) JOIN m USING (alignment) LEFT JOIN w USING (alignment)""")
def alignment_summary(spark, d):  # 100
    return alignment.summary(rows(spark, d))


@register("strand_votes", f"""WITH t AS (SELECT conv_id, turn, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{S.LETTERS}', '{S.CYCLE}') AS s FROM conversations), p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS read, lead(s) OVER (PARTITION BY conv_id ORDER BY turn) || s AS template FROM t),
k AS (SELECT *, greatest(3, least(7, length(read), length(template))) AS k FROM p WHERE template IS NOT NULL), w AS (SELECT conv_id, turn, list_distinct(list_transform(range(length(template) - k + 1), lambda i: substr(template, CAST(i + 1 AS BIGINT), k))) AS own FROM k),
v AS (SELECT k.conv_id, k.turn, k, len(list_filter(list_transform(range(length(read) - k + 1), lambda i: substr(read, CAST(i + 1 AS BIGINT), k)), lambda x: list_contains(own, x))) AS f, len(list_filter(list_transform(range(length(read) - k + 1), lambda i: substr(reverse(translate(read, 'ACGT', 'TGCA')), CAST(i + 1 AS BIGINT), k)), lambda x: list_contains(own, x))) AS r FROM k JOIN w USING (conv_id, turn))
SELECT conv_id, turn, CAST(k AS INTEGER) AS k, CAST(f AS INTEGER) AS forward, CAST(r AS INTEGER) AS reverse, CASE WHEN r > f THEN 'reverse' ELSE 'forward' END AS orientation FROM v""")
def strand_votes(spark, d):  # 73: odd turns are turned round; the template is the next turn and the turn itself
    p = turn_pairs(spark, d, 2**31 - 1)
    read = F.when(F.col("turn") % 2 == 1, S.reverse_complement(F.col("a"))).otherwise(F.col("a"))
    return scans.strand_votes(p.select("conv_id", "turn", read.alias("read"), F.concat("b", "a").alias("template"))).drop("read", "template")


@register("hit_sort", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax, l_discount, l_extendedprice DESC, l_shipmode_key, l_orderkey, l_linenumber) AS BIGINT) AS rank FROM (SELECT *, l_partkey % 100 AS l_shipmode_key FROM lineitem)")
def hit_sort(spark, d):  # 119: by the chosen key, then expectation, falling bit score, accession and first place
    li = table(spark, d, "lineitem").withColumn("accession", F.col("l_partkey") % 100)
    order = ["l_tax", "l_discount", F.desc("l_extendedprice"), "accession", "l_orderkey", "l_linenumber"]
    cell = F.round(F.col("l_tax") * 100) * 100 + F.round(F.col("l_discount") * 100)
    return relations.ranked(li, "l_suppkey", cell, order).select("l_orderkey", "l_linenumber", "rank")
