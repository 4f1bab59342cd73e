"""Queries of features carried to fragments, amplicons and assemblies; numbers in comments are rows of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.operators import assembly, projection, restriction, scans
from strandweave.plans.catalog import register
from strandweave.plans.evidence_queries import _BACK, FORWARD, REVERSE
from strandweave.plans.scalar_queries import SEQS, seqs
from strandweave.plans.site_queries import CHAINS, OVERLAPS, PANEL, _fragments, gibson_fragments, parts, sites_sql
from strandweave.sources import genbank

# Every document of 300 bases and more is a circular GenBank record with a feature each 97 bases (joined, forward, reverse, of no order) and two over its origin.
ANNOTATED = """ann AS (SELECT doc_id, length(seq) AS n, length(seq) // 97 AS m FROM seqs WHERE length(seq) >= 300), ks AS (SELECT *, unnest(range(m)) AS k FROM ann),
seg AS (SELECT doc_id, n, k AS id, 0 AS i, 97 * k AS a, 97 * k + 30 AS b, 1 AS strand, 2 AS parts FROM ks WHERE k % 4 = 0 UNION ALL SELECT doc_id, n, k, 1, 97 * k + 50, 97 * k + 80, 1, 2 FROM ks WHERE k % 4 = 0
UNION ALL SELECT doc_id, n, k, 0, 97 * k, 97 * k + 20 + k * 37 % 70, 1, 1 FROM ks WHERE k % 4 = 1 UNION ALL SELECT doc_id, n, k, 0, 97 * k + 5, 97 * k + 60, -1, 1 FROM ks WHERE k % 4 = 2
UNION ALL SELECT doc_id, n, m, 0, n - 25, n, 1, 2 FROM ann UNION ALL SELECT doc_id, n, m, 1, 0, 20, 1, 2 FROM ann UNION ALL SELECT doc_id, n, m + 1, 0, 0, 15, -1, 2 FROM ann UNION ALL SELECT doc_id, n, m + 1, 1, n - 30, n, -1, 2 FROM ann)"""


def annotated(spark, d):
    """The features that reading those records' texts gives: doc_id, id, start, end, strand, n, status, operator, segments."""
    s = seqs(spark, d).where(F.length("seq") >= 300)
    one = lambda a, b, strand: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(strand).alias("strand"))
    feature = lambda kind, operator, *segments: F.struct(F.lit(kind).alias("type"), F.array(*segments).alias("segments"), F.lit(operator).alias("operator"), F.lit("ok").alias("status"), F.array(F.struct(F.lit("note").alias("name"), F.lit("made").alias("value"))).alias("qualifiers"))

    def made(k):
        p = 97 * k
        joined, ordered = (feature("CDS", o, one(p, p + x, 1), one(p + y, p + z, 1)) for o, x, y, z in (("join", 30, 50, 80), ("order", 10, 20, 30)))
        forward, back = feature("gene", "", one(p, p + 20 + k * 37 % 70, 1)), feature("misc", "", one(p + 5, p + 60, -1))
        return F.when(k % 4 == 0, joined).when(k % 4 == 1, forward).when(k % 4 == 2, back).otherwise(ordered)

    n, zero = F.length("seq"), F.lit(0)
    over = F.array(feature("misc", "join", one(n - 25, n, 1), one(zero, zero + 20, 1)), feature("misc", "join", one(zero, zero + 15, -1), one(n - 30, n, -1)))
    features = F.concat(F.transform(F.sequence(F.lit(0), F.floor(n / 97).cast("int") - 1), made), over)
    text = genbank.genbank_text(F.concat(F.lit("d"), "doc_id"), F.col("seq"), features, F.lit("circular"))
    r = genbank.parse_genbank(s.select(F.col("doc_id").alias("path"), text.alias("value")))
    f = r.select(F.col("path").alias("doc_id"), F.col("length").alias("n"), F.posexplode("features").alias("id", "f"))
    return f.select("doc_id", F.col("id").cast("long").alias("id"), "n", "f.start", "f.end", "f.strand", "f.status", "f.operator", "f.segments")


def shown(f, *names):
    text = F.transform("segments", lambda s: F.concat(s["start"], F.lit(".."), s["end"], F.lit(":"), s["strand"]))
    return f.select(*names, "id", "start", "end", F.array_join(text, ",").alias("segments"), *[c for c in ("partial",) if c in f.columns])


_WHOLE = "CAST(min(x) AS BIGINT) AS start, CAST(max(x + b - a) AS BIGINT) AS \"end\", string_agg(x || '..' || (x + b - a) || ':' || strand, ',' ORDER BY i) AS segments"


@register("fragment_features", f"""WITH {SEQS}, {sites_sql(PANEL, 'seqs', True)}, {_fragments(True, 'seqs')}, {ANNOTATED},
hit AS (SELECT s.*, fragment, CASE WHEN a >= start AND b <= least("end", n) THEN a - start WHEN b <= "end" - n THEN a + n - start END AS x FROM seg s JOIN fragments f USING (doc_id))
SELECT doc_id, fragment, id, {_WHOLE} FROM hit WHERE x IS NOT NULL GROUP BY doc_id, fragment, id, parts HAVING count(*) = parts""")
def fragment_features(spark, d):  # 82, 161: of circular digests, over the origin too
    s = seqs(spark, d)
    runs = projection.digest_runs(restriction.fragments(s, restriction.catalogue(PANEL), circular=True))
    return shown(projection.whole_features(annotated(spark, d), runs, "doc_id"), "doc_id", F.col("product").alias("fragment"))


@register("amplicon_features", f"""WITH {SEQS}, {ANNOTATED}, h AS (SELECT doc_id, p, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w) AS g FROM (SELECT doc_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
j AS (SELECT f.doc_id, f.p AS s, r.p + 6 AS e FROM h f JOIN h r ON f.doc_id = r.doc_id AND f.g = '{FORWARD}' AND r.g = '{_BACK}' AND r.p + 6 > f.p AND r.p + 6 - f.p <= 50000), products AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY e - s, s, e) AS INTEGER) AS rank FROM j),
hit AS (SELECT g.*, rank, a - s AS x FROM seg g JOIN products USING (doc_id) WHERE a >= s AND b <= e)
SELECT doc_id, rank, id, {_WHOLE} FROM hit GROUP BY doc_id, rank, id, parts HAVING count(*) = parts""")
def amplicon_features(spark, d):  # 82, 162: every product of the line
    s = seqs(spark, d)
    p = assembly.pcr_products(scans.primer_bindings(s, [("f", FORWARD), ("r", REVERSE)], 0, 6), s, ("f", FORWARD), ("r", REVERSE))
    runs = projection.amplicon_runs(p)
    return shown(projection.whole_features(annotated(spark, d), runs, "doc_id"), "doc_id", F.col("product").alias("rank"))


def tiled(parts_):
    """A feature of 31 bases each 23 of every part (design, ord, seq), every other one reverse; the last ones pass the end."""
    f = parts_.select(F.struct("design", F.col("ord").alias("ord")).alias("source"), F.length("seq").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.floor(F.length("seq") / 23).cast("int") - 1)).alias("id"))
    return f.select("source", F.col("id").cast("long").alias("id"), "n", (F.col("id") * 23).alias("start"), (F.col("id") * 23 + 31).alias("end"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("strand"), F.lit("ok").alias("status"), F.lit("").alias("operator"), F.lit(None).cast(projection.SEGMENTS).alias("segments"))


def _tiles(source: str) -> str:
    return f"tiles AS (SELECT design, ord, n, k AS id, 23 * k AS a, 23 * k + 31 AS b, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS strand FROM (SELECT design, ord, length(seq) AS n, unnest(range(length(seq) // 23)) AS k FROM {source}))"


# runs: design, ord, s, e, off, total
_CLIPPED = """near AS (SELECT design, ord, id, a, b, strand, t, greatest(off + greatest(a, s) - s, t * total) - t * total AS x, least(off + least(b, e) - s, (t + 1) * total) - t * total AS y FROM tiles JOIN runs USING (design, ord), range(3) r(t))
SELECT design, CAST(ord AS BIGINT) AS ord, id, CAST(min(x) AS BIGINT) AS start, CAST(max(y) AS BIGINT) AS "end", string_agg(x || '..' || y || ':' || strand, ',' ORDER BY CASE WHEN strand = -1 THEN -t ELSE t END) AS segments, sum(y - x) < b - a AS partial FROM near WHERE y > x GROUP BY design, ord, id, a, b"""


def _of_design(f):
    return shown(f.withColumns({"design": F.col("source.design"), "ord": F.col("source.ord").cast("long")}), "design", "ord")


@register("gibson_features", f"""WITH {OVERLAPS}, good AS (SELECT design, CAST(sum(length(seq) - k) AS BIGINT) AS total FROM found_overlaps GROUP BY design HAVING count(k) = count(*) AND NOT bool_or(contains(seq, 'N'))),
runs AS (SELECT design, ord, 0 AS s, length(seq) AS e, CAST(coalesce(sum(length(seq) - k) OVER (PARTITION BY design ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, total FROM found_overlaps JOIN good USING (design)), {_tiles('fragments')}, {_CLIPPED}""")
def gibson_features(spark, d):  # 81, 152: overlaps keep the features of both fragments; the closing one leads over the origin
    f = gibson_fragments(spark, d)
    return _of_design(projection.clipped_features(tiled(f), projection.gibson_runs(f, circular=True), "source"))


@register("golden_gate_features", f"""WITH RECURSIVE {CHAINS}, placed AS (SELECT x.design, j, p.ord, length(p."insert") AS len FROM (SELECT design, unnest(path) AS i, generate_subscripts(path, 1) AS j FROM verdict WHERE reason = 'unique') x JOIN p ON p.design = x.design AND p.i = x.i),
runs AS (SELECT g.design, g.ord, instr(q.seq, 'GGTCTC') + 6 AS s, instr(q.seq, 'GGTCTC') + 6 + len AS e, CAST(coalesce(sum(len - 4) OVER (PARTITION BY g.design ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, CAST(sum(len - 4) OVER (PARTITION BY g.design) AS BIGINT) AS total FROM placed g JOIN parts q USING (design, ord)), {_tiles('parts')}, {_CLIPPED}""")
def golden_gate_features(spark, d):  # 81, 154: what lies outside the inserts is gone, and makes a feature partial
    p = parts(spark, d).withColumn("ord", F.col("ord").cast("long"))
    return _of_design(projection.clipped_features(tiled(p), projection.golden_gate_runs(p), "source"))
