"""Queries of restriction sites, digests and cloning; numbers in comments are rows of the survey's inventory."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators import assembly, cloning, intervals, relations, restriction
from strandweave.plans.catalog import register
from strandweave.plans.scalar_queries import SEQS, seqs
from strandweave.session import table

PANEL = [*facts.PRESETS["common-mcs"], "BsaI"]
CATALOGUE = [e.name for e in restriction.catalogue()]
LONGEST = max(len(e.recognition) for e in restriction.catalogue())


def _patterns(names: list[str]) -> str:
    """(enzyme, head, tail's place, tail, length, strand, top, bottom, mode, fault): a row for every plain way to write a site, runs of N left out."""
    rows = []
    for e in restriction.catalogue(names):
        fault = "methylation_context_unknown" if e.context else "methylation_unknown" if e.needs else "ok"
        back = facts.reverse_complement(e.recognition)
        for strand, text in [(1, e.recognition)] + ([(-1, back)] if back != e.recognition else []):
            head, gap, tail = re.fullmatch(r"([^N]+)(N*)([^N]*)", text).groups()
            n = len(text)
            t, b = (e.top, e.bottom) if strand == 1 else (n - e.bottom, n - e.top)
            rows += [f"('{e.name}', '{h}', {len(head) + len(gap) + 1}, '{x}', {n}, {strand}, {t}, {b}, '{e.mode}', '{fault}')" for h in facts.concrete(head) for x in facts.concrete(tail)]
    return ", ".join(rows)


def sites_sql(names: list[str], source: str = "seqs", circular: bool = False) -> str:
    """CTEs that end in `sites`. Splitting at a pattern would miss overlaps; every place is compared, its following bases joined by a window."""
    text = f"seq || left(seq, {LONGEST - 1})" if circular else "seq"
    leads = ", ".join(f"lead(c, {i}) OVER w" for i in range(1, LONGEST))
    flank = "FALSE" if circular else "least(p + t, p + b) < 0 OR greatest(p + t, p + b) > n"
    wide = "l > n OR abs(t - b) > n OR abs(t) > n OR abs(b) > n" if circular else "FALSE"
    at = (lambda x: f"(({x}) % n + n) % n") if circular else (lambda x: x)
    return f"""chars AS (SELECT doc_id, length(seq) AS n, unnest(range(length({text}))) AS p, unnest(string_split({text}, '')) AS c FROM {source} WHERE seq <> ''),
grams AS MATERIALIZED (SELECT doc_id, n, p, concat(c, {leads}) AS g FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
pats(enzyme, head, tp, tail, l, strand, t, b, mode, fault) AS (VALUES {_patterns(names)}),
found AS (SELECT * FROM grams JOIN pats ON left(g, 3) = left(head, 3) WHERE p < n AND length(g) >= l AND starts_with(g, head) AND substr(g, tp, length(tail)) = tail),
sites AS MATERIALIZED (SELECT doc_id, n, enzyme, CAST(p AS INTEGER) AS position, strand, CASE WHEN mode <> 'nick_bottom' THEN CAST({at('p + t')} AS INTEGER) END AS top_cut, CASE WHEN mode <> 'nick_top' THEN CAST({at('p + b')} AS INTEGER) END AS bottom_cut, mode, p + t AS raw_top, p + b AS raw_bottom,
  CASE WHEN {wide} THEN 'invalid_geometry' WHEN {flank} THEN 'insufficient_flanking_bases' ELSE fault END AS status FROM found),
active AS (SELECT *, CASE WHEN status = 'invalid_geometry' THEN 'invalid-geometry' WHEN status = 'insufficient_flanking_bases' THEN 'insufficient-flanking-bases' WHEN status LIKE 'methylation%' THEN 'conditional' WHEN mode = 'double-strand' THEN 'active-double-strand' ELSE 'nick-only' END AS activity FROM sites)"""


ALL = f"WITH {SEQS}, {sites_sql(CATALOGUE)}"
SITES = f"{SEQS}, {sites_sql(PANEL)}"
COUNTS = [c.replace("-", "_") for c in restriction.CATEGORIES]


def sites(spark, d):
    """Sites of the panel's enzymes."""
    return restriction.sites(seqs(spark, d), restriction.catalogue(PANEL))


@register("restriction_sites", f"{ALL} SELECT doc_id, enzyme, position, strand, top_cut, bottom_cut, mode, status, activity FROM active")
def restriction_sites(spark, d):  # 64, 57, 58: the whole catalogue, methylation unknown
    return restriction.sites(seqs(spark, d))


@register("sites_per_enzyme", f"{ALL}, c AS (SELECT doc_id, enzyme, " + ", ".join(f"count_if(activity = '{a}') AS {c}" for a, c in zip(restriction.CATEGORIES, COUNTS, strict=True)) + f""" FROM active GROUP BY ALL), every AS (SELECT doc_id, e AS enzyme FROM seqs, (SELECT unnest({CATALOGUE}) AS e)),
j AS (SELECT doc_id, enzyme, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in COUNTS)} FROM every LEFT JOIN c USING (doc_id, enzyme)) SELECT *, CASE {" ".join(f"WHEN {c} > 0 THEN '{a}'" for a, c in zip(restriction.CATEGORIES, COUNTS, strict=True))} ELSE 'no-site' END AS category FROM j""")
def sites_per_enzyme(spark, d):  # 91, 94
    s = seqs(spark, d)
    return restriction.sites_per_enzyme(s, restriction.sites(s), CATALOGUE)


@register("unique_cutters", f"{ALL} SELECT doc_id, enzyme, min(position) AS position FROM active WHERE activity = 'active-double-strand' GROUP BY doc_id, enzyme HAVING count(*) = 1")
def unique_cutters(spark, d):  # 92
    s = restriction.sites(seqs(spark, d)).where("activity = 'active-double-strand'")
    return s.groupBy("doc_id", "enzyme").agg(F.count("*").alias("k"), F.min("position").alias("position")).where("k = 1").drop("k")


@register("non_cutters", f"{ALL} SELECT doc_id, enzyme FROM (SELECT doc_id, e AS enzyme FROM seqs, (SELECT unnest({CATALOGUE}) AS e)) EXCEPT SELECT doc_id, enzyme FROM active WHERE activity = 'active-double-strand'")
def non_cutters(spark, d):  # 93, 131
    s = seqs(spark, d)
    every = s.select("doc_id").withColumn("enzyme", F.explode(F.array(*map(F.lit, CATALOGUE))))
    return every.join(restriction.sites(s).where("activity = 'active-double-strand'").select("doc_id", "enzyme").distinct(), ["doc_id", "enzyme"], "left_anti")


@register("distinct_cuts", f"{ALL} SELECT doc_id, top_cut, bottom_cut, array_to_string(list_sort(list(DISTINCT enzyme)), ',') AS enzymes FROM active WHERE activity = 'active-double-strand' GROUP BY ALL")
def distinct_cuts(spark, d):  # 127: physical geometry, with all enzymes that make it
    s = restriction.sites(seqs(spark, d)).where("activity = 'active-double-strand'")
    return s.groupBy("doc_id", "top_cut", "bottom_cut").agg(F.array_join(F.array_sort(F.collect_set("enzyme")), ",").alias("enzymes"))


@register("site_keys", f"{ALL} SELECT doc_id, enzyme || '@' || position AS id, strand, raw_top < position OR raw_top > position + (SELECT max(l) FROM pats WHERE pats.enzyme = active.enzyme) AS type_iis FROM active WHERE mode = 'double-strand'")
def site_keys(spark, d):  # 141
    size = F.create_map(*[F.lit(x) for e in restriction.catalogue() for x in (e.name, len(e.recognition))])
    s = restriction.sites(seqs(spark, d)).where("mode = 'double-strand'")
    far = (F.col("top_cut") < F.col("position")) | (F.col("top_cut") > F.col("position") + F.try_element_at(size, F.col("enzyme")))
    return s.select("doc_id", F.concat("enzyme", F.lit("@"), "position").alias("id"), "strand", far.alias("type_iis"))


def _fragments(circular: bool, source: str = "seqs") -> str:
    """CTEs after sites_sql: good (sequences without an issue), cuts, fragments with their ends."""
    bounds = (
        "SELECT doc_id, n, cut AS a, coalesce(lead(cut) OVER w, first_value(cut) OVER w + n) AS z FROM cuts JOIN good USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) UNION ALL SELECT doc_id, n, NULL, NULL FROM good WHERE doc_id NOT IN (SELECT doc_id FROM cuts)"
        if circular else
        "SELECT doc_id, n, lag(cut) OVER w AS a, cut AS z FROM (SELECT doc_id, cut FROM cuts UNION ALL SELECT doc_id, NULL FROM good) JOIN good USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY cut NULLS LAST)"
    )
    return f"""bad AS (SELECT doc_id FROM sites WHERE status <> 'ok' UNION SELECT doc_id FROM sites GROUP BY doc_id, top_cut HAVING count(DISTINCT (bottom_cut, sign(raw_top - raw_bottom))) > 1),
good AS (SELECT doc_id, length(seq) AS n, seq FROM {source} WHERE seq <> '' AND doc_id NOT IN (SELECT doc_id FROM bad)),
cuts AS (SELECT doc_id, top_cut AS cut, any_value(raw_bottom - raw_top) AS wide, string_agg(enzyme, ',' ORDER BY i) AS enzymes FROM (SELECT doc_id, top_cut, raw_top, raw_bottom, enzyme, min((position, k)) AS i FROM sites JOIN (SELECT unnest({PANEL}) AS enzyme, generate_subscripts({PANEL}, 1) AS k) USING (enzyme) WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY ALL) GROUP BY doc_id, top_cut),
bounds AS ({bounds}),
texts AS (SELECT c.doc_id, cut, wide, enzymes, substr(seq || seq || seq, CAST(n + cut + least(0, wide) + 1 AS BIGINT), CAST(abs(wide) AS BIGINT)) AS sense FROM cuts c JOIN good USING (doc_id)),
ends AS (SELECT doc_id, cut, enzymes, CASE WHEN wide > 0 THEN '5prime' WHEN wide < 0 THEN '3prime' ELSE 'blunt' END AS kind, CASE WHEN wide < 0 THEN reverse(translate(sense, 'ACGT', 'TGCA')) ELSE sense END AS l, CASE WHEN wide < 0 THEN sense ELSE reverse(translate(sense, 'ACGT', 'TGCA')) END AS r FROM texts),
fragments AS (SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY coalesce(a, 0)) AS INTEGER) AS fragment, CAST(coalesce(a, 0) AS INTEGER) AS start, CAST(coalesce(z, b.n) AS INTEGER) AS "end", CAST(coalesce(z, b.n) - coalesce(a, 0) AS INTEGER) AS length,
  coalesce(x.enzymes, '') AS left_enzymes, coalesce(y.enzymes, '') AS right_enzymes, coalesce(x.l, '') AS left_end, coalesce(y.r, '') AS right_end, coalesce(x.kind, 'blunt') AS left_type, coalesce(y.kind, 'blunt') AS right_type
  FROM bounds b LEFT JOIN ends x ON x.doc_id = b.doc_id AND x.cut = b.a LEFT JOIN ends y ON y.doc_id = b.doc_id AND y.cut = b.z % b.n WHERE coalesce(z, b.n) > coalesce(a, 0))"""


FRAGMENTS = f"{SITES}, {_fragments(False)}"
TURNS = f"turns AS (SELECT conv_id * 1000 + turn AS doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{S.LETTERS}', '{S.CYCLE}') AS seq FROM conversations WHERE text IS NOT NULL)"
CIRCLES = f"{TURNS}, {sites_sql(PANEL, 'turns', True)}, {_fragments(True, 'turns')}"


def turns(spark, d):
    """The turns of conversations as sequences."""
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), S.as_bases(F.col("text")).alias("seq"))


def fragments(spark, d):
    return restriction.fragments(seqs(spark, d), restriction.catalogue(PANEL))


@register("digest_fragments", f"WITH {FRAGMENTS} SELECT * FROM fragments")
def digest_fragments(spark, d):  # 113
    return fragments(spark, d)


@register("digest_circles", f"WITH {CIRCLES} SELECT * FROM fragments")
def digest_circles(spark, d):  # 113 on circles
    return restriction.fragments(turns(spark, d), restriction.catalogue(PANEL), circular=True)


_RECIPE = "ecori, BamHI;HINDIII EcoRI  DpnI BsaI"


@register("digest_recipes", f"WITH {SEQS}, {sites_sql(['EcoRI', 'BamHI', 'HindIII', 'DpnI', 'BsaI'])}, c AS (SELECT doc_id, count(*) AS k, count(DISTINCT CASE WHEN status = 'ok' AND mode = 'double-strand' THEN (top_cut, bottom_cut, sign(raw_top - raw_bottom)) END) AS cuts, string_agg(DISTINCT CASE WHEN status <> 'ok' THEN status END, ',' ORDER BY CASE WHEN status <> 'ok' THEN status END) AS issues FROM sites GROUP BY doc_id)"
          " SELECT doc_id, CAST(coalesce(k, 0) AS INTEGER) AS n_sites, CAST(coalesce(cuts, 0) AS INTEGER) AS cuts, CASE WHEN seq = '' OR issues <> '' THEN 0 ELSE coalesce(cuts, 0)::INTEGER + 1 END AS fragments, CASE WHEN seq = '' OR issues <> '' THEN 'not-run' WHEN coalesce(cuts, 0) = 0 THEN 'uncut' ELSE 'fragmented' END AS outcome, CASE WHEN seq = '' THEN 'empty_sequence' ELSE coalesce(issues, '') END AS issues FROM seqs LEFT JOIN c USING (doc_id)")
def digest_recipes(spark, d):  # 160, 78
    return restriction.recipes(seqs(spark, d), _RECIPE)


@register("recipe_enzymes", "SELECT * FROM (VALUES ('resolved', 1, 'EcoRI'), ('resolved', 2, 'BamHI'), ('resolved', 3, 'HindIII'), ('duplicate', 1, 'EcoRI'), ('duplicate', 2, 'BamHI'), ('unresolved', 1, 'Nope1'), ('unresolved', 2, 'zzz')) t(kind, place, name)")
def recipe_enzymes(spark, d):  # 77, 78
    known, twice, unknown = restriction.resolved(" ecori;BamHI\tHINDIII,EcoRI Nope1 bamhi zzz EcoRI NOPE1 ")
    return spark.createDataFrame([(k, i, n) for k, names in (("resolved", known), ("duplicate", twice), ("unresolved", unknown)) for i, n in enumerate(names, 1)], "kind string, place int, name string")


@register("enzyme_sources", "SELECT 'presets' AS source, unnest(['BsaI', 'BbsI', 'BsmBI', 'Esp3I', 'SapI', 'BspQI', 'EcoRI', 'ZraI']) AS enzyme, unnest(range(1, 9))::INTEGER AS place UNION ALL SELECT 'none', NULL, 0 UNION ALL SELECT 'unknown', 'EcoRI', 1")
def enzyme_sources(spark, d):  # 79, 126
    one = restriction.union_of_sources(["golden-gate-type-iis", "custom:mine", "favorites"], ["ecori", "BSAI"], {"mine": ["bsai", "EcoRI", "nothing", "ZraI"]})
    none = restriction.union_of_sources(["favorites"], ["nothing"])
    fallen = restriction.union_of_sources(["no such list"])
    rows = [("presets", n, i) for i, n in enumerate(one, 1)] + ([("none", None, 0)] if not none else []) + [("unknown", fallen[0], 1)]
    return spark.createDataFrame(rows, "source string, enzyme string, place int")


@register("gel_bands", f"""WITH {FRAGMENTS} SELECT doc_id, length AS size, count(*) AS n, round(least(1.0, 0.6 + 0.2 * count(*)), 3)::DOUBLE AS intensity, round(greatest(0, least(1, 1.1 - 0.25 * log10(length))), 6)::DOUBLE AS distance FROM fragments GROUP BY doc_id, length""")
def gel_bands(spark, d):  # 101
    far = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.1 - 0.25 * F.log10("length")))
    return fragments(spark, d).groupBy("doc_id", F.col("length").alias("size")).agg(F.count("*").alias("n"), F.round(F.least(F.lit(1.0), 0.6 + 0.2 * F.count("*")), 3).alias("intensity"), F.round(F.first(far), 6).alias("distance"))


@register("site_clusters", f"""WITH RECURSIVE {SITES}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position, enzyme, top_cut, strand) AS i FROM sites),
b AS (SELECT doc_id, i, position, position AS begin, 0 AS cluster FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, o.position, CASE WHEN o.position - b.position <= 200 AND o.position - b.begin <= 500 THEN b.begin ELSE o.position END, CASE WHEN o.position - b.position <= 200 AND o.position - b.begin <= 500 THEN cluster ELSE cluster + 1 END FROM b JOIN o ON o.doc_id = b.doc_id AND o.i = b.i + 1),
m AS (SELECT o.*, b.cluster, raw_top < o.position OR raw_top > o.position + length('GGTCTC') + CASE WHEN enzyme = 'NotI' THEN 2 ELSE 0 END AS far FROM o JOIN b USING (doc_id, i)),
named AS (SELECT doc_id, cluster, string_agg(enzyme, ',' ORDER BY NOT far, i) AS enzymes FROM (SELECT doc_id, cluster, enzyme, bool_or(far) AS far, min(i) FILTER (far = best) AS i FROM (SELECT *, bool_or(far) OVER (PARTITION BY doc_id, cluster, enzyme) AS best FROM m) GROUP BY ALL) GROUP BY ALL)
SELECT m.doc_id, CAST(m.cluster AS INTEGER) AS cluster, CAST(list(position ORDER BY i)[CAST(count(*) // 2 + 1 AS BIGINT)] AS INTEGER) AS anchor, CAST(count(*) AS INTEGER) AS n, any_value(named.enzymes) AS enzymes, bool_or(far) AS has_type_iis FROM m JOIN named ON named.doc_id = m.doc_id AND named.cluster = m.cluster GROUP BY m.doc_id, m.cluster""")
def site_clusters(spark, d):  # 114
    s = seqs(spark, d)
    return restriction.clusters(sites(spark, d), s.select("doc_id", F.length("seq").alias("n")), 200, 500)


@register("site_density_bins", f"WITH {SITES} SELECT doc_id, CAST(position * 64 // n AS BIGINT) AS bin, count(*) AS n, round(avg(position), 6) AS mean_position FROM sites GROUP BY ALL")
def site_density_bins(spark, d):  # 108
    s = restriction.sites(seqs(spark, d), restriction.catalogue(PANEL), sized=True)
    return s.groupBy("doc_id", F.floor(F.col("position").cast("long") * 64 / F.col("n")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("position"), 6).alias("mean_position"))


@register("overview_bins", f"""WITH {FRAGMENTS}, x AS (SELECT f.doc_id, unnest(range(start::BIGINT * 32 // n, least(31, ("end"::BIGINT - 1) * 32 // n) + 1)) AS bin FROM (SELECT f.*, good.n FROM fragments f JOIN good USING (doc_id)) f) SELECT doc_id, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY ALL""")
def overview_bins(spark, d):  # 107
    f = restriction.fragments(seqs(spark, d), restriction.catalogue(PANEL), sized=True).where("doc_id IS NOT NULL")
    return intervals.overview_bins(f.select("doc_id", "n", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "doc_id", 32)


@register("downsampled_rows", f"""WITH {SITES}, r AS (SELECT doc_id, position, enzyme, row_number() OVER (PARTITION BY doc_id ORDER BY position, enzyme) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM sites)
SELECT doc_id, position, enzyme FROM r WHERE n <= 16 OR i IN (SELECT k * (n - 1) // 15 FROM range(16) t(k))""")
def downsampled_rows(spark, d):  # 116
    return relations.downsample(sites(spark, d).select("doc_id", "position", "enzyme"), "doc_id", ["position", "enzyme"], 16)


@register("ligations", f"""WITH {FRAGMENTS}, n AS (SELECT *, lead(left_end) OVER w AS nx, lead(left_type) OVER w AS nt FROM fragments WINDOW w AS (PARTITION BY doc_id ORDER BY fragment)),
j AS (SELECT *, CASE WHEN nt IS NULL THEN 'open' WHEN right_type = 'blunt' AND nt = 'blunt' THEN 'blunt' WHEN right_type = nt AND right_type <> 'blunt' AND nx = reverse(translate(right_end, 'ACGT', 'TGCA')) THEN 'compatible' ELSE 'incompatible' END AS junction, (SELECT count(*) FROM fragments f WHERE f.doc_id = n.doc_id AND f.left_type = n.right_type AND f.left_end = reverse(translate(n.right_end, 'ACGT', 'TGCA'))) AS k FROM n)
SELECT doc_id AS design, fragment AS ord, junction, CASE junction WHEN 'blunt' THEN TRUE WHEN 'compatible' THEN k > 1 WHEN 'incompatible' THEN k > 0 ELSE FALSE END AS ambiguous FROM j""")
def ligations(spark, d):  # 84
    return assembly.ligations(fragments(spark, d).select(F.col("doc_id").alias("design"), F.col("fragment").alias("ord"), F.col("left_end").alias("left"), "left_type", F.col("right_end").alias("right"), "right_type"))


@register("fitting_ends", f"""WITH {FRAGMENTS} SELECT a.doc_id, a.fragment, count(b.doc_id) AS fits FROM fragments a LEFT JOIN fragments b ON a.doc_id = b.doc_id AND b.left_end = reverse(translate(a.right_end, 'ACGT', 'TGCA')) GROUP BY ALL""")
def fitting_ends(spark, d):  # 84, as counts
    return assembly.fitting_ends(fragments(spark, d).select("doc_id", "fragment", "right_end", "left_end"))


# Every document gives a design of four flanked parts: sixty of its bases each, overhangs from behind them. Every fifth design is open, every seventh lacks a flank.
_OH = "substr(seq, 401 + 4 * CAST(k AS BIGINT), 4)"
PARTS = f"""{SEQS}, cut AS (SELECT doc_id, seq, unnest(range(4)) AS i FROM seqs WHERE length(seq) >= 430),
oh AS (SELECT doc_id, k, {_OH} AS o FROM (SELECT doc_id, seq, unnest(range(5)) AS k FROM seqs WHERE length(seq) >= 430)),
parts AS MATERIALIZED (SELECT c.doc_id AS design, (i * 3 + 1) % 4 AS ord, 'part' || i AS name, 'TT' || CASE WHEN c.doc_id % 7 = 0 AND i = 2 THEN 'GGTCTG' ELSE 'GGTCTC' END || 'A' || a.o || substr(seq, CAST(1 + 100 * i AS BIGINT), 60) || b.o || 'TGAGACCA' AS seq FROM cut c JOIN oh a ON a.doc_id = c.doc_id AND a.k = c.i JOIN oh b ON b.doc_id = c.doc_id AND b.k = CASE WHEN c.i = 3 AND c.doc_id % 5 <> 0 THEN 0 ELSE c.i + 1 END)"""


def parts(spark, d):
    s = seqs(spark, d).where(F.length("seq") >= 430)
    p = s.select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    oh = lambda k: F.substring("seq", (401 + 4 * k).cast("int"), F.lit(4))
    nxt = F.when((F.col("i") == 3) & (F.col("doc_id") % 5 != 0), 0).otherwise(F.col("i") + 1)
    site = F.when((F.col("doc_id") % 7 == 0) & (F.col("i") == 2), "GGTCTG").otherwise("GGTCTC")
    text = F.concat(F.lit("TT"), site, F.lit("A"), oh(F.col("i")), F.substring("seq", (1 + 100 * F.col("i")).cast("int"), F.lit(60)), oh(nxt), F.lit("TGAGACCA"))
    return p.select(F.col("doc_id").alias("design"), (F.col("i") * 3 + 1).alias("x"), F.concat(F.lit("part"), "i").alias("name"), text.alias("seq")).select("design", (F.col("x") % 4).alias("ord"), "name", "seq")


DIGESTED = f"""{PARTS}, f AS (SELECT *, instr(seq, 'GGTCTC') - 1 AS a, CASE WHEN instr(seq, 'GGTCTC') > 0 AND instr(substr(seq, instr(seq, 'GGTCTC') + 6), 'GAGACC') > 0 THEN instr(seq, 'GGTCTC') + 5 + instr(substr(seq, instr(seq, 'GGTCTC') + 6), 'GAGACC') - 1 ELSE -1 END AS b,
  len(regexp_extract_all(seq, 'GGTCTC')) + len(regexp_extract_all(seq, 'GAGACC')) AS sites FROM parts),
g AS (SELECT *, CASE WHEN a < 0 OR b < 0 THEN 'missing_flanks' WHEN sites > 2 THEN 'internal_sites' WHEN a + 11 > length(seq) THEN 'out_of_bounds' WHEN b - 5 < a + 11 THEN 'flanks_overlap' END AS issue FROM f),
digested AS MATERIALIZED (SELECT design, ord, name, issue, CASE WHEN issue IS NULL THEN substr(seq, a + 8, 4) END AS "left", CASE WHEN issue IS NULL THEN substr(seq, b - 4, 4) END AS "right", CASE WHEN issue IS NULL THEN substr(seq, a + 8, b - a - 8) END AS "insert" FROM g)"""


@register("golden_gate_parts", f'WITH {DIGESTED} SELECT design, ord::INTEGER AS ord, name, issue, "left", "right", "insert" FROM digested')
def golden_gate_parts(spark, d):  # 154: what digestion releases of each part
    return cloning.digested_parts(parts(spark, d)).select("design", "ord", "name", "issue", "left", "right", "insert")


CHAINS = f"""{DIGESTED}, usable AS (SELECT * FROM digested WHERE design NOT IN (SELECT design FROM digested WHERE issue IS NOT NULL)),
p AS (SELECT *, row_number() OVER (PARTITION BY design ORDER BY ord) - 1 AS i FROM usable),
walk AS (SELECT design, [i] AS path, "right" AS tail, "left" AS head FROM p UNION ALL SELECT w.design, list_append(w.path, p.i), p."right", w.head FROM walk w JOIN p ON p.design = w.design AND p."left" = w.tail AND NOT list_contains(w.path, p.i)),
whole AS (SELECT design, path, head = tail AS circle, head, tail FROM walk WHERE len(path) = 4),
keyed AS (SELECT *, CASE WHEN circle THEN list_position(path, list_min(path)) - 1 ELSE 0 END AS turn FROM whole),
canon AS (SELECT design, circle, path[turn + 1:] || path[:turn] AS key, path, head, tail FROM keyed),
kinds AS (SELECT design, count(DISTINCT (circle, key)) AS k, min(path) AS path, bool_or(circle) AS circle, arg_min(head, path) AS head, arg_min(tail, path) AS tail FROM canon GROUP BY design),
same AS (SELECT design, bool_and("left" = "right") AND count(DISTINCT "left") = 1 AS own FROM usable GROUP BY design),
issues AS (SELECT design, string_agg(issue, ',' ORDER BY ord) AS bad FROM digested WHERE issue IS NOT NULL GROUP BY design),
verdict AS (SELECT d.design, CASE WHEN bad IS NOT NULL THEN bad WHEN k IS NULL THEN 'no-chain' WHEN k > 1 THEN 'ambiguous-multiple-chains' WHEN own THEN 'ambiguous-self-ligation' WHEN NOT circle THEN 'open' ELSE 'unique' END AS reason, path, head, tail FROM (SELECT DISTINCT design FROM digested) d LEFT JOIN kinds USING (design) LEFT JOIN same USING (design) LEFT JOIN issues USING (design))"""
_PRODUCT = """(SELECT string_agg(CASE WHEN j = 1 THEN p."insert" ELSE substr(p."insert", 5) END, '' ORDER BY j) FROM (SELECT unnest(path) AS i, generate_subscripts(path, 1) AS j) x JOIN p ON p.design = v.design AND p.i = x.i)"""


@register("golden_gate_assemblies", f"""WITH RECURSIVE {CHAINS}, u AS (SELECT design, list_distinct(list_concat(list("left" ORDER BY ord), list("right" ORDER BY ord))) AS e FROM usable GROUP BY design)
SELECT v.design, CASE WHEN reason = 'unique' THEN 'ready' WHEN reason LIKE 'ambiguous%' THEN 'ambiguous' ELSE 'invalid_input' END AS status, reason, CASE WHEN reason IN ('unique', 'open') THEN (SELECT string_agg(p.name, ',' ORDER BY j) FROM (SELECT unnest(path) AS i, generate_subscripts(path, 1) AS j) x JOIN p ON p.design = v.design AND p.i = x.i) ELSE '' END AS parts,
  CASE WHEN reason = 'open' THEN tail END AS missing_left, CASE WHEN reason = 'open' THEN head END AS missing_right, CASE WHEN reason = 'unique' THEN sha256(left({_PRODUCT}, length({_PRODUCT}) - 4)) ELSE sha256('') END AS product,
  CAST(CASE WHEN e IS NULL THEN 0 ELSE (SELECT count(*) FROM unnest(e) a(x) WHERE x = reverse(translate(x, 'ACGT', 'TGCA'))) END AS BIGINT) AS palindromic FROM verdict v LEFT JOIN u USING (design)""")
def golden_gate_assemblies(spark, d):  # 85, 154
    a = cloning.golden_gate(parts(spark, d))
    n = F.size(F.filter(F.split("warnings", ","), lambda w: w.startswith("palindromic"))).cast("long")
    return a.select("design", "status", "reason", "parts", "missing_left", "missing_right", F.sha2("product", 256).alias("product"), n.alias("palindromic"))


@register("golden_gate_sites", f"""WITH {SEQS}, {sites_sql(['BsaI'])}, x AS (SELECT s.doc_id, position, strand, least(raw_top, raw_bottom) AS cut, s.n, seq FROM sites s JOIN seqs USING (doc_id)),
f AS (SELECT doc_id, min(position) FILTER (strand = 1) AS a, max(position) FILTER (strand = -1) AS z FROM sites GROUP BY doc_id)
SELECT x.doc_id, position, strand, CAST(cut AS INTEGER) AS cut, CASE WHEN cut >= 0 AND cut + 4 <= n THEN CASE WHEN strand = 1 THEN substr(seq, CAST(cut + 1 AS BIGINT), 4) ELSE reverse(translate(substr(seq, CAST(cut + 1 AS BIGINT), 4), 'ACGT', 'TGCA')) END END AS overhang,
  NOT (coalesce(a < z, FALSE) AND (strand = 1 AND position = a OR strand = -1 AND position = z)) AS internal FROM x JOIN f USING (doc_id)""")
def golden_gate_sites(spark, d):  # 72
    return cloning.sites(seqs(spark, d), "BsaI")


@register("golden_gate_roles", f"""WITH {DIGESTED}, m AS (SELECT design, ord, name, CASE WHEN "left" = 'GATG' AND "right" = 'TGAG' THEN 'coding_sequence' WHEN "right" = 'GATG' THEN 'promoter' WHEN "left" = 'TGAG' THEN 'terminator' ELSE 'unknown' END AS role FROM digested)
SELECT design, ord::INTEGER AS ord, name, role, CAST(row_number() OVER (PARTITION BY design ORDER BY CASE role WHEN 'promoter' THEN 10 WHEN 'coding_sequence' THEN 20 WHEN 'terminator' THEN 30 ELSE 1000 END, ord) AS INTEGER) AS place FROM m""")
def golden_gate_roles(spark, d):  # 117
    return cloning.organised(parts(spark, d))


@register("kit_conformance", f"""WITH {DIGESTED}, k AS (SELECT ['GGAG', 'TACT', 'CCAT', 'AATG', 'AGGT', 'GCAG', 'TTCG', 'GCTT', 'CGCT', 'GGTA', 'ACTA'] AS kit), o AS (SELECT design, ord, list_filter(["left", "right"], lambda x: x IS NOT NULL) AS own FROM digested)
SELECT design, ord::INTEGER AS ord, array_to_string(list_filter(own, lambda x: list_contains(kit, x)), ',') AS matched, array_to_string(list_filter(own, lambda x: NOT list_contains(kit, x)), ',') AS unmatched, len(own) > 0 AND len(list_filter(own, lambda x: NOT list_contains(kit, x))) = 0 AS consistent FROM o, k""")
def kit_conformance(spark, d):  # 61
    o = cloning.digested_parts(parts(spark, d)).select("design", "ord", F.array("left", "right").alias("overhangs"))
    return cloning.kit_check(o, "emma").select("design", "ord", F.array_join("matched", ",").alias("matched"), F.array_join("unmatched", ",").alias("unmatched"), "consistent")


@register("synthetic_vectors", f"""WITH {SEQS}, v AS (SELECT doc_id, 'AAAAGGTCTCA' || left(seq, 4) || left(repeat('ACTG', 13), 50) || substr(seq, 5, 4) || 'AGAGACCAAAA' AS s FROM seqs WHERE length(seq) >= 8)
SELECT doc_id, CASE WHEN len(regexp_extract_all(s, 'GGTCTC')) + len(regexp_extract_all(s, 'GAGACC')) + len(regexp_extract_all(s, 'GAAGAC')) + len(regexp_extract_all(s, 'GTCTTC')) + len(regexp_extract_all(s, 'CGTCTC')) + len(regexp_extract_all(s, 'GAGACG')) + len(regexp_extract_all(s, 'GCTCTTC')) + len(regexp_extract_all(s, 'GAAGAGC')) = 2 THEN s END AS vector FROM v""")
def synthetic_vectors(spark, d):  # 157
    s = seqs(spark, d).where(F.length("seq") >= 8)
    return s.select("doc_id", cloning.synthetic_vector(F.substring("seq", 1, 4), F.substring("seq", 5, 4)).alias("vector"))


# Ligation counts: how often two ends meet in the orders' keys, as overhangs of three bases.
_END = lambda x: f"substr('ACGT', CAST({x} % 4 + 1 AS BIGINT), 1) || substr('ACGT', CAST({x} // 4 % 4 + 1 AS BIGINT), 1) || substr('ACGT', CAST({x} // 16 % 4 + 1 AS BIGINT), 1)"
LIGATED = f"""counts AS (SELECT {_END('o_custkey')} AS l, {_END('o_orderkey // 4')} AS r, count(*) AS n FROM orders GROUP BY ALL),
j0 AS (SELECT s_nationkey AS design, s_suppkey AS ord, {_END('s_suppkey * 7')} AS l FROM supplier),
junctions AS (SELECT design, ord, l, CASE WHEN ord % 11 = 0 THEN l ELSE reverse(translate(l, 'ACGT', 'TGCA')) END AS r FROM j0),
ends AS (SELECT DISTINCT design, x FROM (SELECT design, l AS x FROM junctions UNION ALL SELECT design, r FROM junctions)),
scored AS (SELECT j.design, j.ord, j.l, j.r, j.r = reverse(translate(j.l, 'ACGT', 'TGCA')) AS pair, coalesce((SELECT n FROM counts c WHERE c.l = j.l AND c.r = j.r), 0) + coalesce((SELECT n FROM counts c WHERE c.l = j.r AND c.r = j.l), 0) AS correct,
  coalesce((SELECT sum(n) FROM counts c JOIN ends e ON e.x = c.r WHERE e.design = j.design AND c.l = j.l), 0) + coalesce((SELECT sum(n) FROM counts c JOIN ends e ON e.x = c.r WHERE e.design = j.design AND c.l = j.r), 0) AS total FROM junctions j),
empirical AS (SELECT design, ord, l AS "left", r AS "right", CASE WHEN pair THEN CAST(correct AS BIGINT) END AS correct, CASE WHEN pair THEN CAST(total AS BIGINT) END AS total, CASE WHEN pair AND total > 0 THEN correct::DOUBLE / total::DOUBLE END AS fidelity FROM scored),
hamming AS (SELECT j.design, j.ord, j.l AS "left", j.r AS "right", CASE WHEN j.r = reverse(translate(j.l, 'ACGT', 'TGCA')) THEN CAST(coalesce((SELECT min((left(x, 1) <> left(j.r, 1))::INT + (substr(x, 2, 1) <> substr(j.r, 2, 1))::INT + (right(x, 1) <> right(j.r, 1))::INT) FROM ends e WHERE e.design = j.design AND x <> j.r), 3) AS INTEGER) END AS nearest FROM junctions j)"""


def ligation_counts(spark, d):
    end = lambda x: F.concat(*[F.lit("ACGT").substr((F.floor(x / k) % 4 + 1).cast("int"), F.lit(1)) for k in (1, 4, 16)])
    counts = table(spark, d, "orders").groupBy(end(F.col("o_custkey")).alias("left"), end(F.floor(F.col("o_orderkey") / 4)).alias("right")).agg(F.count("*").alias("n"))
    j = table(spark, d, "supplier").select(F.col("s_nationkey").alias("design"), F.col("s_suppkey").alias("ord"), end(F.col("s_suppkey") * 7).alias("left"))
    return counts, j.withColumn("right", F.when(F.col("ord") % 11 == 0, F.col("left")).otherwise(S.reverse_complement(F.col("left"))))


@register("junction_fidelity", f"WITH {LIGATED} SELECT * REPLACE (round(fidelity, 9) AS fidelity) FROM empirical")
def junction_fidelity(spark, d):  # 109, 125
    counts, j = ligation_counts(spark, d)
    return cloning.fidelity(j, counts).withColumn("fidelity", F.round("fidelity", 9))


@register("junction_distances", f"WITH {LIGATED} SELECT *, round(nearest / 3.0::DOUBLE, 9) AS score FROM hamming")
def junction_distances(spark, d):  # 109, where no matrix fits
    return cloning.heuristic(ligation_counts(spark, d)[1]).withColumn("score", F.round("score", 9))


@register("overhang_set_ranking", f"""WITH {LIGATED}, e AS (SELECT design, count(fidelity)::DOUBLE / count(*) AS coverage, CASE WHEN count(fidelity) = count(*) THEN CASE WHEN min(fidelity) > 0 THEN round(product(fidelity), 9) ELSE 0 END END AS estimate FROM empirical GROUP BY design),
h AS (SELECT design, count(nearest)::DOUBLE / count(*) AS coverage, CASE WHEN count(nearest) = count(*) THEN CASE WHEN min(nearest) > 0 THEN round(product(nearest / 3.0::DOUBLE), 9) ELSE 0 END END AS estimate FROM hamming GROUP BY design),
r AS (SELECT design, CASE WHEN e.estimate IS NOT NULL THEN 2 WHEN h.estimate IS NOT NULL THEN 1 ELSE 0 END AS tier, coalesce(e.estimate, h.estimate) AS estimate, CASE WHEN e.estimate IS NOT NULL THEN e.coverage ELSE h.coverage END AS coverage FROM e JOIN h USING (design))
SELECT design, tier, round(estimate, 6) AS estimate, coverage, CAST(row_number() OVER (ORDER BY tier DESC, coalesce(estimate, coverage) DESC, coverage DESC, design) AS BIGINT) AS rank FROM r""")
def overhang_set_ranking(spark, d):  # 122
    counts, j = ligation_counts(spark, d)
    empirical = cloning.assembly_scores(cloning.fidelity(j, counts), "fidelity")
    hamming = cloning.assembly_scores(cloning.heuristic(j), "score")
    return cloning.ranked_sets(empirical, hamming).select("design", "tier", F.round("estimate", 6).alias("estimate"), "coverage", F.col("rank").cast("long").alias("rank"))


# Every document gives a design of three fragments that share 15 to 44 bases; every sixth has a gap instead, every eleventh an N.
_FRAG = """fragments AS (SELECT doc_id AS design, i::INTEGER AS ord, CASE i WHEN 0 THEN substr(seq, 1, 200) WHEN 1 THEN CASE WHEN doc_id % 6 = 0 THEN 'ACGTTGCA' ELSE '' END || substr(seq, 201 - k, 150 + k) ELSE substr(seq, 331, 35) || CASE WHEN doc_id % 11 = 0 THEN 'N' ELSE substr(seq, 366, 1) END || substr(seq, 367, 34) || substr(seq, 1, 30) END AS seq FROM (SELECT *, CAST(15 + doc_id % 30 AS BIGINT) AS k, unnest(range(3)) AS i FROM seqs WHERE length(seq) >= 430))"""
OVERLAPS = f"""{SEQS}, {_FRAG}, n AS (SELECT *, coalesce(lead(seq) OVER w, first_value(seq) OVER w) AS nxt FROM fragments WINDOW w AS (PARTITION BY design ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ks AS (SELECT design, ord, list(k ORDER BY k DESC) AS ks FROM n, range(15, 61) t(k) WHERE length(seq) >= k AND length(nxt) >= k AND right(seq, k) = left(nxt, k) AND NOT contains(right(seq, k), 'N') GROUP BY ALL),
found_overlaps AS MATERIALIZED (SELECT n.*, CAST(ks[1] AS INTEGER) AS k, coalesce(len(ks), 0) AS many FROM n LEFT JOIN ks USING (design, ord))"""


def gibson_fragments(spark, d):
    s = seqs(spark, d).where(F.length("seq") >= 430).withColumn("k", (15 + F.col("doc_id") % 30).cast("int"))
    cut = lambda a, n: F.substring("seq", F.lit(a) if isinstance(a, int) else a, F.lit(n) if isinstance(n, int) else n)
    texts = F.array(cut(1, 200), F.concat(F.when(F.col("doc_id") % 6 == 0, "ACGTTGCA").otherwise(""), cut(201 - F.col("k"), 150 + F.col("k"))), F.concat(cut(331, 35), F.when(F.col("doc_id") % 11 == 0, "N").otherwise(cut(366, 1)), cut(367, 34), cut(1, 30)))
    return s.select(F.col("doc_id").alias("design"), F.posexplode(texts).alias("ord", "seq"))


@register("overlap_search", f"WITH {OVERLAPS} SELECT design, ord, k AS overlap, many = 1 AS is_unique, CASE WHEN many = 1 THEN 'exact' WHEN many > 1 THEN 'multiple_exact' ELSE 'none' END AS reason FROM found_overlaps")
def overlap_search(spark, d):  # 71
    from pyspark.sql import Window

    w = Window.partitionBy("design").orderBy("ord")
    nxt = F.coalesce(F.lead("seq").over(w), F.first("seq").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    f = cloning.with_overlaps(gibson_fragments(spark, d).withColumn("next", nxt), "seq", "next")
    return f.select("design", "ord", F.col("o.length").alias("overlap"), F.col("o.unique").alias("is_unique"), "o.reason")


@register("gibson_assemblies", f"""WITH {OVERLAPS}, b AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY design ORDER BY ord), 0) AS before, right(seq, k) AS text FROM found_overlaps), g AS (SELECT design, count_if(k IS NULL) AS missing, string_agg(substr(seq, before + 1), '' ORDER BY ord) AS s, arg_max(k, ord) AS closing, string_agg(k::VARCHAR, ',' ORDER BY ord) AS ks, count_if(many > 1) AS alternate, count(text) - count(DISTINCT text) AS reused, bool_or(contains(seq, 'N')) AS odd FROM b GROUP BY design)
SELECT design, missing = 0 AND NOT odd AS success, CASE WHEN odd THEN 'not_canonical' WHEN missing > 0 THEN 'no_overlap' ELSE '' END AS errors, coalesce(ks, '') AS overlaps, CAST(alternate AS BIGINT) AS alternate, CAST(reused AS INTEGER) AS reused, sha256(CASE WHEN missing = 0 AND NOT odd THEN left(s, length(s) - closing) ELSE '' END) AS product FROM g""")
def gibson_assemblies(spark, d):  # 152
    return cloning.gibson(gibson_fragments(spark, d), circular=True).select("design", "success", "errors", "overlaps", "alternate", "reused", F.sha2("product", 256).alias("product"))
