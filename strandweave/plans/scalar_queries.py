"""Queries of the scalar functions over the derived sequences of `documents`; numbers in comments are rows of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators import scans
from strandweave.plans.catalog import register
from strandweave.session import table

SEQS = f"seqs AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{S.LETTERS}', '{S.CYCLE}') AS seq FROM documents WHERE text IS NOT NULL)"
LETTERS = "letters AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents WHERE text IS NOT NULL)"
OLIGOS = f"oligos AS (SELECT DISTINCT translate(upper(w), '{S.LETTERS}', '{S.CYCLE}') AS seq FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' ')) AS w FROM documents WHERE text IS NOT NULL) WHERE length(w) >= 8)"


def seqs(spark, d):
    return S.sequences(table(spark, d, "documents"))


def letters(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s"))


def oligos(spark, d):
    """Every different word of eight letters or more, as bases: short sequences for primer-sized functions."""
    w = table(spark, d, "documents").where("text IS NOT NULL").select(F.explode_outer(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("w"))
    return w.where("w IS NOT NULL").distinct().select(F.translate(F.upper("w"), S.LETTERS, S.CYCLE).alias("seq")).distinct()


def n_sql(s: str, x: str) -> str:
    return f"(length({s}) - length(replace({s}, '{x}', '')))"


@register("alphabet_inspection", f"""WITH {LETTERS}, c AS (SELECT doc_id, unnest(range(length(s))) AS p, unnest(string_split(replace(s, 'U', 'T'), '')) AS c FROM letters WHERE s <> ''), f AS (SELECT doc_id, c, min(p) AS p FROM c GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(c, '' ORDER BY p) FILTER (NOT contains('ACGTRYSWKMBDHVN', c)), '') AS invalid, coalesce(bool_or(contains('RYSWKMBDHVN', c)), FALSE) AS ambiguous FROM letters LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def alphabet_inspection(spark, d):  # 29: invalid symbols in the order first seen
    return letters(spark, d).select("doc_id", F.array_join(S.invalid_symbols(F.col("s")), "").alias("invalid"), F.translate("s", "U", "T").rlike("[RYSWKMBDHVN]").alias("ambiguous"))


@register("mean_dna_mass", f"""WITH {LETTERS}, w AS (SELECT DISTINCT upper(x) AS s FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' ')) AS x FROM documents WHERE text IS NOT NULL) WHERE regexp_full_match(upper(x), '[ACGTRYSWKMBDHVN]+')),
m AS (SELECT s, list_sum(list_transform(string_split(s, ''), lambda c: CASE c WHEN 'A' THEN 331.2218::DOUBLE WHEN 'C' THEN 307.1971::DOUBLE WHEN 'G' THEN 347.2212::DOUBLE WHEN 'T' THEN 322.2085::DOUBLE WHEN 'R' THEN (331.2218::DOUBLE + 347.2212::DOUBLE) / 2 WHEN 'Y' THEN (307.1971::DOUBLE + 322.2085::DOUBLE) / 2 WHEN 'S' THEN (307.1971::DOUBLE + 347.2212::DOUBLE) / 2 WHEN 'W' THEN (331.2218::DOUBLE + 322.2085::DOUBLE) / 2 WHEN 'K' THEN (347.2212::DOUBLE + 322.2085::DOUBLE) / 2 WHEN 'M' THEN (331.2218::DOUBLE + 307.1971::DOUBLE) / 2
  WHEN 'B' THEN (307.1971::DOUBLE + 347.2212::DOUBLE + 322.2085::DOUBLE) / 3 WHEN 'D' THEN (331.2218::DOUBLE + 347.2212::DOUBLE + 322.2085::DOUBLE) / 3 WHEN 'H' THEN (331.2218::DOUBLE + 307.1971::DOUBLE + 322.2085::DOUBLE) / 3 WHEN 'V' THEN (331.2218::DOUBLE + 307.1971::DOUBLE + 347.2212::DOUBLE) / 3 ELSE (331.2218::DOUBLE + 307.1971::DOUBLE + 347.2212::DOUBLE + 322.2085::DOUBLE) / 4 END::DOUBLE)) - (length(s) - 1) * 18.0153::DOUBLE AS mass FROM w) SELECT s, floor(mass * 100 + 0.5) / 100 AS mass FROM m""")
def mean_dna_mass(spark, d):  # 35: ambiguous bases as their mean
    w = table(spark, d, "documents").where("text IS NOT NULL").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " ")).alias("x")).select(F.upper("x").alias("s")).where(F.col("s").rlike("^[ACGTRYSWKMBDHVN]+$")).distinct()
    return w.select("s", S.mean_dna_mass(F.col("s")).alias("mass"))


@register("reverse_complement", f"WITH {SEQS} SELECT doc_id, sha256(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc_sha256, sha256(translate(seq, 'ACGT', 'TGCA')) AS c_sha256 FROM seqs")
def reverse_complement(spark, d):  # 31, 49
    return seqs(spark, d).select("doc_id", F.sha2(S.reverse_complement(F.col("seq")), 256).alias("rc_sha256"), F.sha2(S.complement(F.col("seq")), 256).alias("c_sha256"))


@register("iupac_pair_compatibility", "SELECT a, b, list_has_any(string_split(x, ''), string_split(y, '')) AS compatible FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in facts.IUPAC.items()) + ") l(a, x), (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in facts.IUPAC.items()) + ") r(b, y)")
def iupac_pair_compatibility(spark, d):  # 32
    masks = {k: sum(1 << "ACGT".index(c) for c in v) for k, v in facts.IUPAC.items()}
    m = F.create_map(*[F.lit(x) for kv in masks.items() for x in kv])
    pairs = spark.createDataFrame([(k,) for k in masks], "a string").withColumn("b", F.explode(F.map_keys(m)))
    return pairs.select("a", "b", (F.try_element_at(m, F.col("a")).bitwiseAND(F.try_element_at(m, F.col("b"))) != 0).alias("compatible"))


@register("nucleotide_composition", f"WITH {LETTERS} SELECT doc_id, " + ", ".join(f"{n_sql('s', b)} AS n_{b.lower()}" for b in "ATUGCN") + ", length(s) - " + " - ".join(n_sql("s", b) for b in "ATUGCN") + " AS n_other FROM letters")
def nucleotide_composition(spark, d):  # 33
    c = {b: S.count_of(F.col("s"), b) for b in "ATUGCN"}
    other = F.length("s")
    for x in c.values():
        other = other - x
    return letters(spark, d).select("doc_id", *[x.alias(f"n_{b.lower()}") for b, x in c.items()], other.alias("n_other"))


@register("gc_fraction", f"WITH {SEQS} SELECT doc_id, CASE WHEN length(seq) > 0 THEN round(({n_sql('seq', 'G')} + {n_sql('seq', 'C')})::DOUBLE / length(seq), 9) ELSE 0 END AS gc FROM seqs")
def gc_fraction(spark, d):  # 34
    return seqs(spark, d).select("doc_id", F.round(S.gc_fraction(F.col("seq")), 9).alias("gc"))


def _mass_sql(mode: str, extra: str) -> str:
    m, w = facts.NUCLEOTIDE_MASS[mode], facts.NUCLEOTIDE_WATER[mode]
    total = " + ".join(f"{n_sql('seq', b)} * {m[b]}::DOUBLE" for b in "ACGT")
    return f"floor(({total} - {extra} * {w}::DOUBLE) * 100 + 0.5) / 100"


@register("dna_molecular_weight", f"WITH {SEQS} SELECT doc_id, CASE WHEN length(seq) = 0 THEN 0 ELSE {_mass_sql('average', '(length(seq) - 1)')} END AS linear_mass, CASE WHEN length(seq) = 0 THEN 0 ELSE {_mass_sql('monoisotopic', 'length(seq)')} END AS circular_mono FROM seqs")
def dna_molecular_weight(spark, d):  # 35
    return seqs(spark, d).select("doc_id", S.dna_mass(F.col("seq")).alias("linear_mass"), S.dna_mass(F.col("seq"), "monoisotopic", circular=True).alias("circular_mono"))


_RES = " + ".join(f"{n_sql('s', a)} * {m}::DOUBLE" for a, m in facts.RESIDUE_MASS.items())
_KNOWN = " + ".join(n_sql("s", a) for a in facts.RESIDUE_MASS)


@register("protein_molecular_weight", f"WITH {LETTERS} SELECT doc_id, CASE WHEN length(s) = 0 THEN 0 ELSE floor(({_RES} + (length(s) - ({_KNOWN})) * {facts.RESIDUE_OTHER}::DOUBLE + {facts.RESIDUE_WATER}::DOUBLE) * 100 + 0.5) / 100 END AS mass FROM letters")
def protein_molecular_weight(spark, d):  # 36
    return letters(spark, d).select("doc_id", S.protein_mass(F.col("s")).alias("mass"))


@register("quick_melting_temperature", f"WITH {OLIGOS}, c AS (SELECT seq, {n_sql('seq', 'A')} + {n_sql('seq', 'T')} AS w, {n_sql('seq', 'G')} + {n_sql('seq', 'C')} AS g FROM oligos) SELECT seq, round(CASE WHEN w + g <= 20 THEN 2 * w + 4 * g ELSE 64.9 + 41 * (g - 16.4) / (w + g) END, 6)::DOUBLE AS tm FROM c")
def quick_melting_temperature(spark, d):  # 37
    return oligos(spark, d).select("seq", F.round(S.quick_tm(F.col("seq")), 6).alias("tm"))


def _pairs_sql() -> str:
    rows = ", ".join(f"('{p}', {h * 1000}::DOUBLE, {s}::DOUBLE)" for p, (h, s) in facts.STACKS.items())
    end = lambda e: f"CASE WHEN {e} IN ('A', 'T') THEN {facts.END_AT[0] * 1000} ELSE {facts.END_GC[0] * 1000} END"
    ends = lambda e: f"CASE WHEN {e} IN ('A', 'T') THEN {facts.END_AT[1]} ELSE {facts.END_GC[1]} END"
    return f"""{OLIGOS}, stacks(pair, h, s) AS (VALUES {rows}), pairs AS (SELECT seq, substr(seq, CAST(i AS BIGINT), 2) AS pair FROM (SELECT seq, unnest(generate_series(1, length(seq) - 1)) AS i FROM oligos)),
    own AS (SELECT seq, seq = reverse(translate(seq, 'ACGT', 'TGCA')) AS own FROM oligos),
    thermo AS (SELECT seq, sum(h) + any_value({end("substr(seq, 1, 1)")}) + any_value({end("right(seq, 1)")}) AS dh, sum(s) + any_value({ends("substr(seq, 1, 1)")}) + any_value({ends("right(seq, 1)")}) + CASE WHEN any_value(own) THEN {facts.SYMMETRY_DS} ELSE 0 END AS ds, any_value(own) AS own FROM pairs JOIN stacks USING (pair) JOIN own USING (seq) GROUP BY seq)"""


@register("nearest_neighbour_thermodynamics", f"WITH {_pairs_sql()} SELECT seq, round(dh, 3)::DOUBLE AS delta_h, round(ds, 3)::DOUBLE AS delta_s, round(dh - 310.15 * ds, 4)::DOUBLE AS delta_g37 FROM thermo")
def nearest_neighbour_thermodynamics(spark, d):  # 38
    dh, ds = S.duplex(F.col("seq"))
    return oligos(spark, d).select("seq", dh.alias("h"), ds.alias("s")).select("seq", F.round("h", 3).alias("delta_h"), F.round("s", 3).alias("delta_s"), F.round(F.col("h") - 310.15 * F.col("s"), 4).alias("delta_g37"))


@register("salt_corrected_tm", f"""WITH {_pairs_sql()}, k AS (SELECT seq, dh / (ds + 1.987 * ln(250e-9 / CASE WHEN own THEN 1 ELSE 4 END)) AS kelvin, ({n_sql('seq', 'G')} + {n_sql('seq', 'C')})::DOUBLE / length(seq) AS gc FROM thermo)
SELECT seq, CASE WHEN length(seq) < 14 THEN 2.0 * ({n_sql('seq', 'A')} + {n_sql('seq', 'T')}) + 4.0 * ({n_sql('seq', 'G')} + {n_sql('seq', 'C')}) ELSE floor((1 / (1 / kelvin + (4.29 * gc - 3.95) * 1e-5 * ln(0.05) + 9.40e-6 * ln(0.05) * ln(0.05)) - 273.15) * 10 + 0.5) / 10 END::DOUBLE AS tm FROM k""")
def salt_corrected_tm(spark, d):  # 39
    return oligos(spark, d).select("seq", S.melting_temperature(F.col("seq")).alias("tm"))


def _magnesium_sql(na: float, mg: float, dntp: float) -> str:
    """Owczarzy's corrections with magnesium, free of dNTPs, as SQL over kelvin, gc and n; constants as published."""
    free = f"((-(1 + 3e4 * ({dntp} - {mg})) + sqrt(pow(1 + 3e4 * ({dntp} - {mg}), 2) + 4 * 3e4 * {mg})) / (2 * 3e4))"
    a, d, g = ("3.92e-5 * (0.843 - 0.352 * sqrt(na) * ln(na))", "1.42e-5 * (1.279 - 4.03e-3 * ln(na) - 8.03e-3 * ln(na) * ln(na))", "8.31e-5 * (0.486 - 0.258 * ln(na) + 5.25e-3 * pow(ln(na), 3))")
    full = lambda a, d, g: f"1 / kelvin + {a} - 9.11e-6 * ln(mg) + gc * (6.26e-5 + {d} * ln(mg)) + (1 / (2.0 * (n - 1))) * (-4.82e-4 + 5.25e-4 * ln(mg) + {g} * ln(mg) * ln(mg))"
    inverse = f"CASE WHEN sqrt(mg) / na < 6 THEN {full(a, d, g)} ELSE {full('3.92e-5', '1.42e-5', '8.31e-5')} END"
    return f"(SELECT floor((1 / ({inverse}) - 273.15) * 10 + 0.5) / 10 FROM (SELECT {na}::DOUBLE AS na, {free}::DOUBLE AS mg))"


@register("magnesium_tm", f"""WITH {_pairs_sql()}, k AS (SELECT seq, length(seq)::DOUBLE AS n, dh / (ds + 1.987 * ln(250e-9 / CASE WHEN own THEN 1 ELSE 4 END)) AS kelvin, ({n_sql('seq', 'G')} + {n_sql('seq', 'C')})::DOUBLE / length(seq) AS gc FROM thermo WHERE length(seq) >= 14)
SELECT seq, {_magnesium_sql(0.05, 0.002, 0.0008)} AS mixed, {_magnesium_sql(0.001, 0.002, 0.0008)} AS magnesium FROM k""")
def magnesium_tm(spark, d):  # 39: the mixed and the magnesium branch
    o = oligos(spark, d).where(F.length("seq") >= 14)
    return o.select("seq", S.melting_temperature(F.col("seq"), 50, 2, 250, 0.8).alias("mixed"), S.melting_temperature(F.col("seq"), 1, 2, 250, 0.8).alias("magnesium"))



def _translate_sql(frame: int) -> str:
    code = facts.code_string(1)
    res = f"substr('{code}', CAST(1 + 16 * (instr('TCAG', substr(c, 1, 1)) - 1) + 4 * (instr('TCAG', substr(c, 2, 1)) - 1) + instr('TCAG', substr(c, 3, 1)) - 1 AS BIGINT), 1)"
    return f"array_to_string(list_transform(regexp_extract_all(substr(seq, {frame + 1}), '...'), lambda c: {res}), '')"


@register("translation_frames", f"WITH {SEQS} SELECT doc_id, " + ", ".join(f"sha256(coalesce({_translate_sql(f)}, '')) AS frame{f + 1}_sha256" for f in range(3)) + ", greatest(length(seq) // 3, 0) AS residues FROM seqs")
def translation_frames(spark, d):  # 41, 42
    t = scans.translations(seqs(spark, d))
    n = seqs(spark, d).select("doc_id", F.floor(F.length("seq") / 3).alias("residues"))
    return t.join(n, "doc_id").select("doc_id", *[F.sha2(f"frame{f}", 256).alias(f"frame{f}_sha256") for f in (1, 2, 3)], "residues")


@register("genetic_codes", "SELECT t AS table_id, substr('TCAG', CAST(i // 16 + 1 AS BIGINT), 1) || substr('TCAG', CAST(i // 4 % 4 + 1 AS BIGINT), 1) || substr('TCAG', CAST(i % 4 + 1 AS BIGINT), 1) AS codon, substr(code, CAST(i + 1 AS BIGINT), 1) AS aa FROM (VALUES " + ", ".join(f"({t}, '{facts.code_string(t)}')" for t in facts.CODES) + ") c(t, code), generate_series(0, 63) g(i)")
def genetic_codes(spark, d):  # 44
    code = spark.createDataFrame([(t, facts.code_string(t)) for t in facts.CODES], "table_id int, code string")
    i, b = F.col("i"), F.lit(facts.BASES)
    at = lambda k: b.substr(k.cast("int") + 1, F.lit(1))
    return code.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).select("table_id", F.concat(at(F.floor(i / 16)), at(F.floor(i / 4) % 4), at(i % 4)).alias("codon"), F.col("code").substr(i + 1, F.lit(1)).alias("aa"))


@register("gc_clamp", f"WITH {OLIGOS} SELECT seq, regexp_matches(right(seq, 5), '[GC]') AS clamp FROM oligos")
def gc_clamp(spark, d):  # 62
    return oligos(spark, d).select("seq", S.gc_clamp(F.col("seq")).alias("clamp"))


@register("ambiguous_base_count", f"WITH {LETTERS} SELECT doc_id, length(regexp_replace(s, '[^RYSWKMBDHVN]', '', 'g')) AS n FROM letters")
def ambiguous_base_count(spark, d):  # 95
    return letters(spark, d).select("doc_id", F.length(F.regexp_replace("s", "[^RYSWKMBDHVN]", "")).alias("n"))


@register("fasta_records", f"WITH {SEQS} SELECT doc_id, sha256('>' || doc_id || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10))) AS fasta_sha256 FROM seqs")
def fasta_records(spark, d):  # 14
    from strandweave.sources.text import to_fasta

    return seqs(spark, d).select("doc_id", F.sha2(to_fasta(F.col("doc_id").cast("string"), F.col("seq")), 256).alias("fasta_sha256"))
