"""Construct verification: reads are trimmed, mapped and turned into evidence for or against a reference.

Reads are trimmed by batch, mapped by seeds and bands (mapping), and give their alignment columns and variants. All that is said
about a construct follows by aggregates over those rows: depth, alleles and consensus by position, variants by what they change,
required regions and expected variants by joins, the state by the worst reason. A deep position or a construct with very many reads is
no group of its own anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.operators import mapping
from strandweave.session import written


class Thresholds(NamedTuple):
    """Fixed values of the defaults."""

    trim_quality: float = 20
    trim_window: int = 12
    min_length: int = 40
    min_identity: float = 0.82
    min_margin: float = 0.03
    min_coverage: float = 1.0
    min_depth: int = 1
    min_consensus: float = 0.7
    min_quality: float = 20
    min_fraction: float = 0.6
    most_indel: int = 24
    most_indel_fraction: float = 0.12


def trimmed(quality: list[int] | np.ndarray | None, n: int, t: Thresholds) -> tuple[int, int]:
    """From the first to the last window whose mean quality is high enough; the whole read if it has no qualities."""
    if quality is None or not n:
        return 0, n
    c = np.concatenate([[0], np.cumsum(quality)])
    w = min(n, t.trim_window)
    good = np.flatnonzero(c[w:] - c[:-w] >= t.trim_quality * w)
    return (int(good[0]), int(good[-1]) + w) if len(good) else (0, 0)


COLUMN = "array<struct<pos:int,allele:string,q:double>>"
VARIANT = "array<struct<type:string,start:int,end:int,ref:string,alt:string,q:double>>"


def arrays_of(column: pa.Array) -> list[np.ndarray | None]:
    """The lists of an Arrow column of numbers as arrays."""
    off, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return [values[a:b] if ok else None for a, b, ok in zip(off[:-1].tolist(), off[1:].tolist(), column.is_valid().to_pylist(), strict=True)]


def lists(parts: list[np.ndarray | None], values: pa.Array) -> pa.Array:
    """A list column of `values`, which are those of `parts` end to end; None: null."""
    off = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in parts], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values, mask=pa.array([p is None for p in parts], pa.bool_()))


def joined(parts: list[np.ndarray | None], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(p for p in parts if p is not None)]).astype(kind)


def prepared(reads: DataFrame, t: Thresholds) -> DataFrame:
    """construct, read, trim_start, trim_end, calls (upper case, trimmed), quality (of these; null: none) of reads (construct, read, calls, quality)."""
    kinds = ", ".join(f"{c} {reads.schema[c].dataType.simpleString()}" for c in ("construct", "read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                texts = [(c or "").upper() for c in b.column("calls").to_pylist()]
                quality = arrays_of(b.column("quality"))
                ends = [trimmed(q, len(c), t) for c, q in zip(texts, quality, strict=True)]
                kept = [c[x:y] for c, (x, y) in zip(texts, ends, strict=True)]
                scores = [None if q is None else q[x:y] for q, (x, y) in zip(quality, ends, strict=True)]
                cols = [pa.array([x for x, _ in ends], pa.int32()), pa.array([y for _, y in ends], pa.int32()), pa.array(kept, pa.string()), lists(scores, pa.array(joined(scores, np.float64)))]
                yield pa.RecordBatch.from_arrays([b.column("construct"), b.column("read"), *cols], names=["construct", "read", "trim_start", "trim_end", "calls", "quality"])

    return reads.select("construct", "read", "calls", "quality").mapInArrow(run, f"{kinds}, trim_start int, trim_end int, calls string, quality array<double>")


def beside(known: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every place the known value nearest to it, the mean of two at the same distance; nan where nothing is known."""
    place = np.arange(len(known))
    before = np.maximum.accumulate(np.where(known, place, -1))
    after = np.minimum.accumulate(np.where(known, place, len(known))[::-1])[::-1]
    far = len(known) + 1
    left, right = np.where(before < 0, far, place - before), np.where(after == len(known), far, after - place)
    v = np.append(value, np.nan)
    a, b = v[np.where(before < 0, -1, before)], v[np.where(after == len(known), -1, after)]
    return np.where(left < right, a, np.where(right < left, b, (a + b) / 2))


def read_columns(own: str, quality: np.ndarray | None, path: str, segment: str, place: int, circle: int, most_indel: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Calls by position (places, letters, qualities; nan: unknown) and variants (indels where the path has them) of one mapped read."""
    steps = np.frombuffer(path.encode(), np.uint8)
    alone, gone = steps == ord("i"), steps == ord("d")
    i, j = np.cumsum(~gone) - 1, np.cumsum(~alone) - 1
    bases = np.frombuffer(own.encode("latin-1", "replace"), np.uint8)
    text = np.frombuffer(segment.upper().encode("latin-1", "replace"), np.uint8)
    where = place + np.where(alone, j + 1, j)
    where = where % circle if circle else where
    read = np.where(gone, ord("-"), bases[np.where(gone, 0, i)] if len(bases) else 0)
    q = np.full(len(steps), np.nan) if quality is None else np.where(gone, np.nan, quality[np.where(gone, 0, i)])
    shown = np.where(gone, beside(~np.isnan(q), q), q)
    value = lambda k: None if np.isnan(shown[k]) else float(shown[k])
    on = np.flatnonzero(~alone & np.isin(read, np.frombuffer(b"ACGT-", np.uint8)))
    _, first = np.unique(where[on], return_index=True)
    on = on[np.sort(first)]
    below = np.where(alone, 0, text[np.where(alone, 0, j)] if len(text) else 0)
    plain = np.isin(read, PLAIN) & np.isin(below, PLAIN)
    variants = [{"type": "substitution", "start": int(where[k]), "end": int(where[k]) + 1, "ref": chr(below[k]), "alt": chr(read[k]), "q": value(k)} for k in np.flatnonzero((steps == ord("s")) & plain & (read != below)).tolist()]
    edges = np.flatnonzero(np.diff(steps)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(steps)], strict=True):
        if not alone[a] and not gone[a]:
            continue
        kind, letters = ("insertion", read[a:b]) if alone[a] else ("deletion", below[a:b])
        if b - a > most_indel or not np.isin(letters, PLAIN).all():
            continue
        allele, start = letters.astype(np.uint8).tobytes().decode(), int(where[a])
        known = [v for v in map(value, range(a, b) if alone[a] else [a]) if v is not None]
        mean = sum(known) / len(known) if known else None
        variants.append({"type": kind, "start": start, "end": start if alone[a] else start + b - a, "ref": "" if alone[a] else allele, "alt": allele if alone[a] else "", "q": mean})
    return where[on].astype(np.int32), read[on].astype(np.uint8), shown[on], variants


PLAIN = np.frombuffer(b"ACGT", np.uint8)


def statuses(rows: DataFrame, t: Thresholds) -> DataFrame:
    """rows of prepared reads and their alignments (null: none) with status and identity.

    In this order: too short after trimming, unmapped (no alignment scores above nothing), too little identity, too much or too long an indel, a position of a circle met twice,
    another path that scores as much or nearly so.
    """
    count = lambda c: F.length("path") - F.length(F.replace("path", F.lit(c), F.lit("")))
    steps = F.length("path")
    identity = count("m") / steps
    longest = F.greatest(*[F.array_max(F.transform(F.regexp_extract_all("path", F.lit(f"({c}+)"), F.lit(1)), F.length)) for c in "id"])
    best = F.col("score") == F.col("second")
    near = (F.col("score") - F.col("second")) / (mapping.MATCH * F.col("n")) < t.min_margin
    status = (
        F.when(F.length("calls") < t.min_length, "trimmed_read_too_short").when(F.coalesce(F.col("score"), F.lit(0)) <= 0, "unmapped_read").when(identity < t.min_identity, "low_mapping_identity")
        .when((F.coalesce(longest, F.lit(0)) > t.most_indel) | ((count("i") + count("d")) / steps > t.most_indel_fraction), "excessive_indel")
        .when((F.col("circle") > 0) & (steps - count("i") > F.col("circle")), "ambiguous_mapping").when(best | near, "ambiguous_mapping").otherwise("mapped")
    )
    there = ~F.col("status").isin("trimmed_read_too_short", "unmapped_read")
    return rows.withColumn("status", status).withColumn("identity", F.when(there, identity)).withColumn("strand", F.when(there, F.col("strand")))


def map_reads(reads: DataFrame, references: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """reads (construct, read, calls, quality: array or null) joined with references (construct, seq, topology) and mapped: construct, read, status, strand, trim_start, trim_end, identity, columns, variants.

    A read is a row of its own (construct, read). Indels are moved as far to the left as the reference repeats them.
    """
    t = thresholds
    names = ["construct", "read"]
    refs = references.select("construct", F.upper(F.coalesce("seq", F.lit(""))).alias("seq"), F.coalesce(F.col("topology") == "circular", F.lit(False)).alias("circular"))
    known = written(prepared(reads, t).join(refs.select("construct").hint("merge"), "construct", "left_semi"), "constructs-reads")
    asked = known.where(F.length("calls") >= max(1, t.min_length))
    found = mapping.alignments(asked, refs.where(F.length("seq") > 0), t.min_margin)
    rows = written(statuses(known.join(found.hint("merge"), names, "left"), t), "constructs-mapped")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ref", pa.string()), ("alt", pa.string()), ("q", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for q, calls, strand, path, segment, place, circle in zip(arrays_of(b.column("quality")), *(b.column(c).to_pylist() for c in ("calls", "strand", "path", "segment", "place", "circle")), strict=True):
                    own = calls if strand == 1 else facts.reverse_complement(calls)
                    out.append(read_columns(own, q if q is None or strand == 1 else q[::-1], path, segment, place, circle, t.most_indel))
                places, letters, shown, variants = ([o[i] for o in out] for i in range(4))
                letter = joined(letters, np.uint8)
                alleles = pa.StringArray.from_buffers(len(letter), pa.py_buffer(np.arange(len(letter) + 1, dtype=np.int32)), pa.py_buffer(letter))
                each = pa.StructArray.from_arrays([pa.array(joined(places, np.int32)), alleles, pa.array(joined(shown, np.float64), from_pandas=True)], names=["pos", "allele", "q"])
                yield pa.RecordBatch.from_arrays([b.column("construct"), b.column("read"), lists(places, each), pa.array(variants, change)], names=["construct", "read", "columns", "variants"])

    shown = written(rows.where("status = 'mapped'").select(*names, "calls", "quality", "strand", "path", "segment", "place", "circle").mapInArrow(run, f"{kinds}, columns {COLUMN}, variants {VARIANT}"), "constructs-columns")
    each = shown.select(*names, F.posexplode("variants").alias("ord", "v")).select(*names, "ord", "v.*")
    allele = F.when(F.col("type") == "insertion", F.col("alt")).otherwise(F.col("ref"))
    indels = each.where("type <> 'substitution'").withColumn("allele", allele)
    moved = mapping.leftmost(indels, refs.select("construct", "seq"))
    own = F.col("type") == "insertion"
    indels = indels.join(moved.hint("merge"), ["construct", "type", "start", "allele"]).select(
        *names, "ord", "type", F.col("to_start").alias("start"), F.when(own, F.col("to_start")).otherwise(F.col("to_start") + F.length("allele")).alias("end"),
        F.when(own, "").otherwise(F.col("to_allele")).alias("ref"), F.when(own, F.col("to_allele")).otherwise("").alias("alt"), "q")
    change = ["type", "start", "end", "ref", "alt"]
    once = each.where("type = 'substitution'").select(*names, "ord", *change, "q").unionByName(indels).groupBy(*names, *change).agg(F.min_by("q", "ord").alias("q"), F.min("ord").alias("ord"))
    listed = once.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *change, "q"))), lambda x: F.struct(*[x[c].alias(c) for c in [*change, "q"]])).alias("variants"))
    none = lambda kind: F.array().cast(kind)
    out = rows.join(shown.select(*names, "columns").hint("merge"), names, "left").join(listed.hint("merge"), names, "left")
    return out.select(*names, "status", "strand", "trim_start", "trim_end", "identity", F.coalesce("columns", none(COLUMN)).alias("columns"), F.coalesce("variants", none(VARIANT)).alias("variants"))


def weight(q):
    return F.coalesce(q + 1, F.lit(1.0))


def calls(reads: DataFrame) -> DataFrame:
    """construct, read, strand, pos, allele, q: one call a read and position of mapped reads; ambiguous bases are no calls, a deletion is one."""
    return reads.where("status = 'mapped'").select("construct", "read", "strand", F.explode("columns").alias("c")).select("construct", "read", "strand", "c.pos", "c.allele", "c.q")


def shown_variants(reads: DataFrame) -> DataFrame:
    """construct, read and the variants of mapped reads."""
    return reads.where("status = 'mapped'").select("construct", "read", F.explode("variants").alias("v")).select("construct", "read", "v.*")


def observed(reads: DataFrame, spans: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """spans: span_reads of these variants at least. construct, type, start, end, ref, alt, support, depth, high_depth, fraction, mean_q, confidence of every variant that some read shows; depth counts reads with a call at each of its positions."""
    each = shown_variants(reads)
    kinds = each.select("construct", "type", "start", "end", "ref", "alt").distinct()
    s = each.join(spans.select("construct", "type", "start", "end", "ref", "alt", "read", "least").hint("merge"), ["construct", "type", "start", "end", "ref", "alt", "read"])
    key = ["construct", "type", "start", "end", "ref", "alt"]
    total = spans.groupBy(*key).agg(F.count("*").alias("depth"), F.sum(weight(F.col("least"))).alias("w"), F.count_if(F.col("least") >= t.min_quality).alias("high_depth"))
    own = s.groupBy(*key).agg(F.count("*").alias("support"), F.sum(weight(F.col("q"))).alias("sw"), F.avg("q").alias("mean_q"), F.bool_or(F.coalesce(F.col("least") >= t.min_quality, F.lit(False))).alias("high"), F.array_sort(F.collect_set("read")).alias("reads"))
    j = kinds.join(total.hint("merge"), key, "left").join(own.hint("merge"), key, "left").fillna(0, ["depth", "support", "high_depth"]).withColumn("fraction", F.coalesce(F.least(F.lit(1.0), F.col("sw") / F.col("w")), F.lit(0.0)))
    sure = (F.col("fraction") >= t.min_fraction) & (F.col("mean_q") >= t.min_quality) & F.col("high")
    return j.select(*key, "support", "depth", "high_depth", "fraction", "mean_q", F.when(sure, "high").otherwise("low").alias("confidence"), "reads")


def span_reads(kinds: DataFrame, called: DataFrame, lengths: DataFrame, t: Thresholds) -> DataFrame:
    """The variants of `kinds` with every read that has a call at all of their positions, and its lowest quality there (null if one is unknown)."""
    n = F.col("n")
    before = F.when(F.col("circular"), F.array_distinct(F.array(F.pmod(F.col("start") - 1, n), F.pmod(F.col("start"), n)))).when(F.col("start") == 0, F.array(F.lit(0))).when(F.col("start") == n, F.array(n - 1)).otherwise(F.array(F.col("start") - 1, F.col("start")))
    places = F.when(F.col("type") == "insertion", before).otherwise(F.sequence(F.col("start"), F.col("end") - 1))
    key = ["construct", "type", "start", "end", "ref", "alt"]
    p = kinds.join(lengths.hint("merge"), "construct").withColumn("places", places).select(*key, F.size("places").alias("want"), F.explode("places").alias("pos"))
    g = p.join(called.hint("merge"), ["construct", "pos"]).groupBy(*key, "want", "read").agg(F.count("*").alias("have"), F.min("q").alias("low"), F.count("q").alias("known"))
    return g.where("have = want").withColumn("least", F.when(F.col("known") == F.col("want"), F.col("low")))


ALLELES = "ACGT-"  # what a call can be; of equal ones the first leads


def consensus(called: DataFrame, bases: DataFrame, seen: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """construct, pos, base, call, status, depth, forward, reverse, fraction of every position of the references (construct, pos, base).

    The allele with most weight is the call, unless two tie or it has too little; a call that changes the reference also needs a sure variant. Else the call is N.
    """
    sums = [F.sum(F.when(F.col("allele") == a, weight(F.col("q")))).alias(f"w{i}") for i, a in enumerate(ALLELES)]
    g = called.groupBy("construct", "pos").agg(*sums, F.count("*").alias("depth"), F.count_if(F.col("strand") == 1).alias("forward"))
    p = bases.join(g.hint("merge"), ["construct", "pos"], "left").fillna(0, ["depth", "forward"])
    w = [F.col(f"w{i}") for i in range(len(ALLELES))]
    p = p.withColumn("most", F.greatest(*w)).withColumn("lead", F.coalesce(*[F.when(x == F.col("most"), a) for x, a in zip(w, ALLELES, strict=True)]))
    share = F.coalesce(F.col("most") / sum((F.coalesce(x, F.lit(0.0)) for x in w), F.lit(0.0)), F.lit(0.0))
    tie = sum((F.coalesce((x == F.col("most")).cast("int"), F.lit(0)) for x in w), F.lit(0)) > 1
    mask = F.create_map(*[F.lit(x) for k, v in facts.IUPAC.items() for x in (k, v)])
    alike = F.coalesce(F.try_element_at(mask, F.col("base")).contains(F.col("lead")), F.lit(False))
    sure = seen.where(F.col("confidence") == "high").where(F.col("fraction") >= t.min_consensus)
    edits = sure.where("type = 'substitution'").select("construct", F.col("start").alias("pos"), F.col("alt").alias("edit")).unionByName(sure.where("type = 'deletion'").select("construct", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), F.lit("-").alias("edit"))).distinct().groupBy("construct", "pos").agg(F.collect_set("edit").alias("edits"))
    p = p.join(edits.hint("merge"), ["construct", "pos"], "left")
    backed = F.coalesce(F.array_contains("edits", F.col("lead")), F.lit(False))
    status = F.when(F.col("depth") == 0, "uncovered").when(tie | (share < t.min_consensus), "conflict").when(alike, "reference").when(backed, "variant").otherwise("conflict")
    contested = (F.col("depth") > 0) & (tie | (share < t.min_consensus))
    return p.select("construct", "pos", "base", F.when(status.isin("reference", "variant"), F.col("lead")).otherwise("N").alias("call"), status.alias("status"), "depth", "forward", (F.col("depth") - F.col("forward")).alias("reverse"), share.alias("fraction"), contested.alias("contested"))


def region_status(positions: DataFrame, regions: DataFrame) -> DataFrame:
    """construct, region, covered, met, both, length, least, status of required regions (construct, region, start, end, min_depth, both_strands; end before start passes the origin) over consensus positions."""
    n = positions.groupBy("construct").agg(F.max("pos").alias("last"))
    places = F.when(F.col("end") > F.col("start"), F.sequence(F.col("start"), F.col("end") - 1)).otherwise(F.concat(F.sequence(F.col("start"), F.col("last")), F.when(F.col("end") > 0, F.sequence(F.lit(0), F.col("end") - 1)).otherwise(F.array().cast("array<int>"))))
    r = regions.join(n.hint("merge"), "construct").withColumn("pos", F.explode(places)).join(positions.select("construct", "pos", "depth", "forward", "reverse").hint("merge"), ["construct", "pos"])
    g = r.groupBy("construct", "region", "min_depth", "both_strands").agg(F.count("*").alias("length"), F.count_if(F.col("depth") > 0).alias("covered"), F.count_if(F.col("depth") >= F.col("min_depth")).alias("met"), F.count_if((F.col("forward") > 0) & (F.col("reverse") > 0)).alias("both"), F.min("depth").alias("least"))
    status = F.when(F.col("covered") < F.col("length"), "uncovered").when(F.col("met") < F.col("length"), "low_depth").when(F.col("both_strands") & (F.col("both") < F.col("length")), "missing_strand").otherwise("covered")
    return g.select("construct", "region", "length", "covered", "met", "both", "least", status.alias("status"))


def expected_status(expected: DataFrame, seen: DataFrame, spans: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """spans: span_reads of these variants at least. Expected variants (construct, id, type, start, end, ref, alt) with status: observed, low_confidence, not_observed, not_covered."""
    key = ["construct", "type", "start", "end", "ref", "alt"]
    deep = spans.groupBy(*key).agg(F.count_if(F.col("least") >= t.min_quality).alias("depth"))
    j = expected.join(seen.select(*key, "confidence").hint("merge"), key, "left").join(deep.hint("merge"), key, "left").fillna(0, ["depth"])
    return j.withColumn("status", F.when(F.col("confidence") == "high", "observed").when(F.col("confidence") == "low", "low_confidence").when(F.col("depth") == 0, "not_covered").otherwise("not_observed")).drop("confidence")


INCONSISTENT = ["unexpected_variant", "expected_variant_not_observed", "conflicting_consensus"]


def verified(reads: DataFrame, references: DataFrame, expected: DataFrame | None = None, regions: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """construct, state, reasons, reads, usable, coverage, mean_depth, consensus, variants, report of every reference (construct, seq, topology).

    state: inconsistent if evidence speaks against the construct, needs_review if it is not enough, else consistent. report is the whole as canonical JSON.
    """
    m = written(map_reads(reads, references, t), "constructs-reads")
    lengths = references.select("construct", F.length("seq").alias("n"), (F.col("topology") == "circular").alias("circular"))
    called = calls(m)
    key = ["construct", "type", "start", "end", "ref", "alt"]
    asked = shown_variants(m).select(*key)
    asked = (asked if expected is None else asked.unionByName(expected.select(*key))).distinct()
    spans = written(span_reads(asked, called, lengths, t), "constructs-spans")
    seen = observed(m, spans, t)
    wanted = expected.select(*key, F.lit(True).alias("wanted")) if expected is not None else None
    seen = written(seen.join(wanted.hint("merge"), key, "left") if wanted is not None else seen.withColumn("wanted", F.lit(None).cast("boolean")), "constructs-variants")
    bases = references.select("construct", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "base")).where("base <> ''")
    spots = written(consensus(called, bases, seen, t), "constructs-positions")
    says = lambda bad, name: F.when(bad, name)
    by_read = m.groupBy("construct").agg(F.count("*").alias("reads"), F.count_if(F.col("status") == "mapped").alias("usable"), F.collect_set(says(F.col("status") != "mapped", F.col("status"))).alias("r1"))
    bare = reads.groupBy("construct").agg(F.collect_set(says(F.col("quality").isNull(), "missing_quality")).alias("r2"))
    cover = spots.groupBy("construct").agg((F.count_if(F.col("depth") >= t.min_depth) / F.count("*")).alias("coverage"), F.avg("depth").alias("mean_depth"), F.count_if("contested").alias("conflicts"), F.array_join(F.sort_array(F.collect_list(F.struct("pos", "call")))["call"], "").alias("calls"))
    sure_insertion = (F.col("type") == "insertion") & (F.col("confidence") == "high") & (F.col("fraction") >= t.min_consensus)
    per_place = seen.groupBy("construct", "start").agg(
        F.count_if(sure_insertion).alias("k"), F.max(F.when(sure_insertion, F.col("alt"))).alias("added"), F.collect_list(F.concat_ws(":", "type", "start", "end", "ref", "alt", "confidence")).alias("v"),
        F.count_if(F.col("confidence") == "low").alias("low"), F.count_if((F.col("confidence") == "high") & F.col("wanted").isNull()).alias("odd"))
    shown = per_place.groupBy("construct").agg(
        F.array_sort(F.flatten(F.collect_list("v"))).alias("variants"), F.collect_list(F.when(F.col("k") == 1, F.struct("start", "added"))).alias("added"),
        F.sum("low").alias("low"), F.sum("odd").alias("odd"), F.count_if(F.col("k") > 1).alias("rivals"))
    out = references.select("construct").join(by_read.hint("merge"), "construct", "left").join(bare.hint("merge"), "construct", "left").join(cover.hint("merge"), "construct", "left").join(shown.hint("merge"), "construct", "left").join(lengths.hint("merge"), "construct")
    out = out.fillna(0, ["reads", "usable", "low", "odd", "rivals", "conflicts"])
    none = F.array().cast("array<string>")
    why = [F.coalesce("r1", none), F.coalesce("r2", none), F.array(says(F.col("usable") == 0, "no_usable_reads"), says(F.col("coverage") < t.min_coverage, "partial_reference_coverage"), says((F.col("conflicts") > 0) | (F.col("rivals") > 0), "conflicting_consensus"), says(F.col("low") > 0, "low_confidence_variant"), says(F.col("odd") > 0, "unexpected_variant"))]
    if expected is not None:
        state_of = expected_status(expected, seen, spans, t).groupBy("construct").agg(F.collect_set(F.when(F.col("status").isin("not_covered", "not_observed"), F.concat(F.lit("expected_variant_"), "status"))).alias("r3"))
        out = out.join(state_of.hint("merge"), "construct", "left")
        why.append(F.coalesce("r3", none))
    if regions is not None:
        r = region_status(spots, regions).groupBy("construct").agg(F.collect_set(F.when(F.col("status") != "covered", F.concat(F.lit("required_region_"), "status"))).alias("r4"))
        out = out.join(r.hint("merge"), "construct", "left")
        why.append(F.coalesce("r4", none))
    # The calls between insertions, each with what is put behind them; deletions leave last. A circle has no place behind its last base.
    calls_ = F.col("calls")
    put = F.filter(F.array_sort(F.col("added")), lambda x: (x["start"] < F.col("n")) | (~F.col("circular") & (x["start"] == F.col("n"))))
    put = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("added"))), F.coalesce(put, F.array().cast("array<struct<start:int,added:string>>")))
    part = lambda x, i: F.concat(x["added"], F.substring(calls_, x["start"] + 1, F.coalesce(F.get("put", i + 1)["start"], F.col("n")) - x["start"]))
    out = out.withColumn("put", put)
    text = F.replace(F.array_join(F.transform("put", part), ""), F.lit("-"), F.lit(""))
    out = out.withColumn("reasons", F.array_sort(F.array_compact(F.concat(*why)))).withColumn("variants", F.coalesce("variants", none)).withColumn("consensus", F.coalesce(text, F.lit("")))
    state = F.when(F.arrays_overlap("reasons", F.array(*map(F.lit, INCONSISTENT))), "inconsistent").when(F.size("reasons") > 0, "needs_review").otherwise("consistent")
    out = out.select("construct", state.alias("state"), "reasons", "reads", "usable", F.round("coverage", 6).alias("coverage"), F.round("mean_depth", 6).alias("mean_depth"), "consensus", "variants")
    return out.withColumn("report", F.to_json(F.struct("construct", "state", "reasons", "reads", "usable", "coverage", "mean_depth", F.sha2("consensus", 256).alias("consensus_sha256"), "variants")))
