"""Records, features, variants, saved results: checks, coordinate maps, references between collections.

Rules about one row are Column expressions; rules between rows are joins and aggregates. A broken row is not dropped: it is
returned with an issue, or as a row of an issue table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators.relations import closure, unpeeled
from strandweave.session import written

# --- fixed values: alphabets of records and of alignments ---
ALPHABETS = {"dna": "ACGTNRYSWKMBDHV", "rna": "ACGUNRYSWKMBDHV", "protein": "ACDEFGHIKLMNPQRSTVWYOUJBXZ*"}
ALIGNED = {"dna": "ACGTRYSWKMBDHVN?", "rna": "ACGURYSWKMBDHVN?", "protein": "ACDEFGHIKLMNPQRSTVWYOUJBXZ*?"}
SEGMENT = "struct<start:int,end:int,strand:int>"


def strict(value: Column, hint: str | None = None) -> Column:
    """Struct of status (ok, invalid_character, empty, invalid_sequence), sequence, offset and character (of the first bad one).

    Only blanks, tabs and line ends are taken out. With a hint every symbol must be of its alphabet; without one a `*` asks for a protein, DNA
    symbols for DNA, and other text is a protein only if it is in capitals without gaps between words.
    """
    bare = F.upper(F.regexp_replace(value, "[ \t\r\n]", ""))
    letters = lambda m: re.escape(ALPHABETS[m])
    fits = lambda m: bare.rlike(f"^[{letters(m)}]+$")
    if hint in ALPHABETS:
        bad = F.regexp_instr(value, F.lit(f"[^{letters(hint)}{letters(hint).lower()} \t\r\n]")) - 1
        status = F.when(bad >= 0, "invalid_character").when(bare == "", "empty").otherwise("ok")
    else:
        bad = F.when(F.length(F.upper(value)) != F.length(value), F.regexp_instr(value, F.lit("[ßŉǰΐΰ\u0587\u1e96-\u1e9a\ufb00-\ufb17]")) - 1).otherwise(-1)  # symbols that are two in capitals
        implicit = ~F.trim(value).rlike("[a-z]") & ~F.trim(value).rlike("[A-Z*][\t ]+[A-Z*]")
        good = F.when(bare.contains("*"), fits("protein")).otherwise(fits("dna") | (fits("protein") & implicit))
        status = F.when(bad >= 0, "invalid_character").when(bare == "", "empty").when(good, "ok").otherwise("invalid_sequence")
    return F.struct(status.alias("status"), F.when(status == "ok", bare).alias("sequence"), F.when(bad >= 0, bad).alias("offset"), F.when(bad >= 0, F.substring(value, (bad + 1).cast("int"), F.lit(1))).alias("character"))


def primer_tm(primer: Column, template: Column) -> tuple[Column, Column, Column]:
    """Temperature less three degrees a mismatch (place by place; a difference in length counts too), mismatches, status (exact, ambiguous, invalid)."""
    p, t = S.normalised(primer), S.normalised(template)
    n = F.least(F.length(p), F.length(t))
    wrong = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(p, i, F.lit(1)) != F.substring(t, i, F.lit(1))))).otherwise(0) + F.abs(F.length(p) - F.length(t))
    both = F.concat(p, t)
    status = F.when(both.rlike("[^ACGTRYSWKMBDHVN]"), "invalid").when(both.rlike("[^ACGT]"), "ambiguous").otherwise("exact")
    tm = F.when(status == "exact", S.round_half_up(S.melting_temperature(p) - 3 * wrong, 1))
    return tm, F.when(status == "exact", wrong), status


def translation_code(record: Column, metadata: Column, supported: list[int] | None = None) -> Column:
    """Struct of id, source (feature, record, default), requested and supported: a feature's qualifier comes before the record's code, an unknown one blocks."""
    known = F.array(*map(F.lit, supported or list(facts.CODES)))
    keys = [k for k in ("transl_table", "translTable", "translationTableId")]
    raw = reduce(lambda a, k: F.when(F.array_contains(F.map_keys(metadata), k), F.struct(F.lit(True).alias("there"), F.try_element_at(metadata, F.lit(k)).alias("v"))).otherwise(a), reversed(keys), F.struct(F.lit(False).alias("there"), F.lit(None).cast("string").alias("v")))
    number = lambda v: F.when(F.trim(v).rlike("^[0-9]{1,9}$"), F.trim(v).cast("int"))
    from_feature, from_record = raw["there"], record.isNotNull()
    asked = F.when(from_feature, number(raw["v"])).when(from_record, number(record.cast("string"))).otherwise(1)
    ok = F.coalesce(F.array_contains(known, asked), F.lit(False))
    return F.struct(F.when(ok, asked).alias("id"), F.when(from_feature, "feature").when(from_record, "record").otherwise("default").alias("source"), asked.alias("requested"), ok.alias("supported"))


def usage_lookup(asked: DataFrame, usage: DataFrame, fallback: str) -> DataFrame:
    """Rows of `asked` (organism, codon, ...) with frequency and used: the organism's table, or the fallback's for an unknown organism. usage: organism, codon, frequency."""
    known = usage.select("organism").distinct().withColumn("known", F.lit(True))
    a = asked.join(known, "organism", "left").withColumn("used", F.when(F.col("known"), F.col("organism")).otherwise(fallback)).drop("known")
    return a.join(usage.select(F.col("organism").alias("used"), "codon", "frequency"), ["used", "codon"], "left")


RESIDUES = {"Sec": "U", "Pyl": "O", "TERM": "*"}


def translation_exceptions(cds: DataFrame) -> DataFrame:
    """cds (id, seq, strand, qualifier) with protein, status: the whole sequence is one CDS on its strand; entries `(pos:a..b,aa:X)` or `(pos:complement(a..b),aa:X)` put U, O or `*` in a codon's place.

    Nothing is changed if any entry is malformed, turned the wrong way, off the codons, out of bounds or at odds with another.
    """
    item = r"\(pos:(complement\()?([0-9]+)(?:\.\.([0-9]+))?\)?,aa:([A-Za-z]+)\)"
    q = F.regexp_replace("qualifier", r"\s", "")
    ds = cds.withColumn("_q", q).withColumn("_i", F.regexp_extract_all("_q", F.lit(item), F.lit(0)))
    part = lambda x, k: F.regexp_extract(x, item, k)
    back = F.col("strand") == -1
    n = F.length("seq")
    entry = F.transform("_i", lambda x: F.struct(
        part(x, 2).cast("int").alias("a"), F.when(part(x, 3) == "", part(x, 2)).otherwise(part(x, 3)).cast("int").alias("b"), (part(x, 1) != "").alias("turned"),
        reduce(lambda o, kv: F.when(part(x, 4) == kv[0], kv[1]).otherwise(o), RESIDUES.items(), F.lit(None).cast("string")).alias("residue"), (part(x, 1) != "").cast("int").alias("_p")))
    coding = F.when(back, S.reverse_complement(F.upper("seq"))).otherwise(F.upper("seq"))
    ds = ds.withColumn("_e", entry).withColumn("_c", coding)
    place = lambda e: F.when(back, n - e["b"]).otherwise(e["a"] - 1)
    every = lambda f: F.forall("_e", f)
    protein = S.translate(F.col("_c"))
    spots = F.transform("_e", lambda e: F.struct((place(e) / 3).cast("int").alias("i"), e["residue"].alias("r")))
    status = (
        F.when(F.coalesce(F.col("_q"), F.lit("")) == "", "missing_qualifier").when((F.size("_i") == 0) | (F.array_join("_i", "") != F.regexp_replace("_q", r"\)[;,]\(", ")(")) | ~every(lambda e: e["residue"].isNotNull() & (e["b"] == e["a"] + 2)), "malformed")
        .when(~every(lambda e: e["turned"] == back), "orientation_mismatch").when((n % 3 != 0) | (n == 0) | ~F.col("_c").rlike("^[ACGTU]+$"), "invalid_cds_frame")
        .when(~every(lambda e: (e["a"] >= 1) & (e["b"] <= n)), "not_codon").when(~every(lambda e: place(e) % 3 == 0), "not_codon")
        .when(F.size(F.array_distinct(spots)) != F.size(F.array_distinct(spots["i"])), "duplicate_exception").otherwise("ok")
    )
    started = F.when(F.left("_c", F.lit(3)).isin(facts.CODES[1][1].split()), F.concat(F.lit("M"), F.substring(protein, 2, 2**31 - 1))).otherwise(protein)
    changed = F.aggregate(spots, started, lambda p, e: F.overlay(p, e["r"], (e["i"] + 1).cast("int"), F.lit(1)))
    return ds.withColumn("status", status).withColumn("protein", F.when(F.col("status") == "ok", changed)).drop("_q", "_i", "_e", "_c")


def location_facts(segments: Column, metadata: Column) -> dict[str, Column]:
    """What a feature's segments and metadata say: multipart, ordered, ambiguous, quarantined, materialisable, length, signature."""
    said = lambda k, v: F.coalesce(F.try_element_at(metadata, F.lit(k)) == v, F.lit(False))
    own = F.filter(segments, lambda s: s["end"] > s["start"])
    many = F.size(own) > 1
    ordered, ambiguous = many & said("locationOperator", "order"), many & said("subRangeOrderAmbiguous", "true")
    quarantined = said("locationQuarantined", "true") & F.array_contains(F.map_keys(metadata), "originalLocation")
    signature = F.concat(F.lit("["), F.array_join(F.transform(own, lambda s: F.concat(F.lit("["), s["start"], F.lit(","), s["end"], F.lit(","), s["strand"], F.lit("]"))), ","), F.lit("]"))
    return {"multipart": many, "ordered": ordered, "ambiguous": ambiguous, "quarantined": quarantined, "materialisable": ~(ordered | ambiguous | quarantined), "length": F.aggregate(own, F.lit(0), lambda a, s: a + s["end"] - s["start"]), "signature": signature}


def feature_issues(features: DataFrame, most_segments: int = 10_000, longest_text: int = 4096, circular: bool = False) -> DataFrame:
    """id, code, path: what is wrong with each feature (id, name, type, start, end, strand, segments, metadata, n: the sequence's length), a row an issue."""
    text = lambda c: F.col(c).isNull() | (F.length(F.trim(c)) == 0) | (F.length(c) > longest_text) | F.col(c).rlike("[\\x00-\\x1f\\x7f]")
    when = lambda bad, code, path: F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), path.alias("path") if isinstance(path, Column) else F.lit(path).alias("path")))
    inside = (F.col("start") >= 0) & (F.col("end") >= 0) & (F.col("start") <= F.col("n")) & (F.col("end") <= F.col("n"))
    inside = inside if circular else inside & (F.col("end") >= F.col("start"))
    whole = [when(text("name"), "invalid_feature", "name"), when(text("type"), "invalid_feature", "type"), when(~F.col("strand").isin(-1, 0, 1), "invalid_feature", "strand"), when(~inside, "invalid_feature", "coordinates")]
    whole += [F.when(F.col("segments").isNotNull() & (F.size("segments") == 0), F.struct(F.lit("invalid_subrange").alias("code"), F.lit("segments").alias("path"))), F.when(F.size("segments") > most_segments, F.struct(F.lit("subrange_limit").alias("code"), F.lit("segments").alias("path")))]
    good = lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.col("n")) & F.coalesce(s["strand"].isin(-1, 0, 1), F.lit(True))
    parts = F.array_compact(F.transform(F.coalesce("segments", F.array().cast(f"array<{SEGMENT}>")), lambda s, i: F.when(~F.coalesce(good(s), F.lit(False)), F.struct(F.lit("invalid_subrange").alias("code"), F.concat(F.lit("segments["), i, F.lit("]")).alias("path")))))
    meta = F.transform(F.filter(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: (F.length(e["value"]) > longest_text) | e["value"].rlike("[\\x00-\\x1f\\x7f]")), lambda e: F.struct(F.lit("metadata_limit").alias("code"), e["key"].alias("path")))
    return features.select("id", F.explode(F.concat(F.array_compact(F.array(*whole)), parts, meta)).alias("x")).select("id", "x.code", "x.path")


def remapped(features: DataFrame, spans: DataFrame, key: str, bin_size: int = 1024) -> DataFrame:
    """key, id, start, end, segments of features (key, id, segments) whose every segment lies in one source span (key, ord, start, end, target), moved there; others are left out.

    Spans are filed under the bins that they touch and met in a segment's first bin; of several the first by ord counts.
    """
    seg = features.select(key, "id", F.size("segments").alias("_k"), F.posexplode("segments").alias("i", "s")).withColumn("bin", F.floor(F.col("s.start") / bin_size))
    filed = spans.where("end > start").select(key, "ord", F.col("start").alias("a"), F.col("end").alias("b"), "target").withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / bin_size), F.floor((F.col("b") - 1) / bin_size))))
    hit = seg.join(filed, [key, "bin"]).where("s.start >= a AND s.end <= b").groupBy(key, "id", "_k", "i").agg(F.min(F.struct("ord", (F.col("target") + F.col("s.start") - F.col("a")).alias("start"), (F.col("target") + F.col("s.end") - F.col("a")).alias("end"), F.col("s.strand").alias("strand"))).alias("m"))
    g = hit.groupBy(key, "id", "_k").agg(F.count("*").alias("found"), F.min("m.start").alias("start"), F.max("m.end").alias("end"), F.array_sort(F.collect_list(F.struct("i", "m.start", "m.end", "m.strand"))).alias("x")).where("found = _k")
    return g.select(key, "id", "start", "end", F.transform("x", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["strand"].alias("strand"))).alias("segments"))


def mapped_through(features: DataFrame, runs: DataFrame, key: str, bin_size: int = 1024) -> DataFrame:
    """key, id, start, end, pieces, partial of features (key, id, strand, segments, n) through an assembly's affine runs (key, start, end, product: null where omitted).

    What lies in an omitted run or outside the source is gone and makes the feature partial; without a piece it is left out. A reverse
    segment's pieces come in reverse order, so that the stored order stays that of reading.
    """
    seg = features.select(key, "id", "n", F.posexplode("segments").alias("i", "s")).select(key, "id", "i", F.col("s.strand").alias("strand"), "s.start", "s.end", F.greatest(F.lit(0), F.least("n", "s.start")).alias("lo"), F.greatest(F.lit(0), F.least("n", "s.end")).alias("hi"))
    out = seg.withColumn("clipped", (F.col("lo") != F.col("start")) | (F.col("hi") != F.col("end")))
    filed = runs.select(key, F.col("start").alias("a"), F.col("end").alias("b"), "product").withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / bin_size), F.floor((F.col("b") - 1) / bin_size))))
    binned = out.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor((F.col("hi") - 1) / bin_size))))
    first = F.greatest(F.floor(F.col("a") / bin_size), F.floor(F.col("lo") / bin_size)) == F.col("bin")  # a pair meets once
    met = binned.join(filed, [key, "bin"]).where(first & (F.col("a") < F.col("hi")) & (F.col("b") > F.col("lo")))
    lo, hi = F.greatest("a", "lo"), F.least("b", "hi")
    met = met.select(key, "id", "i", F.when(F.col("strand") == -1, -lo).otherwise(lo).alias("place"), (F.col("product") + lo - F.col("a")).alias("start"), (F.col("product") + hi - F.col("a")).alias("end"))
    g = met.groupBy(key, "id").agg(F.bool_or(F.col("start").isNull()).alias("gap"), F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("i", "place", "start", "end")))).alias("x"))
    c = out.groupBy(key, "id").agg(F.bool_or("clipped").alias("clipped"))
    g = g.join(c, [key, "id"]).where(F.size("x") > 0)
    return g.select(key, "id", F.array_min("x.start").alias("start"), F.array_max("x.end").alias("end"), F.transform("x", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("pieces"), (F.col("gap") | F.col("clipped")).alias("partial"))


def normalised_variant(v: dict[str, Column]) -> dict[str, Column]:
    """A variant's fields from old and new names: start or position, kind or type, reference or ref, alternate or alt; valid only with an id, a start and an end not before it."""
    text = lambda *names: F.coalesce(*[F.when(F.length(F.trim(v[n])) > 0, F.trim(v[n])) for n in names if n in v])
    start = F.coalesce(v["start"], v["position"])
    kind = F.coalesce(v["kind"], v["type"])
    kinds = ["substitution", "insertion", "deletion"]
    valid = (F.coalesce(F.length(F.trim(v["id"])), F.lit(0)) > 0) & F.coalesce(start >= 0, F.lit(False)) & F.coalesce(v["end"] >= start, F.lit(True))
    return {"start": start, "end": v["end"], "kind": F.when(kind.isin(kinds), kind).otherwise("other"), "reference": text("reference", "ref"), "alternate": text("alternate", "alt"), "valid": valid}


def variant_label(label: Column, kind: Column, reference: Column, alternate: Column, start: Column) -> Column:
    """A variant's own label, or what it does at its 1-based place."""
    at = (F.greatest(F.lit(0), F.floor(start)) + 1).cast("string")
    shown = lambda c, e: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(e))
    known = (shown(reference, "") != "") | (shown(alternate, "") != "")
    made = F.when(kind == "insertion", F.trim(F.concat(F.lit("Insertion "), shown(alternate, ""), F.lit(" at "), at))).when(kind == "deletion", F.trim(F.concat(F.lit("Deletion "), shown(reference, ""), F.lit(" at "), at))).otherwise(F.concat(shown(reference, "?"), F.lit(">"), shown(alternate, "?"), F.lit(" at "), at))
    return F.when(F.trim(F.coalesce(label, F.lit(""))) != "", F.trim(label)).when(known, made).otherwise(F.concat(F.lit("Variant at "), at))


def shifted(start: Column, end: Column, pos: Column, delta: Column) -> tuple[Column, Column]:
    """Start and end after `delta` bases were put in behind pos (or, if negative, taken out from pos on)."""
    cut = pos - delta
    down = lambda x: F.when(x >= cut, x + delta).when(x > pos, pos).otherwise(x)
    move = lambda x: F.when(delta >= 0, F.when(x > pos, x + delta).otherwise(x)).otherwise(down(x))
    a = move(start)
    return a, F.when(delta >= 0, move(end)).otherwise(F.when(end.isNotNull(), F.greatest(a, down(end))))


SCAR = "array<struct<position:int,type:string,text:string>>"


def _scar(position: Column, kind: str, text: Column) -> Column:
    return F.struct(position.cast("int").alias("position"), F.lit(kind).alias("type"), text.alias("text"))


def scars_after(seq: Column, scars: Column, edit: str, pos: Column, text: Column | None = None, count: Column | None = None) -> Column:
    """Scars (position, type, text) of a sequence after a substitution (text: the new base), an insertion behind pos (-1: the front) or a deletion of `count` bases; a place outside changes nothing.

    A substitution takes the place of a scar there and remembers the old base; an insertion moves later scars and leaves one for each base; a deletion takes the scars inside it and leaves one.
    """
    n = F.length(seq)
    moved = lambda x, by: F.struct((x["position"] + by).cast("int").alias("position"), x["type"].alias("type"), x["text"].alias("text"))
    if edit == "substitution":
        kept = F.filter(scars, lambda x: x["position"] != pos)
        return F.when((pos >= 0) & (pos < n), F.concat(kept, F.array(_scar(pos, edit, F.concat(F.substring(seq, (pos + 1).cast("int"), F.lit(1)), F.lit(">"), text))))).otherwise(scars)
    if edit == "insertion":
        k = F.length(text)
        later = F.transform(scars, lambda x: F.when(x["position"] > pos, moved(x, k)).otherwise(moved(x, F.lit(0))))
        new = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: _scar(pos + i, edit, F.substring(text, i, F.lit(1))))
        return F.when((pos >= -1) & (pos < n) & (k > 0), F.concat(later, new)).otherwise(scars)
    size = F.least(count, n - pos)
    rest = F.transform(F.filter(scars, lambda x: (x["position"] < pos) | (x["position"] >= pos + size)), lambda x: F.when(x["position"] >= pos, moved(x, -size)).otherwise(moved(x, F.lit(0))))
    gone = _scar(pos, edit, F.substring(seq, (pos + 1).cast("int"), size.cast("int")))
    return F.when((pos >= 0) & (pos < n) & (count > 0), F.concat(rest, F.array(gone))).otherwise(scars)


def freshness(inputs: DataFrame, records: DataFrame) -> DataFrame:
    """result, state, reasons of saved results from their inputs (result, ord, record, sha256) and the records as they are (record, sha256).

    A missing record or another hash is stale, a missing or malformed attestation unverified; stale outweighs unverified, that outweighs fresh.
    """
    now = records.select("record", F.col("sha256").alias("now"), F.lit(True).alias("there"))
    j = inputs.join(now, "record", "left")
    gone = F.when(F.col("there").isNull(), "record_missing")
    attested = F.when(F.col("sha256").isNull(), "sequence_attestation_missing").when(~F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), "sequence_attestation_invalid").when(F.col("there") & (F.lower("sha256") != F.col("now")), "sequence_hash_mismatch")
    r = j.withColumn("reason", F.array_compact(F.array(gone, attested)))
    stale = F.exists("reason", lambda x: x.isin("record_missing", "sequence_hash_mismatch"))
    g = r.groupBy("result").agg(F.max(F.when(stale, 2).when(F.size("reason") > 0, 1).otherwise(0)).alias("s"), F.array_sort(F.collect_list(F.when(F.size("reason") > 0, F.struct("ord", "record", "reason")))).alias("x"))
    said = F.flatten(F.transform("x", lambda i: F.transform(i["reason"], lambda y: F.concat(y, F.lit(":"), i["record"]))))
    return g.select("result", F.when(F.col("s") == 2, "stale").when(F.col("s") == 1, "unverified").otherwise("fresh").alias("state"), F.array_join(said, ",").alias("reasons"))


def appended(collection: DataFrame, new: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The collection with the rows of `new` (same columns, id) that may be added, and (id, issue) of the others.

    Issues: `duplicate_id` (there already, or twice in `new`), `missing_dependency` (nowhere), `cyclic` (on a circle of any length, or on a way between two) and `refused_dependency`
    (needs, over any number of steps, a row that is not added). edges: id, needs; a dependency may be another new row. Rows without open needs leave a distributed graph round by
    round; what cannot leave is refused.
    """
    twice = new.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    there = new.select("id").join(collection.select("id").hint("merge"), "id", "left_semi").distinct()
    issues = twice.unionByName(there).distinct().withColumn("issue", F.lit("duplicate_id"))
    if edges is not None:
        ids = new.select("id").distinct().join(there.hint("merge"), "id", "left_anti")
        own = edges.select("id", "needs").distinct().join(ids.hint("merge"), "id", "left_semi").join(collection.select(F.col("id").alias("needs")).hint("merge"), "needs", "left_anti")
        dangling = own.join(ids.select(F.col("id").alias("needs")).hint("merge"), "needs", "left_anti").select("id").distinct()
        inner = written(own.join(ids.select(F.col("id").alias("needs")).hint("merge"), "needs", "left_semi").select(F.col("id").alias("node"), F.col("needs").alias("next")), "appended-edges")
        stuck = written(dangling.unionByName(twice.join(ids.hint("merge"), "id", "left_semi")).distinct(), "appended-stuck")
        refused = unpeeled(inner.unionByName(stuck.select(F.col("id").alias("node"), F.col("id").alias("next")))).select(F.col("node").alias("id")).distinct()
        circles = unpeeled(unpeeled(inner).select(F.col("next").alias("node"), F.col("node").alias("next"))).select(F.col("node").alias("id")).distinct()
        named = issues.unionByName(dangling.withColumn("issue", F.lit("missing_dependency"))).unionByName(circles.withColumn("issue", F.lit("cyclic")))
        issues = written(named, "appended-issues")
        issues = issues.unionByName(refused.join(issues.hint("merge"), "id", "left_anti").withColumn("issue", F.lit("refused_dependency")))
    return collection.unionByName(new.join(issues.hint("merge"), "id", "left_anti")), issues


def removed(collection: DataFrame, edges: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The collection without the rows asked for (id), and (id, issue) of those that stay or are not there.

    A plain removal refuses what others need: `required` if a row that stays needs it, over any number of steps, or if it is on a circle with others asked for; `unknown_id` if it is not there. edges: id, needs.
    """
    asked = asked.select("id").distinct()
    unknown = asked.join(collection.select("id").hint("merge"), "id", "left_anti").withColumn("issue", F.lit("unknown_id"))
    own = written(edges.select(F.col("needs").alias("node"), F.col("id").alias("next")).distinct().join(asked.select(F.col("id").alias("node")).hint("merge"), "node", "left_semi"), "removed-edges")
    held = own.join(asked.select(F.col("id").alias("next")).hint("merge"), "next", "left_anti").select("node").distinct()
    inner = own.join(asked.select(F.col("id").alias("next")).hint("merge"), "next", "left_semi").select("node", "next")
    required = unpeeled(inner.unionByName(held.select("node", F.col("node").alias("next")))).select(F.col("node").alias("id")).distinct().withColumn("issue", F.lit("required"))
    return collection.join(asked.join(required, "id", "left_anti").hint("merge"), "id", "left_anti"), unknown.unionByName(required)


def cascaded(collection: DataFrame, edges: DataFrame, asked: DataFrame, uses: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The collection without the rows asked for (id) and all that need them, and the assets (asset) that only removed rows used. edges: id, needs; uses: id, asset."""
    gone = closure(edges.select(F.col("needs").alias("node"), F.col("id").alias("next")), asked.select(F.col("id").alias("node"))).withColumnRenamed("node", "id")
    kept = collection.join(gone, "id", "left_anti")
    if uses is None:
        return kept, None
    orphans = uses.join(gone, "id", "left_semi").select("asset").distinct().join(uses.join(kept.select("id"), "id", "left_semi").select("asset"), "asset", "left_anti")
    return kept, orphans


def upserted(collection: DataFrame, changes: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The collection with rows of `changes` in place of those with their id, or added, and without `removed` (id)."""
    out = collection.join(changes.select("id"), "id", "left_anti").unionByName(changes)
    return out if removed is None else out.join(removed.select("id"), "id", "left_anti")


def dependants(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """needs, id: the rows that refer to each id asked for (needs). edges: id, needs."""
    return edges.join(asked.select("needs").distinct(), "needs", "left_semi").select("needs", "id").distinct()


def references(results: DataFrame, fields: list[str]) -> DataFrame:
    """id, field, ref: every id that a result's fields (strings or arrays of strings) refer to, once a field."""
    parts = [results.select("id", F.lit(f).alias("field"), (F.explode(F.col(f)) if "array" in results.schema[f].dataType.simpleString() else F.col(f)).alias("ref")) for f in fields]
    return reduce(DataFrame.unionByName, parts).where("ref IS NOT NULL").distinct()


def integrity(collections: dict[str, DataFrame], links: dict[str, DataFrame], target: DataFrame) -> DataFrame:
    """collection, id, issue: ids that come twice in a collection, and links (id, ref) whose ref is no row of `target` (ref)."""
    twice = [c.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select(F.lit(n).alias("collection"), "id", F.lit("duplicate_id").alias("issue")) for n, c in collections.items()]
    lost = [x.join(target, "ref", "left_anti").select(F.lit(n).alias("collection"), "id", F.lit("dangling_reference").alias("issue")).distinct() for n, x in links.items()]
    return reduce(DataFrame.unionByName, twice + lost)


def slugs(named: DataFrame, group: str, order: str) -> DataFrame:
    """named (group, order, name) with slug: lower case letters and digits with hyphens, at most 72; the second of a kind gets -2, and so on, past names that are taken as they are."""
    root = F.substring(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 72)
    n = named.withColumn("_root", F.when(root == "", "record").otherwise(root))
    k = F.row_number().over(Window.partitionBy(group, "_root").orderBy(order))
    first = n.withColumn("_k", k)
    taken = first.where("_k = 1").select(group, F.col("_root").alias("_try"), F.col(order).alias("_o"))
    made = first.withColumn("_try", F.when(F.col("_k") == 1, F.col("_root")).otherwise(F.concat("_root", F.lit("-"), F.col("_k"))))
    clash = made.where("_k > 1").join(taken, [group, "_try"]).where(F.col("_o") <= F.col(order)).select(group, order).distinct().withColumn("_clash", F.lit(1))
    bump = F.sum(F.coalesce("_clash", F.lit(0))).over(Window.partitionBy(group, "_root").orderBy(order))
    out = made.join(clash, [group, order], "left").withColumn("_bump", bump)
    return out.withColumn("slug", F.when(F.col("_k") == 1, F.col("_root")).otherwise(F.concat("_root", F.lit("-"), (F.col("_k") + F.col("_bump")).cast("string")))).drop("_root", "_k", "_try", "_clash", "_bump")


def molecule(seq: Column, hint: Column | None = None) -> Column:
    """dna, rna or protein: the hint, else U without T is RNA, base symbols are DNA, all else protein."""
    s = F.upper(seq)
    own = F.when(s.contains("U") & ~s.contains("T") & s.rlike("^[ACGUNRYSWKMBDHV]+$"), "rna").when(s.rlike("^[ACGTNRYSWKMBDHV]+$"), "dna").otherwise("protein")
    return own if hint is None else F.coalesce(hint, own)


def file_hint(filename: Column) -> Column:
    return F.when(F.lower(filename).rlike(r"\.(faa|pep|protein)$"), "protein").when(F.lower(filename).rlike(r"\.(fna|ffn)$"), "dna")


def sniffed(content: Column) -> Column:
    """json, genbank, fasta, raw or empty, by how a text begins and what it holds."""
    t = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t.rlike(r"^[{\[]"), "json").when(t.rlike(r"(?m)^\s*LOCUS\s"), "genbank").when(t.contains(">"), "fasta").otherwise("raw")


def payload_issues(records: DataFrame, most_records: int = 100, longest: int = 250_000, most_residues: int = 25_000_000) -> DataFrame:
    """payload, issue of payloads of records (payload, id, seq, active): limits, ids that come twice, empty or odd sequences, none active."""
    g = records.groupBy("payload").agg(
        F.count("*").alias("n"), F.max(F.length("seq")).alias("long"), F.sum(F.length("seq")).alias("total"), F.count_if(F.coalesce("active", F.lit(True))).alias("on"),
        F.count_if(F.coalesce(F.length("seq"), F.lit(0)) == 0).alias("empty"), F.count_if(F.col("seq").rlike(r"[^A-Za-z*\s-]")).alias("odd"), F.count(F.col("id")).alias("ids"), F.count_distinct("id").alias("different"))
    said = F.array_compact(F.array(
        F.when(F.col("n") > most_records, "too_many_records"), F.when(F.col("long") > longest, "record_too_long"), F.when(F.col("total") > most_residues, "too_many_residues"), F.when(F.col("ids") > F.col("different"), "duplicate_id"),
        F.when(F.col("on") == 0, "no_active_record"), F.when(F.col("empty") > 0, "empty_sequence"), F.when(F.col("odd") > 0, "invalid_characters")))
    return g.select("payload", F.explode(said).alias("issue"))


def alignment_issues(rows: DataFrame, kind: str, most_rows: int = 100, most_columns: int = 50_000, most_cells: int = 2_000_000) -> DataFrame:
    """alignment, issue of imported rows (alignment, id, name, aligned): fewer than two rows, unlike lengths, ids or names (case aside) that come twice, rows of gaps only, odd symbols, limits."""
    a = F.upper(F.regexp_replace(F.regexp_replace("aligned", "[ \t\r\n]", ""), r"\.", "-"))
    r = rows.withColumn("a", a)
    g = r.groupBy("alignment").agg(
        F.count("*").alias("n"), F.min(F.length("a")).alias("lo"), F.max(F.length("a")).alias("hi"), F.count_distinct("id").alias("ids"), F.count("id").alias("named"), F.count_distinct(F.lower("name")).alias("names"), F.count("name").alias("called"),
        F.count_if(F.length(F.regexp_replace("a", "-", "")) == 0).alias("bare"), F.count_if(F.col("a").rlike(f"[^{re.escape(ALIGNED[kind])}-]")).alias("odd"))
    said = F.array_compact(F.array(
        F.when(F.col("n") < 2, "too_few_rows"), F.when(F.col("lo") != F.col("hi"), "unequal_lengths"), F.when(F.col("ids") < F.col("named"), "duplicate_id"), F.when(F.col("names") < F.col("called"), "duplicate_name"), F.when(F.col("bare") > 0, "gaps_only"),
        F.when(F.col("odd") > 0, "invalid_symbols"), F.when((F.col("n") > most_rows) | (F.col("hi") > most_columns) | (F.col("n") * F.col("hi") > most_cells), "too_large")))
    return g.select("alignment", F.explode(said).alias("issue"))


def alphabet_anomalies(rows: DataFrame, least: int = 10) -> DataFrame:
    """Rows (row, molecule, aligned) said to be protein whose ten residues or more are all nucleotide letters."""
    bare = F.regexp_replace(F.upper("aligned"), "[-.?]", "")
    return rows.where((F.col("molecule") == "protein") & (F.length(bare) >= least) & bare.rlike("^[ACGTUN]+$"))


def selected(rows: DataFrame, wanted: DataFrame, start: int, end: int) -> DataFrame:
    """alignment, ord, row, aligned: the rows asked for (alignment, row, ord), in that order, cut to the inclusive columns; swapped or outer ends are set right."""
    lo, hi = min(start, end), max(start, end)
    n = F.length("aligned")
    a, b = F.greatest(F.lit(0), F.least(n - 1, F.lit(lo))), F.greatest(F.lit(0), F.least(n - 1, F.lit(hi)))
    return rows.join(wanted, ["alignment", "row"]).select("alignment", "ord", "row", F.substring("aligned", (a + 1).cast("int"), (b - a + 1).cast("int")).alias("aligned"))


def anchor_reviews(notes: DataFrame) -> DataFrame:
    """Notes (id, start, end, at, removed, inserted) with their new range and whether it is to be reviewed: kept and shifted ranges are not, cut ones are, detached ones are gone."""
    from strandweave.operators.intervals import edited

    a, b, status = edited(F.col("start"), F.col("end"), F.col("at"), F.col("removed"), F.col("inserted"))
    d = notes.withColumn("_a", a).withColumn("_b", b).withColumn("anchor", status)
    gone = F.col("anchor") == "detached"
    return d.withColumns({"new_start": F.when(~gone, F.col("_a")), "new_end": F.when(~gone, F.col("_b")), "review": F.col("anchor").isin("review", "detached")}).drop("_a", "_b")


def canonical_json(value: Column) -> Column:
    """A JSON text as one with sorted keys and no white space; null if it is no JSON, or holds NaN or infinities. Numbers and nested values keep their order in arrays."""
    ok = F.try_parse_json(value)
    return F.when(ok.isNotNull() & ~F.coalesce(F.lower(value), F.lit("")).rlike(r'(?<!")\b(nan|infinity)\b(?!")'), F.to_json(ok))
