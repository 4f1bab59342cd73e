"""Golden Gate and Gibson assembly: flanked parts, chains, products, fidelity of junctions, kits, synthetic vectors.

Parts and fragments are rows (design, ord, name, seq). What concerns one part or one pair of neighbours is Column
expressions and windows by design; only the search for chains is a small helper, on the parts of one design (a
bounded group, whose work has a budget). Fidelity is a join with a sparse table of ligation counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import facts
from strandweave.functions import sequence as S
from strandweave.operators.batches import emit, flat
from strandweave.operators.restriction import Finder, catalogue

# --- fixed values: fusion sites of the published kits; boundaries of a transcription unit; filler of a synthetic vector ---
KITS = {
    "moclo-plant": ["GGAG", "TACT", "CCAT", "AATG", "AGGT", "GCTT", "CGCT", "TGCC"],
    "moclo-ytk": ["CCCT", "AACG", "TATG", "ATCC", "TGGC", "GCTG", "TACA", "GCTT", "CCGA", "CAAT"],
    "moclo-mammalian": ["GGAG", "TACT", "CCAT", "AATG", "GCAG", "TTCG", "GCTT", "CGCT"],
    "emma": ["GGAG", "TACT", "CCAT", "AATG", "AGGT", "GCAG", "TTCG", "GCTT", "CGCT", "GGTA", "ACTA"],
    "loop": ["GGAG", "AATG", "AGGT", "GCTT", "CGCT", "TCAG", "TTAC"],
    "goldenbraid-3": ["GGAG", "TACT", "CCAT", "AATG", "AGGT", "TGAG", "GCTT", "CGCT", "GATG"],
    "greengate": ["ACCT", "AACA", "AGGT", "CTGA", "GCAG", "GCTT", "GTGG"],
    "moclo-cidar": ["GGAG", "TACT", "AATG", "AGGT", "GCTT", "CGCT"],
}
ROLES = {"promoter": 10, "coding_sequence": 20, "terminator": 30, "unknown": 1000}
FILLER = "ACTG"
IDEAL_OVERLAP_TM = 50.0
MOST_CHAINS, MOST_STEPS = 64, 100_000


def type_iis(enzyme: str = "BsaI"):
    """Facts of a Type IIS enzyme of the assembly list; KeyError for another."""
    name = {n.lower(): n for n in facts.PRESETS["golden-gate-type-iis"]}[enzyme.lower()]
    return catalogue([name])[0]


def sites(seqs: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """doc_id, position, strand, cut, overhang (null where its window leaves the sequence), internal: all sites but the outer flank pair are internal."""
    e = type_iis(enzyme)
    finder, wide = Finder([e]), e.bottom - e.top

    def work(data, off):
        import numpy as np

        s = finder.find(data, off, False)
        text, p, strand = s["text"], s["position"], s["strand"]
        cut = np.minimum(s["top"], s["bottom"])
        n = np.diff(off)
        fits = (cut >= 0) & (cut + wide <= n[text])
        raw = data.tobytes().decode("latin-1").upper().replace("U", "T")
        sense = [raw[o + c : o + c + wide] if ok else None for o, c, ok in zip(off[:-1][text].tolist(), cut.tolist(), fits.tolist(), strict=True)]
        over = [None if x is None else x if d == 1 else facts.reverse_complement(x) for x, d in zip(sense, strand.tolist(), strict=True)]
        first, last = np.full(len(n), 1 << 40), np.full(len(n), -1)
        np.minimum.at(first, text[strand == 1], p[strand == 1])
        np.maximum.at(last, text[strand == -1], p[strand == -1])
        flank = (first < last)[text] & np.where(strand == 1, p == first[text], p == last[text])
        return text, p, strand, cut, pa.array(over, pa.string()), ~flank

    return emit(seqs, "doc_id", "seq", work, "position int, strand int, cut int, overhang string, internal boolean")


def digested_parts(parts: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """The parts with left, right (overhangs on the top strand), insert (both included), released (where it begins in the part without white space) and issue (null: usable)."""
    e = type_iis(enzyme)
    rec, back, wide = e.recognition, facts.reverse_complement(e.recognition), e.bottom - e.top
    seq = F.upper(F.regexp_replace("seq", r"\s", ""))
    sense = F.instr(F.col("_s"), F.lit(rec)) - 1
    d = parts.withColumn("_s", seq).withColumn("_a", sense).withColumn("_b", F.when(F.col("_a") >= 0, F.expr(f"locate('{back}', _s, cast(_a + {len(rec)} + 1 as int))") - 1).otherwise(-1))
    total = F.regexp_count("_s", F.lit(f"(?={rec})")) + F.regexp_count("_s", F.lit(f"(?={back})"))
    left, right = F.col("_a") + e.top, F.col("_b") + len(rec) - e.bottom
    issue = (
        F.when(~F.col("_s").rlike("^[ACGT]+$"), "not_canonical").when((F.col("_a") < 0) | (F.col("_b") < 0), "missing_flanks").when(total > 2, "internal_sites")
        .when((left + wide > F.length("_s")) | (right < 0), "out_of_bounds").when(right < left + wide, "flanks_overlap")
    )
    piece = lambda a, n: F.substring("_s", (a + 1).cast("int"), n.cast("int") if isinstance(n, Column) else F.lit(n))
    d = d.withColumn("issue", issue)
    ok = F.col("issue").isNull()
    return d.withColumns({"left": F.when(ok, piece(left, wide)), "right": F.when(ok, piece(right, wide)), "insert": F.when(ok, piece(left, right + wide - left)), "released": F.when(ok, left)}).drop("_s", "_a", "_b")


def chains(ends: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """How parts (left, right overhang) follow each other through shared overhangs: reason and the one order, if there is one.

    Orders that are one circle turned are one; a part may follow another only by an equal overhang, each part is used once.
    """
    n = len(ends)
    after: dict[str, list[int]] = {}
    for i, (left, _) in enumerate(ends):
        after.setdefault(left, []).append(i)
    seen: dict[tuple, list[int]] = {}
    steps = found = 0
    stack = [[i] for i in reversed(range(n))]
    while stack:
        path = stack.pop()
        if len(path) == n:
            found += 1
            if found > MOST_CHAINS:
                return "work-limit", []
            at = path.index(min(path)) if ends[path[-1]][1] == ends[path[0]][0] else 0
            seen.setdefault((at > 0 or ends[path[-1]][1] == ends[path[0]][0], *path[at:], *path[:at]), path)
            continue
        for i in reversed(after.get(ends[path[-1]][1], [])):
            steps += 1
            if steps > MOST_STEPS:
                return "work-limit", []
            if i not in path:
                stack.append([*path, i])
    if not seen:
        return "no-chain", []
    if len(seen) > 1:
        return "ambiguous-multiple-chains", []
    order = next(iter(seen.values()))
    if all(x == y == ends[0][0] for x, y in ends):
        return "ambiguous-self-ligation", []
    return "unique", order


ASSEMBLY = "status string, reason string, parts string, ords string, overhangs string, missing_left string, missing_right string, product string, warnings string"


def assembled(parts: list[dict], wide: int) -> tuple:
    """Status, reason, order (names and numbers), overhangs, missing ends, circular product and warnings of one design's digested parts, in their order."""
    bad = [p["issue"] for p in parts if p["issue"]]
    if bad or len(parts) < 2:
        return "invalid_input", ",".join(bad) or "too_few_parts", "", "", "", None, None, "", ""
    ends = list(dict.fromkeys([p["left"] for p in parts] + [p["right"] for p in parts]))
    warn = [f"palindromic {x}" for x in ends if x == facts.reverse_complement(x)]
    warn += [f"near {x}/{y}" for i, x in enumerate(ends) for y in ends[i + 1 :] if sum(a != b for a, b in zip(x, y, strict=True)) == 1]
    reason, order = chains([(p["left"], p["right"]) for p in parts])
    if reason != "unique":
        status = "ambiguous" if reason.startswith("ambiguous") else "work_limit" if reason == "work-limit" else "invalid_input"
        return status, reason, "", "", "", None, None, "", ",".join(warn)
    run = [parts[i] for i in order]
    names, ords, overs = (",".join(str(p[c]) for p in run) for c in ("name", "ord", "left"))
    if run[-1]["right"] != run[0]["left"]:
        return "invalid_input", "open", names, ords, overs, run[-1]["right"], run[0]["left"], "", ",".join(warn)
    whole = run[0]["insert"] + "".join(p["insert"][wide:] for p in run[1:])
    return "ready", "unique", names, ords, overs, None, None, whole[: len(whole) - wide], ",".join(warn)


def golden_gate(parts: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """design, status, reason, parts and ords (names and numbers in order), overhangs, missing_left and missing_right (ends a vector must have), product (circular), warnings."""
    e = type_iis(enzyme)
    kind = parts.schema["design"].dataType.simpleString()
    one = digested_parts(parts, enzyme).groupBy("design").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "left", "right", "insert", "issue"))).alias("p"))
    names = [p.split()[0] for p in ASSEMBLY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [assembled(p, e.bottom - e.top) for p in b.column("p").to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("design"), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], names=["design", *names])

    return one.select("design", "p").mapInArrow(run, f"design {kind}, {ASSEMBLY}")


def chain_issues(parts: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """design, kind, detail: the reasons why the overhangs of a design are not safe, a row each."""
    a = golden_gate(parts, enzyme)
    open_ = a.where("reason = 'open'").select("design", F.lit("open_chain").alias("kind"), F.concat_ws("/", "missing_left", "missing_right").alias("detail"))
    twice = a.where("status = 'ambiguous'").select("design", F.lit("duplicate").alias("kind"), F.col("reason").alias("detail"))
    warn = a.where("warnings <> ''").select("design", F.explode(F.split("warnings", ",")).alias("w")).select("design", F.when(F.col("w").startswith("near"), "near_identical").otherwise("palindromic").alias("kind"), F.substring_index("w", " ", -1).alias("detail"))
    return open_.unionByName(twice).unionByName(warn)


def kit_check(overhangs: DataFrame, kit: str) -> DataFrame:
    """The rows (part, overhangs: an array) with matched, unmatched and consistent against a kit's fusion sites; blanks and nulls do not count."""
    own = F.filter(F.transform("overhangs", lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    sites_ = F.array(*map(F.lit, KITS[kit]))
    return overhangs.withColumn("_o", own).withColumns({
        "matched": F.filter("_o", lambda x: F.array_contains(sites_, x)), "unmatched": F.filter("_o", lambda x: ~F.array_contains(sites_, x)),
    }).withColumn("consistent", (F.size("_o") > 0) & (F.size("unmatched") == 0)).drop("_o")


def organised(parts: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """design, ord, name, role, place: parts of a transcription unit by the role that their boundaries show, then as given."""
    d = digested_parts(parts, enzyme)
    role = F.when((F.col("left") == "GATG") & (F.col("right") == "TGAG"), "coding_sequence").when(F.col("right") == "GATG", "promoter").when(F.col("left") == "TGAG", "terminator").otherwise("unknown")
    rank = F.lit(ROLES["unknown"])
    for r, k in ROLES.items():
        rank = F.when(F.col("role") == r, k).otherwise(rank)
    place = F.row_number().over(Window.partitionBy("design").orderBy(rank, "ord"))
    return d.withColumn("role", role).select("design", "ord", "name", "role", place.alias("place"))


def synthetic_vector(left: Column, right: Column, enzyme: str = "BsaI", filler_length: int = 50) -> Column:
    """A destination vector that, cut, shows these overhangs: padding, site, spacer, left, filler, right, spacer, site, padding; null for overhangs that are not plain bases of the right length."""
    e = type_iis(enzyme)
    wide = e.bottom - e.top
    lead, trail = e.top - len(e.recognition), e.bottom - len(e.recognition) - wide
    ok = F.upper(left).rlike(f"^[ACGT]{{{wide}}}$") & F.upper(right).rlike(f"^[ACGT]{{{wide}}}$")
    filler = (FILLER * (filler_length // len(FILLER) + 1))[:filler_length]
    whole = F.concat(F.lit("AAAA" + e.recognition + "A" * lead), F.upper(left), F.lit(filler), F.upper(right), F.lit("A" * trail + facts.reverse_complement(e.recognition) + "AAAA"))
    words = {w for n in facts.PRESETS["golden-gate-type-iis"] for w in (facts.ENZYMES[n][0], facts.reverse_complement(facts.ENZYMES[n][0]))}
    found = sum((F.regexp_count(whole, F.lit(f"(?={w})")) for w in sorted(words)), F.lit(0))
    return F.when(ok & (found == 2), whole)


def fidelity(junctions: DataFrame, counts: DataFrame) -> DataFrame:
    """junctions (design, ord, left, right) with correct, total and fidelity: observed ligations of the intended pair over all of either end with any end of the design.

    counts: left, right, n, of one assay condition. An end pair that is no Watson-Crick pair, or was never observed in this company, has no fidelity.
    """
    ends = junctions.select("design", F.col("left").alias("end")).unionByName(junctions.select("design", F.col("right").alias("end"))).where("end IS NOT NULL").distinct()
    among = ends.withColumnRenamed("end", "left").join(counts, "left").join(ends.withColumnRenamed("end", "right"), ["design", "right"]).groupBy("design", F.col("left").alias("end")).agg(F.sum("n").alias("all"))
    pair = F.col("right") == S.reverse_complement(F.col("left"))
    j = junctions.join(counts.withColumnRenamed("n", "one"), ["left", "right"], "left").join(counts.select(F.col("right").alias("left"), F.col("left").alias("right"), F.col("n").alias("two")), ["left", "right"], "left")
    j = j.join(among.select("design", F.col("end").alias("left"), F.col("all").alias("la")), ["design", "left"], "left").join(among.select("design", F.col("end").alias("right"), F.col("all").alias("ra")), ["design", "right"], "left")
    j = j.fillna(0, ["one", "two", "la", "ra"]).withColumn("correct", F.when(pair, F.col("one") + F.col("two"))).withColumn("total", F.when(pair, F.col("la") + F.col("ra")))
    return j.select("design", "ord", "left", "right", "correct", "total", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).alias("fidelity"))


def heuristic(junctions: DataFrame) -> DataFrame:
    """junctions with nearest and score: the Hamming distance from the right end to the nearest other end of the design, and its share of the length."""
    ends = junctions.select("design", F.col("left").alias("end")).unionByName(junctions.select("design", F.col("right").alias("end"))).where("end IS NOT NULL").groupBy("design").agg(F.collect_set("end").alias("ends"))
    n = F.length("right")
    far = lambda x: F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(x, i, F.lit(1)) != F.substring(F.col("right"), i, F.lit(1))))
    other = F.filter("ends", lambda x: x != F.col("right"))
    nearest = F.when(F.col("right") == S.reverse_complement(F.col("left")), F.coalesce(F.array_min(F.transform(other, far)), n))
    return junctions.join(ends, "design").select("design", "ord", "left", "right", nearest.alias("nearest"), (nearest / n).alias("score"))


def assembly_scores(scored: DataFrame, value: str) -> DataFrame:
    """design, junctions, known, coverage, estimate: the product over a design, where every junction has a value."""
    known = F.count(value)
    total = F.round(F.exp(F.sum(F.log(F.when(F.col(value) > 0, F.col(value))))), 9)
    least = F.min(value)
    return scored.groupBy("design").agg(F.count("*").alias("junctions"), known.alias("known"), (known / F.count("*")).alias("coverage"), F.when(known == F.count("*"), F.when(least > 0, total).otherwise(0.0)).alias("estimate"))


def ranked_sets(empirical: DataFrame, hamming: DataFrame) -> DataFrame:
    """design, tier, estimate, coverage, rank of overhang sets: those with an empirical estimate, then with a heuristic one, then unknown; then by estimate, coverage and design.

    Ranks are made without one sort: an offset for each tier and range of estimates, and row numbers within.
    """
    one = empirical.select("design", F.col("estimate").alias("e"), F.col("coverage").alias("ec")).join(hamming.select("design", F.col("estimate").alias("h"), F.col("coverage").alias("hc")), "design", "full")
    tier = F.when(F.col("e").isNotNull(), 2).when(F.col("h").isNotNull(), 1).otherwise(0)
    r = one.select("design", tier.alias("tier"), F.coalesce("e", "h").alias("estimate"), F.when(F.col("e").isNotNull(), F.col("ec")).otherwise(F.coalesce("hc", "ec")).alias("coverage"))
    score = F.coalesce("estimate", "coverage")
    r = r.withColumn("cell", (2 - F.col("tier")) * 1025 + F.floor((1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))) * 1024))
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = r.groupBy("cell").agg(F.count("*").alias("n")).select("cell", before.alias("before"))  # 3,075 rows at most
    within = F.row_number().over(Window.partitionBy("cell").orderBy(score.desc(), F.desc("coverage"), "design"))
    return r.withColumn("within", within).join(cells, "cell").select("design", "tier", "estimate", "coverage", (F.col("before") + F.col("within")).alias("rank"))


_MASK = np.zeros(256, np.uint8)
for _symbol, _bases in facts.IUPAC.items():
    _MASK[[ord(_symbol), ord(_symbol.lower())]] = sum(1 << "ACGT".index(c) for c in _bases)
_STEP = np.uint64(0x9E3779B97F4A7C15)
OVERLAP = "struct<length:int,lengths:array<int>,unique:boolean,reason:string>"


def _ends(column: pa.Array, high: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Up to `high` upper-case letters of the end (tail) or the beginning of each text, as a matrix that ends or begins at its border, and their number; null has none."""
    data, off = flat(pc.fill_null(column, ""))
    n = np.minimum(np.diff(off), high)
    at = np.arange(high)[None, :] + ((off[1:] - high) if tail else off[:-1])[:, None]
    inside = np.arange(high)[None, :] >= (high - n)[:, None] if tail else np.arange(high)[None, :] < n[:, None]
    out = np.zeros((len(n), high), np.uint8)
    out[inside] = data[at[inside]]
    out[(out >= 97) & (out <= 122)] -= 32
    return out, n


def with_overlaps(rows: DataFrame, left: str, right: str, low: int = 15, high: int = 60, name: str = "o") -> DataFrame:
    """rows with a struct: length (longest exact overlap of left's tail and right's head, null: none), lengths (all, falling), unique, reason; null where either text is.

    For a batch of pairs at a time, numbers of all tails and heads of up to `high` letters grow by one letter a step; where they agree, letters are compared. Ambiguous
    symbols are looked at only in pairs that have them and no exact overlap: `ambiguous_symbols` if they may overlap.
    """
    if not 8 <= low <= high <= 200:
        raise ValueError("overlaps of 8 to 200 bases are searched")

    def found(tails: np.ndarray, heads: np.ndarray, most: np.ndarray) -> list[list[int]]:
        a, b, power = (np.zeros(len(most), np.uint64) for _ in "abp")
        power += np.uint64(1)
        out: list[list[int]] = [[] for _ in most]
        for k in range(1, high + 1):
            a = tails[:, high - k].astype(np.uint64) + a * _STEP
            b += heads[:, k - 1].astype(np.uint64) * power
            power *= _STEP
            if k >= low:
                for i in np.flatnonzero((a == b) & (k <= most)).tolist():
                    text = tails[i, high - k :]
                    if (text == heads[i, :k]).all() and np.isin(text, PLAIN).all():
                        out[i].insert(0, k)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                (tails, n), (heads, m) = _ends(b.column(left), high, True), _ends(b.column(right), high, False)
                most = np.minimum(n, m)
                got = found(tails, heads, most)
                odd = (((tails != 0) & ~np.isin(tails, PLAIN)).any(axis=1) | ((heads != 0) & ~np.isin(heads, PLAIN)).any(axis=1)).tolist()
                none = (b.column(left).is_null().to_numpy(zero_copy_only=False) | b.column(right).is_null().to_numpy(zero_copy_only=False)).tolist()
                cells = []
                for i, ks in enumerate(got):
                    maybe = not ks and odd[i] and any((_MASK[tails[i, high - k :]] & _MASK[heads[i, :k]]).all() for k in range(low, int(most[i]) + 1))
                    reason = "exact" if len(ks) == 1 else "multiple_exact" if ks else "ambiguous_symbols" if maybe else "none"
                    cells.append(None if none[i] else {"length": ks[0] if ks else None, "lengths": ks, "unique": len(ks) == 1, "reason": reason})
                kind = pa.struct([("length", pa.int32()), ("lengths", pa.list_(pa.int32())), ("unique", pa.bool_()), ("reason", pa.string())])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, kind)], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` {OVERLAP}")


PLAIN = np.frombuffer(b"ACGT", np.uint8)


def gibson(fragments: DataFrame, low: int = 15, high: int = 60, circular: bool = False) -> DataFrame:
    """design, success, errors, overlaps (lengths in order), low_tm, reused, product: ordered fragments joined over their overlaps; a circle also closes. Fragments with other letters than A, C, G, T are refused."""
    order = Window.partitionBy("design").orderBy("ord")
    first = F.first("seq").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.lead("seq").over(order)
    f = fragments.withColumn("next", F.coalesce(nxt, first) if circular else nxt)
    f = with_overlaps(f, "seq", "next", low, high)
    f = f.withColumn("k", F.col("o.length")).withColumn("before", F.coalesce(F.lag("k").over(order), F.lit(0)))
    text = F.when(F.col("k").isNotNull(), F.right(F.upper("seq"), F.col("k")))
    f = f.withColumn("text", text).withColumn("tm", F.when(F.col("k").isNotNull(), S.melting_temperature(F.col("text"))))
    g = f.groupBy("design").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.substring(F.upper("seq"), (F.col("before") + 1).cast("int"), F.length("seq")).alias("piece"), "k", "text"))).alias("x"),
        F.count_if(F.col("next").isNotNull() & F.col("k").isNull()).alias("missing"), F.count_if(F.col("tm") < IDEAL_OVERLAP_TM).alias("low_tm"), F.count("*").alias("n"),
        F.max_by("k", "ord").alias("closing"), F.count_if(F.size("o.lengths") > 1).alias("alternate"),
        F.count_if(~F.coalesce(F.upper("seq").rlike("^[ACGT]+$"), F.lit(False))).alias("odd"),
    )
    whole = F.array_join("x.piece", "")
    closed = F.left(whole, F.greatest(F.lit(0), F.length(whole) - F.coalesce("closing", F.lit(0)))) if circular else whole
    errors = F.when(F.col("n") < 2, "too_few_fragments").when(F.col("odd") > 0, "not_canonical").when(F.col("missing") > 0, "no_overlap").when(F.length(closed) == 0, "closing_overlap_consumes_product").otherwise("")
    texts = F.array_compact("x.text")
    return g.select("design", (errors == "").alias("success"), errors.alias("errors"), F.array_join(F.transform(F.array_compact("x.k"), lambda k: k.cast("string")), ",").alias("overlaps"), "low_tm", "alternate", (F.size(texts) - F.size(F.array_distinct(texts))).alias("reused"), F.when(errors == "", closed).otherwise("").alias("product"))


def gibson_plans(fragments: DataFrame, low: int = 15, high: int = 60, circular: bool = False) -> DataFrame:
    """design, plan: the assembly as canonical JSON: its method, fragments by the hash of their bases in order, overlaps, and the product's hash (null where it fails)."""
    parts = fragments.groupBy("design").agg(F.array_sort(F.collect_list(F.struct("ord", F.sha2(F.upper("seq"), 256).alias("sha256")))).alias("fragments"))
    g = gibson(fragments, low, high, circular).join(parts, "design")
    body = F.struct(F.lit("gibson").alias("method"), F.lit("circular" if circular else "linear").alias("topology"), "fragments", "overlaps", "errors", F.when(F.col("success"), F.sha2("product", 256)).alias("product_sha256"))
    return g.select("design", F.to_json(body).alias("plan"))


def golden_gate_plans(parts: DataFrame, enzyme: str = "BsaI", kit: str | None = None) -> DataFrame:
    """design, plan: the assembly as canonical JSON: enzyme, parts by hash in their given order, the order found, overhangs, how they fit the kit, state, and the product's hash."""
    own = parts.groupBy("design").agg(F.array_sort(F.collect_list(F.struct("ord", "name", F.sha2(F.upper("seq"), 256).alias("sha256")))).alias("inputs"))
    a = golden_gate(parts, enzyme).join(own, "design")
    if kit is not None:
        sites_ = F.array(*map(F.lit, KITS[kit]))
        a = a.withColumn("outside_kit", F.array_join(F.filter(F.split("overhangs", ","), lambda x: (x != "") & ~F.array_contains(sites_, x)), ","))
    else:
        a = a.withColumn("outside_kit", F.lit(""))
    body = F.struct(F.lit("golden_gate").alias("method"), F.lit(type_iis(enzyme).name).alias("enzyme"), "inputs", "status", "reason", F.col("parts").alias("order"), "overhangs", "outside_kit", F.when(F.col("status") == "ready", F.sha2("product", 256)).alias("product_sha256"))
    return a.select("design", F.to_json(body).alias("plan"))
