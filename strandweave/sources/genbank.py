"""GenBank flat files as rows, and GFF3 and GenBank text from features.

Files are cut into records by Spark; a record's grammar is parsed by a small helper in a pandas batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<start:long,end:long,strand:int>"
FEATURE = f"struct<type:string,start:long,end:long,strand:int,operator:string,status:string,segments:array<{SEGMENT}>,qualifiers:array<struct<name:string,value:string>>>"
RECORD = f"record int, locus string, length long, molecule string, topology string, definition string, accession string, sequence string, truncated boolean, features array<{FEATURE}>"
MOST_NESTING = 32
MOST_TEXT = 1 << 20


def _split(inner: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(inner[at:i])
            at = i + 1
    return [*parts, inner[at:]]


def parse_location(text: str, strand: int = 1, depth: int = 0) -> tuple[list[dict], str, bool]:
    """Segments in biological order (0-based, half-open), operator, and whether all of it could be placed."""
    t = re.sub(r"\s+", "", text)
    if depth > MOST_NESTING:
        return [], "", False
    if m := re.fullmatch(r"(complement|join|order)\((.*)\)", t):
        name, inner = m.groups()
        if name == "complement":
            seg, op, ok = parse_location(inner, -strand, depth + 1)
            return seg[::-1], op, ok
        found = [parse_location(p, strand, depth + 1) for p in _split(inner)]
        return [s for f in found for s in f[0]], name, all(f[2] for f in found)
    if m := re.fullmatch(r"<?(\d+)(?:\.\.>?(\d+))?>?", t):
        a, b = int(m[1]), int(m[2] or m[1])
        return ([{"start": a - 1, "end": b, "strand": strand}], "", True) if 1 <= a <= b else ([], "", False)
    return [], "", False  # between-base, remote and one-of locations are kept apart


def parse_features(lines: list[str]) -> list[dict]:
    out, now = [], None
    for line in lines:
        key, rest = line[5:21].strip(), line[21:].strip()
        if key:
            now = {"type": key, "loc": rest, "q": []}
            out.append(now)
        elif now and rest.startswith("/"):
            name, _, value = rest[1:].partition("=")
            now["q"].append([name, value])
        elif now and now["q"]:
            now["q"][-1][1] += ("" if now["q"][-1][0] == "translation" else " ") + rest
        elif now:
            now["loc"] += rest
    rows = []
    for f in out:
        seg, op, ok = parse_location(f["loc"])
        strands = {s["strand"] for s in seg}
        rows.append({
            "type": f["type"], "start": min((s["start"] for s in seg), default=None), "end": max((s["end"] for s in seg), default=None), "strand": strands.pop() if len(strands) == 1 else 0,
            "operator": op, "status": "ok" if ok and seg else "quarantined", "segments": seg, "qualifiers": [{"name": n, "value": (v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v).replace('""', '"')} for n, v in f["q"]],
        })
    return rows


def parse_record(text: str) -> dict:
    head: dict[str, str] = {}
    section, name, features, bases = "head", "", [], []
    for line in text.split("\n"):
        if line.startswith("FEATURES"):
            section = "features"
        elif line.startswith("ORIGIN"):
            section = "origin"
        elif section == "head":
            if line[:12].strip():
                name = line[:12].strip()
            head[name] = (head.get(name, "") + " " + line[12:].strip()).strip()
        elif section == "features":
            if line[:1].strip():
                section = "head"
                name = line[:12].strip()
                head[name] = line[12:].strip()
            else:
                features.append(line)
        else:
            bases.append(re.sub(r"[^A-Za-z*]", "", line))
    words = head.get("LOCUS", "").split()
    unit = next((i for i, w in enumerate(words) if w in ("bp", "aa") and i and words[i - 1].isdigit()), None)
    length = int(words[unit - 1]) if unit else None
    seq = "".join(bases).upper()
    kind = "protein" if unit and words[unit] == "aa" else "rna" if any("RNA" in w for w in words[(unit or 0) + 1 :][:1]) else "dna"
    return {
        "locus": words[0] if words else None, "length": length, "molecule": kind, "topology": "circular" if "circular" in words else "linear", "definition": head.get("DEFINITION"),
        "accession": head.get("ACCESSION"), "sequence": seq, "truncated": section != "origin" or length is not None and len(seq) < length, "features": parse_features(features),
    }


def parse_genbank(texts: DataFrame, key: str = "path", column: str = "value") -> DataFrame:
    """key and the fields of RECORD for every record of whole GenBank texts; records without sequence are marked truncated."""
    parts = F.split(F.regexp_replace(column, "\r\n?", "\n"), "(?m)^//[ \t]*$")
    records = texts.select(key, F.posexplode(parts).alias("record", "text")).where(F.col("text").rlike("(?m)^LOCUS"))
    kind = texts.schema[key].dataType.simpleString()
    return records.mapInPandas(lambda batches: parsed(batches, key), f"{key} {kind}, {RECORD}")


def parsed(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows of records (key, record, text) in frames of about MOST_TEXT of text, one record at least: parsed features take many times their text."""
    for b in batches:
        rows, size = [], 0
        for k, r, t in zip(b[key], b["record"], b["text"], strict=True):
            rows.append({key: k, "record": r, **parse_record(t)})
            size += len(t)
            if size >= MOST_TEXT:
                yield pd.DataFrame(rows).astype({"length": "Int64"})
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows).astype({"length": "Int64"})


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    return parse_genbank(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def extract(seq: Column, segments: Column) -> Column:
    """A feature's bases: segments oriented one by one and joined in their stored order."""
    from strandweave.functions.sequence import reverse_complement

    piece = lambda x: seq.substr((x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
    return F.array_join(F.transform(segments, lambda x: F.when(x["strand"] == -1, reverse_complement(piece(x))).otherwise(piece(x))), "")


def gff3_lines(features: DataFrame) -> DataFrame:
    """id, part, line: one GFF3 line a segment, 1-based and inclusive; CDS phases follow the biological order.

    features: seqid, id, type, name, status, operator, segments. Features that could not be placed are left out.
    """
    f = features.where("status = 'ok'").select("seqid", "id", "type", "name", "operator", F.size("segments").alias("parts"), F.col("segments"), F.posexplode("segments").alias("i", "s"))
    before = F.aggregate(F.slice("segments", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    phase = F.when((F.col("type") == "CDS") & (F.col("operator") != "order"), F.pmod(3 - before % 3, F.lit(3)).cast("string")).otherwise(".")
    name = F.replace(F.replace(F.replace(F.replace("name", F.lit("%"), F.lit("%25")), F.lit(";"), F.lit("%3B")), F.lit("="), F.lit("%3D")), F.lit(","), F.lit("%2C"))
    attributes = F.concat(F.lit("ID="), F.col("id").cast("string"), F.lit(";Name="), name, F.when(F.col("parts") > 1, F.concat(F.lit(";part="), (F.col("i") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"))).otherwise(""))
    strand = F.when(F.col("s.strand") == 1, "+").when(F.col("s.strand") == -1, "-").otherwise(".")
    return f.select("id", (F.col("i") + 1).alias("part"), F.concat_ws("\t", "seqid", F.lit("strandweave"), "type", (F.col("s.start") + 1).cast("string"), F.col("s.end").cast("string"), F.lit("."), strand, phase, attributes).alias("line"))


def genbank_text(name: Column, seq: Column, features: Column, topology: Column, molecule: Column | None = None) -> Column:
    """One GenBank record as text: ORIGIN rows are numbered by their first base and show six groups of ten; reading it again gives the same sequence and locations.

    features: array of FEATURE. molecule: dna (also where it is not given), rna or protein, which is counted in aa.
    """
    kind = F.lit("dna") if molecule is None else F.coalesce(F.lower(molecule), F.lit("dna"))

    def location(f: Column) -> Column:
        one = lambda s: F.when(s["strand"] == -1, F.concat(F.lit("complement("), (s["start"] + 1).cast("string"), F.lit(".."), s["end"].cast("string"), F.lit(")"))).otherwise(F.concat((s["start"] + 1).cast("string"), F.lit(".."), s["end"].cast("string")))
        inner = F.array_join(F.transform(f["segments"], one), ",")
        return F.when(F.size(f["segments"]) > 1, F.concat(F.when(f["operator"] == "order", "order").otherwise("join"), F.lit("("), inner, F.lit(")"))).otherwise(inner)

    quals = lambda f: F.array_join(F.transform(f["qualifiers"], lambda q: F.concat(F.lit("\n" + " " * 21 + "/"), q["name"], F.lit('="'), F.replace(q["value"], F.lit('"'), F.lit('""')), F.lit('"'))), "")
    table = F.array_join(F.transform(F.filter(features, lambda f: f["status"] == "ok"), lambda f: F.concat(F.lit("     "), F.rpad(f["type"], 16, " "), location(f), quals(f))), "\n")
    row = lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.regexp_replace(x, "(.{1,10})", " $1"))
    rows = F.transform(F.regexp_extract_all(F.lower(seq), F.lit("(.{1,60})"), F.lit(1)), row)
    origin = F.when(F.length(seq) > 0, F.concat(F.array_join(rows, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("LOCUS       "), name, F.lit(" "), F.length(seq).cast("string"), F.when(kind == "protein", " aa ").otherwise(F.concat(F.lit(" bp "), F.upper(kind), F.lit(" "))), topology, F.lit("\nFEATURES             Location/Qualifiers\n"),
        F.when(F.length(table) > 0, F.concat(table, F.lit("\n"))).otherwise(""), F.lit("ORIGIN\n"), origin, F.lit("//\n"),
    )
