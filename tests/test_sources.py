"""File formats, assembly kernels and streams on small hand-made inputs."""

import struct

import pandas as pd
from pyspark.sql import functions as F

from strandweave.operators import verification
from strandweave.sources import abif, genbank, text
from strandweave.streaming import windows

GB = '''LOCUS       demo        30 bp    DNA     circular SYN 01-JAN-2024
DEFINITION  a small
            record.
ACCESSION   X1
FEATURES             Location/Qualifiers
     source          1..30
                     /organism="none"
     CDS             join(1..7,complement(10..14))
                     /gene="one"
                     /note="two
                     lines, and a ""quote"""
     misc            5^6
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac
//
LOCUS       cut 99 bp DNA linear
ORIGIN
        1 acgt
//
'''


def test_locations():
    one = lambda a, b, s=1: {"start": a, "end": b, "strand": s}
    assert genbank.parse_location("5..9") == ([one(4, 9)], "", True)
    assert genbank.parse_location("<5..>9")[0] == [one(4, 9)]
    assert genbank.parse_location("complement(join(1..2,5..6))") == ([one(4, 6, -1), one(0, 2, -1)], "join", True)
    assert genbank.parse_location("order(1..2,J0:5..6)")[2] is False
    assert genbank.parse_location("9..5")[2] is False and genbank.parse_location("5^6")[2] is False
    assert genbank.parse_location("complement(" * 40 + "1..2" + ")" * 40)[2] is False


def test_genbank_records(spark):
    r = genbank.parse_genbank(spark.createDataFrame([("f", GB), ("g", "nothing"), ("h", "")], "path string, value string")).orderBy("record").collect()
    assert [(x.locus, x.length, x.topology, x.truncated, len(x.features)) for x in r] == [("demo", 30, "circular", False, 3), ("cut", 99, "linear", True, 0)]
    assert r[0].definition == "a small record." and r[0].sequence == "ACGTACGTACGTACGTACGTACGTACGTAC"
    cds = r[0].features[1]
    assert [tuple(s) for s in cds.segments] == [(0, 7, 1), (9, 14, -1)] and cds.strand == 0 and cds.status == "ok"
    assert {q.name: q.value for q in cds.qualifiers} == {"gene": "one", "note": 'two lines, and a "quote"'}
    assert r[0].features[2].status == "quarantined"


def test_extraction_and_round_trip(spark):
    df = genbank.parse_genbank(spark.createDataFrame([("f", GB)], "path string, value string")).where("locus = 'demo'")
    got = df.select(genbank.extract(F.col("sequence"), F.col("features")[1]["segments"]).alias("x"), "sequence").first()
    s = got.sequence
    assert got.x == s[0:7] + s[9:14][::-1].translate(str.maketrans("ACGT", "TGCA"))
    text = df.select(F.lit("t").alias("path"), genbank.genbank_text(F.col("locus"), F.col("sequence"), F.col("features"), F.col("topology")).alias("value"))
    back = genbank.parse_genbank(text).first()
    assert back.sequence == s and not back.truncated and [f.segments for f in back.features] == [f.segments for f in df.first().features if f.status == "ok"]


def test_gff3(spark):
    f = genbank.parse_genbank(spark.createDataFrame([("f", GB)], "path string, value string")).where("locus = 'demo'").select(F.col("locus").alias("seqid"), F.posexplode("features").alias("id", "f"))
    rows = genbank.gff3_lines(f.select("seqid", "id", "f.type", F.lit("a;b").alias("name"), "f.status", "f.operator", "f.segments")).orderBy("id", "part").collect()
    assert [r.line for r in rows] == [
        "demo\tstrandweave\tsource\t1\t30\t.\t+\t.\tID=0;Name=a%3Bb", "demo\tstrandweave\tCDS\t1\t7\t.\t+\t0\tID=1;Name=a%3Bb;part=1/2", "demo\tstrandweave\tCDS\t10\t14\t.\t-\t2\tID=1;Name=a%3Bb;part=2/2"]


def chromatogram(calls: bytes, quality: bytes, peaks: list[int], channels: list[list[int]]) -> bytes:
    entries, blob = [], b""
    items = [(b"PBAS", 2, 2, calls), (b"PCON", 2, 2, quality), (b"PLOC", 2, 4, struct.pack(f">{len(peaks)}h", *peaks)), (b"FWO_", 1, 2, b"GATC")]
    items += [(b"DATA", 9 + i, 4, struct.pack(f">{len(c)}h", *c)) for i, c in enumerate(channels)]
    for tag, number, kind, body in items:
        size = len(body)
        place = body.ljust(4, b"\0") if size <= 4 else struct.pack(">i", 128 + len(blob))
        blob += body if size > 4 else b""
        entries.append(struct.pack(">4sihhii", tag, number, kind, abif.WIDTH[kind], size // abif.WIDTH[kind], size) + place + b"\0\0\0\0")
    head = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhiii", b"tdir", 1, 1023, 28, len(entries), 28 * len(entries), 128 + len(blob)) + b"\0" * 4
    return head.ljust(128, b"\0") + blob + b"".join(entries)


def test_chromatograms(spark):
    raw = chromatogram(b"ACGTN", bytes([10, 20, 30, 40, 2]), [3, 9, 15, 21, 27], [[1, 2], [3, 4], [5, 6], [7, 8]])
    got = {r.path: r for r in abif.parse_traces(spark.createDataFrame([("a", raw), ("b", b"nothing"), ("c", raw[:200])], "path string, content binary")).collect()}
    a = got["a"]
    assert (a.calls, a.quality, a.peaks, a.g, a.t, a.status) == ("ACGTN", [10, 20, 30, 40, 2], [3, 9, 15, 21, 27], [1, 2], [5, 6], "ok")
    assert got["b"].status == "not an ABIF file" and got["c"].status != "ok" and got["c"].calls is None


def test_read_evidence(spark):
    calls = verification.one_call_per_read(spark.createDataFrame([(1, 0, 1, "A", 1, 30), (1, 0, 1, "C", 1, 10), (1, 0, 2, "C", -1, 30), (1, 1, 1, "G", 1, 40), (1, 1, 2, "G", -1, 40)], "ref int, pos int, read int, base string, strand int, q int"))
    assert {(r.pos, r.depth, r.forward, r.reverse) for r in verification.coverage(calls).collect()} == {(0, 2, 1, 1), (1, 2, 1, 1)}
    assert {(r.pos, r.call) for r in verification.consensus(calls).collect()} == {(0, "N"), (1, "G")}


def test_windows_on_a_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src.replace("events.parquet", "events*.parquet"))
    q = windows.tumbling(stream, late="3650 days").writeStream.format("memory").queryName("tumbled").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in windows.tumbling(batch).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("tumbled").collect()} == want
    assert windows.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_fasta_inside_prose(spark):
    """Prose before, between and behind records; lead lines; comments; what a group of letters must show."""
    cases = {
        "prose": ("Please look:\nACGTACGTACGTAC\nIt is new.\n  >d1 one \nACGT ACGT ACGT\nHello there my friend.\nACGTACGTACGT\n>d2\n\n;note\nMKV-LL*\r\nok then thanks\nGG\n", ">Pasted sequence\nACGTACGTACGTAC\n>d1 one\nACGT ACGT ACGT\n>d2\n\n;note\nMKV-LL*"),
        "no header": ("ACGTACGTACGTACGT", None), "empty": ("", None), "null": (None, None), "no residues": (">a\nThe quick fox.", None),
        "protein lead": ("MEFILPQWERTYEEE\nnothing here\n>x\nHello!\nACGU\n\n", ">Pasted sequence\nMEFILPQWERTYEEE\n>x\nACGU"),
        "signs": ("> h\nsome prose words of it\nACG1 23\nACGTNN(3)acgt\nEnd.\nA", "> h\nACG1 23\nACGTNN(3)acgt"),
        "short groups": (">h\nAC GT AC GT AC\nACG TAC GTA CGT\n", ">h\nACG TAC GTA CGT"),
    }
    got = {r.path: r.value for r in text.extract_fasta(spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "path string, value string")).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


def test_genbank_rows_are_numbered(spark):
    df = spark.range(1).select(genbank.genbank_text(F.lit("x"), F.lit("ACGTACGTAC" * 13), F.array().cast("array<struct<type:string,segments:array<struct<start:int,end:int,strand:int>>,operator:string,status:string,qualifiers:array<struct<name:string,value:string>>>>"), F.lit("linear"), F.lit("protein")).alias("v"))
    lines = df.first().v.split("\n")
    assert lines[0].split()[2:4] == ["130", "aa"] and lines[3:] == ["        1" + " acgtacgtac" * 6, "       61" + " acgtacgtac" * 6, "      121 acgtacgtac", "//", ""]


def test_parsed_genbank_leaves_in_small_frames():
    one = "LOCUS       d 120 bp DNA linear\nFEATURES             Location/Qualifiers\n     gene            1..20\nORIGIN\n" + "        1 acgtacgtac\n" * 30_000
    frames = list(genbank.parsed(iter([pd.DataFrame({"path": range(9), "record": [0] * 9, "text": [one] * 9})]), "path"))
    assert [p for f in frames for p in f["path"]] == list(range(9)) and max(map(len, frames)) <= 3


def test_pasted_text_is_looked_at_once(spark):
    plan = text.extract_fasta(spark.createDataFrame([("a", "x")], "path string, value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.count("RLIKE") < 60
