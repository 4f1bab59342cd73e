"""Queries of sources and sinks on texts made of the tables; numbers in comments are rows of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.functions import sequence as S
from strandweave.operators import alignment, assembly, cloning, scans
from strandweave.plans.catalog import register
from strandweave.plans.evidence_queries import _BACK, FORWARD, REVERSE
from strandweave.plans.scalar_queries import SEQS, seqs
from strandweave.plans.site_queries import CHAINS, OVERLAPS, gibson_fragments, parts
from strandweave.plans.table_queries import ROWS, rows
from strandweave.session import table
from strandweave.sources import genbank
from strandweave.sources import text as T


def _cut(a, n):
    return F.substring("seq", a, n)


@register("fasta_scan", f"""WITH {SEQS} SELECT doc_id AS path, 0 AS record, 'd' || doc_id AS header, 'first one' AS description, left(seq, 140) AS sequence, 2 AS gaps_removed FROM seqs WHERE length(seq) >= 140 UNION ALL SELECT doc_id, 2, 'two', '', left(seq, 10), 0 FROM seqs WHERE length(seq) >= 140""")
def fasta_scan(spark, d):  # 1
    s = seqs(spark, d).where(F.length("seq") >= 140)
    text = F.concat(F.lit("prose\n>d"), "doc_id", F.lit(" first one\n; note\n"), _cut(1, 70), F.lit("-\r\n."), _cut(71, 70), F.lit("\n>empty\n\n>two\n"), _cut(1, 10))
    return T.parse_fasta(s.select(F.col("doc_id").alias("path"), text.alias("value"))).select("path", "record", "header", "description", "sequence", "gaps_removed")


@register("pasted_fasta", f"""WITH {SEQS} SELECT doc_id AS path, '>Pasted sequence' || chr(10) || left(seq, 40) || chr(10) || '>d' || doc_id || chr(10) || substr(seq, 41) || chr(10) || ' ; kept' || chr(10) || substr(seq, 41) || chr(10) || '>next' || chr(10) || 'ACGT ACGT ACGT' AS value FROM seqs WHERE length(seq) > 40""")
def pasted_fasta(spark, d):  # 2: the whole sequence between prose
    s = seqs(spark, d).where(F.length("seq") > 40)
    rest = F.substring("seq", F.lit(41), F.length("seq"))
    text = F.concat(F.lit("Please look at this.\n"), _cut(1, 40), F.lit("\nIt is new.\n  >d"), "doc_id", F.lit("\r\nHere it comes, my friends\n"), rest, F.lit("\n ; kept\n\t"), rest, F.lit("\nThat was the first record.\nACGTACGTACGTACGT\n>next\nACGT ACGT ACGT\nThanks a lot!\n"))
    return T.extract_fasta(s.select(F.col("doc_id").alias("path"), text.alias("value")))


_TAGS = ["inventory.v1", "inventory.v2"]


@register("json_inventories", f"""WITH {SEQS}, t AS (SELECT doc_id, doc_id % 5 AS k, left(seq, 12) AS s FROM seqs) SELECT doc_id AS path, CASE k WHEN 2 THEN 'unsupported_schema' WHEN 3 THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN k NOT IN (2, 3) THEN 'r' || doc_id || ':' || s || ':' || (k = 0) END AS first FROM t""")
def json_inventories(spark, d):  # 6
    k = F.col("doc_id") % 5
    tag = F.when(k == 4, "").when(k == 2, '"schema": "other.v9", ').otherwise('"schema": "inventory.v2", ')
    text = F.concat(F.lit(" {"), tag, F.lit('"records": [{"id": "r'), "doc_id", F.lit('", "sequence": "'), _cut(1, 12), F.lit('", "active": '), F.when(k == 0, "true").otherwise("false"), F.when(k == 3, "}").otherwise("}]}"))
    p = T.parse_inventory(seqs(spark, d).select(F.col("doc_id").alias("path"), text.alias("value")), _TAGS)
    return p.select("path", "status", F.concat_ws(":", F.col("records")[0]["id"], F.col("records")[0]["sequence"], F.col("records")[0]["active"].cast("string")).alias("first")).withColumn("first", F.when(F.col("status") == "ok", F.col("first")))


def records(spark, d):
    """GenBank texts of whole documents with a coding sequence in two parts and a feature on the other strand."""
    s = seqs(spark, d).where(F.length("seq") >= 300)
    made = F.expr("array(named_struct('type', 'CDS', 'segments', array(named_struct('start', 10, 'end', 40, 'strand', 1), named_struct('start', 60, 'end', 90, 'strand', 1)), 'operator', 'join'), named_struct('type', 'misc', 'segments', array(named_struct('start', 100, 'end', 130, 'strand', -1)), 'operator', ''))")
    full = F.transform(made, lambda f: F.struct(f["type"].alias("type"), f["segments"].alias("segments"), f["operator"].alias("operator"), F.lit("ok").alias("status"), F.array(F.struct(F.lit("note").alias("name"), F.lit('a "b"').alias("value"))).alias("qualifiers")))
    return s.select(F.col("doc_id").alias("path"), genbank.genbank_text(F.concat(F.lit("d"), "doc_id"), F.col("seq"), full, F.lit("circular")).alias("value"))


@register("genbank_text", f"""WITH {SEQS}, r AS (SELECT doc_id, string_agg(lpad((i * 60 + 1)::VARCHAR, 9, ' ') || regexp_replace(lower(substr(seq, CAST(i * 60 + 1 AS BIGINT), 60)), '(.{{1,10}})', ' \\1', 'g'), chr(10) ORDER BY i) AS o FROM (SELECT *, unnest(range((length(seq) + 59) // 60)) AS i FROM seqs WHERE length(seq) >= 300) GROUP BY doc_id)
SELECT doc_id AS path, sha256('LOCUS       d' || doc_id || ' ' || length(seq) || ' bp DNA circular' || chr(10) || 'FEATURES             Location/Qualifiers' || chr(10) || '     CDS             join(11..40,61..90)' || chr(10) || repeat(' ', 21) || '/note="a ""b""' || chr(34) || chr(10) || '     misc            complement(101..130)' || chr(10) || repeat(' ', 21) || '/note="a ""b""' || chr(34) || chr(10) || 'ORIGIN' || chr(10) || o || chr(10) || '//' || chr(10)) AS sha256 FROM seqs JOIN r USING (doc_id)""")
def genbank_text(spark, d):  # 25: the text itself
    return records(spark, d).select("path", F.sha2("value", 256).alias("sha256"))


@register("genbank_scan", f"""WITH {SEQS} SELECT doc_id AS path, 'd' || doc_id AS locus, length(seq)::BIGINT AS length, 'circular' AS topology, sha256(seq) AS sha256, FALSE AS truncated, substr(seq, 11, 30) || substr(seq, 61, 30) AS cds, reverse(translate(substr(seq, 101, 30), 'ACGT', 'TGCA')) AS other, 'a "b"' AS note FROM seqs WHERE length(seq) >= 300""")
def genbank_scan(spark, d):  # 3, 4, 9, 18, 25, 50
    r = genbank.parse_genbank(records(spark, d))
    take = lambda i: genbank.extract(F.col("sequence"), F.col("features")[i]["segments"])
    return r.select("path", "locus", F.col("length").cast("long").alias("length"), "topology", F.sha2("sequence", 256).alias("sha256"), "truncated", take(0).alias("cds"), take(1).alias("other"), F.col("features")[0]["qualifiers"][0]["value"].alias("note"))


@register("gff3_rows", """SELECT doc_id AS path, part::INTEGER AS part, 'd' || doc_id || chr(9) || 'strandweave' || chr(9) || CASE WHEN part < 3 THEN 'CDS' ELSE 'misc' END || chr(9) || CASE part WHEN 1 THEN '11' || chr(9) || '40' WHEN 2 THEN '61' || chr(9) || '90' ELSE '101' || chr(9) || '130' END || chr(9) || '.' || chr(9) || CASE part WHEN 3 THEN '-' ELSE '+' END || chr(9) || CASE part WHEN 3 THEN '.' ELSE '0' END || chr(9) || CASE part WHEN 3 THEN 'ID=1;Name=b%3D' ELSE 'ID=0;Name=a%3B;part=' || part || '/2' END AS line
FROM (SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 300), range(1, 4) t(part)""")
def gff3_rows(spark, d):  # 23
    r = genbank.parse_genbank(records(spark, d)).select("path", F.col("locus").alias("seqid"), F.posexplode("features").alias("id", "f"))
    g = genbank.gff3_lines(r.select(F.concat("seqid", F.lit("")).alias("seqid"), "id", "f.type", F.when(F.col("id") == 0, "a;").otherwise("b=").alias("name"), "f.status", "f.operator", "f.segments"))
    return g.select(F.substring(F.substring_index("line", "\t", 1), 2, 20).cast("long").alias("path"), F.when(F.col("id") == 1, 3).otherwise(F.col("part")).alias("part"), "line")


_NAMED = "named AS (SELECT lang AS alignment, doc_id AS row, 'Sample ' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN ' ümlaut' ELSE '' END AS name, left(translate(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') || repeat('-', 100), 100) AS aligned FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 0)"


def named(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL AND doc_id % 4 = 0")
    a = F.substring(F.concat(F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")), S.LETTERS, S.CYCLE), F.lit("-" * 100)), 1, 100)
    return t.select(F.col("lang").alias("alignment"), F.col("doc_id").alias("row"), F.concat(F.lit("Sample "), F.col("doc_id") % 3, F.when(F.col("doc_id") % 2 == 0, " ümlaut").otherwise("")).alias("name"), a.alias("aligned"))


_LABELS = """labels_ AS (SELECT *, left(regexp_replace(regexp_replace(regexp_replace(name, '[^\\x20-\\x7e]', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[-_.]+|[-_.]+$', '', 'g'), 30) AS root FROM named), k AS (SELECT *, row_number() OVER (PARTITION BY alignment, lower(root) ORDER BY row) AS k FROM labels_), l AS (SELECT *, CASE WHEN k = 1 THEN root ELSE left(root, 30 - length('_' || k)) || '_' || k END AS label FROM k)"""


@register("clustal_lines", f"""WITH {_NAMED}, {_LABELS}, c AS (SELECT alignment, b, i, min(substr(aligned, CAST(b * 60 + i + 1 AS BIGINT), 1)) AS lo, max(substr(aligned, CAST(b * 60 + i + 1 AS BIGINT), 1)) AS hi FROM named, range(2) t(b), range(60) u(i) WHERE b * 60 + i < 100 GROUP BY ALL)
SELECT alignment, CAST(b AS INTEGER) AS block, row, rpad(label, 32, ' ') || substr(aligned, CAST(b * 60 + 1 AS BIGINT), 60) AS line FROM l, range(2) t(b) UNION ALL SELECT alignment, CAST(b AS INTEGER), 2147483647, repeat(' ', 32) || string_agg(CASE WHEN lo = hi AND lo <> '-' THEN '*' ELSE ' ' END, '' ORDER BY i) FROM c GROUP BY alignment, b""")
def clustal_lines(spark, d):  # 16
    return T.to_clustal(named(spark, d))


@register("clustal_import", f"""WITH {_NAMED}, {_LABELS} SELECT alignment AS path, label AS name, aligned FROM l""")
def clustal_import(spark, d):  # 11: the sink's text read again
    lines = T.to_clustal(named(spark, d)).groupBy("alignment").agg(F.array_sort(F.collect_list(F.struct("block", "row", "line"))).alias("x"))
    text = F.concat(F.lit("CLUSTAL\n\n"), F.array_join("x.line", "\n"))
    return T.parse_clustal(lines.select(F.col("alignment").alias("path"), text.alias("value"))).select("path", "name", "aligned")


_FASTA80 = lambda s: f"regexp_replace(regexp_replace({s}, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10) || '$', '')"


@register("aligned_fasta", f"""WITH {_NAMED} SELECT alignment, sha256(string_agg('>' || name || chr(10) || {_FASTA80('aligned')}, chr(10) ORDER BY row) || chr(10)) AS gapped, sha256(string_agg('>' || name || chr(10) || {_FASTA80("replace(aligned, '-', '')")}, chr(10) ORDER BY row) FILTER (replace(aligned, '-', '') <> '') || chr(10)) AS bare FROM named GROUP BY alignment""")
def aligned_fasta(spark, d):  # 15
    n = named(spark, d)
    return T.aligned_fasta(n).withColumnRenamed("value", "g").join(T.aligned_fasta(n, True).withColumnRenamed("value", "b"), "alignment").select("alignment", F.sha2("g", 256).alias("gapped"), F.sha2("b", 256).alias("bare"))


@register("banded_text", f"""WITH {_NAMED}, w AS (SELECT alignment, greatest(max(length(name)), 9) AS w FROM named GROUP BY 1), s AS (SELECT alignment, p, CASE WHEN p % 3 = 0 THEN '*' WHEN p % 3 = 1 THEN '.' ELSE ' ' END AS m FROM w, range(100) t(p))
SELECT n.alignment, CAST(b AS INTEGER) AS block, row AS ord, rpad(name, CAST(w AS INTEGER), ' ') || ' ' || substr(aligned, CAST(b * 60 + 1 AS BIGINT), 60) || ' ' || least(100, b * 60 + 60) AS line FROM named n JOIN w ON w.alignment IS NOT DISTINCT FROM n.alignment, range(2) t(b) UNION ALL SELECT s.alignment, CAST(p // 60 AS INTEGER), 4611686018427387904, repeat(' ', CAST(any_value(w) + 1 AS BIGINT)) || string_agg(m, '' ORDER BY p) FROM s JOIN w ON w.alignment IS NOT DISTINCT FROM s.alignment GROUP BY s.alignment, p // 60""")
def banded_text(spark, d):  # 17
    n = named(spark, d)
    s = n.select("alignment").distinct().withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("score", F.when(F.col("column") % 3 == 0, 1.0).when(F.col("column") % 3 == 1, 0.5).otherwise(0.0))
    return T.banded_text(n, s)


@register("tsv_cells", """SELECT p_partkey, CASE WHEN contains(c, chr(9)) OR contains(c, '"') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS cell FROM (SELECT p_partkey, CASE WHEN left(trim(t), 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS c FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' =' || p_name WHEN 1 THEN p_name || chr(9) || 'x' WHEN 2 THEN '@"' || p_name || '"' ELSE p_name END AS t FROM part))""")
def tsv_cells(spark, d):  # 19
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, F.concat(F.lit(" ="), "p_name")).when(k == 1, F.concat("p_name", F.lit("\tx"))).when(k == 2, F.concat(F.lit('@"'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.tsv_cell(t).alias("cell"))


@register("serialised_notes", """SELECT conv_id, '[' || string_agg('{"id":' || turn || ',"scope":"record","tags":["' || role || '"]}', ',' ORDER BY turn) || ']' AS notes FROM conversations GROUP BY conv_id""")
def serialised_notes(spark, d):  # 21, 22: written, read again and written alike
    kind = "array<struct<id:bigint,scope:string,tags:array<string>>>"
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("id"), F.lit("record").alias("scope"), F.array("role").alias("tags")))).alias("n"))
    return n.select("conv_id", F.to_json(F.from_json(F.to_json("n"), kind)).alias("notes"))


@register("logo_heights", f"""WITH {ROWS}, s AS (SELECT alignment, "column", sum(n) AS k, sum(n * log2(n)) AS nlogn FROM counts WHERE symbol <> '' AND "column" BETWEEN 10 AND 59 GROUP BY ALL), h AS (SELECT alignment, "column", k, total, k::DOUBLE / total * greatest(0, least(1, 1 - greatest(0, log2(k) - nlogn / k) / 2)) AS information FROM s JOIN totals USING (alignment))
SELECT c.alignment, c."column", round(information, 6) AS information, symbol, round(n::DOUBLE / k, 9) AS fraction, CAST(row_number() OVER (PARTITION BY c.alignment, c."column" ORDER BY n DESC, symbol) AS INTEGER) AS place FROM counts c JOIN h USING (alignment, "column") WHERE symbol <> ''""")
def logo_heights(spark, d):  # 97, 96
    r = rows(spark, d).unionByName(rows(spark, d).where("aligned = ''").withColumn("aligned", F.lit("-"))).where("aligned <> ''")
    return alignment.logo_heights(r, 4, 10, 60).withColumn("information", F.round("information", 6)).withColumn("fraction", F.round("fraction", 9))


@register("row_identities", f"""WITH {_NAMED}, c AS (SELECT alignment, p, substr(aligned, CAST(p + 1 AS BIGINT), 1) AS s, count(*) AS n, min(row) AS f FROM named, range(100) t(p) GROUP BY ALL), m AS (SELECT alignment, p, arg_max(s, (n, -f)) AS s FROM c WHERE s <> '-' GROUP BY ALL)
SELECT n.alignment, row, floor(count_if(substr(aligned, CAST(p + 1 AS BIGINT), 1) = s)::DOUBLE / count(*) * 1000 + 0.5) / 10 AS identity FROM named n JOIN m USING (alignment) GROUP BY ALL""")
def row_identities(spark, d):  # 99
    return alignment.identities(named(spark, d))


@register("gibson_plans", f"""WITH {OVERLAPS}, b AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY design ORDER BY ord), 0) AS before FROM found_overlaps), g AS (SELECT design, count_if(k IS NULL) AS missing, string_agg(substr(seq, before + 1), '' ORDER BY ord) AS s, arg_max(k, ord) AS closing, string_agg(k::VARCHAR, ',' ORDER BY ord) AS ks, string_agg('{{"ord":' || ord || ',"sha256":"' || sha256(seq) || '"}}', ',' ORDER BY ord) AS f, bool_or(contains(seq, 'N')) AS odd FROM b GROUP BY design)
SELECT design, '{{"method":"gibson","topology":"circular","fragments":[' || f || '],"overlaps":"' || coalesce(ks, '') || '","errors":"' || CASE WHEN odd THEN 'not_canonical' WHEN missing > 0 THEN 'no_overlap' ELSE '' END || '"' || CASE WHEN missing = 0 AND NOT odd THEN ',"product_sha256":"' || sha256(left(s, length(s) - closing)) || '"' ELSE '' END || '}}' AS plan FROM g""")
def gibson_plans(spark, d):  # 153
    return cloning.gibson_plans(gibson_fragments(spark, d), circular=True)


@register("golden_gate_plans", f"""WITH RECURSIVE {CHAINS}, i AS (SELECT design, string_agg('{{"ord":' || ord || ',"name":"' || name || '","sha256":"' || sha256(seq) || '"}}', ',' ORDER BY ord) AS inputs FROM parts GROUP BY design) SELECT design, inputs, CASE WHEN reason = 'unique' THEN 'ready' WHEN reason LIKE 'ambiguous%' THEN 'ambiguous' ELSE 'invalid_input' END AS status, reason FROM verdict JOIN i USING (design)""")
def golden_gate_plans(spark, d):  # 155, 156: what the plan says of inputs and state
    p = cloning.golden_gate_plans(parts(spark, d), kit="moclo-ytk").withColumn("j", F.from_json("plan", "inputs array<struct<ord:int,name:string,sha256:string>>, status string, reason string"))
    return p.select("design", F.expr("substring(to_json(j.inputs), 2, length(to_json(j.inputs)) - 2)").alias("inputs"), "j.status", "j.reason")


@register("amplicon_records", f"""WITH {SEQS}, h AS (SELECT doc_id, p, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w, lead(c, 4) OVER w, lead(c, 5) OVER w) AS g FROM (SELECT doc_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
j AS (SELECT f.doc_id, f.p AS s, r.p + 6 AS e FROM h f JOIN h r ON f.doc_id = r.doc_id AND f.g = '{FORWARD}' AND r.g = '{_BACK}' AND r.p + 6 > f.p AND r.p + 6 - f.p <= 50000), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s, s, e) AS rank, count(*) OVER (PARTITION BY doc_id) AS k FROM j)
SELECT doc_id, CAST(e - s AS INTEGER) AS length, CASE WHEN k > 1 THEN 'ambiguous' ELSE 'exact' END AS status, sha256(sha256(seq) || '|' || '{FORWARD}/{REVERSE}' || '|' || sha256(substr(seq, s + 1, e - s))) AS key FROM m JOIN seqs USING (doc_id) WHERE rank = 1""")
def amplicon_records(spark, d):  # 89, 162: the best product of each line with the key that tells it from others
    s = seqs(spark, d)
    p = assembly.pcr_products(scans.primer_bindings(s, [("f", FORWARD), ("r", REVERSE)], 0, 6), s, ("f", FORWARD), ("r", REVERSE)).where("rank = 1").join(s, "doc_id")
    key = F.sha2(F.concat(F.sha2("seq", 256), F.lit(f"|{FORWARD}/{REVERSE}|"), F.sha2("product", 256)), 256)
    return p.select("doc_id", "length", F.when(F.col("rivals") > 0, "ambiguous").otherwise("exact").alias("status"), key.alias("key"))
