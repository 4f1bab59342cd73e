"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and pipeline stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandweave.llm import balltree, crosstoken, exactdedup, flac, mixing, neardup, packing, pii, quality, sharding, streamdedup, tokens
from strandweave.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, copies string, tokens int, block string, pick int, weight int, row string, shard string, sig string, key string, rep string"
EXTRA = ["s", 1, "c", 2, "b", 3, 4, "r", "sh", "sg", "k", "rp"]
BIG = 2**60


def long_text(n=400_000):
    random.seed(11)
    return " ".join(f"w{random.randrange(5000)}" for _ in range(n // 6))


@pytest.fixture(scope="module")
def rows():
    one = long_text()
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (7, one), (8, one), (None, "no id a b c"), (None, None), (9, "same id one"), (9, "same id two and more words here"), (BIG + 1, "mail a@b.co or +1 555 123 4567"), (BIG + 3, "x" * 3000)]
    return [(i, t, None if i == 4 else "en", None if i in (5, None) else "web", None, *EXTRA) for i, t in texts]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


OPERATORS = {
    "op1": lambda d: exactdedup.cut_repeats(d), "op2": lambda d: flac.digest(flac.encode_text_column(d)), "op4": lambda d: pii.detect(d), "op5": lambda d: tokens.count_tokens(d),
    "op6": lambda d: sharding.shard_documents(d, 4), "op7": lambda d: mixing.copies(d, whole_rows=True), "op9": lambda d: packing.pack_documents(d), "op10": lambda d: neardup.near_duplicates(d, 2),
    "op11": lambda d: crosstoken.aligned_documents(d), "op13": lambda d: streamdedup.exact_duplicates(d),
    "op3": lambda d: quality.score(d, d.sparkSession.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_on_odd_rows(table, rows, name):
    got = OPERATORS[name](table)
    ids = Counter(r[0] for r in got.select("doc_id").collect())
    want = Counter(r[0] for r in rows)
    assert set(ids) == set(want) if name == "op9" else ids == want
    assert OPERATORS[name](table.limit(0)).count() == 0
    assert OPERATORS[name](table.withColumn("text", F.lit(None).cast("string"))).count() > 0


def test_clashing_columns_keep_their_values(table):
    mixed = mixing.copies(table, whole_rows=True).select("row.*")
    assert mixed.columns == table.columns and mixed.select("copies", "row", "block", "tokens").distinct().collect() == [("c", "r", "b", 2)]
    scored = quality.score(table, table.sparkSession.createDataFrame([], "doc_id long, quality int"), score_name="q", predicted_name="p")
    assert scored.columns == [*table.columns, "q", "p"] and {r[0] for r in scored.select("score").collect()} == {"s"}
    assert dict(quality.score(table, table.sparkSession.createDataFrame([], "doc_id long, quality int")).dtypes)["score"] == "double"


def test_values_of_odd_rows(table):
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(table, 2).collect()}
    assert near[(1, 0)] == (1, True) and near[(2, 0)] == (2, True) and near[(3, 0)] == (3, True)
    assert near[(6, 7)] == (5, False) and near[(9, 2)] == (9, True) and near[(9, 6)] == (9, True)
    long = [v for (i, _), v in near.items() if i == 8]
    assert long == [(7, False)]
    cut = {r.doc_id: r for r in exactdedup.cut_repeats(table.where("doc_id IN (7, 8)")).collect()}
    assert cut[7].n_removed == cut[7].n_bytes == len(long_text()) and cut[8].n_spans == 1
    assert {r.doc_id for r in packing.pack_documents(table).collect()} >= {BIG + 1, BIG + 3}
    kept = table.sparkSession.createDataFrame([(BIG + 1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in packing.pack_documents(kept).collect()) == [str(BIG + 1), "None"]


def test_one_document_with_two_texts_is_linked_through_each(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:60]), " ".join(words[100:160])
    d = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "else where")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(d, 2).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    kept = corpus_pipeline.one_of_each(spark, d, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (4, "else where")])


def test_texts_of_one_document_tie_their_classes(spark):
    """A document whose id is not the smallest of its texts' classes, and chains of such documents, against brute force."""
    random.seed(8)
    a, b = (" ".join(random.choices("abcdefghijklmnop", k=80)) for _ in range(2))
    d = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b + " more"), (9, ""), (9, None), (12, "other")], "doc_id long, text string")
    got = neardup.near_duplicates(d, 2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (7, 3, False), (9, 3, False), (12, 12, True)} and len(got) == 7
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, d, "").collect()) == [(3, a), (12, "other")]
    texts = [" ".join(random.choices("abcdefghijklmnop", k=40)) for _ in range(60)]
    rows = [(random.randrange(50, 90), random.choice(texts) + random.choice(["", " z"])) for _ in range(120)]
    at = {i: i for i, _ in rows}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    for x in range(len(rows)):
        for y in range(x):
            if rows[x][0] == rows[y][0] or 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                lo, hi = sorted((root(rows[x][0]), root(rows[y][0])))
                at[hi] = lo
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, root(i)) for i, _ in rows}


def test_links_that_no_star_makes(spark, monkeypatch):
    """400 pairs that edit the same places of one base: buckets hold many unlike pairs, and only partners are alike."""
    random.seed(21)
    base = [f"b{i}" for i in range(300)]
    places = random.sample(range(300), 60)
    texts = []
    for p in range(400):
        t = list(base)
        for k in places:
            t[k] = f"p{p}x{k}"
        u = list(t)
        u[random.randrange(300)] = f"q{p}"
        texts += [" ".join(t), " ".join(u)]
    ids = list(range(len(texts)))
    random.shuffle(ids)
    want = {}
    for p in range(400):
        low = min(ids[2 * p], ids[2 * p + 1])
        want[ids[2 * p]] = want[ids[2 * p + 1]] = low
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for block in (2048, 100):  # in one block a bucket, and dealt anew by rare shingles
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d, 2).collect()} == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, table, labels_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, table, labels_dir)
    assert out.count() > 0 or name == "quality"
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.dtypes == table.dtypes
    assert stage(spark, table.limit(0), labels_dir).count() == 0
    if name == "personal data":
        assert out.where("text IS NULL").count() == 2 and out.where("text LIKE '%a@b.co%'").count() == 0
    if name == "mixing":
        assert out.dropDuplicates(["doc_id", "text"]).count() == table.dropDuplicates(["doc_id", "text"]).count()
    if name == "near duplicates":
        assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 9: 2, None: 2, BIG + 1: 1, BIG + 3: 1})


def test_top_k_edges(spark):
    rows = [(i, [float(i), 1.0]) for i in range(4)] + [(50, [1.0]), (50, [2.0, 0.0]), (100, []), (None, [1.0])]
    v = balltree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = v.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "v")
    got = balltree.search(v, q, 5).collect()
    assert {r.query_id for r in got} == {0, 50, 100} and all(r.query_id != r.vec_id for r in got)
    assert [(r.rank, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [(i, 0) for i in range(1, 6)]
    assert balltree.search(v.limit(0), q).count() == 0 and balltree.search(v, q.limit(0)).count() == 0


def test_spans_of_a_long_list_are_found_in_time(spark):
    text = "\n".join(f"tel: 0{i % 90 + 10} {1000 + i % 9000} {2000 + i % 7000}" for i in range(20_000))
    found = pii.detector().spans(text)[1]
    assert len(found) > 10_000
    taken, spans = pii.Taken(), []
    random.seed(1)
    for _ in range(400):
        s = random.randrange(1000)
        e = s + random.randint(1, 30)
        assert taken.free(s, e) == all(b <= s or a >= e for a, b in spans)
        taken.add(s, e)
        spans.append((s, e))


def test_context_sums_against_a_plain_loop(spark):
    texts = ["the cat sat, on the mat", "a cat", None, "", "one 22 three ; four", "the the the"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    place, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIMS), np.int64)
    for t in texts:
        words, _ = quality.word_buckets(*quality.byte_buffer(pa.array([t], pa.string())))
        for i, w in enumerate(words):
            for j, x in enumerate(words):
                if 0 < abs(i - j) <= quality.REACH:
                    for p, s in zip(place[x], sign[x], strict=True):
                        want[w, p] += int(s)
    assert (quality.context_sums(d) == want).all()


def test_lpc_frame_written_by_hand():
    """A Rice2 frame with a second-order linear predictor, its bits put together one by one."""
    samples = [10, 12, 15, 17, 22, 20, 19, 25, 30, 28, 27, 33, 40, 41, 39, 35]
    bits = ""
    put = lambda v, n: format(v & ((1 << n) - 1), f"0{n}b")
    header = bytes([0xFF, 0xF8, 0x64, 0x02, 0x00, len(samples) - 1])

    def crc(data, poly, width):
        c = 0
        for byte in data:
            c ^= byte << (width - 8)
            for _ in range(8):
                c = (c << 1) ^ (poly if c >> (width - 1) & 1 else 0)
                c &= (1 << width) - 1
        return c

    bits += put((32 + 1) << 1, 8) + put(samples[0], 8) + put(samples[1], 8)
    coefs, shift = [11, -4], 3
    bits += put(5 - 1, 4) + put(shift, 5) + "".join(put(c, 5) for c in coefs)
    bits += put(1, 2) + put(1, 4)  # Rice2, two partitions
    for part, (a, b) in enumerate([(2, 8), (8, 16)]):
        k = (3, 4)[part]
        bits += put(k, 5)
        for i in range(a, b):
            r = samples[i] - ((coefs[0] * samples[i - 1] + coefs[1] * samples[i - 2]) >> shift)
            u = 2 * r if r >= 0 else -2 * r - 1
            bits += "0" * (u >> k) + "1" + (put(u, k) if k else "")
    bits += "0" * (-len(bits) % 8)
    frame = header + bytes([crc(header, 0x07, 8)]) + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    frame += crc(frame, 0x8005, 16).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode([stream])[0].tolist() == samples
    wrong = bytearray(stream)
    wrong[-8] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(wrong)])


def test_encoder_picks_linear_predictors():
    t = np.arange(4096)
    wave = (100 * np.sin(t / 3) + 20 * np.sin(t / 1.7)).astype(np.int64) + 128
    (stream,) = flac.encode(wave.astype(np.uint8), np.array([0, len(wave)]))
    at = flac.stream_parts(stream)[2]
    assert stream[at + 8] >> 1 >= 32  # the first subframe's type, behind a header of eight bytes
    assert (flac.decode([stream])[0] + 128 == wave).all()


def test_null_media(spark):
    m = spark.createDataFrame([(1, 5, None)], "doc_id long, n_bytes long, media binary")
    assert flac.digest(m).collect()[0][1:] == (5, None, None, None, None, None, None)


def test_ids_of_a_whole_table_equal_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    ids = dict(zip(texts, (np.array([*e.ids, 1], "<u4") for e in t.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))
    for p in packing.pack_documents(d).toPandas().itertuples():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError):
        shared_dir(type("Session", (), {"conf": Conf()})())


def test_small_partitions_fill_all_shards(spark):
    """Many partitions with few vectors of a cell each: a cell's shards get about as many each."""
    rng = np.random.default_rng(4)
    points = rng.integers(-200, 200, (2000, 4))
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, v array<long>").repartition(200)
    cells = balltree.Cells.__new__(balltree.Cells)  # one cell, whose centre is the origin
    cells.centre, cells.of = np.zeros((1, 4)), lambda x: np.zeros(len(x), np.int64)
    got = balltree.grown(vectors, cells, np.array([50]), 4).select("shard", F.length("ids").alias("n")).collect()
    assert len(got) == 50 and max(r.n for r in got) < 3 * 2000 * 8 / 50
