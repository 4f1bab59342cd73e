"""Exact dedup, FLAC, tokens, sharding, top-k and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strandweave.llm import balltree, deepshallow, exactdedup, flac, packing, sharding, tokens

DOCS = "doc_id long, text string, extra string, row string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], DOCS)


def cut(text, counts):
    raw = (text or "").encode()
    mark = bytearray(len(raw))
    for p in range(len(raw) - 199):
        if counts[raw[p : p + 200]] > 1:
            mark[p : p + 200] = b"\1" * 200
    return sum(mark), len([s for s in bytes(mark).split(b"\0") if s]), hashlib.sha256(bytes(c for c, m in zip(raw, mark, strict=True) if not m)).hexdigest()


@pytest.mark.parametrize("most", [4096, 0])
def test_suffix_dedup(spark, most, monkeypatch):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdé ") for _ in range(6))
    passage, other = "".join(word() for _ in range(60)), "".join(word() for _ in range(40))
    texts = [None, "", "short", passage, passage, "x" + passage[:250] + other, other[:200], other[:199], "a" * 450, "ab" * 300, word() + passage[20:] + word(), passage[:230] + "Q" + passage[231:], "a" * 199]
    texts += [word() * 3 + passage[i : i + 220 + i] + word() * 5 for i in range(0, 60, 7)]
    monkeypatch.setattr(exactdedup.repeated_ranges, "__defaults__", (most,))
    counts = Counter((t or "").encode()[p : p + 200] for t in texts for p in range(len((t or "").encode()) - 199))
    got = {r.doc_id: r for r in exactdedup.cut_repeats(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == cut(t, counts), i
        assert r.n_bytes == len((t or "").encode())


def test_suffix_dedup_empty_and_repeated_rows(spark):
    assert exactdedup.cut_repeats(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(7, "abc" * 90)] * 2, "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in exactdedup.cut_repeats(twice).collect()] == [(7, 270)] * 2


def test_deep_shallow_order():
    random.seed(3)
    strings = [bytes(random.choice(b"ab\0") for _ in range(random.randint(0, 90))) for _ in range(400)] + [b"a" * 60 + bytes([c]) for c in range(40)] + [b"a" * 61, b"a" * 60]
    group = np.sort(np.array([random.randint(0, 5) for _ in strings]))
    order = deepshallow.suffix_order(group, strings)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))
    common = deepshallow.neighbours_common(order, group, strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        want = -1 if group[order[k]] != group[order[k - 1]] else next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == want


@pytest.mark.parametrize("how", [{}, {"block": 4096}, {"lpc": ([3, -2, 1], 1)}, {"lpc": ([12, -3], 3), "block": 192}])
def test_flac_round_trip(how):
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, 64 * int(rng.integers(1, 40))).astype(np.uint8) for _ in range(20)] + [np.zeros(64, np.uint8), np.r_[np.zeros(1000, np.uint8), [255], np.zeros(23, np.uint8)]]
    parts += [np.frombuffer((b"hello world the and " * 999)[: 64 * n], np.uint8) for n in (1, 17, 200)]
    off = np.cumsum([0, *map(len, parts)])
    streams = flac.encode(np.concatenate(parts), off, **how)
    samples, stream, sample_at, n, byte_at = flac.decode(streams)
    assert (samples + 128 == np.concatenate(parts)).all()
    bare = [s[:4] + b"\x80" + s[5:42] + s[flac.stream_parts(s)[2] :] for s in streams]  # without seek tables
    again, *rest = flac.decode(bare)
    assert (again == samples).all() and (rest[1] == sample_at).all()
    broken = bytearray(streams[3])
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def test_flac_columns(spark):
    texts = [None, "", "é" * 40, "x" * 5000, "x" * 5000]
    media = flac.encode_text_column(docs(spark, texts), block=1024)
    rows = {r.doc_id: r for r in flac.digest(media).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert rows[3].media_sha256 == rows[4].media_sha256 and rows[3].feature == rows[4].feature
    blocks = flac.decode_blocks(media).where("doc_id = 3").orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [0, 1024, 2048, 3072, 4096] and sum(b.samples for b in blocks) == 5056
    assert b"".join((np.frombuffer(b.pcm, "<i4") + 128).astype(np.uint8).tobytes() for b in blocks)[:5000] == b"x" * 5000
    assert flac.digest(flac.encode_text_column(docs(spark, []))).count() == 0


def odd_texts(n, alphabet, seed):
    random.seed(seed)
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, 50))) for _ in range(n)]


def test_token_counts(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = odd_texts(3000, "abcdefgAB é İΣσ́ \t\n\x1c\x85\xa0᠎​﻿1٣²½'s't.,!?##<|endoftext|>漢字😀", 1)
    texts += ["<|endoftext|>a<|startoftext|> b", "a" * 5000, "ab" * 3000, "don't we'll ABC'S", "", " ", "THEİ ΑΣ ΑΣΑ"]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs(spark, [*texts, None])).collect()}
    assert [got[i][1] for i in range(len(texts))] == want
    assert got[len(texts)] == (0, 0, False) and got[len(texts) - 6][0] == 5000
    assert all(got[i][2] == (want[i] > 2048) for i in range(len(texts)))


def brute_minimax(sizes, shards):
    """Least largest sum over all contiguous partitions into at most `shards` parts."""
    total = [0, *np.cumsum(sizes).tolist()]
    best = [0] + [10**9] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[i], total[j] - total[i]) for i in range(j)) for j in range(1, len(total))]
    return best[-1]


def test_minimax():
    random.seed(5)
    for _ in range(60):
        sizes = [random.randint(1, 50) for _ in range(random.randint(1, 40))]
        k = random.randint(1, 9)
        cap, starts = sharding.minimax_cuts(np.array(sizes), k)
        assert cap == brute_minimax(sizes, k) and len(starts) <= k and starts[0] == 0
        ends = [*starts[1:], len(sizes)]
        assert max(sum(sizes[a:b]) for a, b in zip(starts, ends, strict=True)) == cap and len(starts) == min(k, len(sizes))
    sizes = np.array([3] * 50 + [400] + [3] * 70)  # a large atom in its place; the others level
    _, starts = sharding.minimax_cuts(sizes, 6)
    assert [int(x.sum()) for x in np.split(sizes, starts[1:])] in ([75, 75, 400, 69, 72, 69], [75, 75, 400, 69, 69, 72], [75, 75, 400, 72, 69, 69])
    assert sharding.minimax_cuts(np.array([], dtype=np.int64), 4) == (0, [])


def test_shards(spark):
    random.seed(6)
    texts = ["same " * 30] * 300 + ["".join(random.choice("abcé") for _ in range(random.randint(0, 90))) for _ in range(700)] + [None, ""]
    got = sharding.shard_documents(docs(spark, texts), 20).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts))) and set(got.shard) == set(range(20))
    by_text: dict = {}
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by_text.setdefault(raw, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    rest = got[got.shard != got[got.doc_id == 0].shard.iloc[0]].groupby("shard")["size"].sum()
    assert rest.max() - rest.min() <= 0.2 * rest.max() + 400
    assert sharding.shard_documents(docs(spark, []), 8).count() == 0


@pytest.mark.parametrize("shard,block", [(8192, 4096), (100, 3), (20, 2)])
def test_top_k(spark, shard, block):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (230, 8)).astype("float32")
    x[60:140] = x[60]  # many ties
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + [(300, None, None), (350, [1.0, None], None), (400, [float("nan")] * 8, None), (450, [float("inf")] * 8, None)]
    v = balltree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string"))
    q = v.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "v")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in balltree.search(v, q, 5, shard, block).orderBy("query_id", "rank").collect()]
    z = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 230, 50):
        s = z @ z[i]
        best = sorted((j for j in range(230) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(best)]
    assert got == want


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    e = packing.encoder(P.path("byte_bpe_50k.tiktoken"))
    odd = odd_texts(3000, "ab cd'sxé İ  \t\n\x1c\x85\xa0​1٣²!#漢😀<|endoftext|>", 3) + ["a <|endoftext|> b", "", " a", "a ", "x\n y", "a\n \nb"]
    assert all(np.frombuffer(e.encode(s), "<u4").tolist() == w.ids for s, w in zip(odd, t.encode_batch(odd, add_special_tokens=False), strict=True))
    random.seed(9)
    texts = [None, "", *["".join(random.choice(["the ", "and ", "kla ", "bno ", "xi"]) for _ in range(random.randint(1, 2500))) for _ in range(60)], "copy of this " * 90, "copy of this " * 90, "z" * 9000]
    ids = [np.array([*w.ids, 1], "<u4") for w in t.encode_batch([s or "" for s in texts], add_special_tokens=False)]
    got = packing.pack(packing.tokenised(docs(spark, texts)).cache(), shard_docs=16).toPandas()
    for d, g in got.groupby("doc_id"):
        at = 0
        for p in g.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(ids[d][p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    assert got.doc_id.nunique() == len(texts)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()


def test_packing_weighs_terms_by_the_whole_corpus(spark):
    random.seed(4)
    words = [[f" {c}{chr(97 + k)}x" for k in range(12)] for c in ("alpha", "river", "stone", "cloud", "green", "house")]
    texts = ["".join(random.choice(words[i % 6] if random.random() < 0.7 else random.choice(words)) for _ in range(random.randint(20, 400))) for i in range(90)]
    tokens = packing.tokenised(docs(spark, texts)).cache()
    rows = tokens.toPandas().set_index("doc_id").sort_index()
    index = packing.Bm25([np.frombuffer(t, "<u2") for t in rows.terms], [np.frombuffer(c, "<u4") for c in rows.counts])
    got = packing.pack(tokens, shard_docs=16).toPandas()
    assert (got.sequence_id // 2**32).nunique() > 2

    class Part:
        def __init__(self, ids):
            self.ids = ids

        def scores(self, seed):
            return index.scores(self.ids[seed])[self.ids]

    for _, g in got.groupby(got.sequence_id // 2**32):
        own = rows.loc[g.doc_id.unique()].reset_index().sort_values(["sig", "doc_id"])
        ids, n = own.doc_id.to_numpy(), own.n.to_numpy()
        want = [(ids[d], start, length, seq, offset) for d, start, length, seq, offset in packing.fill_windows(n, Part(ids))]
        assert sorted(want) == sorted(zip(g.doc_id, g.start, g.length, g.sequence_id % 2**32, g["offset"], strict=True))


def test_bm25_against_brute_force():
    random.seed(8)
    terms = [np.unique(np.array([random.randint(0, 60) for _ in range(random.randint(1, 30))], "<u2")) for _ in range(30)]
    counts = [np.array([random.randint(1, 5) for _ in t], "<u2") for t in terms]
    index = packing.Bm25(terms, counts)
    size = [int(c.sum()) for c in counts]
    df = Counter(int(x) for t in terms for x in t)
    for seed in range(30):
        got = index.scores(seed)
        for d in range(30):
            tf = dict(zip(terms[d].tolist(), counts[d].tolist(), strict=True))
            want = sum(max(0.0, np.log((30 - df[x] + 0.5) / (df[x] + 0.5))) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * size[d] / np.mean(size))) for x in terms[seed].tolist() if x in tf)
            assert abs(got[d] - want) < 1e-9
