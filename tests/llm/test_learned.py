"""Quality classifier, personal data, mixing, near-duplicates and the pipeline."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandweave.llm import components, mixing, neardup, pii, quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, None, sources[i] if sources else None, None) for i, t in enumerate(texts)], DOCS)


def test_quality_held_out(spark):
    got = quality.op3_quality_classifier(spark, SF).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.3)).all()
    y = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    a, b = y[y.quality == 1].score.to_numpy(), y[y.quality == 0].score.to_numpy()
    assert ((a[:, None] > b[None]).mean() + (a[:, None] == b[None]).mean() / 2) > 0.9
    assert (a >= 0.3).mean() > 0.95


def test_quality_edges(spark):
    texts = [None, "", "word", "a b c " * 4000, "same same", "same same"]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(docs(spark, texts), none).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got)
    one = quality.score(docs(spark, texts), spark.createDataFrame([(i, 1) for i in range(6)] + [(None, 0), (2, None)], "doc_id long, quality int")).collect()
    assert all(r.score == 1.0 for r in one)
    assert quality.score(docs(spark, []), none).count() == 0
    mixed = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    many = docs(spark, [("good words here " if i % 2 else "bad### junk### ") * 5 for i in range(60)] + [None, ""])
    r = quality.score(many, mixed).collect()
    assert len(r) == 62 and all(0 <= x.score <= 1 for x in r) and r[60].score == r[61].score


def test_context_sums_do_not_depend_on_partitions(spark):
    d = docs(spark, ["one two three", "two three four five", None, "x"])
    assert (quality.context_sums(d.repartition(1)) == quality.context_sums(d.repartition(4))).all()


def brute_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans():
    random.seed(1)
    texts = ["".join(random.choice("ab.@-+ 0123456789()%_\n") for _ in range(random.randint(0, 50))) for _ in range(20000)]
    texts += ["+1" * 50, "1.2.3.4.5.6.7.8 1.2.3.4567 a@b.c@d.e x_y@z.w_q@r.s", "4111 1111 1111 1111", "001.002.003.0255", "a" * 30000, "9" * 30000, "1." * 20000]
    for t in texts[:-3]:
        assert pii.base_spans(t) == brute_spans(t), t
    assert [pii.base_spans(t) for t in texts[-3:-1]] == [[], []]


def test_pii_rows_and_redaction(spark):
    texts = [None, "", "é mail me.x@a.example.com now", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "In 1999-2004 page 12 34", "host 10.2.3.4, +1 (826) 555-4081"]
    got = {r.doc_id: r for r in pii.detect(docs(spark, texts)).collect()}
    assert got[2].spans == "email:7:25" and got[2].n_email == 1 and got[2].base_sha256 == hashlib.sha256(b"email:7:25").hexdigest()
    assert got[3].spans.startswith("secret:9:49") and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].spans == "" and got[0].spans == "" and (got[5].n_ip, got[5].n_phone) == (1, 1)
    red = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert red[0] is None and red[2] == "é mail [EMAIL] now" and red[3] == 'token = "[SECRET]"' and red[4] == texts[4] and red[5] == "host [IP], [PHONE]"
    assert pii.detect(docs(spark, [])).count() == 0


def test_added_spans_of_written_out_texts():
    """Texts of another seed than the trees have seen: found whole by kind, and what is added beside them."""
    d = pii.detector()
    hit, missed, wrong = 0, 0, 0
    for marked, label in pii.examples(1200, seed=77):
        a = marked.index("\1")
        b = marked.index("\1", a + 1) - 1
        base, every = d.spans(marked.replace("\1", ""))
        whole = any((s, e) == (a, b) for s, e, _ in every)
        hit, missed = hit + (label and whole), missed + (label and not whole)
        wrong += sum(s not in base and not (label and s[0] < b and s[1] > a) for s in every)
    assert hit / (hit + missed) > 0.98 and wrong <= 0.01 * hit


def test_boosting_learns():
    from strandweave.llm.boosting import Boosted

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = Boosted(x[:400], y[:400])
    m.calibrate(x[400:], y[400:])
    p = m.probability(x[400:])
    assert ((p > 0.5) == (y[400:] == 1)).mean() > 0.93


def test_mixing_budget_and_repeats(spark):
    random.seed(2)
    sources = ["big"] * 600 + ["mid"] * 90 + ["small"] * 10 + [None] * 5
    texts = ["x" * random.randint(0, 400) for _ in sources]
    d = docs(spark, texts, sources)
    c = mixing.copies(d, block_rows=20).toPandas()
    assert len(c) == len(texts)
    tokens = c.groupby("source").tokens.sum()
    made = (c.tokens * c.copies).groupby(c.source).sum()
    weight = c.groupby("source").weight.first()
    for s in tokens.index:
        quota = math.floor(weight[s] * tokens.sum())
        assert quota - c[c.source == s].tokens.max() <= made[s] <= quota
        assert c[c.source == s].copies.max() - c[c.source == s].copies.min() <= 1 and made[s] <= 4.01 * tokens[s]
    rows = mixing.mixed(d, block_rows=20).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert rows.to_dict() == {r.doc_id: r.copies for r in c.itertuples() if r.copies}
    assert mixing.mixed(docs(spark, [])).count() == 0
    whole = mixing.copies(d, budget_share=None, most_repeats=1.25).toPandas()
    assert whole.copies.min() == 1 and whole.copies.max() <= 2


def test_alpha_bisection(spark):
    t = {"a": 1000, "b": 100, "c": 10}

    def weights(alpha):
        raw = {k: (v / 1110) ** alpha for k, v in t.items()}
        return {k: x / sum(raw.values()) for k, x in raw.items()}

    def entropy(w):
        return -sum(x * math.log(x) for x in w.values())

    p = spark.createDataFrame([(v / 1110,) for v in t.values()], "p double")
    goal = entropy(weights(1.0))
    goal += 0.5 * (math.log(3) - goal)
    a = mixing.bisect_alpha(p, 1.0, 0.5, 100.0)
    assert entropy(weights(a)) <= goal + 1e-9 < entropy(weights(a - 1.5e-6))
    tight = mixing.bisect_alpha(p, 1.0, 0.5, 2.0)
    repeats = lambda alpha: max(x * 1110 / t[k] for k, x in weights(alpha).items())
    assert tight > a and repeats(tight) <= 2.0 + 1e-9 < repeats(tight - 1.5e-6)
    assert mixing.bisect_alpha(p, 1.0, 1.0, 1e9) == 0.0 and mixing.bisect_alpha(p, 1.0, 0.5, 0.5) == 1.0


def brute_components(texts, words, percent=80):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    random.seed(7)
    word = lambda: random.choice("abcdefgh") * random.randint(1, 3) + random.choice("xyz")
    texts = [None, "", "One", "one", "one two", "  \t", "Ünï x y"]
    for _ in range(12):
        base = [word() for _ in range(random.randint(3, 120))]
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(6):  # a drifting chain of edits: ends may be unlike, neighbours alike
            k = random.randrange(len(base))
            base = base[:k] + [word()] + base[k + 1 :]
            texts.append("\n".join(base))
    shared = [word() for _ in range(40)]
    texts += [" ".join(shared + [f"{word()}{i}{j}" for j in range(14)]) for i in range(40)]  # alike, but not enough
    sizes, want = brute_components(texts, words)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts), words).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_likely_pairs_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    random.seed(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(24):
        t = list(base)
        for k in random.sample(range(60), 7):
            t[k] = f"q{i}{k}"
        texts.append(" ".join(t))
    _, want = brute_components(texts, 2)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts), 2).collect()}
    assert [got[i] for i in range(24)] == want


def likely(spark, texts, pairs):
    """What likely_pairs makes of the buckets that each pair shares, every text being a component of its own; and the pairs with such a bucket."""
    order = neardup.probe_order()
    sets = neardup.shingle_sets(pa.array(texts), 1)
    keys = [neardup.bands(neardup.sketch(s, order)) for s in sets]
    left = [(int(keys[i][k]), k, i, len(sets[i]), i, 2) for p in pairs for k in np.flatnonzero(keys[p[0]] == keys[p[1]]).tolist() for i in p]
    left = spark.createDataFrame(left, "bucket long, band int, rep long, n long, label long, m long")
    got = {(r.a, r.b) for r in neardup.likely_pairs(left, docs(spark, texts), 1, 80).collect()}
    return got, {p for p in pairs if (keys[p[0]] == keys[p[1]]).any()}


def test_likely_pairs_whose_low_bytes_agree_in_an_earlier_band(spark):
    texts = []
    for i in range(150):
        same = [f"s{i}x{k}" for k in range(900)]
        texts += [" ".join([*same, *(f"{side}{i}x{k}" for k in range(98))]) for side in "ab"]
    got, want = likely(spark, texts, [(i, i + 1) for i in range(0, 300, 2)])
    assert len(want) > 145 and got == want


def test_likely_pairs_with_equal_halved_hashes(spark):
    words = [f"w{k}" for k in range(200_000)]
    low = np.array([int(s[0]) & 0xFFFFFFFF for s in neardup.shingle_sets(pa.array(words), 1)])
    order = np.argsort(low, kind="stable")
    x, y = next((words[i], words[j]) for i, j in zip(order[:-1], order[1:], strict=True) if low[i] == low[j])
    got, want = likely(spark, [f"{x} {y} c d", f"{x} {y} c d e"], [(0, 1)])
    assert got == want == {(0, 1)}


def test_near_duplicates_empty_and_repeated(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.kept) for r in neardup.near_duplicates(twice).collect()) == [("4", True), ("4", True), ("None", True)]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in components.components(e).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == d.columns and dict(out.dtypes) == dict(d.dtypes)
        ids = {r[0] for r in out.select("doc_id").collect()}
        before = {r[0] for r in kept.select("doc_id").collect()}
        assert ids <= before and ids
        if name == "near duplicates":
            texts = {r.doc_id: r.text for r in kept.collect()}
            order = sorted(texts)
            _, label = brute_components([texts[i] for i in order], 5)
            assert ids == {order[k] for k in range(len(order)) if label[k] == k}
        if name == "personal data":
            assert ids == before and out.where(F.col("text").contains("@mail")).count() == 0
        if name == "mixing":
            assert ids == before and out.count() > len(ids)
        kept = out
    pieces = corpus_pipeline.pack(spark, kept, SF)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
