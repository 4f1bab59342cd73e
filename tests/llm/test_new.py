"""Cross-tokenizer alignment, spelling variants and streaming deduplication against brute force, and their odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm import crosstoken, streamdedup, variants
from strandweave.llm.common import shared_dir
from strandweave.llm.tokens import byte_symbols

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n long, pair long, row string, digest string, word string, file string, keep string"
CLASH = (7, 8, "r", "d", "w", "f", "k")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOCS)


def table(name):
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/{name}.parquet'").fetchall()


ODD = ["a", " ", "   ", "a ", " a", "a  b   c    ", "\n\n x\r\n\ty", "it's we'll I'VE don't 's", "<|endoftext|> a<s>b</s><unk>", "naïve café Ünïcödé ß İ", "日本語のテキスト 漢字", "🙂🙃 emoji 👩‍👩‍👧", "\x00\x1c\x1d\x85\xa0z", "αβγ Привет עברית ไทย", "a▁b ▁▁", "x" * 700, "12345 67,890.12 !!! ---", " line sep​", "ᲊꟜ new letters \U00010940"]


@pytest.fixture(scope="module")
def both():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: b for b, c in byte_symbols().items()}

    def a(text):
        ids = first.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in ids]

    def b(text):
        pieces = [(i, second.id_to_piece(i)) for i in second.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    return a, b


def slow_alignment(rows, both):
    """Rows of the operator by loops over tokens and byte ranges."""
    out, held = [], Counter()
    for doc, text in rows:
        a, b = (f(text) if text else [] for f in both)
        whole = (" " + text).encode() if text else b""
        if not text or any(b"".join(x for _, x in t) != whole for t in (a, b)):
            out.append((doc, [], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
        links, groups, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(str(x) for x, _ in a[i:p]) + "|" + ",".join(str(x) for x, _ in b[j:q]))
            links += [(a[x][0], b[y][0]) for x in range(i, p) for y in range(j, q) if max(ends[0][x] - len(a[x][1]), ends[1][y] - len(b[y][1])) < min(ends[0][x], ends[1][y])]
            i, j = p, q
        held.update(set(links))
        out.append((doc, a, b, links, ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return Counter((d, len(a), len(b), g.count("|"), len(k), sum(held[x] == best[x[0]] for x in k), sum(held[x] for x in k), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, k, g in out)


@pytest.mark.parametrize("hot_pairs", [0, 50, crosstoken.HOT_PAIRS])
def test_alignment_against_brute_force(spark, both, hot_pairs):
    rows = table("documents")[:60] + [(9000 + i, t) for i, t in enumerate(ODD)] + [(9100, None), (9101, ""), (None, "no id here"), (9000, "a"), (9000, "a")]
    want = slow_alignment(rows, both)
    got = Counter(map(tuple, crosstoken.aligned_documents(frame(spark, rows), hot_pairs=hot_pairs).collect()))
    assert got == want
    assert any(r[1] == 0 for r in got if r[0] == 9000 + ODD.index("a▁b ▁▁"))


def test_units_equal_the_libraries(both):
    """Unit by unit the ids are those of the whole text, for random mixtures of hard pieces, while the memo fills and is emptied."""
    whole = crosstoken.open_vocabularies(None, None)
    small = crosstoken.Both(whole.first, whole.second, most=500)
    random.seed(5)
    parts = [" ", "  ", "   ", "\n", "\t", "\n ", "'s", "'", "é", "ñ", "ß", "a", "word", "Word", "1", "42", ".", "...", "-", "漢", "か", "я", "🙂", "­", "̀", "\u200d", "\x1f", "\x85", "\xa0", "\u3000", "\u2028", "<s>", "<|endoftext|>"]
    texts = ["".join(random.choices(parts, k=random.randrange(1, 40))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        a, n_a, b, n_b, good = small.ids([" " + t for t in some])
        for ids, n, f in ((a, n_a, both[0]), (b, n_b, both[1])):
            upto = np.concatenate([[0], np.cumsum(n)])
            for i, t in enumerate(some):
                assert ids[upto[i] : upto[i + 1]].tolist() == [x for x, _ in f(t)], t
        assert good.all() and small.held <= 500


def test_lists_of_the_alignment(spark, both):
    row = crosstoken.align(frame(spark, [(1, "x"), (2, None), (3, "naïve tokenisation ahead"), (4, "y z")])).where("doc_id = 3").first()
    a, b = both[0]("naïve tokenisation ahead"), both[1]("naïve tokenisation ahead")
    assert row.a == [x for x, _ in a] and row.b == [x for x, _ in b]
    ends_a, ends_b = (np.cumsum([len(x) for _, x in t]) for t in (a, b))
    assert [c + 1 for c in row.cuts] == sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert ends_a[np.array(row.a_upto) - 1].tolist() == [c + 1 for c in row.cuts] == ends_b[np.array(row.b_upto) - 1].tolist()
    assert len(row.link_a) == len(set(zip(row.link_a, row.link_b, strict=True))) == len(set(ends_a.tolist()) | set(ends_b.tolist()))


def test_bits():
    random.seed(2)
    for n in (1, 63, 64, 65, 1000):
        on = sorted(random.sample(range(n), n // 2 + 1))
        bits = crosstoken.Bits.at(np.array(on), n)
        assert bits.select().tolist() == on
        assert bits.rank(np.arange(n + 1)).tolist() == [sum(x < p for x in on) for p in range(n + 1)]


def slow_variants(rows, shortest=6, least=5, factor=5, every=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        edits = {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in ["", *letters] for k in (0, 1)}
        near[w] = {v for v in edits if v in words and v != w}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= factor * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, form[w], root, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_of_the_documents(spark):
    got = variants.op12_spelling_variants(spark, SF).collect()
    assert len(got) > 500 and sum(r.form is not None for r in got) > 10
    rows = table("documents")
    assert {tuple(r) for r in got} == slow_variants(rows) and len(got) == len(set(got))


@pytest.mark.parametrize("most", [4, variants.MOST])
def test_variants_by_brute_force(spark, most):
    """Chains of forms, doubled letters, hot halves that are dealt anew, words of one letter and odd rows; few letters, so that much is near."""
    random.seed(3)
    rows = []
    for i in range(400):
        word = "".join(random.choices("abé×", k=random.randrange(5, 9)))
        rows.append((i, " ".join([word] * random.choice([1, 2, 7, 40])) + "-" + word.upper()))
    rows += [(600 + i, "standard " * 700 + "standart " * 70 + "standrt " * 7) for i in range(10)]
    rows += [(501, ("a" * 3000 + " ") * 30 + ("a" * 2999 + " ") * 6), (502, None), (503, ""), (None, "nobody's " * 9), (None, "nobodys " * 9)]
    rows += [rows[0], rows[0]]
    got = variants.spelling_variants(frame(spark, rows), every=5, most=most).collect()
    assert {tuple(r) for r in got} == slow_variants(rows, every=5) and len(got) == len(set(got))
    assert sum(r.root != r.form for r in got if r.form) > 0
    assert variants.spelling_variants(frame(spark, rows).limit(0)).count() == 0


def test_automaton_is_minimal_and_numbers_are_ranks():
    random.seed(4)
    words = sorted({"".join(random.choices("ab", k=random.randrange(0, 9))) for _ in range(150)})
    index = variants.Automaton(words)
    tails = set()
    for w in words:
        for i in range(len(w) + 1):
            tails.add(tuple(sorted(v[i:] for v in words if v[:i] == w[:i])))
    assert len(index.edges) == len(tails)
    assert [index._finish(index.start, w, 0, {}) for w in words] == list(range(len(words)))
    for w in words:
        half = len(w) // 2
        edits = {w[:i] + c + w[i + k :] for i in range(half, len(w) + 1) for c in ("", "a", "b") for k in (0, 1)} - {w}
        assert {words[k] for k in index.completions(w, half)} - {w} == {v for v in words if v in edits}


def slow_groups(rows):
    same = defaultdict(list)
    for doc, text in rows:
        same[text or ""].append(-1 if doc is None else doc)
    out = Counter()
    for text, ids in same.items():
        keep = max(ids)
        for k, i in enumerate(sorted(ids)):
            out[(None if i < 0 else i, None if keep < 0 else keep, len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


EQUALS = [(1, "a"), (2, "b"), (3, "a"), (5, "A"), (5, "a "), (4, None), (6, ""), (7, "b"), (7, "b"), (None, "b"), (None, "only"), (None, "only"), (8, "x" * 300_000), (9, "x" * 300_000), (10, "x" * 299_999 + "y"), *[(100 + i, "hot") for i in range(300)]]


@pytest.mark.parametrize("digest", [streamdedup.sha256, lambda t: F.unhex(F.hex(F.crc32(t.cast("binary")) % 3)), lambda t: F.unhex(F.lit("00"))])
def test_equal_texts_even_under_weak_digests(spark, digest):
    got = streamdedup.exact_duplicates(frame(spark, EQUALS), digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == slow_groups(EQUALS)
    assert streamdedup.exact_duplicates(frame(spark, EQUALS).limit(0), digest).count() == 0


def test_state_goes_on_over_files_and_runs(spark):
    """Files come one a micro-batch and in two runs; the second run reads the new ones only and knows the old."""
    at = f"{shared_dir(spark)}/op13-test"
    frame(spark, EQUALS[:12]).repartition(4).write.parquet(f"{at}/rows")
    streamdedup.ingest(spark, f"{at}/rows", at, most_files=1)
    assert Counter(map(tuple, streamdedup.verdicts(spark, f"{at}/rows", at).collect())) == slow_groups(EQUALS[:12])
    before = streamdedup.entries(spark, at).count()
    frame(spark, EQUALS[12:] + [(50, "a"), (0, "b")]).repartition(3).write.mode("append").parquet(f"{at}/rows")
    streamdedup.ingest(spark, f"{at}/rows", at, most_files=1)
    rows = EQUALS + [(50, "a"), (0, "b")]
    assert Counter(map(tuple, streamdedup.verdicts(spark, f"{at}/rows", at).collect())) == slow_groups(rows)
    assert streamdedup.entries(spark, at).count() > before
    assert spark.read.parquet(f"{at}/updates").agg(F.count_distinct("batch")).first()[0] >= 7  # the tables of micro-batches, the empty one at the start has no row
    assert spark.conf.get(streamdedup.PROVIDER, None) != streamdedup.ROCKS
