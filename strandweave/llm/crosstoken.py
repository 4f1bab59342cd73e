"""Cross-tokenizer alignment: packed bitsets of token ends, shared cuts by AND, ranges by rank, links by OR.

Two vocabularies cut the same bytes (a space, then the text). Of a slice of texts end to end, each vocabulary's token ends are
one packed bitset. AND of the two gives the shared cuts, which bound the groups; popcounts with a directory (rank) map
a cut to the tokens before it in either; the positions of set bits (select) come from the unpacked AND. Two tokens overlap in one
run of bytes, which ends at an end of either and holds no other: so the bits of OR are the links, and rank at
each gives its two tokens.

Tokens. A: byte-level BPE by the `tokenizers` library, B: BPE with byte fallback by `sentencepiece`; special strings are plain
text. Neither merges over the beginning of a run of spaces (no piece of B has a space behind another character, which is checked; A
cuts there unless other white space runs on into the spaces), so both encode units: a run of spaces and what follows. Units met before come from a memo
of about MEMO_CHARS characters. Texts where white space runs on into spaces are one unit each.

Counts. The number of documents that hold an id pair linked is summed within a task, then by Spark. What documents need back: the
most frequent pairs, HOT_PAIRS at most, go to every task as two arrays (their least count is chosen from a histogram with 64 rows); all
other pairs are joined as rows by pair. So no pair is hot in the join, and none is dropped.

Null and empty texts, and texts whose joined token bytes differ from the space and the text (a text with U+2581, for one), have no tokens: zeros,
and groups_sha256 is ''. Repeated rows are documents of their own and count each; a null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import documents, slices, written
from strandweave.llm.tokens import byte_symbols

MEMO_CHARS = 8 << 20
ENCODED, SLICE = 4096, 1 << 20
HOT_PAIRS = 131_072
COUNTED = 4 << 20
#: White space that runs on into spaces: there, spaces may be cut otherwise than at a unit's beginning.
RUNS_ON = re.compile(r"[^\S ](?:  | $)")
#: Units that are cut off from a unit behind them, whatever it is.
BESIDE = re.compile(r" (?:[^\s▁]|[^\s▁][^▁]*[^\s▁])")


class Ragged:
    """Lists of ids end to end."""

    def __init__(self):
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: list[np.ndarray], lens: list[np.ndarray]) -> None:
        self.flat = np.concatenate([self.flat, *flat]).astype(np.int32)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(lens))])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.start[rows + 1] - self.start[rows]
        return self.flat[np.repeat(self.start[rows] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))], lens


class ByteLevel:
    """The first vocabulary: a file of the `tokenizers` library with byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the tasks side by side
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte = {c: b for b, c in byte_symbols().items()}
        vocab = self.library.get_vocab()
        self.size = max(vocab.values()) + 1
        self.spelt = [b""] * self.size
        for piece, i in vocab.items():
            self.spelt[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.lengths = np.array([len(x) for x in self.spelt], np.int64)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]


class Pieces:
    """The second vocabulary: a `sentencepiece` BPE model with byte fallback that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.vocab_size()
        pieces = [m.id_to_piece(i) for i in range(self.size)]
        self.apart = all("▁" not in p.lstrip("▁") for p in pieces)
        self.spelt = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.spelt], np.int64)
        self.space = m.piece_to_id("▁")

    def encode(self, units: list[str]) -> list[list[int]]:
        got = self.library.encode([u[1:] for u in units], num_threads=1)
        return [[self.space] if u == " " else g for u, g in zip(units, got, strict=True)]  # of nothing at all the library makes no tokens


class Both:
    """Ids of texts by both vocabularies, a unit (spaces and what follows up to the next) at a time; units met before are not encoded again."""

    def __init__(self, first: ByteLevel, second: Pieces, most: int = MEMO_CHARS):
        self.first, self.second, self.most = first, second, most
        self.pattern = re.compile(" +[^ ]*")
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.a, self.b, self.good, self.held = Ragged(), Ragged(), np.zeros(0, bool), 0

    def units(self, text: str) -> list[str]:
        return self.pattern.findall(text) if self.second.apart and not RUNS_ON.search(text) else [text]

    def one_by_one(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per vocabulary: flat ids, ids of each unit, whether they spell it."""
        out = []
        for vocabulary in (self.first, self.second):
            lists, spelt = vocabulary.encode(units), vocabulary.spelt
            good = np.fromiter((b"".join([spelt[i] for i in g]) == u.encode() for g, u in zip(lists, units, strict=True)), bool, len(units))
            out.append((np.array(list(chain.from_iterable(lists)), np.int32), np.fromiter(map(len, lists), np.int64, len(lists)), good))
        return out

    def together(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """The same for units that may stand in one text side by side; None if a token lies over the border of two."""
        out, text = [], "".join(units)
        raw, ends = text.encode(), np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
        for vocabulary in (self.first, self.second):
            ids = vocabulary.encode([text])[0]
            if b"".join([vocabulary.spelt[i] for i in ids]) != raw:
                return None
            ids = np.array(ids, np.int32)
            upto = np.cumsum(vocabulary.lengths[ids])
            last = np.searchsorted(upto, ends)
            if (upto[last] != ends).any():
                return None
            out.append((ids, np.diff(last, prepend=-1), np.ones(len(units), bool)))
        return out

    def learn(self, units: list[str]) -> None:
        beside = {True: [], False: []}
        for u in units:
            beside[BESIDE.fullmatch(u) is not None].append(u)
        self.at.update(zip(beside[True] + beside[False], range(len(self.good), len(self.good) + len(units)), strict=True))
        done = []
        for safe, some in beside.items():
            for i in range(0, len(some), ENCODED):
                part = some[i : i + ENCODED]
                done.append((self.together(part) if safe else None) or self.one_by_one(part))
        for held, column in ((self.a, 0), (self.b, 1)):
            held.add([d[column][0] for d in done], [d[column][1] for d in done])
        self.good = np.concatenate([self.good, *(d[0][2] & d[1][2] for d in done)])
        self.held += sum(map(len, units))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that begin with a space: ids of the first vocabulary and their number by text, the same of the second, and whether both spell the text."""
        parts = [self.units(t) if t else [] for t in texts]
        units = list(chain.from_iterable(parts))
        code = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(code < 0).tolist()
        if missing:
            self.learn(list({units[i] for i in missing}))
            code[missing] = [self.at[units[i]] for i in missing]
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        (a, n_a), (b, n_b) = self.a.take(code), self.b.take(code)
        per_text = [np.diff(np.concatenate([[0], np.cumsum(v)])[upto]) for v in (n_a, n_b, ~self.good[code])]
        if self.held > self.most:
            self.forget()
        return a, per_text[0], b, per_text[1], per_text[2] == 0


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Both:
    return Both(ByteLevel(a_path), Pieces(b_path))


class Bits:
    """A packed bitset with a rank directory, a count for every 64 bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros(-(-n // 64) * 64 + 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Set bits below each place."""
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[place >> 6] + np.bitwise_count(self.words[place >> 6] & low)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """Both tokenisations of some texts, laid over each other.

    a, b: ids; a_of, b_of: tokens of each text; cuts: the last byte of each group; a_upto, b_upto: tokens up to the end of each
    group; groups_of: groups of each text; link_a, link_b: places in a and b of the linked tokens; links_of: links of each text.
    """

    def __init__(self, texts: list[str | None], both: Both):
        a, n_a, b, n_b, good = both.ids([" " + t if t else "" for t in texts])
        good &= n_a > 0
        self.a, self.b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        self.a_of, self.b_of = np.where(good, n_a, 0), np.where(good, n_b, 0)
        ends = [np.cumsum(v.lengths[ids]) for v, ids in ((both.first, self.a), (both.second, self.b))]
        size = int(ends[0][-1]) if len(ends[0]) else 0
        cut_a, cut_b = (Bits.at(e - 1, size) for e in ends)
        shared, either = Bits(cut_a.words & cut_b.words), Bits(cut_a.words | cut_b.words)
        self.cuts, links = shared.select(), either.select()
        self.a_upto, self.b_upto = cut_a.rank(self.cuts + 1), cut_b.rank(self.cuts + 1)
        self.link_a, self.link_b = cut_a.rank(links), cut_b.rank(links)
        last = np.concatenate([[0], ends[0]])[np.cumsum(self.a_of)]  # bytes up to the end of each text
        self.groups_of, self.links_of = (np.diff(np.concatenate([[0], x.rank(last)])) for x in (shared, either))

    def spelled_groups(self) -> list[bytes]:
        """Per text `a1,a2|b1;a3|b2,b3`: the ids of its groups."""
        groups = len(self.cuts)
        in_a, in_b = np.diff(np.concatenate([[0], self.a_upto])), np.diff(np.concatenate([[0], self.b_upto]))
        place_a = np.arange(len(self.a)) + np.repeat(self.b_upto - in_b, in_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.a_upto, in_b)
        ids, mark = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        if groups:
            mark[place_a[self.a_upto - 1]], mark[place_b[self.b_upto - 1]] = ord("|"), ord(";")
        width = len(str(int(ids.max(initial=0))))
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, width))
        out, size, step = [], np.concatenate([[0], np.cumsum(digits + 1)]), 1 << 20
        for i in range(0, len(ids), step):
            part, n = ids[i : i + step], digits[i : i + step]
            cells = np.zeros((len(part), width + 1), np.uint8)
            for k in range(width):  # the k-th digit from the right stands right-aligned before the mark
                cells[:, width - 1 - k] = part // 10**k % 10 + 48
            cells[:, width] = mark[i : i + step]
            out.append(cells[np.arange(width + 1) >= (width - n)[:, None]].tobytes())
        flat, upto = b"".join(out), size[np.cumsum(self.a_of + self.b_of)]
        return [flat[s : e - 1] if e > s else b"" for s, e in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]


def open_vocabularies(a_path: str | None, b_path: str | None) -> Both:
    import public_tokenizers

    return vocabularies(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, a and b (ids), cuts (last byte of each group), a_upto and b_upto (tokens up to there), link_a and link_b (places of linked tokens) of every row."""

    def ragged(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = open_vocabularies(a_path, b_path)
        for batch in slices(batches, "text", SLICE):
            x = Alignment(batch.column("text").to_pylist(), both)
            bytes_of = np.array([len(t.encode()) + 1 if t and n else 0 for t, n in zip(batch.column("text").to_pylist(), x.a_of.tolist(), strict=True)], np.int64)
            own = [np.cumsum(n) - n for n in (bytes_of, x.a_of, x.b_of)]  # what lies before each text
            to_groups, to_links = ([np.repeat(o, n) for o in own] for n in (x.groups_of, x.links_of))
            lists = [ragged(x.a, x.a_of), ragged(x.b, x.b_of), *(ragged(v - o, x.groups_of) for v, o in zip((x.cuts, x.a_upto, x.b_upto), to_groups, strict=True)), *(ragged(v - o, x.links_of) for v, o in zip((x.link_a, x.link_b), to_links[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "a", "b", "cuts", "a_upto", "b_upto", "link_a", "link_b"])

    lists = ", ".join(f"{c} array<int>" for c in ("a", "b", "cuts", "a_upto", "b_upto", "link_a", "link_b"))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {lists}")


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (different linked id pairs, a << 32 | b, and how often) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = open_vocabularies(a_path, b_path)
        for batch in slices(batches, "text", SLICE):
            x = Alignment(batch.column("text").to_pylist(), both)
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in x.spelled_groups()]
            of = np.repeat(np.arange(batch.num_rows), x.links_of)
            wide = both.second.size
            code = (of * both.first.size + x.a[x.link_a]) * wide + x.b[x.link_b]
            code, times = np.unique(code, return_counts=True)
            own, code = np.divmod(code, both.first.size * wide)
            pairs = (code // wide << 32 | code % wide).astype("<i8")
            end = np.searchsorted(own, np.arange(batch.num_rows + 1)).tolist()
            times = times.astype("<u4")
            cols = [x.a_of, x.b_of, x.groups_of, x.links_of]
            binary = [pa.array([v[s:e].tobytes() for s, e in zip(end[:-1], end[1:], strict=True)], pa.binary()) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(sha, pa.string()), *binary], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (the highest n of its first id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held or [np.zeros(0, "<i8")]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for b in batches:
            for p in b.column("pairs").to_pylist():
                held.append(np.frombuffer(p, "<i8"))
                size += len(p) // 8
                if size > COUNTED:
                    yield out()
                    held, size = [], 0
        yield out()

    counts = written(rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "op11-counts")
    first = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(first).agg(F.max("n").alias("best"))  # at most one row an id of the first vocabulary
    return written(counts.withColumn("a", first).join(F.broadcast(best), "a").select("pair", "n", "best"), "op11-pairs")


def frequent(pairs: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A count that at most `most` pairs reach, and those pairs, sorted, with their n and best."""
    classes = pairs.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("pairs")).orderBy(F.desc("k")).collect()  # 64 rows at most
    total, least = 0, 1 << 62
    for k, size in classes:
        total += size
        if total > most:
            break
        least = 1 << k
    got = pairs.where(F.col("n") >= least).toPandas().sort_values("pair")
    return least, *(got[c].to_numpy(np.int64) for c in ("pair", "n", "best"))


def with_counts(rows: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The rows of linked(), written, with n_best and count_sum."""
    pairs = pair_counts(rows)
    least, hot, hot_n, hot_best = frequent(pairs, hot_pairs)

    def found(p: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = np.frombuffer(p, "<i8")
        at = np.searchsorted(hot, pair)
        return pair, np.minimum(at, max(len(hot) - 1, 0)), hot[np.minimum(at, len(hot) - 1)] == pair if len(hot) else np.zeros(len(pair), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, total = [], []
            for p, t in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
                _, at, hit = found(p)
                times, at = np.frombuffer(t, "<u4")[hit].astype(np.int64), at[hit]
                best.append(int(times[hot_n[at] == hot_best[at]].sum()))
                total.append(int((times * hot_n[at]).sum()))
            keep = [c for c in b.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*keep, "hot_best", "hot_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, p, t in zip(*(b.column(c).to_pylist() for c in ("row", "pairs", "times")), strict=True):
                pair, _, hit = found(p)
                if not hit.all():
                    times = np.frombuffer(t, "<u4").astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int((~hit).sum()), r)), pa.array(pair[~hit]), pa.array(times[~hit])], names=["row", "pair", "times"])

    kept = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rest = rows.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long").join(pairs.where(F.col("n") < least), "pair")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("cold_best"), F.sum(F.col("n") * F.col("times")).alias("cold_sum"))
    out = rows.select(*[c.split(" ")[0] for c in kept.split(", ")], "pairs", "times").mapInArrow(sums, f"{kept}, hot_best long, hot_sum long").join(rest, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("hot_best") + F.coalesce("cold_best", zero)).alias("n_best"), (F.col("hot_sum") + F.coalesce("cold_sum", zero)).alias("count_sum"), "groups_sha256")


def aligned_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    return with_counts(written(linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "op11-linked"), hot_pairs)


def op11_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(documents(spark, sf_dir))
