"""Lexical retrieval packing: windows of 2,048 tokens filled with BM25 neighbours of a seed document.

1. Every whole text is tokenised (byte-level BPE, then id 1). Of the ids only what packing needs is kept:
   their number, CRC-32 of every 32-id prefix, distinct ids with counts (the lexical terms) and the
   smallest hash of a neighbouring id pair, which brings like documents to one shard.
2. Shards hold about SHARD_DOCS documents. A signature shared by very many documents (copies) is dealt
   over as many shards as it needs, so no shard grows with a hot group.
3. In each shard a BM25 inverted index returns, for the seed of each window, the shard's unused documents by
   falling score; they fill the window. Document counts of terms and the mean length are those of all
   documents; documents of other shards are not searched. The last one is cut where the window ends (at a multiple of 32
   of its ids), and its rest is the seed of the next window, whose neighbours are its own. Texts longer
   than a window fill whole windows first. Documents without a term in common follow in shard order.

Padding is the gap under 32 ids at a window's end and one open window a shard. CRC-32 of a piece follows
from the CRCs of two prefixes, because CRC-32 is linear; ids are never shuffled.

Tokens. The rank file of the same vocabulary is read by its fast encoder, special strings as the
`tokenizers` library takes them; the tests hold the ids of a whole table against that library and its file.

Null and empty texts are the single id 1. Repeated rows are documents of their own. A null doc_id stays null. An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import documents, slices, written
from strandweave.llm.shingles import mix

WINDOW, STEP = 2048, 32
SHARD_DOCS = 1024
K1, B = 1.2, 0.75


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the `tokenizers` file's."""

    def __init__(self, ranks_path: str, special: str = "<|endoftext|>", special_id: int = 50256):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def prefix_crcs(ids: bytes) -> bytes:
    """CRC-32 of the first 32, 64, ... ids and of all."""
    step, crc, out = 4 * STEP, 0, []
    for i in range(0, len(ids), step):
        crc = zlib.crc32(ids[i : i + step], crc)
        out.append(crc)
    return np.array(out, "<u4").tobytes()


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n, crcs, terms, counts, sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        e = encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        end = np.array([1], "<u4").tobytes()
        for b in slices(batches, "text", 2 << 20):
            ids = [e.encode(t or "") + end for t in b.column("text").to_pylist()]
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.uint64)
            n = np.array([len(x) // 4 for x in ids])
            at = np.cumsum(n) - n
            pair = mix((flat << np.uint64(32)) + np.append(flat[1:], np.uint64(1)))
            sig = np.minimum.reduceat(pair, at).view(np.int64)
            terms, counts = [], []
            for x in ids:
                t, c = np.unique(np.frombuffer(x, "<u4"), return_counts=True)
                terms.append(t.astype("<u2").tobytes())
                counts.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array([prefix_crcs(x) for x in ids], pa.binary()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), pa.array(sig)], names=["doc_id", "n", "crcs", "terms", "counts", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, crcs binary, terms binary, counts binary, sig long")


@lru_cache(maxsize=1)
def shift_matrices() -> np.ndarray:
    """[k, bit]: what 2**k zero bytes make of a CRC with only that bit set."""
    out = np.zeros((32, 32), np.int64)
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out[0, i] = c
    for k in range(1, 32):
        out[k] = apply_matrix(out[k - 1], out[k - 1])
    return out


def apply_matrix(m: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> bit & 1, m[bit], 0)
    return out


def piece_crcs(upto_start: np.ndarray, upto_end: np.ndarray, nbytes: np.ndarray) -> np.ndarray:
    """CRC-32 of pieces from the CRCs of the texts up to their start and up to their end."""
    m, moved = shift_matrices(), upto_start.astype(np.int64)
    for k in range(int(nbytes.max(initial=0)).bit_length()):
        moved = np.where(nbytes >> k & 1, apply_matrix(m[k], moved), moved)
    return moved ^ upto_end


def corpus(tokens: DataFrame) -> tuple[int, float, np.ndarray]:
    """Number of documents, mean length, and the number of documents with each term: at most one row a term for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(65536, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<u2"), minlength=65536)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(df[has])], names=["term", "df"])

    n, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    df = np.zeros(65536, np.int64)
    for term, k in tokens.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = k
    return n, mean or 0.0, df


class Bm25:
    """Inverted index of one shard; classic idf, so a term in more than half of the documents weighs nothing.

    sizes: lengths of the shard's documents; whole: what corpus() gives. Without them the shard is the corpus.
    """

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray | None = None, whole: tuple[int, float, np.ndarray] | None = None):
        n = len(terms)
        flat, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        size = np.bincount(doc, weights=tf, minlength=n) if sizes is None else sizes
        total, mean, df = whole or (n, size.mean(), np.bincount(flat, minlength=65536))
        idf = np.maximum(np.log((total - df + 0.5) / (df + 0.5)), 0)
        w = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        keep = w > 0
        order = np.argsort(flat[keep], kind="stable")
        self.doc, self.weight = doc[keep][order], w[keep][order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(flat[keep], minlength=65536))])
        self.terms, self.n = terms, n

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed].astype(np.int64)
        a, k = self.start[t], self.start[t + 1] - self.start[t]
        total = int(k.sum())
        at = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(total)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill_windows(n: np.ndarray, index: Bm25, window: int = WINDOW, step: int = STEP) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of one shard."""
    used = np.zeros(len(n), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq, nxt, rest = 0, 0, None
    size = n.tolist()
    while True:
        if rest is None:
            while nxt < len(size) and used[nxt]:
                nxt += 1
            if nxt == len(size):
                return pieces
            seed, start = nxt, 0
            used[seed] = True
        else:
            seed, start = rest
            rest = None
        while size[seed] - start >= window:  # start is a multiple of step, and so is window
            pieces.append((seed, start, window, seq, 0))
            seq, start = seq + 1, start + window
        filled = size[seed] - start
        if not filled:
            continue
        pieces.append((seed, start, filled, seq, 0))
        order = None
        while window - filled >= step and not used.all():
            if order is None:
                score = index.scores(seed)
                score[used] = -1
                order = iter(np.argsort(-score, kind="stable").tolist())
            doc = next(d for d in order if not used[d])
            used[doc] = True
            room = window - filled
            take = size[doc] if size[doc] <= room else room // step * step
            pieces.append((doc, 0, take, seq, filled))
            filled += take
            if take < size[doc]:
                rest = (doc, take)
                break
        seq += 1


def pack(tokens: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece. tokens: as tokenised() gives, written."""
    sigs = written(tokens.groupBy("sig").agg(F.count("*").alias("k")), "op9-sigs")  # so that Spark can split the join for a hot signature
    whole = corpus(tokens)
    shards = max(1, -(-whole[0] // shard_docs))
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / (shard_docs // 4)))
    dealt = tokens.join(sigs, "sig").withColumn("shard", F.pmod(F.xxhash64("sig", salt), F.lit(shards))).drop("k")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("sig", "ascending"), ("doc_id", "ascending")])
        terms = [np.frombuffer(x, "<u2") for x in t.column("terms").to_pylist()]
        n = t.column("n").to_numpy()
        index = Bm25(terms, [np.frombuffer(c, "<u4") for c in t.column("counts").to_pylist()], n, whole)
        got = np.array(fill_windows(n, index), np.int64)
        doc, start, length, seq, offset = got.T
        crcs = [np.frombuffer(c, "<u4") for c in t.column("crcs").to_pylist()]
        upto = np.concatenate(crcs).astype(np.int64)
        base = np.cumsum([0, *map(len, crcs)])[:-1]
        end = start + length
        head = np.where(start > 0, upto[base[doc] + np.maximum(start // STEP - 1, 0)], 0)
        tail = upto[base[doc] + -(-end // STEP) - 1]
        return pa.table({
            "doc_id": t.column("doc_id").combine_chunks().take(pa.array(doc)), "start": start, "length": length, "ids_crc32": piece_crcs(head, tail, 4 * length),
            "doc_tokens": n[doc], "sequence_id": key[0].as_py() << 32 | seq, "offset": offset,
        })

    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(written(tokenised(docs), "op9-tokens"))


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
