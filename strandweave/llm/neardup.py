"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

Sketch. One hash of each shingle fills BINS bins with their minimum; an empty bin takes the value of
the first full bin in its own fixed random order of probes. BANDS bands of ROWS bins are the buckets.
Two sets at similarity 0.8 miss every bucket with probability (1 - 0.8**6)**42 < 3e-6.

Copies. Documents with the same shingle set are one class, with the smallest doc_id as representative;
only representatives are sketched further, so groups of copies of any size cost one row each.

Edges. Every bucket links its members to its smallest member only: a star, never all pairs. Each
candidate is confirmed on both full sets, recomputed from the whole texts. A star can leave members of
a bucket unlinked; buckets that still hold more than one component therefore compare their members of
different components once more, by size and by whole signature (five standard deviations below the
threshold), in blocks of bounded size, and what is left is confirmed on full sets too. Of buckets with more
members than a block only those that share a rare shingle are compared (an exact prefix filter). So links that
the star missed are found, while groups of near copies, however large, are done after the star.

Scale. Bucket and class keys are joined and aggregated, not windowed, so that Spark can split hot ones.
Steps are written to the shared folder. Nothing is collected but counts.

Null texts and texts without words have the empty set, are linked with nothing and are kept. Repeated
rows with one doc_id stay as many rows; where their texts differ, they are one document with all of these
texts: it is linked through any of them and has one component_id. Rows without a doc_id are compared with nothing
and kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.common import documents, slices, whole_groups, written
from strandweave.llm.components import components
from strandweave.llm.shingles import mix, shingle_sets, similar

BINS, ROWS = 252, 6
BANDS = BINS // ROWS
PROBES = 2048
BLOCK, PAIR_ROWS = 2048, 20_000


def probe_order() -> np.ndarray:
    """For each bin the bins that it asks for a value when empty: random, alike for every document."""
    k = np.arange(BINS * PROBES, dtype=np.uint64).reshape(BINS, PROBES)
    return (mix(k + np.uint64(0x51ED270B)) % np.uint64(BINS)).astype(np.int64)


def sketch(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty set of hashes."""
    m = mix(s)  # bins by a second mix, so that they do not depend on the sort order of the set
    bins = (m % np.uint64(BINS)).astype(np.int64)
    sig = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(sig, bins, m)
    full = np.zeros(BINS, bool)
    full[bins] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        donors = np.flatnonzero(full)
        hit = full[order[empty]]
        at = hit.argmax(axis=1)
        src = np.where(hit[np.arange(len(empty)), at], order[empty, at], donors[0])
        sig[empty] = sig[src]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h + rows[:, j] * np.uint64(2 * j + 3))
    return h.view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set; null: empty), buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probe_order()
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            flat = [bands(sketch(s, order)) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, flat)]).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), buckets], names=["doc_id", "n_shingles", "key", "buckets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, buckets array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "ta"), "tb"):
            one = b.column("ta").dictionary_encode()
            left = shingle_sets(one.dictionary, words)
            ok = [similar(left[i], y, percent) for i, y in zip(one.indices.to_pylist(), shingle_sets(b.column("tb"), words), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def signatures(texts: DataFrame, words: int) -> DataFrame:
    """rep, n, keys (its buckets, a band each), sig (the low byte of every bin), small (the low half of every shingle's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probe_order()
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), words)
            bins = [sketch(s, order) for s in sets]
            keys, sigs, small = [bands(x).tobytes() for x in bins], [x.astype(np.uint8).tobytes() for x in bins], [s.astype(np.uint32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, sigs, small))], names=["rep", "n", "keys", "sig", "small"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, n long, keys binary, sig binary, small binary")


def numbered(small: np.ndarray) -> np.ndarray:
    """Halved hashes with the number of their repeat above: two such sets share each value as often as both have it."""
    s = np.sort(small).astype(np.uint64)
    at = np.arange(len(s), dtype=np.uint64)
    return s + (at - at[np.searchsorted(s, s)] << np.uint64(32))


def least_matches(n: np.ndarray, percent: int) -> np.ndarray:
    """Equal bins that sets of n shingles and more have at the threshold, less five standard deviations."""
    j = percent / 100
    return BINS * (j - 5 * np.sqrt(j * (1 - j) / np.minimum(n, BINS)))


def redealt(hot: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Hot buckets dealt anew by rare shingles: bucket, band, rep, label, m, as `hot`, which has more members in each bucket.

    Two sets at the threshold share one of the n - ceil(n * percent / 100) + 1 shingles of each that are rarest
    in the bucket (the prefix filter), so nothing is lost; a passage that many unlike documents
    share is frequent there and brings none of them together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = shingle_sets(b.column("text"), words)
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["rep", "size", "hashes"])

    sets = texts.join(hot.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "rep long, size long, hashes array<long>")
    each = written(hot.join(sets, "rep").select("bucket", "rep", "label", "size", F.xxhash64("hashes").alias("text"), F.explode("hashes").alias("hash")), "op10-shingles")
    often = written(each.groupBy("bucket", "hash").agg(F.count("*").alias("often")), "op10-often")  # so that Spark can split hot shingles
    rank = F.row_number().over(Window.partitionBy("bucket", "rep", "text").orderBy("often", "hash"))
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rare = each.join(often.where("often > 1").select("bucket", "hash", "often"), ["bucket", "hash"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    rare = rare.withColumn("rank", rank).where((F.col("rank") <= prefix) & (F.col("often") > 1))
    dealt = written(rare.select(F.xxhash64("bucket", "hash").alias("bucket"), F.lit(-1).alias("band"), "rep", "label").distinct(), "op10-redealt")
    open_ = dealt.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x < y").select("bucket", "m")
    return dealt.join(written(open_, "op10-redealt-open"), "bucket")


def likely_pairs(left: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of one bucket and two components that can be similar.

    A bucket of more than BLOCK members is dealt anew by rare shingles. Members of a bucket are then dealt into
    blocks of about BLOCK; a task compares two blocks. A pair is looked
    at in the first bucket that it shares only, by size, by signature, and last by the halved hashes of both
    sets, whose intersection is never smaller than the true one; so what leaves is next to nothing but links.
    """
    hot = left.where(F.col("m") > BLOCK)
    if not hot.isEmpty():
        left = left.where(F.col("m") <= BLOCK).select("bucket", "band", "rep", "label", "m").unionByName(redealt(hot, texts, words, percent))
    sigs = signatures(texts.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), words)
    blocks = F.ceil(F.col("m") / BLOCK)
    rows = left.select("bucket", "band", "rep", "label", "m").join(sigs, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    rows = rows.select(F.xxhash64("bucket", "lo", "hi").alias("group"), "band", "lo", "hi", "block", "rep", "n", "label", "keys", "sig", "small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group", PAIR_ROWS):
            g, band, lo, hi, block, rep, n, label = (t.column(c).to_numpy() for c in ("group", "band", "lo", "hi", "block", "rep", "n", "label"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, BINS)
            keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
            small = t.column("small")
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            a, b = [], []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if (label[s:e] == label[s]).all():
                    continue
                sets: dict[int, frozenset] = {}

                def hashes(i: int, sets: dict = sets) -> frozenset:
                    if i not in sets:
                        sets[i] = frozenset(numbered(np.frombuffer(small[i].as_py(), np.uint32)).tolist())
                    return sets[i]

                one, two = (np.arange(s, e),) * 2 if lo[s] == hi[s] else (np.flatnonzero(block[s:e] == lo[s]) + s, np.flatnonzero(block[s:e] == hi[s]) + s)
                step = max(1, (1 << 20) // max(1, len(two)))
                for i in range(0, len(one), step):
                    x = one[i : i + step]
                    ok = (label[x][:, None] != label[two]) & (100 * np.minimum(n[x][:, None], n[two]) >= percent * np.maximum(n[x][:, None], n[two]))
                    if lo[s] == hi[s]:
                        ok &= rep[x][:, None] < rep[two]
                    r, c = np.nonzero(ok)
                    for k in range(0, len(r), 1 << 14):
                        p, q = x[r[k : k + (1 << 14)]], two[c[k : k + (1 << 14)]]
                        same = sig[p] == sig[q]
                        first = (keys[p] == keys[q]).argmax(axis=1)
                        good = ((first == band[s]) | (band[s] < 0)) & (same.sum(axis=1) >= least_matches(np.minimum(n[p], n[q]), percent))
                        for u, v in zip(p[good].tolist(), q[good].tolist(), strict=True):
                            both = len(hashes(u) & hashes(v))
                            if 100 * both >= percent * (n[u] + n[v] - both):
                                a.append(rep[u])
                                b.append(rep[v])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    found = written(sketches(docs, words), "op10-sketch")
    unnamed, found = found.where("doc_id IS NULL"), found.where("doc_id IS NOT NULL")
    size = F.col("n_shingles")
    reps = written(
        found.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "buckets")).alias("r"))
        .select("key", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.buckets").alias("buckets")),
        "op10-classes",
    )
    named = found.where("key IS NOT NULL").select("doc_id", "key").distinct()
    several = written(found.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "op10-several")
    of = written(named.join(several, "doc_id").join(reps.select("key", "rep"), "key").select("doc_id", "rep").distinct(), "op10-of")
    tied = of.groupBy("doc_id").agg(F.min("rep").alias("a")).join(of, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()  # the classes of one document's texts
    members = reps.select("rep", "n", F.posexplode("buckets").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1").select("bucket", "centre")
    # Written first, so that both sides of the join are plain exchanges and Spark can split a hot bucket.
    shared = written(members.join(written(shared, "op10-centres"), "bucket"), "op10-buckets")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    star = shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"), "n").distinct()
    sizes = reps.select(F.col("rep").alias("a"), F.col("n").alias("m"))
    star = star.join(sizes, "a").where(fits).select("a", "b")
    nodes = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "op10-texts")
    links = written(confirmed(star, texts, words, percent).unionByName(tied), "op10-links")
    labels = components(links)
    named = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", "n", F.coalesce("label", "rep").alias("label"))
    open_ = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x < y").select("bucket", "m")
    left = written(named.join(open_, "bucket"), "op10-open")
    likely = written(likely_pairs(left, texts, words, percent), "op10-likely")
    labels = components(written(links.unionByName(confirmed(likely, texts, words, percent)), "op10-links"))
    classes = reps.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("label", "rep").alias("component_id"))
    full = found.where("key IS NOT NULL").select("doc_id", "n_shingles", "key").join(classes, "key").select("doc_id", "n_shingles", "component_id")
    own = of.join(labels.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("with_words"))
    none = found.where("key IS NULL").select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("with_words", "doc_id").alias("component_id"))
    every = full.unionByName(none).unionByName(unnamed.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", size.alias("n_shingles"), "component_id", "kept")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2)
