"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network,
probabilities calibrated by temperature.

Words are runs of letters, of digits and of other signs, as written. Every word hashes to one of BUCKETS
buckets; each bucket has a fixed sparse random index vector, and its word vector is the sum of the index
vectors of all words that stand within REACH places of it anywhere in the corpus. Sums are integers, so
the vectors do not depend on the order of work. A document is the mean and the spread of its words'
normalised vectors, the mean cosine of words one and two apart, the share of those that are equal (local repetition),
and the log of its number of words. The network is fitted on a bounded sample of labelled rows whose crc32(doc_id) mod 5
is not 0 (at most `most_labelled`, those with the smallest hash); part of that sample sets the temperature.

Scale. Vectors come from all documents: each task sends at most BUCKETS rows of DIMS sums, which are
added by bucket. The table has a fixed size (BUCKETS x DIMS, 2 MB) at any corpus size and is what tasks
and driver hold. Texts are read for the vectors, for the sample and for the scores; none is shuffled.

doc_id, lang, source and labels are no inputs of a score. Null and empty texts pool to zeros and get
the network's score for that. Without usable labels of both kinds every score is the share of label 1
(0.5 if there are none). Repeated label rows of a document count once, by their largest value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import byte_buffer, documents, slices
from strandweave.llm.shingles import mix

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 2, 2
MOST_LABELLED = 5000
HIDDEN = 32

KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    KIND[_a:_b] = 1
KIND[0x30:0x3A] = 2


def word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of the batch in order, and the index of each text's first word."""
    kind = KIND[data]
    begin = kind > 0
    begin[1:] &= kind[1:] != kind[:-1]
    edge = off[:-1][np.diff(off) > 0]
    begin[edge] = kind[edge] > 0
    at = np.flatnonzero(begin)
    first = np.searchsorted(at, off)
    if not len(at):
        return np.zeros(0, np.int64), first
    place = np.flatnonzero(kind)
    start = np.searchsorted(place, at)
    n = np.diff(np.append(start, len(place)))
    within = (np.arange(len(place)) - np.repeat(start, n)).astype(np.uint64)
    h = np.add.reduceat(mix(data[place].astype(np.uint64) + (within + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), start)
    return (mix(h) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of each bucket's index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0xABCD)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def context_sums(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS integer sums of context index vectors over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        acc = np.zeros(BUCKETS * DIMS)
        for b in slices(batches, "text", 1 << 20):
            w, first = word_buckets(*byte_buffer(b.column("text")))
            text = np.repeat(np.arange(b.num_rows), np.diff(first))
            for k in range(1, REACH + 1):
                same = text[k:] == text[:-k]
                left, right = w[:-k][same], w[k:][same]
                for x, y in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        acc += np.bincount(x * DIMS + place[y, j], weights=sign[y, j], minlength=BUCKETS * DIMS)
        rows = acc.reshape(BUCKETS, DIMS).astype(np.int64)
        used = np.flatnonzero(rows.any(axis=1))
        ends = pa.array((np.arange(len(used) + 1) * DIMS).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(rows[used].ravel()))], names=["bucket", "sums"])

    parts = docs.select("text").mapInArrow(run, "bucket int, sums array<long>")
    total = parts.groupBy("bucket").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIMS)])
    out = np.zeros((BUCKETS, DIMS), np.int64)
    for r in total.collect():  # BUCKETS rows at most
        out[r[0]] = r[1:]
    return out


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    v = np.sign(sums) * np.log1p(np.abs(sums))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """Of each text's word vectors: mean, standard deviation, mean cosine and share of equals one and two words on, and the log of their number; zeros for a text without words."""
    w, first = word_buckets(*byte_buffer(column))
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIMS + 5))
    full = np.flatnonzero(n)
    if len(full):
        v = vectors[w]
        mean = np.add.reduceat(v, first[:-1][full], axis=0, dtype=np.float64) / n[full, None]
        square = np.add.reduceat(v * v, first[:-1][full], axis=0, dtype=np.float64) / n[full, None]
        near = []
        text = np.repeat(np.arange(len(n)), n)
        for k in (1, 2):
            c = np.einsum("ij,ij->i", v[:-k], v[k:]) * (text[k:] == text[:-k]) if len(v) > k else np.zeros(0)
            near += [np.bincount(text[: len(c)], weights=x, minlength=len(n))[full] / n[full] for x in (c, c > 0.999)]
        out[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.array(near).T, np.log1p(n[full])[:, None]])
    return out


class Network:
    """One tanh layer and a logistic output, fitted by Adam on all rows at once; a fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, steps: int = 500, rate: float = 0.02, decay: float = 1e-3):
        rng = np.random.default_rng(11)
        fit = ~calibrate if calibrate.any() and len(set(y[~calibrate])) == 2 else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z, t = (x[fit] - self.mean) / self.scale, y[fit].astype(np.float64)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        for step in range(1, steps + 1):
            h = np.tanh(z @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(t)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grad = [z.T @ dh + decay * p[0] / len(t) ** 0.5, dh.sum(axis=0), h.T @ d + decay * p[2] / len(t) ** 0.5, np.array([d.sum()])]
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        self.temperature = 1.0
        if calibrate.any():
            logit, t = self.logits(x[calibrate]), y[calibrate]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, np.where(t == 1, -logit, logit) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def fold(doc_id) -> F.col:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most_labelled: int = MOST_LABELLED) -> Network | Constant:
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y")).withColumn("fold", fold("doc_id")).where("fold <> 0")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            x = pooled(b.column("text"), vectors)
            ends = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("fold"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "y", "fold", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("y", F.col("y").cast("int")).withColumn("fold", F.col("fold").cast("int"))
    # Of several texts under one id the one with the smallest hash is learned from, in every run.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "y", "fold")).alias("r")).select("doc_id", "r.y", "r.fold", "r.text")
    got = sorted(rows.mapInArrow(run, "doc_id long, y int, fold int, x array<double>").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], int)
    if len(set(y)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    return Network(np.array([r["x"] for r in got]), y, np.array([r["fold"] == 1 for r in got]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = MOST_LABELLED, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """The rows of `docs` with score and predicted added; columns of those names that `docs` has are replaced."""
    docs = docs.drop(score_name, predicted_name)
    vectors = unit_vectors(context_sums(docs))
    model = fit(docs, labels, vectors, most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            s = model.scores(pooled(b.column("text"), vectors))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, score_name, predicted_name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{score_name}` double, `{predicted_name}` int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, labels)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
