"""Exact top-k by inner product: a ball tree per shard, branch and bound by inner-product bound.

For a ball with centre c and radius r no point scores above q.c + |q| r. Vectors are dealt into at most
MOST_CELLS cells by hyperplanes, which are fitted on a bounded sample (SAMPLE_PER_CELL vectors a cell), and a cell into
shards of about SHARD_VECTORS; every vector lies in one shard. A shard is one ball tree, grown once and stored as one
row. A query visits cells in waves by falling bound: the best one first, the next few, then the others, each time only cells
whose bound reaches its current k-th score, which is shared by all shards of the next wave. In a tree, leaves are visited by falling bound
and everything whose bound is below the current k-th score is skipped. Pruning keeps ties
(bound >= k-th score), so results are exact, ties to the smaller vec_id.

Scale. The driver holds the hyperplanes and one ball a cell (MOST_CELLS at any size) and the sample. A task
holds one tree and at most PART_QUERIES queries; a shard that more queries visit is copied for each such part. Vectors move
once to grow the trees and trees once a wave, however many queries there are; rows are never joined pairwise.

Vectors null, or with null or non-finite components, take no part. Vectors of unlike lengths are
compared as if padded with zeros. Rows that share a vec_id are candidates each, but never of a query
with that id. With fewer than k candidates all are returned. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.common import written
from strandweave.llm.shingles import mix

SHARD_VECTORS, LEAF = 8192, 128
MOST_CELLS, SAMPLE_PER_CELL = 1024, 20
PART_QUERIES = 1 << 16
WAVES = ((0, 1), (1, 4), (4, MOST_CELLS))
NONE = np.iinfo(np.int64).min


def apart(points: np.ndarray) -> np.ndarray | None:
    """Direction between two far points; None if all are one."""
    off = points - points.mean(axis=0)
    far = np.einsum("ij,ij->i", off, off)
    if not far.max() > 0:
        return None
    a = points[int(far.argmax())]
    return a - points[int(((points - a) ** 2).sum(axis=1).argmax())]


def wider(bound: np.ndarray, norm: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """A bound made a hair wider than exact, for rounding."""
    return bound + 1e-9 * (np.abs(bound) + norm[:, None] * (1 + radius[None, :])) + 1e-6


class Cells:
    """Hyperplanes that halve a sample `depth` times, and the mean of each cell's part."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.normal, self.cut = np.zeros((2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
        parts = [sample]
        for level in range(depth):
            halves = []
            for k, part in enumerate(parts):
                at = 2**level - 1 + k
                way = apart(part) if len(part) > 1 else None
                if way is not None:
                    self.normal[at] = way
                    self.cut[at] = np.median(part @ way)
                right = part @ self.normal[at] > self.cut[at]
                halves += [part[~right], part[right]]
            parts = halves
        self.centre = np.array([p.mean(axis=0) if len(p) else np.zeros(sample.shape[1]) for p in parts])

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normal[node]) > self.cut[node])
        return node - (2**self.depth - 1)


class BallTree:
    """Balanced ball tree over integer points; nodes are (start, end, left, right; -1: a leaf), parents before children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        nodes: list[tuple[int, int, int, int]] = []
        centre, radius = [], []
        p = points.astype(np.float64)

        def grow(start: int, end: int) -> int:
            own = p[order[start:end]]
            k = len(nodes)
            nodes.append((start, end, -1, -1))
            centre.append(own.mean(axis=0))
            radius.append(float(np.sqrt(((own - centre[-1]) ** 2).sum(axis=1).max())))
            way = apart(own) if end - start > leaf else None
            if way is not None:
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own @ way, half)]
                nodes[k] = (start, end, grow(start, start + half), grow(start + half, end))
            return k

        grow(0, len(points))
        self.ids, self.points = ids[order], points[order]
        self.nodes, self.centre, self.radius = np.array(nodes, np.int64), np.array(centre), np.array(radius)

    def stored(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k)).tobytes() for k in TREE}

    @classmethod
    def read(cls, row: dict[str, bytes], width: int) -> BallTree:
        t = cls.__new__(cls)
        for k, (kind, wide) in TREE.items():
            setattr(t, k, np.frombuffer(row[k], kind).reshape(-1, *([width if wide < 0 else wide] if wide else [])))
        return t

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of every (query, node)."""
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))
        return wider(q @ self.centre.T + norm[:, None] * self.radius[None, :], norm, self.radius)


TREE = {"ids": (np.int64, 0), "points": (np.int64, -1), "nodes": (np.int64, 4), "centre": (np.float64, -1), "radius": (np.float64, 0)}


def exact_dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by float64 where no partial sum can pass 2**53, else by integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def top_k(tree: BallTree, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best here among scores >= floor; floor is a proven k-th score."""
    none, ids = NONE, tree.ids
    best_s, best_i = np.full((len(q), k), none), np.full((len(q), k), np.iinfo(np.int64).max)
    kth = floor.copy()
    ub = tree.bounds(q.astype(np.float64))
    live = np.zeros(ub.shape, dtype=bool)
    live[:, 0] = ub[:, 0] >= kth
    leaves = []
    for n, (_, _, left, right) in enumerate(tree.nodes.tolist()):  # a parent comes before its children
        if left < 0:
            leaves.append(n)
        else:
            for child in (left, right):
                live[:, child] = live[:, n] & (ub[:, child] >= kth)
    leaves = np.array(leaves)
    bound = np.where(live[:, leaves], ub[:, leaves], -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    rows = np.arange(len(q))
    for step in range(len(leaves)):
        pick = order[rows, step]
        rows_live = bound[rows, pick] >= kth[rows]
        rows_live &= np.isfinite(bound[rows, pick])
        rows, pick = rows[rows_live], pick[rows_live]
        if not len(rows):
            break
        by = np.argsort(pick, kind="stable")
        cut = np.flatnonzero(np.diff(pick[by])) + 1
        for group in np.split(by, cut):
            start, end, _, _ = tree.nodes[leaves[pick[group[0]]]]
            own, at = slice(start, end), rows[group]
            s = exact_dots(q[at], tree.points[own])
            s[ids[own][None, :] == qid[at][:, None]] = none
            all_s = np.concatenate([best_s[at], s], axis=1)
            all_i = np.concatenate([best_i[at], np.broadcast_to(ids[own], s.shape)], axis=1)
            keep = np.lexsort((all_i, -all_s.astype(np.float64), ), axis=1) if abs(all_s[all_s != none]).max(initial=0) < 2**53 else np.array([sorted(range(all_s.shape[1]), key=lambda j, r=r: (-int(all_s[r, j]), int(all_i[r, j]))) for r in range(len(at))])
            keep = keep[:, :k]
            best_s[at], best_i[at] = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_i, keep, 1)
            kth[at] = np.maximum(kth[at], best_s[at][:, -1])
    ok = (best_s != none) & (best_s >= floor[:, None])
    r, c = np.nonzero(ok)
    return r, best_i[r, c], best_s[r, c]


def matrix(column, width: int) -> np.ndarray:
    """A list column as rows of integers, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = np.asarray(column.flatten())
    return out


def grown(vectors: DataFrame, cells: Cells, shards: np.ndarray, width: int) -> DataFrame:
    """shard, cell, reach (farthest point from the cell's centre) and the stored tree of every shard."""
    first = np.cumsum(shards) - shards

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every partition begins at a shard of its own, so that many small partitions fill all shards alike.
        seen = (mix((TaskContext.get().partitionId() * len(shards) + np.arange(len(shards))).astype(np.uint64)) % shards.astype(np.uint64)).astype(np.int64)
        for b in batches:
            c = cells.of(matrix(b.column("v"), width).astype(np.float64))
            order = np.argsort(c, kind="stable")
            rank = np.empty(len(c), np.int64)
            rank[order] = np.arange(len(c)) - np.searchsorted(c[order], c[order])
            yield pa.RecordBatch.from_arrays([pa.array(first[c] + (seen[c] + rank) % shards[c]), pa.array(c), b.column("vec_id"), b.column("v")], names=["shard", "cell", "vec_id", "v"])
            seen += np.bincount(c, minlength=len(shards))

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        points, cell = matrix(t.column("v"), width), t.column("cell")[0].as_py()
        tree = BallTree(t.column("vec_id").to_numpy(), points)
        reach = float(np.sqrt(((points - cells.centre[cell]) ** 2).sum(axis=1).max()))
        return pa.table({"shard": [key[0].as_py()], "cell": [cell], "reach": [reach], **{k: pa.array([v], pa.binary()) for k, v in tree.stored().items()}})

    dealt = vectors.mapInArrow(deal, "shard long, cell long, vec_id long, v array<long>")
    return dealt.groupBy("shard").applyInArrow(grow, "shard long, cell long, reach double, " + ", ".join(f"{k} binary" for k in TREE))


def routed(queries: DataFrame, cells: Cells, radius: np.ndarray, shards: np.ndarray, width: int, ranks: tuple[int, int]) -> DataFrame:
    """query_id, qv, floor, shard: each query with every shard of the cells of those ranks (by falling bound) whose bound reaches its floor."""
    first = np.cumsum(shards) - shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                q = matrix(part.column("qv"), width).astype(np.float64)
                norm = np.sqrt(np.einsum("ij,ij->i", q, q))
                bound = wider(q @ cells.centre.T + norm[:, None] * np.maximum(radius, 0)[None, :], norm, np.maximum(radius, 0))
                bound[:, radius < 0] = -np.inf  # cells without vectors
                order = np.argsort(-bound, axis=1, kind="stable")[:, ranks[0] : ranks[1]]
                floor = part.column("floor").fill_null(NONE).to_numpy(zero_copy_only=False)
                row, at = np.nonzero(np.take_along_axis(bound, order, 1) >= np.where(floor == NONE, -np.finfo(float).max, floor)[:, None])
                cell = order[row, at]
                n = shards[cell]
                of = np.repeat(np.arange(len(cell)), n)
                shard = first[cell][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                for j in range(0, len(of), 1 << 16):
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(row[of[j : j + (1 << 16)]])).columns, pa.array(shard[j : j + (1 << 16)])], names=["query_id", "qv", "floor", "shard"])

    return queries.select("query_id", "qv", "floor").mapInArrow(run, "query_id long, qv array<long>, floor long, shard long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_vectors: int = SHARD_VECTORS, part_queries: int = PART_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row of `queries` over `vectors`.

    vectors: vec_id, v array<bigint>; queries: query_id, v.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.where("v IS NOT NULL").select("vec_id", "v"), "op8-vectors")
    queries = written(queries.where("v IS NOT NULL").select("query_id", F.col("v").alias("qv")), "op8-queries")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 0, queries.agg(F.max(F.size("qv"))).first()[0] or 0)
    depth = min(MOST_CELLS, -(-n // shard_vectors) or 1).bit_length() - 1
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_PER_CELL << depth).toArrow()
    cells = Cells(matrix(sample.column("v"), width).astype(np.float64) if n else np.zeros((1, width)), depth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2**depth, np.int64)
        for b in batches:
            out += np.bincount(cells.of(matrix(b.column("v"), width).astype(np.float64)), minlength=len(out))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["cell", "n"])

    rows = np.zeros(2**depth, np.int64)
    for r in vectors.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # a row a cell
        rows[r[0]] = r[1]
    shards = -(-rows // shard_vectors)
    trees = written(grown(vectors, cells, shards, width), "op8-trees")
    radius = np.full(2**depth, -1.0)
    for r in trees.groupBy("cell").agg(F.max("reach")).collect():
        radius[r[0]] = r[1]

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            tree = BallTree.read({c: left.column(c)[0].as_py() for c in TREE}, width)
            qid = right.column("query_id").to_numpy()
            r, i, s = top_k(tree, qid, matrix(right.column("qv"), width), right.column("floor").fill_null(NONE).to_numpy(), k)
            return pa.table({"query_id": qid[r], "vec_id": i, "score": s})
        return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    best = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    known = queries.withColumn("floor", F.lit(None).cast("long"))
    for wave, ranks in enumerate(WAVES[: 1 if depth == 0 else 2 if depth <= 2 else 3]):
        work = written(routed(known, cells, radius, shards, width, ranks), "op8-routed")
        parts = written(work.groupBy("shard").agg(F.ceil(F.count("*") / part_queries).alias("parts")), "op8-parts")
        work = work.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
        copies = trees.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        found = copies.select("shard", "part", *TREE).groupBy("shard", "part").cogroup(work.select("shard", "part", "query_id", "qv", "floor").groupBy("shard", "part")).applyInArrow(visit, "query_id long, vec_id long, score long")
        every = best.drop("rank").unionByName(found)
        best = written(every.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k), f"op8-best-{wave}")
        floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        known = queries.join(floors, "query_id", "left")
    return best.select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 x) of every component; rows that take no part are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: bad(x.cast("double")))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")
    )


def op8_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(v, v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "v"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
