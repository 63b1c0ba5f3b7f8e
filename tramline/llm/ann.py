"""Approximate nearest neighbours: a forest of random-projection trees.

A top tree, built on the driver from at most ``SAMPLE`` vectors (those with the
smallest hash), deals every row to a shard of about ``SHARD`` rows.  Each shard
has a forest of its own: a tree splits its rows at the median of a projection
on the difference of two of its rows, down to leaves of at most ``LEAF`` rows.
A query searches all trees of a shard through one priority queue, ordered by
the largest margin on the way, and ranks what it sees by the exact inner
product in double precision.  A margin is a distance that all rows beyond it
have at least, so it bounds their inner products: the search ends when the
bound falls below the k-th best, or when ``SEARCH`` of the shard's rows have
been seen.

Queries ask the shard that the top tree deals them to, then those whose bound
can still beat the k-th best found there, nearest first, up to the share
``SHARDS`` of all rows.  Clustered vectors are settled in few shards; random
ones, which no bound tells apart, need nearly all.  A shard's rows come to one
task once, and its queries follow in a stream.

Rows with one vector are one entry of the index that carries its k + 1
smallest ids, which is all that any query can return of them; queries with
one vector are searched once.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null vec_id; vectors whose length
is not the commonest one (ties: the longer) take no part; of repeated rows
(vec_id and vector alike) one counts; a query returns all candidates where
there are fewer than k; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, load, partitions, trimmed

K = 20
SHARD = 4096
#: Vectors that the top tree is built from at most.
SAMPLE = 16_384
TREES = 4
LEAF = 64
#: Share of all rows whose shards a query may ask, and of a shard's rows that it looks at, at most; the recall of random vectors follows them, that of clustered ones is higher.
SHARDS, SEARCH = 0.95, 0.85
#: Rows seen that are scored together.
AT_ONCE = 256
#: What rounding may take from a bound.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score double"


class Forest:
    """Trees over the rows of a matrix."""

    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 1):
        self.x, rng = x, np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.splits: list[tuple[float, int, int]] = []  # offset, left and right node; a leaf is -1 - its number
        self.leaves: list[np.ndarray] = []
        self.roots = [self._grow(np.arange(len(x)), leaf, rng) for _ in range(trees if len(x) else 0)]
        self.matrix = np.array(self.normals).reshape(len(self.normals), x.shape[1] if x.ndim == 2 else 0)

    def _grow(self, rows: np.ndarray, leaf: int, rng) -> int:
        if len(rows) <= leaf:
            self.leaves.append(rows)
            return -len(self.leaves)
        a, b = rng.choice(len(rows), 2, replace=False)
        normal = self.x[rows[a]] - self.x[rows[b]]
        size = np.linalg.norm(normal)
        normal = normal if size > 0 else rng.standard_normal(len(normal))
        normal = normal / np.linalg.norm(normal)
        along = self.x[rows] @ normal
        order = np.argsort(along, kind="stable")  # halves by rank, so equal projections cannot make a deep tree
        half = len(rows) // 2
        offset = float(along[order[half - 1]] + along[order[half]]) / 2
        node = len(self.splits)
        self.splits.append((offset, 0, 0))
        self.normals.append(normal)
        left, right = self._grow(rows[order[:half]], leaf, rng), self._grow(rows[order[half:]], leaf, rng)
        self.splits[node] = (offset, left, right)
        return node

    def search(self, margins: np.ndarray, wanted: int) -> np.ndarray:
        """Rows in the leaves reached first, at least wanted of them; margins: the query's projection on every node."""
        seen, n = np.zeros(len(self.x), bool), 0
        queue = [(-np.inf, r) for r in self.roots]
        heapq.heapify(queue)
        while queue and n < wanted:
            key, node = heapq.heappop(queue)
            while node >= 0:  # down to a leaf, the other sides wait in the queue
                offset, left, right = self.splits[node]
                m = margins[node] - offset
                near, far = (left, right) if m < 0 else (right, left)
                heapq.heappush(queue, (max(key, abs(m)), far))
                node = near
            rows = self.leaves[-node - 1]
            n += int((~seen[rows]).sum())
            seen[rows] = True
        return np.flatnonzero(seen)


    def find(self, q: np.ndarray, margins: np.ndarray, k: int, wanted: int, floor: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact inner products of the k best of those seen, ties included.

        floor: an inner product that k rows elsewhere reach; reach: half the sum of
        the squared lengths of the query and the longest row, from which half a
        squared margin is taken for the bound.
        """
        seen, n, kth = np.zeros(len(self.x), bool), 0, floor
        rows, scores, best = [], [], np.zeros(0)
        waiting: list[np.ndarray] = []

        def rank() -> None:
            """Score the rows that wait, many leaves at a time."""
            nonlocal best, kth, waiting
            if not waiting:
                return
            fresh, waiting = np.concatenate(waiting), []
            score = exact(self.x[fresh], q)
            rows.append(fresh)
            scores.append(score)
            best = np.concatenate([best, score])
            if len(best) > k:
                best = np.partition(best, len(best) - k)[-k:]
            if len(best) == k:
                kth = max(kth, float(best.min()))

        queue, held = [(-np.inf, r) for r in self.roots], 0
        heapq.heapify(queue)
        while queue and n < wanted:
            key, node = heapq.heappop(queue)
            if key > 0 and reach - key * key / 2 < kth - SLACK:
                break
            while node >= 0:
                offset, left, right = self.splits[node]
                m = margins[node] - offset
                near, far = (left, right) if m < 0 else (right, left)
                heapq.heappush(queue, (max(key, abs(m)), far))
                node = near
            fresh = self.leaves[-node - 1]
            fresh = fresh[~seen[fresh]]
            if not len(fresh):
                continue
            seen[fresh] = True
            n += len(fresh)
            held += len(fresh)
            waiting.append(fresh)
            if held >= AT_ONCE:
                rank()
                held = 0
        rank()
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0)
        at, score = np.concatenate(rows), np.concatenate(scores)
        keep = score >= (best.min() if len(best) == k else -np.inf)  # ties at the end stay: ids decide
        return at[keep], score[keep]


def nearest(forest: Forest, queries: np.ndarray, k: int, search: float, floors: np.ndarray, longest: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (rows of the forest, exact inner products), the k best of those found."""
    wanted = int(np.ceil(search * len(forest.x)))
    margins = queries @ forest.matrix.T
    reach = ((queries * queries).sum(1) + longest * longest) / 2
    return [forest.find(q, m, k, wanted, f, r) for q, m, f, r in zip(queries, margins, floors.tolist(), reach.tolist(), strict=True)]


class TopTree:
    """Shards as the leaves of one tree over a sample of all vectors."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.forest = Forest(sample, 1, max(1, -(-len(sample) // shards)), 2) if shards > 1 and len(sample) > shards else None
        self.shards = len(self.forest.leaves) if self.forest else 1
        self.share = np.array([len(x) for x in self.forest.leaves]) / len(sample) if self.forest else np.ones(1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The shard of each row."""
        if not self.forest:
            return np.zeros(len(x), np.int64)
        along = x @ self.forest.matrix.T
        node = np.full(len(x), self.forest.roots[0])
        while (at := np.flatnonzero(node >= 0)).size:
            for v in np.unique(node[at]).tolist():
                rows = at[node[at] == v]
                offset, left, right = self.forest.splits[v]
                node[rows] = np.where(along[rows, v] - offset < 0, left, right)
        return -node - 1

    def others(self, q: np.ndarray, kth: float, reach: float, most: float) -> list[int]:
        """Shards beside the query's own that can hold a better row, nearest first, up to a share of all rows."""
        out, share = [], 0.0
        along = self.forest.matrix @ q if self.forest else np.zeros(0)
        queue = [(0.0, self.forest.roots[0])] if self.forest else []
        while queue and share < most:
            key, node = heapq.heappop(queue)
            if key > 0 and reach - key * key / 2 < kth - SLACK:
                break
            while node >= 0:
                offset, left, right = self.forest.splits[node]
                m = along[node] - offset
                near, far = (left, right) if m < 0 else (right, left)
                heapq.heappush(queue, (max(key, abs(m)), far))
                node = near
            out.append(-node - 1)
            share += self.share[-node - 1]
        return out[1:]


def exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each by the same order of additions wherever it is computed."""
    return np.einsum("ij,j->i", rows, q, optimize=False)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part, of the commonest length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (length[0].n if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _answers(index: DataFrame, asked: DataFrame, k: int, trees: int, leaf: int, search: float, longest: float, p: int) -> DataFrame:
    """q, vec_id, score: the k best that each query (shard, q, v, floor) finds in the shard it asks.

    A partition's rows come sorted by shard, its own rows before the queries;
    a task holds the forest of one shard and one batch of queries.
    """
    own = index.select("shard", F.lit(0).alias("kind"), "ids", F.lit(None).cast("long").alias("q"), "v", F.lit(None).cast("double").alias("floor"))
    ask = asked.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("ids"), "q", "v", "floor")
    both = own.unionByName(ask).repartition(p, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, ids, forest = None, [], [], None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])) if len(shard) else np.zeros(0, int)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True):
                some = batch.slice(a, b - a)
                if shard[a] != held:
                    held, parts, ids, forest = shard[a], [], [], None
                if kind[a] == 0:
                    parts.append(_matrix(some.column("v")))
                    ids += some.column("ids").to_pylist()
                    continue
                if not ids:
                    continue
                forest = forest or Forest(np.concatenate(parts), trees, leaf)
                out: tuple[list, list, list] = ([], [], [])
                floors = some.column("floor").to_numpy(zero_copy_only=False)
                for q, (at, score) in zip(some.column("q").to_pylist(), nearest(forest, _matrix(some.column("v")), k, search, floors, longest), strict=True):
                    best = sorted((-s, i) for r, s in zip(at.tolist(), score.tolist(), strict=True) for i in ids[r])[:k]
                    out[0].extend([q] * len(best))
                    out[1].extend(i for _, i in best)
                    out[2].extend(-s for s, _ in best)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["q", "vec_id", "score"])

    return both.mapInArrow(trimmed(run), "q long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, is_query, k: int = K, shard: int = SHARD, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, search: float = SEARCH, shards: float = SHARDS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the condition is_query (of vec_id) holds, its k nearest others."""
    spark = vectors.sparkSession
    work, p = Workspace(spark, "ann"), partitions(spark)
    rows = usable(vectors).withColumn("h", F.xxhash64("v"))
    ranked = rows.dropDuplicates(["vec_id", "h"]).withColumn("nth", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    entries = work.store(ranked.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = rows.where(is_query).select("vec_id", "h", "v").distinct()
    askers = work.store(asked, "askers")
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    longest = float(size.longest or 0.0)
    drawn = entries.select("v").orderBy("h").limit(sample).collect() if size.n > shard else []
    tree = TopTree(np.array([r.v for r in drawn], float), max(1, -(-size.n // shard)))
    sent = spark.sparkContext.broadcast(tree)  # as many nodes as there are shards, and the sample

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.home(_matrix(batch.column("v"))), pa.int64()), batch.column("ids"), batch.column("v")], ["shard", "ids", "v"])

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, floors = _matrix(batch.column("v")), batch.column("floor").to_numpy(zero_copy_only=False)
            reach = ((x * x).sum(1) + longest * longest) / 2
            to = [sent.value.others(v, f, r, shards) for v, f, r in zip(x, floors.tolist(), reach.tolist(), strict=True)]
            at = np.repeat(np.arange(len(to)), [len(t) for t in to])
            some = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array([s for t in to for s in t], pa.int64()), *(some.column(c) for c in ("q", "v", "floor"))], ["shard", "q", "v", "floor"])

    index = work.store(entries.select("ids", "v").mapInArrow(dealt, "shard long, ids array<bigint>, v array<double>"), "index")
    once = askers.groupBy("h", "v").agg(F.min("vec_id").alias("q"))
    once = work.store(once, "queries")
    begin = once.select(F.array("q").alias("ids"), "v").mapInArrow(dealt, "shard long, ids array<bigint>, v array<double>")
    begin = begin.select("shard", F.col("ids")[0].alias("q"), "v", F.lit(float("-inf")).alias("floor"))
    found = work.store(_answers(index, begin, k + 1, trees, leaf, search, longest, p), "home")
    if tree.shards > 1:
        full = found.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
        next_ = once.join(full, "q").select("q", "v", "floor").mapInArrow(away, "shard long, q long, v array<double>, floor double")
        found = found.unionByName(work.store(_answers(index, next_, k + 1, trees, leaf, search, longest, p), "away"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    top = work.store(top, "top")
    work.keep_only(askers, once, top)
    # back to each query of the vector: its own row goes, the rest is ranked anew
    again = askers.select(F.col("vec_id").alias("query_id"), "h", "v").join(once, ["h", "v"]).select("query_id", "q")
    mine = again.join(top, "q").where("query_id != vec_id").select("query_id", "vec_id", "score")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with vec_id divisible by 20, against all: query_id, rank, vec_id, score."""
    return nearest_neighbours(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)
