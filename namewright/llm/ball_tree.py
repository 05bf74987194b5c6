"""Exact top-k inner-product search: a ball tree a shard, branch and bound, the current k-th score shared.

Shards are balls too: vectors are dealt to the nearest of a bounded number of pivots, and cells beyond the size of a shard are
split by id. Queries go to shards in waves: to their own, then to those with the largest upper bounds, then to all others
whose bound reaches the k-th score that the waves before have found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Vectors a shard, vectors a leaf, queries searched together.
SHARD, LEAF, BLOCK = 50_000, 256, 512
#: Pivots at most; shards that a query visits in the second wave.
PIVOTS, FIRST = 4096, 8


def _slack(up: np.ndarray, norm: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """More than rounding can take away from an upper bound."""
    return 1e-9 * (1 + np.abs(up) + norm * reach)


class BallTree:
    """Vectors (integers as float64) in balls; ids rise within a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self.nodes: list[tuple] = []
        if len(ids):
            self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        v = self.vectors[rows]
        center = v.mean(0)
        far = np.sqrt(((v - center) ** 2).sum(1))
        at = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= self.leaf or not far.max():
            rows = rows[np.argsort(self.ids[rows], kind="stable")]
            self.nodes[at] = (center, far.max(), rows, None, None)
            return at
        a = v[far.argmax()]
        b = v[((v - a) ** 2).sum(1).argmax()]
        order = np.argsort(v @ (b - a), kind="stable")
        half = len(rows) // 2
        left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        self.nodes[at] = (center, far.max(), None, left, right)
        return at

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best among those of at least its score ``least``, ties to smaller ids."""
        self.q_ids, self.q, self.k = q_ids, queries, k
        self.norm = np.sqrt((queries**2).sum(1))
        self.kth = least.astype(np.float64).copy()
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if self.nodes:
            self._visit(0, np.arange(len(q_ids)))
        return self.found

    def _bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        """No score of a vector in the ball is larger; widened by more than rounding can take away."""
        center, radius = self.nodes[node][:2]
        up = self.q[rows] @ center + self.norm[rows] * radius
        return up + _slack(up, self.norm[rows], radius + np.abs(center).max(initial=0))

    def _visit(self, node: int, rows: np.ndarray) -> None:
        _, _, leaf, left, right = self.nodes[node]
        if leaf is not None:
            self._scan(leaf, rows)
            return
        bounds = {n: self._bound(n, rows) for n in (left, right)}
        for n in sorted(bounds, key=lambda n: -bounds[n].sum()):
            if len(still := rows[bounds[n] >= self.kth[rows]]):
                self._visit(n, still)

    def _scan(self, leaf: np.ndarray, rows: np.ndarray) -> None:
        for some in np.array_split(leaf, -(-len(leaf) // 4096)):
            scores = self.q[rows] @ self.vectors[some].T
            near = (scores >= self.kth[rows][:, None]) & (self.q_ids[rows][:, None] != self.ids[some][None, :])
            i, j = np.nonzero(near)
            if not len(i):
                continue
            touched = np.unique(rows[i])
            old = np.isin(self.found[0], touched)
            row, ids, s = (np.concatenate(x) for x in zip([x[old] for x in self.found], (rows[i], self.ids[some[j]], scores[i, j]), strict=True))
            order = np.lexsort((ids, -s, row))
            row, ids, s = row[order], ids[order], s[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == self.k - 1
            self.kth[row[last]] = np.maximum(self.kth[row[last]], s[last])
            best = place < self.k
            self.found = tuple(np.concatenate((x[~old], y[best])) for x, y in zip(self.found, (row, ids, s), strict=True))


def _vectors(rows: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, asks): components as floor(256 x); without nulls and vectors that hold null or non-finite components; an id once."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = F.col(id_col).isNotNull() & F.coalesce(F.forall(F.col(vector_col), lambda x: whole(x.cast("double"))), F.lit(False))
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    found = rows.filter(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    repeated = written(found.groupBy(F.col("id").alias("r_id")).count().filter("count > 1").select("r_id"), "repeated")
    if repeated.isEmpty():
        return found
    one = found.join(repeated, F.col("id") == F.col("r_id"), "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    return found.join(repeated, F.col("id") == F.col("r_id"), "left_anti").unionByName(one)


class Balls:
    """Pivots of each length of vectors; once cells are known, the balls around them and their shards."""

    def __init__(self, sample: list[list[float]]):
        by_dim: dict[int, set] = {}
        for v in sample:
            by_dim.setdefault(len(v), set()).add(tuple(v))
        self.pivots, self.cells = {}, 0
        for dim, found in sorted(by_dim.items()):
            m = np.array(sorted(found), np.float64).reshape(len(found), dim)
            self.pivots[dim] = self.cells, m, (m**2).sum(1)
            self.cells += len(m)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its pivot); vectors of a length that no pivot has are in one cell more, of unknown size."""
        if x.shape[1] not in self.pivots:
            return np.full(len(x), self.cells), np.full(len(x), np.inf)
        first, m, squares = self.pivots[x.shape[1]]
        d = squares[None, :] - 2 * x @ m.T
        own = d.argmin(1)
        return first + own, np.sqrt(np.maximum(d[np.arange(len(x)), own] + (x**2).sum(1), 0))

    def measure(self, cells: list[tuple[int, int, float]], shard_size: int) -> int:
        """Takes (cell, vectors, radius) in and numbers the shards; returns how many there are."""
        self.radius, self.splits = np.zeros(self.cells + 1), np.zeros(self.cells + 1, np.int64)
        for cell, n, radius in cells:
            self.radius[cell], self.splits[cell] = radius, -(-n // shard_size)
        self.first = np.cumsum(self.splits) - self.splits
        return int(self.splits.sum())

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shards, for each row of x and shard an upper bound of its scores there)."""
        if x.shape[1] in self.pivots:
            at, m, _ = self.pivots[x.shape[1]]
            of, norm = np.arange(at, at + len(m)), np.sqrt((x**2).sum(1))[:, None]
            up = x @ m.T + norm * self.radius[of]
            up += _slack(up, norm, self.radius[of] + np.abs(m).max(1, initial=0))
        else:
            of, up = np.array([self.cells]), np.full((len(x), 1), np.inf)
        shards = np.concatenate([np.arange(f, f + n) for f, n in zip(self.first[of], self.splits[of], strict=True)])
        return shards, np.repeat(up, self.splits[of], axis=1)


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Parts of rows of one length, of at most 128 rows each."""
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    return [(i, min(i + 128, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, b, 128)]


def _dealt(vectors: DataFrame, balls: Balls) -> DataFrame:
    """vectors (id, v, asks) with their cell and distance from its pivot."""

    def run(batches):
        for batch in batches:
            v, found = batch.column(1), []
            for a, b in _runs(pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)):
                found.append(balls.nearest(_matrix(v.slice(a, b - a))))
            if found:
                cell, far = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far.astype(np.float64))], ["id", "v", "asks", "cell", "far"])

    return vectors.select("id", "v", "asks").mapInArrow(run, "id long, v array<double>, asks boolean, cell int, far double")


def _routes(queries: DataFrame, balls: Balls, low: int, high: int | None) -> DataFrame:
    """(id, v, least, shard): queries (id, v, least, own) to those of the shards low to high, by falling bound, whose bound reaches ``least``."""

    def run(batches):
        for batch in batches:
            ids, v, least, own = batch.columns
            low_score, own_shard = least.to_numpy(zero_copy_only=False), own.to_numpy()
            for a, b in _runs(pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)):
                shards, up = balls.bounds(_matrix(v.slice(a, b - a)))
                order = np.argsort(-up, axis=1, kind="stable")[:, low:high]
                goes = (np.take_along_axis(up, order, 1) >= low_score[a:b, None]) & (shards[order] != own_shard[a:b, None])
                row, place = np.nonzero(goes)
                for i in range(0, len(row), 4096):
                    few, to = pa.array(a + row[i : i + 4096]), shards[order[row[i : i + 4096], place[i : i + 4096]]]
                    yield pa.RecordBatch.from_arrays([ids.take(few), v.take(few), least.take(few), pa.array(to.astype(np.int32))], ["id", "v", "least", "shard"])

    return queries.select("id", "v", "least", "own").mapInArrow(run, "id long, v array<double>, least double, shard int")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(queries: DataFrame, shards: DataFrame, k: int, n_shards: int) -> DataFrame:
    """Queries (id, v, least, shard) against vectors (id, v, shard): (query_id, vec_id, score), at most k of a query and shard.

    Each partition holds shards one after the other, the vectors of a shard before its queries, which pass by in blocks.
    """
    both = shards.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("least")).unionByName(queries.select("shard", F.lit(1).alias("kind"), "id", "v", "least"))
    both = both.withColumn("dim", F.size("v")).repartition(n_shards, "shard").sortWithinPartitions("shard", "dim", "kind", "id", "v")

    def run(batches):
        held_key, kept, tree = None, [], None
        for batch in batches:
            shard, kind, ids, v, least, dim = batch.columns
            key = shard.to_numpy().astype(np.int64) * (1 << 32) + dim.to_numpy()
            kinds, cuts = kind.to_numpy(), [0]
            cuts += (np.flatnonzero((np.diff(key) != 0) | (np.diff(kinds) != 0)) + 1).tolist() + [len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a] != held_key:
                    held_key, kept, tree = key[a], [], None
                part = ids.slice(a, b - a).to_numpy(), _matrix(v.slice(a, b - a))
                if kinds[a] == 0:
                    kept.append(part)
                    continue
                if tree is None:
                    own, m = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), part[1][:0])
                    own, first = np.unique(own, return_index=True)  # of repeated ids the first, in order of vectors
                    tree, kept = BallTree(own, m[first]), []
                low = least.slice(a, b - a).to_numpy(zero_copy_only=False)
                for at in range(0, b - a, BLOCK):
                    row, got, score = tree.search(part[0][at : at + BLOCK], part[1][at : at + BLOCK], k, low[at : at + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array(part[0][at : at + BLOCK][row]), pa.array(got), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def _bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """queries with ``least``: the k-th score found so far, minus infinity where fewer are."""
    kth = _best(found, k).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("s"))
    return queries.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("s", F.lit(float("-inf"))).alias("least"), "own")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products among all other rows, ties to smaller ids.

    Null ids and vectors that are null or hold null or non-finite components take no part; vectors of different length don't
    meet; of repeated ids the least vector counts; no queries, no rows. Scores are exact below 2**53. Cells of many vectors, such
    as copies of one, are split by id, and the queries among them with them, so that no task holds more than a shard.
    """
    spark = rows.sparkSession
    vectors = _vectors(rows, is_query, id_col, vector_col)
    n = max(-(-rows.count() // shard_size), 2 * spark.sparkContext.defaultParallelism)
    sample = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(min(n, PIVOTS)).collect()
    balls = Balls([r["v"] for r in sample])
    cells = written(_dealt(vectors, balls), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*"), F.max("far")).collect()  # PIVOTS + 1 rows at most
    n = max(balls.measure([tuple(r) for r in sizes], shard_size), 1)
    numbers = [(int(c), int(balls.first[c]), int(balls.splits[c])) for c, _, _ in sizes]
    numbered = F.broadcast(spark.createDataFrame(numbers, "n_cell int, first int, splits int"))
    shard = F.col("first") + F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")
    dealt = cells.join(numbered, F.col("cell") == F.col("n_cell")).select("id", "v", "asks", shard.alias("shard"))
    shards = dealt.select("id", "v", "shard")
    queries = written(dealt.filter("asks").select("id", "v", F.lit(float("-inf")).alias("least"), F.col("shard").alias("own")), "queries")
    found = written(_search(queries.withColumn("shard", F.col("own")), shards, k, n), "found")
    for low, high in ((0, FIRST), (FIRST, None)):
        routes = _routes(_bounded(queries, found, k), balls, low, high)
        found = found.unionByName(written(_search(routes, shards, k, n), "found"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
