"""Approximate nearest neighbours by inner product: one vantage-point tree per shard of the rows.

A tree needs distances, so each vector gets one more component that brings all vectors of a shard to
the same length; the nearest in that space are those of the largest inner product. A node keeps a
vantage point and, for both halves of its rows, the smallest and largest distance to it. By the
triangle inequality a half whose rows are farther from the query than the k-th best found can be
skipped. ``factor`` below one skips it already when it is beyond that share of the k-th distance;
factor one skips nothing that counts, so the search is exact.

Queries go through a tree in batches: a node asks one matrix product for all queries that reach it.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS = 16_384
QUERY_ROWS = 8_192
LEAF_ROWS = 256
FACTOR = 0.9
#: Candidates kept beyond k during a search: the query's own row, and rounding between near ties.
SLACK = 8


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vec`` (array of double) of the rows that take part; rows without an id do not."""
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    lists = column.combine_chunks()
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


class Tree:
    """Distinct vectors of a shard, ordered so that every node holds a run of them."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        points, inverse = np.unique(points[order], axis=0, return_inverse=True)
        ids, inverse = ids[order], inverse.reshape(-1)
        # of equal vectors, only the k + 1 smallest ids can be among anyone's k nearest
        by_vector = np.argsort(inverse, kind="stable")
        ids, inverse = ids[by_vector], inverse[by_vector]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (inverse[1:] != inverse[:-1])
        ids, inverse = ids[fresh], inverse[fresh]
        place = np.arange(len(ids)) - np.searchsorted(inverse, inverse)
        ids, inverse = ids[place <= k], inverse[place <= k]
        self.k = k
        squares = np.einsum("ij,ij->i", points, points)
        self.reach = float(squares.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.reach - squares, 0.0))
        self.order = np.arange(len(points))
        self.points = points
        nodes: list[list[float]] = []
        self._grow(nodes, 0, len(points), leaf_rows, np.random.default_rng(len(points)))
        self.nodes = np.array(nodes, np.float64).reshape(len(nodes), -1)
        first = np.searchsorted(inverse, np.arange(len(points) + 1))
        count = np.diff(first)[self.order]
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.ids = ids[np.arange(self.first[-1]) + np.repeat(first[:-1][self.order] - self.first[:-1], count)] if len(ids) else ids
        self.points, self.lift = points[self.order], self.lift[self.order]

    def _grow(self, nodes: list, low: int, high: int, leaf_rows: int, rng: np.random.Generator) -> int:
        """Nodes as rows ``low, high, vantage point, near child, far child, near least, near most, far least, far most``."""
        number = len(nodes)
        nodes.append([low, high, -1, -1, -1, 0, 0, 0, 0])
        if high - low <= leaf_rows:
            return number
        here = self.order[low:high]
        vantage = here[rng.integers(len(here))]
        gap = self.points[here] @ self.points[vantage] + self.lift[here] * self.lift[vantage]
        away = np.sqrt(np.maximum(2 * self.reach - 2 * gap, 0.0))
        by_distance = np.argsort(away, kind="stable")
        half = (high - low) // 2
        self.order[low:high] = here[by_distance]
        away = away[by_distance]
        near = self._grow(nodes, low, low + half, leaf_rows, rng)
        far = self._grow(nodes, low + half, high, leaf_rows, rng)
        nodes[number] = [low, high, vantage, near, far, away[0], away[half - 1], away[half], away[-1]]
        return number

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        nodes = self.nodes.copy()
        inner = nodes[:, 2] >= 0
        nodes[inner, 2] = place[nodes[inner, 2].astype(np.int64)]
        np.savez(file, points=self.points, ids=self.ids, first=self.first, nodes=nodes, head=np.array([self.reach, self.k]))
        return file.getvalue()


class Search:
    """A stored tree, and the queries that go through it."""

    def __init__(self, stored: bytes):
        held = np.load(io.BytesIO(stored))
        self.points, self.ids, self.first, self.nodes = held["points"], held["ids"], held["first"], held["nodes"]
        self.reach, self.k = float(held["head"][0]), int(held["head"][1])

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, id, score`` rows with the ``k`` best ids of this tree per query, the query's own id left out."""
        if k > self.k:
            raise ValueError(f"the index holds enough equal vectors for k = {self.k}")
        width = min(k + 1 + SLACK, len(self.points))
        self.queries, self.factor, self.width = queries, factor, width
        self.squares = np.einsum("ij,ij->i", queries, queries) + self.reach
        self.score = np.full((len(queries), width), -np.inf)
        self.row = np.full((len(queries), width), -1, np.int64)
        self._visit(0, np.arange(len(queries)))
        n_query, n_id, n_score = [], [], []
        for q in range(len(queries)):
            rows = self.row[q][self.row[q] >= 0]
            exact = np.einsum("ij,j->i", self.points[rows], queries[q])
            sizes = self.first[rows + 1] - self.first[rows]
            ids = self.ids[np.repeat(self.first[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            score = np.repeat(exact, sizes)
            other = ids != query_ids[q]
            ids, score = ids[other], score[other]
            best = np.lexsort((ids, -score))[:k]
            n_query.append(np.full(len(best), query_ids[q]))
            n_id.append(ids[best])
            n_score.append(score[best])
        return np.concatenate(n_query), np.concatenate(n_id), np.concatenate(n_score)

    def _visit(self, number: int, who: np.ndarray) -> None:
        if len(who) == 0:
            return
        low, high, vantage, near, far = self.nodes[number, :5].astype(np.int64)
        if vantage < 0:
            score = self.queries[who] @ self.points[low:high].T
            better = np.flatnonzero(score.max(axis=1) >= self.score[who, -1])
            if len(better):
                who, score = who[better], score[better]
                scores = np.concatenate([self.score[who], score], axis=1)
                rows = np.concatenate([self.row[who], np.broadcast_to(np.arange(low, high), score.shape)], axis=1)
                pick = np.argpartition(-scores, self.width - 1, axis=1)[:, : self.width]
                least = np.take_along_axis(scores, pick, 1).min(axis=1)
                tied = np.flatnonzero((scores >= least[:, None]).sum(axis=1) > self.width)
                if len(tied):  # of equal scores, the vectors with the smallest ids stay
                    smallest = np.where(rows[tied] >= 0, self.ids[self.first[np.maximum(rows[tied], 0)]], np.iinfo(np.int64).max)
                    pick[tied] = np.lexsort((smallest, -scores[tied]), axis=1)[:, : self.width]
                scores, rows = np.take_along_axis(scores, pick, 1), np.take_along_axis(rows, pick, 1)
                order = np.argsort(-scores, axis=1, kind="stable")
                self.score[who], self.row[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)
            return
        away = np.sqrt(np.maximum(self.squares[who] - 2 * (self.queries[who] @ self.points[vantage]), 0.0))
        near_least, near_most, far_least, far_most = self.nodes[number, 5:]
        to_near = np.maximum(np.maximum(away - near_most, near_least - away), 0.0)
        to_far = np.maximum(np.maximum(away - far_most, far_least - away), 0.0)
        near_first = to_near <= to_far
        for side, first, bound in ((near, near_first, to_near), (far, ~near_first, to_far), (far, near_first, to_far), (near, ~near_first, to_near)):
            self._visit(side, who[first & (bound <= self._limit(who))])

    def _limit(self, who: np.ndarray) -> np.ndarray:
        """Distance beyond which a half is skipped; a shade more than needed, for rounding."""
        kth = self.score[who, -1]
        left = np.where(np.isfinite(kth), self.squares[who] - 2 * np.where(np.isfinite(kth), kth, 0), np.inf)
        return self.factor * np.sqrt(np.maximum(left, 0.0)) * (1 + 1e-9) + 1e-9


def index(df: DataFrame, k: int, shard_rows: int = SHARD_ROWS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``dim, shard, tree``: every usable row is in the tree of one shard of about ``shard_rows`` rows.

    Vectors of different lengths are never compared; each length has its own trees.
    """
    rows = vectors(df, id_column, vector_column).dropDuplicates(["vec_id", "vec"])
    shards = max(1, math.ceil(rows.count() / shard_rows))

    def build(part: pa.Table) -> pa.Table:
        ids, points = np.asarray(part["vec_id"]), matrix(part["vec"])
        return pa.table({"dim": pa.array([points.shape[1]], pa.int32()), "shard": part["shard"][:1].combine_chunks(),
                         "tree": pa.array([Tree(ids, points, k).to_bytes()], pa.binary())})

    return (rows.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
            .groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"))


def search(trees: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR, query_rows: int = QUERY_ROWS,
           id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, ties to the smaller id.

    Queries are cut into blocks; each tree meets each block once, in a task of bounded size. A
    query that is not usable has no rows, nor has one without any candidate. A candidate with the
    query's id is the query's own row. Equal rows count once.
    """
    rows = vectors(queries, id_column, vector_column).dropDuplicates(["vec_id", "vec"])
    blocks = max(1, math.ceil(rows.count() / query_rows))
    places = trees.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    asked = (rows.withColumn("dim", F.size("vec")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .join(places, "dim"))
    tables = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]

    def run(tree: pa.Table, block: pa.Table) -> pa.Table:
        if tree.num_rows == 0 or block.num_rows == 0:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = Search(tree["tree"][0].as_py()).nearest(np.asarray(block["vec_id"]), matrix(block["vec"]), k, factor)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    found = tables.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, every: int, k: int, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
               id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Searches all rows of ``df`` for the rows whose id is divisible by ``every``."""
    trees = written(df.sparkSession, index(df, k, shard_rows, id_column, vector_column), "vp-trees")
    return search(trees, df.where(F.col(id_column) % every == 0), k, factor, id_column=id_column, vector_column=vector_column)
