"""Hard negatives by exact search in inverted multi-indexes.

Rows are dealt to sampled pivots by nearness, and a pivot with many rows is cut into pieces of at most about
``SHARD_ROWS``. Every piece has an index of its own: both halves of the vectors have a codebook, and
the rows lie in cells, one for each pair of codes. A row's score with an anchor is at most the sum of two half
scores, each that of a code plus the anchor's half length times the code's radius. A heap walks the sorted
half scores of both codebooks and gives cells by falling bound. The walk stops when every window
is certified: its last wanted score lies above the bound of all cells to come, or the bound below the window.

The same bound over a pivot's radius tells which pieces an anchor must see at all. It first sees the
pivot that looks best, and then only those that can still hold better rows than it has.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, none_of, written

SHARD_ROWS = 8_192
QUERY_ROWS = 2_048
#: Codes of each half; a piece has their square of cells.
CODES = 16
#: Rows that the codebooks of a piece are fitted to, and rounds of fitting. All rows are put into cells.
FIT_ROWS, FIT_ROUNDS = 4_096, 4
#: Rows whose vectors may become pivots, at any size of the table: those of the smallest hashes.
PIVOTS = 2_048
#: Rows scored at a time on a walk.
STEP_ROWS = 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1

INDEX = "dim int, pivot int, piece int, cells binary"
FOUND = "anchor_key long, window int, vec_id long, score long"


# ---------------------------------------------------------------- rows

def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``vec_id, label, dim, q`` of the rows that take part, once each, with components as whole numbers and every seventh id's label shifted."""
    vector = F.col(vector_column).cast("array<double>")
    rows = (df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), vector.alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("vec", lambda x: F.floor(x * 256).cast("long"))
    return rows.select("vec_id", label.alias("label"), F.size("vec").alias("dim"), whole.alias("q")).distinct()


def candidates(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows with equal vectors and labels, the ``keep`` smallest ids: no list of ``keep - 1`` can hold another."""
    equal = Window.partitionBy(F.xxhash64("q"), "q", "label").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= keep).drop("_n")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype=np.int64).reshape(len(lists), dim)


def lengths(points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", points, points))


# ---------------------------------------------------------------- one piece

def codebook(points: np.ndarray, codes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code vectors, the code of every row, and the largest distance of a row from its code."""
    sample = points[rng.permutation(len(points))[:FIT_ROWS]]
    centers = sample[: min(codes, len(sample))].copy()

    def nearest(some: np.ndarray) -> np.ndarray:
        return np.argmin(np.einsum("ij,ij->i", centers, centers) - 2 * some @ centers.T, axis=1)

    for _ in range(FIT_ROUNDS):
        code = nearest(sample)
        for c in np.unique(code):
            centers[c] = sample[code == c].mean(axis=0)
    code = nearest(points)
    radius = np.zeros(len(centers))
    np.maximum.at(radius, code, lengths(points - centers[code]))
    return centers, code, radius


class Cells:
    """Rows of a piece in the order of their cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, codes: int = CODES):
        rng = np.random.default_rng(len(ids))
        points, half = q.astype(np.float64), q.shape[1] // 2
        (self.first, code_1, self.radius_1), (self.second, code_2, self.radius_2) = (codebook(p, codes, rng) for p in (points[:, :half], points[:, half:]))
        cell = code_1 * len(self.second) + code_2
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.q = ids[order], labels[order], q[order]
        self.start = np.searchsorted(cell[order], np.arange(len(self.first) * len(self.second) + 1))

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, **vars(self))
        return file.getvalue()

    @classmethod
    def from_bytes(cls, stored: bytes) -> Cells:
        cells = cls.__new__(cls)
        vars(cells).update(np.load(io.BytesIO(stored)))
        return cells


class Walk(NamedTuple):
    """What an anchor found: ``window, id, score`` rows, and how many rows were scored."""

    window: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    seen: int


class Search:
    """An index, ready for anchors."""

    def __init__(self, cells: Cells):
        self.cells = cells
        self.points = cells.q.astype(np.float64)
        self.longest = float(lengths(self.points).max(initial=0.0))

    def scores(self, rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
        """Whole-number inner products; beyond what a double holds exactly with Python's numbers, cut to the range of a long."""
        if exact:
            return (self.points[rows] @ anchor.astype(np.float64)).astype(np.int64)
        found = self.cells.q[rows].astype(object) @ anchor.astype(object) if len(anchor) else np.zeros(len(rows), object)
        return np.array([min(max(x, LEAST), MOST) for x in found], np.int64)

    def walk(self, anchor_id: int, label: int, anchor: np.ndarray, same: bool, low: list[int], high: list[int], k: int) -> Walk:
        """The ``k`` best rows of each window ``low <= score <= high``, ties to smaller ids.

        Rows have the anchor's label (``same``) or another one; rows with the anchor's id are left out.
        """
        cells, half = self.cells, len(anchor) // 2
        point = anchor.astype(np.float64)
        reach_1, reach_2 = (math.sqrt(part @ part) for part in (point[:half], point[half:]))
        exact = self.longest * math.hypot(reach_1, reach_2) < 2.0 ** 52
        middle_1, middle_2 = cells.first @ point[:half], cells.second @ point[half:]
        most_1, most_2 = middle_1 + reach_1 * cells.radius_1, middle_2 + reach_2 * cells.radius_2
        least_1, least_2 = middle_1 - reach_1 * cells.radius_1, middle_2 - reach_2 * cells.radius_2
        by_1, by_2 = np.argsort(-most_1).tolist(), np.argsort(-most_2).tolist()
        most_1, most_2, least_1, least_2 = (x.tolist() for x in (most_1, most_2, least_1, least_2))
        width, start = len(cells.second), cells.start
        heap = [(-(most_1[by_1[0]] + most_2[by_2[0]]), 0, 0)]
        open_windows = [w for w in range(len(low)) if low[w] <= high[w]]
        held_scores, held_ids, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while heap and open_windows:
            ranges, gathered = [], 0
            top = max(_open(high[w]) for w in open_windows)
            while heap and gathered < STEP_ROWS:
                _, i, j = heapq.heappop(heap)
                if j + 1 < len(by_2):
                    heapq.heappush(heap, (-(most_1[by_1[i]] + most_2[by_2[j + 1]]), i, j + 1))
                if j == 0 and i + 1 < len(by_1):
                    heapq.heappush(heap, (-(most_1[by_1[i + 1]] + most_2[by_2[0]]), i + 1, 0))
                cell = by_1[i] * width + by_2[j]
                floor = least_1[by_1[i]] + least_2[by_2[j]]
                if start[cell] < start[cell + 1] and floor - _slack(floor) <= top:
                    ranges.append(np.arange(start[cell], start[cell + 1]))
                    gathered += len(ranges[-1])
            if ranges:
                rows = np.concatenate(ranges)
                seen += len(rows)
                rows = rows[((cells.labels[rows] == label) == same) & (cells.ids[rows] != anchor_id)]
                held_scores = np.concatenate([held_scores, self.scores(rows, anchor, exact)])
                held_ids = np.concatenate([held_ids, cells.ids[rows]])
            bound = -heap[0][0] if heap else -math.inf
            bound += _slack(bound)
            open_windows = [w for w in open_windows if bound >= _open(low[w]) and bound >= _kth(held_scores, low[w], high[w], k)]
        window, ids, scores = [], [], []
        for w in range(len(low)):
            inside = np.flatnonzero((held_scores >= low[w]) & (held_scores <= high[w]))
            best = inside[np.lexsort((held_ids[inside], -held_scores[inside]))[:k]]
            window.append(np.full(len(best), w, np.int32))
            ids.append(held_ids[best])
            scores.append(held_scores[best])
        return Walk(np.concatenate(window), np.concatenate(ids), np.concatenate(scores), seen)


def _slack(bound: float) -> float:
    """More than a bound's rounding error."""
    return 1e-6 * (1 + abs(bound)) if math.isfinite(bound) else 0.0


def _open(limit: int) -> float:
    """The ends of a long stand for all scores beyond them."""
    return -math.inf if limit == LEAST else math.inf if limit == MOST else limit


def _kth(scores: np.ndarray, low: int, high: int, k: int) -> float:
    """The ``k``-th best score of a window; below every score if it has fewer."""
    inside = scores[(scores >= low) & (scores <= high)]
    return float(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else -math.inf


# ---------------------------------------------------------------- index over all rows

class Pivots:
    """Sampled vectors by dimension; rows and anchors are compared with those of their own."""

    def __init__(self, sample: list):
        self.points: dict[int, np.ndarray] = {}
        for dim in {len(q) for q in sample}:
            self.points[dim] = np.unique(np.array([q for q in sample if len(q) == dim], np.float64).reshape(-1, dim), axis=0)
        self.radius: dict[tuple[int, int], float] = {}
        self.pieces: dict[tuple[int, int], int] = {}

    def nearest(self, dim: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and distance of each row's pivot; number -1 where the dimension has none."""
        pivots = self.points.get(dim)
        if pivots is None:
            return np.full(len(points), -1), np.zeros(len(points))
        number = np.argmin(np.einsum("ij,ij->i", pivots, pivots) - 2 * points @ pivots.T, axis=1)
        return number, lengths(points - pivots[number])

    def reach(self, dim: int, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the pivots that have rows, and the least and greatest score that their rows can have."""
        numbers = np.array(sorted(p for d, p in self.pieces if d == dim), np.int64)
        if dim not in self.points:
            return numbers, np.full(len(numbers), -math.inf), np.full(len(numbers), math.inf)
        middle = self.points[dim][numbers] @ anchor
        spread = math.sqrt(anchor @ anchor) * np.array([self.radius[dim, p] for p in numbers.tolist()])
        spread = spread + 1e-6 * (1 + np.abs(middle) + spread)
        return numbers, middle - spread, middle + spread


def per_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``dim, row numbers, vectors`` for each dimension of a batch with columns ``dim, q``."""
    dims = np.asarray(batch.column(batch.schema.get_field_index("dim")))
    lists = batch.column(batch.schema.get_field_index("q"))
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, matrix(lists.take(pa.array(rows)), dim)


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> tuple[DataFrame, Pivots]:
    """A table with the cells of every piece, and the pivots that lead to them. All rows are indexed.

    The pivots are a bounded sample (at most ``pivots`` vectors, fewer for small tables); radii and numbers of
    pieces come from all rows, one row a pivot reaches the driver.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    wanted = min(pivots, math.ceil(rows.count() / shard_rows))
    sample = rows.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(wanted).collect() if wanted > 1 else []
    held = Pivots([r["q"] for r in sample])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, some, points in per_dimension(batch):
                number[some], away[some] = held.nearest(dim, points.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(away)], names=[*batch.schema.names, "pivot", "away"])

    placed = written(spark, rows.select("vec_id", "label", "dim", "q").mapInArrow(place, "vec_id long, label long, dim int, q array<long>, pivot int, away double"), "placed")
    for r in placed.groupBy("dim", "pivot").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        held.radius[r["dim"], r["pivot"]] = r["radius"]
        held.pieces[r["dim"], r["pivot"]] = math.ceil(r["n"] / shard_rows)
    many = {k: n for k, n in held.pieces.items() if n > 1}
    pieces = F.lit(1)
    if many:
        table = F.create_map(*[F.lit(x) for (dim, pivot), n in many.items() for x in (f"{dim} {pivot}", n)])
        pieces = F.coalesce(F.try_element_at(table, F.concat_ws(" ", "dim", "pivot")), F.lit(1))

    def build(part: pa.Table) -> pa.Table:
        q = matrix(part["q"], part["dim"][0].as_py())
        cells = Cells(np.asarray(part["vec_id"]), np.asarray(part["label"]), q)
        return pa.table([part["dim"][:1], part["pivot"][:1], part["piece"][:1], pa.array([cells.to_bytes()], pa.binary())], names=["dim", "pivot", "piece", "cells"])

    cells = (placed.drop("away").withColumn("piece", F.pmod(F.xxhash64("vec_id", "q"), pieces).cast("int"))
             .groupBy("dim", "pivot", "piece").applyInArrow(build, INDEX))
    return written(spark, cells, "multi-index"), held


# ---------------------------------------------------------------- search

ANCHORS = "anchor_key long, anchor_id long, label long, dim int, q array<long>, low array<long>, high array<long>"


def routed(anchors: DataFrame, pivots: Pivots, first: bool) -> DataFrame:
    """Anchors once per piece they must see: those of the pivot that looks best (``first``), or those of the others.

    ``need`` is what a row of each window must reach to count; a pivot is left out where none of its rows can.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needs, lows, highs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("need", "low", "high"))
            take, number, piece = [], [], []
            for dim, some, points in per_dimension(batch):
                for row, anchor in zip(some.tolist(), points.astype(np.float64)):
                    numbers, least, most = pivots.reach(dim, anchor)
                    windows = [(_open(max(n, l)), _open(h)) for n, l, h in zip(needs[row], lows[row], highs[row]) if l <= h]
                    if not windows or not len(numbers):
                        continue
                    # where the middle score is nearest to the highest one wanted
                    aim = max(h for _, h in windows)
                    with np.errstate(invalid="ignore"):  # pivots without bounds
                        middle = np.nan_to_num((least + most) / 2)
                        best = int(np.argmax(middle) if math.isinf(aim) else np.argmin(np.abs(middle - aim)))
                    can = np.zeros(len(numbers), bool)
                    for n, h in windows:
                        can |= (most >= n) & (least <= h)
                    can = can & ((np.arange(len(numbers)) == best) == first)
                    for p in numbers[can].tolist():
                        for x in range(pivots.pieces[dim, p]):
                            take.append(row)
                            number.append(p)
                            piece.append(x)
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(number, pa.int32()), pa.array(piece, pa.int32())], names=[*batch.schema.names, "pivot", "piece"])

    return anchors.mapInArrow(run, f"{ANCHORS}, need array<long>, pivot int, piece int")


def asked(routes: DataFrame, cells: DataFrame, same: bool, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``FOUND`` rows of every routed anchor from its piece. A piece with many anchors is sent to several blocks of them."""
    routes = written(routes.sparkSession, routes, "routes")
    blocks = routes.groupBy("dim", "pivot", "piece").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
    keys = ["dim", "pivot", "piece"]
    left = routes.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("anchor_key"), "blocks").cast("int")).drop("blocks")
    right = cells.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    nothing = none_of(FOUND)

    def run(some: pa.Table, piece: pa.Table) -> pa.Table:
        if some.num_rows == 0 or piece.num_rows == 0:
            return nothing
        search = Search(Cells.from_bytes(piece["cells"][0].as_py()))
        vectors = matrix(some["q"], some["dim"][0].as_py())
        key, out = np.asarray(some["anchor_key"]), []
        columns = (some[c].to_pylist() for c in ("anchor_id", "label", "low", "high", "need"))
        for row, (number, label, low, high, need) in enumerate(zip(*columns)):
            found = search.walk(number, label, vectors[row], same, [max(a, b) for a, b in zip(low, need)], high, k)
            out.append((np.full(len(found.ids), key[row]), *found[:3]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=nothing.schema)

    keys = [*keys, "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)


def find(anchors: DataFrame, cells: DataFrame, pivots: Pivots, same: bool, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``FOUND`` with ``rank``: the exact ``k`` best rows of every anchor and window."""
    spark = anchors.sparkSession
    best = Window.partitionBy("anchor_key", "window").orderBy(F.desc("score"), "vec_id")
    start = anchors.withColumn("need", F.col("low"))
    some = written(spark, asked(routed(start, pivots, True), cells, same, k, query_rows), "found")
    top = some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # a window that is full already needs nothing below its last score
    full = (top.groupBy("anchor_key", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            .groupBy("anchor_key").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("full")))
    known = F.transform("low", lambda l, w: F.coalesce(F.try_element_at(F.col("full"), w.cast("int")), l))
    rest = anchors.join(full, "anchor_key", "left").withColumn("need", known).drop("full")
    more = asked(routed(rest, pivots, False), cells, same, k, query_rows)
    return some.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90,
         shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
         id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``, for each of their ``positives`` best rows of the same label.

    Negatives have another label and a score of ``least_percent`` to ``most_percent`` of the positive's. Rows
    without an id, label or vector, or with a null or non-finite component, take no part. Equal rows
    count once. Rows with the anchor's id are its own, rows of other dimensions are never compared. An anchor
    without positives, and a positive without negatives in its window, has no rows.
    """
    spark = df.sparkSession
    rows = written(spark, whole_vectors(df, id_column, vector_column, label_column), "whole-vectors")
    cells, pivots = index(candidates(rows, max(positives, negatives) + 1), shard_rows)
    anchors = (rows.where(F.col("vec_id") % every == 0)
               .select(F.xxhash64("vec_id", "label", "q").alias("anchor_key"), F.col("vec_id").alias("anchor_id"), "label", "dim", "q"))
    everything = anchors.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    same = written(spark, find(everything, cells, pivots, True, positives, query_rows), "positives")
    listed = same.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("list"))

    # of whole numbers that a long holds: in decimals, where the products fit
    share = lambda p, percent: p["score"].cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    wanted = written(spark, anchors.join(listed, "anchor_key").select(
        *anchors.columns, F.transform("list", lambda p: F.ceil(share(p, least_percent)).cast("long")).alias("low"),
        F.transform("list", lambda p: F.floor(share(p, most_percent)).cast("long")).alias("high"), "list"), "windows")
    found = find(wanted.drop("list"), cells, pivots, False, negatives, query_rows)
    of = F.get(F.col("list"), F.col("window"))
    return (found.join(wanted.select("anchor_key", "anchor_id", "list"), "anchor_key")
            .select("anchor_id", of["id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                    of["score"].alias("positive_score"), F.col("score").alias("negative_score")))
