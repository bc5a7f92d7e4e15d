"""Scores of user-item pairs, and the best items of every user without forming all pairs.

The ranking cuts items into blocks of bounded size, and users into blocks. Items are ordered by what they can reach with
a user of average length: their bias, weighted as the average user weighs it, plus their length times that user's. A task gets
one user block and one item block, multiplies the two matrices, some users at a time, and keeps the best n items per user; only those
leave the task. All users meet the first block. No item of another block can score more with a user than the
block's highest bias and its greatest length times the user's length allow, nor more than its highest reach allows once that is
turned to the user's own length, so a user meets only those
blocks that can still beat the n-th score found. Users with about as many blocks to meet share user blocks.

With a required support, candidates are verified lazily: in score order, until n of them pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.functions.scalars import HIGHEST_RATING, LOWEST_RATING, clamp
from starfold.functions.vectors import NORM_FLOOR, dot, norm, unit
from starfold.operators.ridge import _list_matrix
from starfold.session import new_folder

USERS_PER_BLOCK = 2048
# Users of a block that are scored at a time.
USERS_AT_A_TIME = 256
ITEMS_PER_BLOCK = 8192
# Rated vectors of one user that may sit beside an item block at a time, and of all users of a block.
RATED_PER_PIECE = 4096
RATED_PER_BLOCK = 131_072

TOP_DDL = "userId long, movieId long, raw double, score double, support double"
_TOP = pa.schema([("userId", pa.int64()), ("movieId", pa.int64()), ("raw", pa.float64()),
                  ("score", pa.float64()), ("support", pa.float64())])


def predict(user_vec: Column, user_bias: Column, item_vec: Column, item_bias: Column,
            mean: Column, size: int | None = None) -> Column:
    """Rating estimate ``mean + user bias + item bias + user . item``, not clamped."""
    return mean + user_bias + item_bias + dot(user_vec, item_vec, size)


def predict_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, mean: Column,
                  size: int | None = None) -> DataFrame:
    """Estimate every (user, item) row of ``pairs`` both sides of which are known."""
    u = users.select("userId", F.col("vec").alias("_u"), F.col("bias").alias("_ub"))
    i = items.select("movieId", F.col("vec").alias("_i"), F.col("bias").alias("_ib"))
    joined = pairs.join(i, "movieId").join(u.where(F.col("_u").isNotNull()), "userId")
    raw = predict(F.col("_u"), F.col("_ub"), F.col("_i"), F.col("_ib"), mean, size)
    return joined.withColumn("raw", raw).withColumn("predicted", clamp(F.col("raw"))).drop(
        "_u", "_ub", "_i", "_ib")


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------ item blocks


class Blocks(NamedTuple):
    """What the items of each block can reach at most; one row per ``ITEMS_PER_BLOCK`` items."""

    number: np.ndarray
    length: np.ndarray
    high_bias: np.ndarray
    low_bias: np.ndarray
    first_id: np.ndarray
    short: np.ndarray
    high_reach: np.ndarray
    typical: tuple[float, float]

    def reach(self, base: np.ndarray, weight: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bounds of the scores of users (rows) in the blocks (columns)."""
        bias = np.maximum(np.outer(weight, self.high_bias), np.outer(weight, self.low_bias))
        bound = bias + np.outer(length, self.length)
        usual_weight, usual_length = self.typical
        if usual_weight > 0:
            # weight * bias + length * own length, as a share of the reach plus what the user's length differs by
            share = np.maximum(weight, 0.0) / usual_weight
            differs = (length - share * usual_length)[:, None]
            turned = np.outer(share, self.high_reach) + np.where(differs > 0, differs * self.length, differs * self.short)
            bound = np.where(weight[:, None] > 0, np.minimum(bound, turned), bound)
        bound = base[:, None] + bound
        return bound + 1e-9 * (1 + np.abs(bound) + np.abs(base[:, None]))


def item_blocks(items: DataFrame, weight: float = 0.0, length: float = 1.0) -> tuple[DataFrame, Blocks]:
    """Items with their ``item_block``, numbered by falling reach for a user of this weight and length, and the blocks' bounds."""
    plain = items.select("movieId", "vec", F.col("bias").cast("double").alias("bias"), norm(F.col("vec")).alias("length"))
    plain = plain.withColumn("reach", F.lit(weight) * F.coalesce("bias", F.lit(0.0)) + F.lit(length) * F.col("length"))
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    # of equal reaches the ids decide, so that any number of items of one reach is split too
    ranged = plain.repartitionByRange(blocks, F.desc("reach"), "movieId").withColumn("item_block", F.spark_partition_id())
    placed = _written(ranged, "item-blocks")
    rows = placed.groupBy("item_block").agg(F.max("length"), F.max("bias"), F.min("bias"), F.min("movieId"), F.min("length"), F.max("reach")).orderBy("item_block").collect()
    columns = [np.array(c) for c in zip(*rows)] if rows else [np.zeros(0)] * 7
    return placed, Blocks(*columns, (weight, length))


def _hide_rated(score: np.ndarray, ids: np.ndarray, rated: pa.Array) -> None:
    """Set the scores of rated items to minus infinity; ``ids`` ascend."""
    lengths = rated.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rated.flatten().to_numpy(zero_copy_only=False)
    if len(flat):
        score[np.repeat(np.arange(len(lengths)), lengths), np.searchsorted(ids, flat)] = -np.inf


def _best(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n best finite scores per row, ties to the lower column."""
    if n < 1:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    width = score.shape[1]
    chosen = np.isfinite(score)
    if width > n:
        floor = np.partition(score, width - n, axis=1)[:, width - n, None]
        above, tied = score > floor, score == floor
        room = n - above.sum(axis=1)
        # Clamped scores tie in masses; only the first ties of a row have room.
        crowded = np.flatnonzero(tied.sum(axis=1) > room)
        tied[crowded] &= np.cumsum(tied[crowded], axis=1) <= room[crowded, None]
        chosen &= above | tied
    row, column = np.nonzero(chosen)
    order = np.lexsort((column, -score[row, column], row))
    return row[order], column[order]


# ------------------------------------------------------------------ lazy verification


class Profile:
    """Directions of the items a user rated, in clusters with the largest angle of a member to its center."""

    SMALL = 32

    def __init__(self, directions: np.ndarray):
        self.directions = directions
        self.computed = 0
        rows = directions[np.linalg.norm(directions, axis=1) > 0.5]  # those without a length support nothing
        count = 1 if len(rows) < self.SMALL else int(len(rows) ** 0.5)
        centers = rows[np.linspace(0, len(rows) - 1, count).astype(int)] if len(rows) else rows
        for _ in range(2 if len(rows) else 0):
            nearest = (rows @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, rows)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(size > NORM_FLOOR, sums / np.maximum(size, NORM_FLOOR), centers)
        nearest = (rows @ centers.T).argmax(axis=1) if len(rows) else np.zeros(0, int)
        held = np.unique(nearest)  # a center may have lost all its members
        self.centers = centers[held]
        self.members = [rows[nearest == c] for c in held]
        self.angle = np.array([np.arccos(np.clip(m @ c, -1, 1)).max(initial=0.0) for m, c in zip(self.members, self.centers)])

    def passing(self, items: np.ndarray, least: float) -> np.ndarray:
        """Which item directions have a cosine of ``least`` with some member.

        An item is nearer than its angle to the center less the cluster's to no member, so most clusters are not looked into.
        """
        passed = np.zeros(len(items), bool)
        if not len(self.centers):
            return passed
        angle = np.arccos(np.clip(items @ self.centers.T, -1, 1))
        bound = np.cos(np.maximum(angle - self.angle, 0.0))
        self.computed += angle.size
        for c in np.argsort(angle.min(axis=0)):
            rows = np.flatnonzero(~passed & (bound[:, c] >= least - 1e-9))
            if len(rows):
                passed[rows] = (items[rows] @ self.members[c].T).max(axis=1) >= least
                self.computed += len(rows) * len(self.members[c])
        return passed

    def support(self, items: np.ndarray) -> np.ndarray:
        """Largest cosine of each item direction to a member."""
        self.computed += len(items) * len(self.directions)
        return (items @ self.directions.T).max(axis=1) if len(items) else np.zeros(0)


def verified(score: np.ndarray, directions: np.ndarray, profile: Profile, n: int, least: float, need: float) -> np.ndarray:
    """Columns of the n best scores whose items have the support; scores below ``need`` do not matter."""
    rest = np.flatnonzero(np.isfinite(score) & (score >= need))
    found: list[int] = []
    size = 32 * n
    while len(rest) and len(found) < n:
        # only the highest of the rest are sorted, with all that tie with the last of them
        mine = score[rest]
        floor = np.partition(mine, len(rest) - size)[len(rest) - size] if len(rest) > size else -np.inf
        above = mine >= floor
        some = rest[above]
        order = some[np.argsort(-score[some], kind="stable")]
        begin, step = 0, 4 * n
        while begin < len(order) and len(found) < n:
            part = order[begin: begin + step]
            found.extend(part[profile.passing(directions[part], least)].tolist())
            begin, step = begin + step, 2 * step
        rest, size = rest[~above], 4 * size
    return np.array(found[:n], int)


# ------------------------------------------------------------------ ranking


def _score_cell(n: int, low: float | None, high: float | None, min_support: float):
    """Best items of one item block for one user block."""

    def run(users: pa.Table, items: pa.Table) -> pa.Table:
        if users.num_rows == 0 or items.num_rows == 0:
            return _TOP.empty_table()
        items = items.sort_by("movieId")
        return pa.concat_tables([few(users.slice(begin, USERS_AT_A_TIME), items) for begin in range(0, users.num_rows, USERS_AT_A_TIME)])

    def few(users: pa.Table, items: pa.Table) -> pa.Table:
        ids = items.column("movieId").to_numpy()
        q = _list_matrix(items.column("vec"))
        raw = _list_matrix(users.column("vec")) @ q.T + users.column("base").to_numpy()[:, None]
        raw += np.outer(users.column("bias_weight").to_numpy(), items.column("bias").to_numpy())
        score = raw.copy() if low is None else np.clip(raw, low, high)
        _hide_rated(score, ids, users.column("rated").combine_chunks())
        if min_support > 0:
            # A long profile is here in pieces. An item of the overall top n is in the top n of
            # every piece it passes in, so no piece needs to keep more.
            lengths = np.linalg.norm(q, axis=1)
            directions = np.where(lengths[:, None] < NORM_FLOOR, 0.0, q / np.maximum(lengths, NORM_FLOOR)[:, None])
            need = users.column("need").to_numpy()
            rows, columns, supports = [], [], []
            for row, piece in enumerate(users.column("rated_unit")):
                profile = Profile(_list_matrix(piece.values))
                chosen = verified(score[row], directions, profile, n, min_support, need[row])
                rows.append(np.full(len(chosen), row))
                columns.append(chosen)
                supports.append(profile.support(directions[chosen]))
            row, column, support = (np.concatenate(x) for x in (rows, columns, supports))
        else:
            row, column = _best(score, n)
            support = np.full(len(row), np.nan)
        arrays = (users.column("userId").to_numpy()[row], ids[column], raw[row, column],
                  score[row, column], support)
        return pa.Table.from_arrays(
            [pa.array(a, f.type, from_pandas=True) for a, f in zip(arrays, _TOP)], schema=_TOP)

    return run


def wanted_blocks(users: DataFrame, blocks: Blocks, bounds: tuple[float, float] | None) -> DataFrame:
    """Users once per block they must still meet, with ``bucket``, the magnitude of their number of blocks.

    ``need`` and ``need_id`` are the n-th score found in the first block and its item; the first block is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            base, weight, length, need = (column[c].to_numpy(zero_copy_only=False) for c in ("base", "bias_weight", "length", "need"))
            bound = blocks.reach(base, weight, length)
            if bounds is not None:
                bound = np.clip(bound, *bounds)
            # a block that can only tie needs an item with a smaller id
            tie = (bound == need[:, None]) & (blocks.first_id < column["need_id"].to_numpy(zero_copy_only=False)[:, None])
            open_blocks = ((bound > need[:, None]) | tie) & (blocks.number > 0)
            row, block = np.nonzero(open_blocks)
            bucket = np.floor(np.log2(np.maximum(open_blocks.sum(axis=1), 1))).astype(np.int32)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(blocks.number[block].astype(np.int32)), pa.array(bucket[row])],
                names=[*batch.schema.names, "item_block", "bucket"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in users.schema)
    return users.mapInArrow(run, f"{fields}, item_block int, bucket int")


def _met(routes: DataFrame, sizes: DataFrame, items: DataFrame, masked: DataFrame, n: int,
         bounds: tuple[float, float] | None, min_support: float) -> DataFrame:
    """The best items of every routed user in the blocks they are routed to.

    sizes: ``bucket, load`` of the users of each bucket; it says how many user blocks a bucket has.
    """
    # a bucket is a magnitude of a number of blocks, so there are a few dozen of them
    blocks = {r["bucket"]: max(1, int(np.ceil(r["load"]))) for r in sizes.collect()}
    if not blocks:
        return items.sparkSession.createDataFrame([], TOP_DDL)
    count = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("bucket"))
    own = F.pmod(F.xxhash64("userId", "piece"), count).cast("int")
    placed = routes.withColumn("user_block", F.concat_ws("-", "bucket", own))
    pairs = placed.select(F.col("user_block").alias("user_block"), F.col("item_block").alias("item_block")).distinct()
    left = placed.join(masked, ["userId", "item_block"], "left")
    right = items.join(pairs, "item_block").select("movieId", "vec", "bias", "user_block", "item_block")
    low, high = bounds or (None, None)
    return left.groupBy("user_block", "item_block").cogroup(
        right.groupBy("user_block", "item_block")).applyInArrow(_score_cell(n, low, high, min_support), TOP_DDL)


def top_items(
    users: DataFrame,
    items: DataFrame,
    rated: DataFrame,
    n: int,
    bounds: tuple[float, float] | None = (LOWEST_RATING, HIGHEST_RATING),
    min_support: float = 0.0,
    profile_items: DataFrame | None = None,
) -> DataFrame:
    """The n best unrated items of every user: ``userId, movieId, raw, score, support, rank``.

    users: ``userId, vec, base`` and optionally ``bias_weight``; the raw score is
    ``base + bias_weight * bias + vec . item``. rated: ``userId, movieId`` pairs that
    must not be returned. The order is by score (clamped to ``bounds``), then item id.
    min_support: a candidate must reach this cosine to some item the user rated;
    ``profile_items`` supplies the vectors of rated items (default: ``items``).
    """
    if "bias_weight" not in users.columns:
        users = users.withColumn("bias_weight", F.lit(1.0))
    left = users.where(F.col("vec").isNotNull()).select(
        "userId", F.col("vec").cast("array<double>").alias("vec"),
        F.col("base").cast("double").alias("base"),
        F.col("bias_weight").cast("double").alias("bias_weight"))
    left = _written(left.withColumn("length", norm(F.col("vec"))), "scored-users")
    usual = left.agg(F.avg(F.greatest("bias_weight", F.lit(0.0))), F.avg("length")).first()
    placed, blocks = item_blocks(items, usual[0] or 0.0, usual[1] or 1.0)
    # Only rated items that are candidates need masking; as distinct items of one block
    # their number per user is bounded, and repeats are dropped before the shuffle.
    masked = rated.join(placed.select("movieId", "item_block"), "movieId").groupBy("userId", "item_block").agg(
        F.collect_set("movieId").alias("rated"))
    if min_support > 0:
        vectors = (profile_items if profile_items is not None else items)
        left = left.join(_profile_pieces(rated, vectors), "userId")
        load = F.greatest(F.lit(1.0 / USERS_PER_BLOCK), F.size("rated_unit") / RATED_PER_BLOCK)
    else:
        left, load = left.withColumn("piece", F.lit(0)), F.lit(1.0 / USERS_PER_BLOCK)
    left = _written(left.withColumn("load", load), "ranked-users")
    order = Window.partitionBy("userId").orderBy(F.col("score").desc(), "movieId")

    def ranked(cells: DataFrame) -> DataFrame:
        if min_support > 0:
            # A long profile was compared piece by piece; its best piece counts.
            cells = cells.groupBy("userId", "movieId").agg(
                F.max("raw").alias("raw"), F.max("score").alias("score"), F.max("support").alias("support"))
        return cells.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)

    first = left.withColumns({"item_block": F.lit(0), "bucket": F.lit(0), "need": F.lit(float("-inf"))})
    some = _met(first, left.groupBy(F.lit(0).alias("bucket")).agg(F.sum("load").alias("load")), placed, masked, n, bounds, min_support)
    if len(blocks.number) <= 1 or n < 1:
        return ranked(some)
    some = _written(some, "first-block")
    found = ranked(some).where(F.col("rank") == n).select("userId", F.col("score").alias("need"), F.col("movieId").alias("need_id"))
    known = left.join(found, "userId", "left").withColumns({"need": F.coalesce("need", F.lit(float("-inf"))), "need_id": F.coalesce("need_id", F.lit(0)).cast("long")})
    routes = _written(wanted_blocks(known, blocks, bounds), "routes")
    # a user's load counts once, not once per block
    each = routes.groupBy("userId", "piece").agg(F.first("bucket").alias("bucket"), F.first("load").alias("load"))
    sizes = each.groupBy("bucket").agg(F.sum("load").alias("load"))
    return ranked(some.unionByName(_met(routes, sizes, placed, masked, n, bounds, min_support)))


def _profile_pieces(rated: DataFrame, vectors: DataFrame) -> DataFrame:
    """Directions of the rated items per user, in pieces of bounded length."""
    pairs = rated.select("userId", "movieId").distinct()
    directions = pairs.join(vectors.select("movieId", "vec"), "movieId").select(
        "userId", "movieId", F.col("vec").cast("array<double>").alias("vec"))
    sizes = directions.groupBy("userId").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(RATED_PER_PIECE)).cast("int").alias("pieces"))
    marked = directions.join(sizes, "userId").select(
        "userId", F.pmod(F.xxhash64("movieId"), F.col("pieces")).cast("int").alias("piece"),
        unit(F.col("vec")).alias("direction"))
    return marked.groupBy("userId", "piece").agg(F.collect_list("direction").alias("rated_unit"))


# ------------------------------------------------------------------ score components

SPREAD_DDL = "userId long, personal_std double"


def moments(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of items, mean vector, and covariance matrix of the vectors (k x k numbers, summed by the tasks)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            q = _list_matrix(batch.column(0))
            rows = np.column_stack([q, np.ones(len(q))])
            total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    parts = items.where(F.col("vec").isNotNull()).select("vec").mapInArrow(sums, "place long, value double")
    values = [r["value"] for r in parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()]
    size = round(len(values) ** 0.5)
    gram = np.array(values).reshape(size, size) if values else np.zeros((1, 1))
    n = round(gram[-1, -1])
    mean = gram[:-1, -1] / max(n, 1)
    return n, mean, gram[:-1, :-1] / max(n, 1) - np.outer(mean, mean)


def score_components(users: DataFrame, items: DataFrame) -> DataFrame:
    """Range and spread of the popular part (item bias) and the personal part
    (user . item) of each user's scores over all items, and the ratio of the spreads.

    The spread is the quadratic form of the items' covariance matrix; the extremes are the best
    items for the user's vector and for its opposite, found by the ranking.
    """
    spark = users.sparkSession
    _, _, covariance = moments(items)
    own = _written(users.where(F.col("vec").isNotNull()).select("userId", F.col("vec").cast("array<double>").alias("vec")), "component-users")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _list_matrix(batch.column(1))
            if batch.num_rows:
                variance = np.einsum("ij,ij->i", u @ covariance, u)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(np.maximum(variance, 0.0)))], names=["userId", "personal_std"])

    nobody = spark.createDataFrame([], "userId long, movieId long")

    def extreme(sign: float, name: str) -> DataFrame:
        turned = own.select("userId", F.transform("vec", lambda x: x * F.lit(sign)).alias("vec"), F.lit(0.0).alias("base"), F.lit(0.0).alias("bias_weight"))
        return top_items(turned, items, nobody, 1, bounds=None).select("userId", (F.col("raw") * sign).alias(name))

    bias = F.col("bias").cast("double")
    popular = items.agg(F.min(bias).alias("low"), F.max(bias).alias("high"), F.stddev_pop(bias).alias("std")).first()
    part = {f"popularity_{k}": F.lit(v).cast("double") for k, v in (("min", popular["low"]), ("max", popular["high"]), ("std", popular["std"]))}
    return (own.mapInArrow(spread, SPREAD_DDL).join(extreme(-1.0, "personal_min"), "userId").join(extreme(1.0, "personal_max"), "userId")
            .withColumns(part)
            .select("userId", *[f"{part}_{stat}" for part in ("popularity", "personal") for stat in ("min", "max", "std")],
                    F.try_divide("personal_std", "popularity_std").alias("std_ratio")))
