"""Fold-in: taste vectors of users a model was never trained on, and their evaluation.

``model`` arguments are ``(items, mean)``: the item factors ``movieId, vec, bias``
and the mean training rating as a number or a scalar column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starfold.functions.scalars import HIGHEST_RATING, LOWEST_RATING
from starfold.operators.ridge import (
    CHUNK_ROWS,
    RidgeSpec,
    Vectors,
    _list_matrix,
    _runs,
    add_blocks,
    key_sizes,
    ridge_by_key,
    routed,
)

DEFAULT_ALPHA = 100.0
# Rows, and so vectors, that leave-one-out holds at a time.
LOO_BLOCK_ROWS = 50_000


def _as_column(mean: float | Column) -> Column:
    return mean if isinstance(mean, Column) else F.lit(float(mean))


def fold_in(
    ratings: DataFrame,
    items: DataFrame,
    mean: float | Column,
    alphas: Sequence[float] = (DEFAULT_ALPHA,),
    solver: str = "ridge",
    min_rows: int = 2,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Taste vector and bias of every user: ``userId, alpha, n, vec, bias, status``.

    A user with fewer than ``min_rows`` ratings on known items gets
    ``status = 'too_few'`` and no vector. ``solver="least_squares"`` drops the penalty.
    """
    spec = RidgeSpec(
        alphas=(0.0,) if solver == "least_squares" else tuple(float(a) for a in alphas),
        intercept="lstsq" if solver == "least_squares" else "free",
        min_rows=min_rows,
    )
    rows = ratings.select("userId", "movieId", (F.col("rating") - _as_column(mean)).alias("y"))
    solved = ridge_by_key(rows, items, "userId", "movieId", spec, chunk_rows=chunk_rows)
    status = F.when(F.col("vec").isNull(), "too_few").otherwise("ok")
    return solved.select("userId", "alpha", "n", "vec", "bias", status.alias("status"))


def fold_in_user(ratings: DataFrame, items: DataFrame, mean: float | Column,
                 alpha: float = DEFAULT_ALPHA) -> tuple[np.ndarray, float]:
    """Single-user form of :func:`fold_in`; fails when too few ratings are usable."""
    one = ratings.withColumn("userId", F.lit(0).cast("long"))
    row = fold_in(one, items, mean, [alpha]).first()
    if row is None or row["status"] != "ok":
        raise ValueError("need at least 2 ratings on items the model knows")
    return np.array(row["vec"]), float(row["bias"])


# --------------------------------------------------------------------- leave one out

_GRAM = pa.schema([("key", pa.int64()), ("gram", pa.list_(pa.float64()))])
LOO_DDL = "key long, alpha double, n long, se double, ae double, e double"
_LOO = pa.schema([("key", pa.int64()), ("alpha", pa.float64()), ("n", pa.int64()),
                  ("se", pa.float64()), ("ae", pa.float64()), ("e", pa.float64())])


def _error_sums(key: int, alpha: float, residual: np.ndarray, leverage: np.ndarray,
                rating: np.ndarray, clamp: bool) -> tuple:
    """Error sums when each row is left out in turn.

    ``e_i / (1 - h_ii)`` equals the error of a refit without row i, so no refit is needed.
    """
    error = -residual / (1.0 - leverage)
    if clamp:
        error = np.clip(rating + error, LOWEST_RATING, HIGHEST_RATING) - rating
    return (key, alpha, len(error), float((error ** 2).sum()), float(np.abs(error).sum()),
            float(error.sum()))


def _held_out_all(key: int, x: np.ndarray, y: np.ndarray, rating: np.ndarray,
                  alphas: Sequence[float], clamp: bool) -> list[tuple]:
    """All rows of a key at hand: one decomposition, of the smaller of rows and factors."""
    n, k = x.shape
    x, y = x - x.mean(axis=0), y - y.mean()
    if n <= k:
        values, axes = np.linalg.eigh(x @ x.T)
        values = np.maximum(values, 0.0)
    else:
        values, right = np.linalg.eigh(x.T @ x)
        values = np.maximum(values, 0.0)
        axes = (x @ right) / np.sqrt(np.maximum(values, 1e-300))
    shares = axes.T @ y
    out = []
    for alpha in alphas:
        kept = values / (values + alpha)
        out.append(_error_sums(key, alpha, y - axes @ (kept * shares),
                               1.0 / n + (axes ** 2) @ kept, rating, clamp))
    return out


def _held_out_chunk(key: int, gram: np.ndarray, x: np.ndarray, y: np.ndarray,
                    rating: np.ndarray, alphas: Sequence[float], clamp: bool) -> list[tuple]:
    """Some rows of a key, beside the Gram matrix of all of them."""
    k, n = gram.shape[0] - 2, gram[-1, -1]
    mean_x, mean_y = gram[:k, -1] / n, gram[k, -1] / n
    values, axes = np.linalg.eigh(gram[:k, :k] - n * np.outer(mean_x, mean_x))
    cross = axes.T @ (gram[:k, k] - n * mean_x * mean_y)
    rotated = (x - mean_x) @ axes
    out = []
    for alpha in alphas:
        scale = 1.0 / (np.maximum(values, 0.0) + alpha)
        out.append(_error_sums(key, alpha, (y - mean_y) - rotated @ (scale * cross),
                               1.0 / n + (rotated ** 2) @ scale, rating, clamp))
    return out


def _loo_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _LOO)], schema=_LOO)


def _loo_block(alphas: Sequence[float], clamp: bool, min_rows: int):
    """All keys of one chunk in a block."""

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and sent.num_rows:
            rating = rows.column("rating").to_numpy()
            for key, _, _, z, places in _runs(rows, Vectors(sent)):
                if z is not None and len(z) >= min_rows:
                    out.extend(_held_out_all(key, z[:, :-1], z[:, -1], rating[places], alphas, clamp))
        return pa.Table.from_batches([_loo_batch(out)] if out else [], _LOO)

    return run


def _chunk_gram(rows: pa.Table, sent: pa.Table) -> pa.Table:
    """Gram matrices of the chunks of heavy keys in a block."""
    out: list[tuple] = []
    if rows.num_rows and sent.num_rows:
        for key, _, _, z, _ in _runs(rows, Vectors(sent)):
            if z is not None:
                z = np.column_stack([z, np.ones(len(z))])
                out.append((key, (z.T @ z).ravel()))
    return pa.Table.from_pydict({"key": [k for k, _ in out], "gram": [g for _, g in out]}, _GRAM)


def _loo_chunk(alphas: Sequence[float], clamp: bool):
    """One chunk of a heavy key, beside the Gram matrix of the whole key."""

    def run(chunk: pa.Table, total: pa.Table) -> pa.Table:
        if chunk.num_rows == 0 or total.num_rows == 0:
            return _LOO.empty_table()
        flat = _list_matrix(total.column("gram"))[0]
        p = int(round(np.sqrt(len(flat))))
        rows = _held_out_chunk(
            chunk.column("key")[0].as_py(), flat.reshape(p, p),
            _list_matrix(chunk.column("vec")), chunk.column("y").to_numpy(),
            chunk.column("rating").to_numpy(), alphas, clamp)
        return pa.Table.from_batches([_loo_batch(rows)])

    return run


def _gram_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the partial Gram matrices of each key of a sorted partition."""
    open_key, total = None, None
    for batch in batches:
        flat = _list_matrix(batch.column("gram"))
        for key, row in zip(batch.column("key").to_numpy(), flat):
            if open_key is not None and key != open_key:
                yield pa.RecordBatch.from_pydict({"key": [open_key], "gram": [total]}, _GRAM)
                total = None
            open_key, total = int(key), row if total is None else total + row
    if open_key is not None:
        yield pa.RecordBatch.from_pydict({"key": [open_key], "gram": [total]}, _GRAM)


def leave_one_out_sums(ratings: DataFrame, key: str, items: DataFrame, mean: float | Column, alphas: Sequence[float],
                       clamp: bool = True, min_rows: int = 3, chunk_rows: int = CHUNK_ROWS, home: str | None = None) -> DataFrame:
    """Error sums per key and penalty: ``key, alpha, n, se, ae, e``.

    ratings: ``key, movieId, rating``; those on items without a vector take no part. home: a column of
    ratings that keys with the same items have in common; their vectors are then sent once.
    Keys of one chunk are finished in their block. Of the others the Gram matrices of all
    chunks are added up first, and each chunk is then judged beside the sum.
    """
    alphas = tuple(float(a) for a in alphas)
    sizes = key_sizes(ratings, key, chunk_rows)
    rows = ratings.select(*dict.fromkeys((key, home or key)), "movieId", F.col("rating").cast("double").alias("rating"),
                          (F.col("rating") - _as_column(mean)).cast("double").alias("y"))
    marked = add_blocks(rows, key, "movieId", sizes, LOO_BLOCK_ROWS, home).select(
        F.col(key).cast("long").alias("key"), F.col("movieId").alias("other"), "rating", "y", "chunk", "n_chunks", "block")
    vectors = items.select(F.col("movieId").alias("other"), "vec", "bias")
    light, large = marked.where("n_chunks = 1"), marked.where("n_chunks > 1")

    def met(part: DataFrame, function, ddl: str) -> DataFrame:
        sent = routed(part, "other", vectors).drop("kind")
        return part.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(function, ddl)

    light_sums = met(light, _loo_block(alphas, clamp, min_rows), LOO_DDL)
    grams = (met(large, _chunk_gram, "key long, gram array<double>").repartition("key")
             .sortWithinPartitions("key").mapInArrow(_gram_sum, "key long, gram array<double>"))
    per_chunk = grams.join(sizes.heavy.withColumnRenamed(key, "key"), "key").select(
        "key", "gram", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    own = large.join(vectors, "other").select("key", "chunk", "rating", "vec", (F.col("y") - F.col("bias")).alias("y"))
    per_chunk_sums = own.groupBy("key", "chunk").cogroup(
        per_chunk.groupBy("key", "chunk")).applyInArrow(_loo_chunk(alphas, clamp), LOO_DDL)
    heavy_sums = per_chunk_sums.groupBy("key", "alpha").agg(
        *[F.sum(c).alias(c) for c in ("n", "se", "ae", "e")])
    return light_sums.unionByName(heavy_sums).withColumnRenamed("key", key)


def error_metrics(sums: DataFrame) -> DataFrame:
    """Replace error sums by ``rmse, mae, mean_error``."""
    return (sums.withColumn("rmse", F.sqrt(F.col("se") / F.col("n")))
            .withColumn("mae", F.col("ae") / F.col("n"))
            .withColumn("mean_error", F.col("e") / F.col("n")).drop("se", "ae", "e"))


def leave_one_out(ratings: DataFrame, items: DataFrame, mean: float | Column,
                  alphas: Sequence[float] = (1, 5, 10, 15, 20), clamp: bool = True,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Held-out error of fold-in per user and penalty, users with >= 3 known ratings.

    Returns ``userId, alpha, n, rmse, mae, mean_error``.
    """
    return error_metrics(leave_one_out_sums(ratings, "userId", items, mean, alphas, clamp,
                                            chunk_rows=chunk_rows))


def best_alpha(metrics: DataFrame) -> DataFrame:
    """Penalty with the smallest error per user; the smaller penalty wins a tie."""
    pick = F.min_by(F.struct("alpha", "rmse"), F.struct("rmse", "alpha"))
    return metrics.groupBy("userId").agg(pick.alias("best")).select("userId", "best.*")


def fold_in_tuned(ratings: DataFrame, items: DataFrame, mean: float | Column,
                  alphas: Sequence[float], clamp: bool = False) -> DataFrame:
    """Fold-in of every user at the penalty its own leave-one-out search prefers."""
    best = best_alpha(leave_one_out(ratings, items, mean, alphas, clamp)).select("userId", "alpha")
    return fold_in(ratings, items, mean, alphas).join(best, ["userId", "alpha"])
