"""Ridge regressions for very many groups at once.

Rows ``(key, other, y)`` are one regression per key on the vectors of ``other``. Rows are
dealt to blocks of bounded size by their key. A vector travels once to every block that
holds a row of its owner, not once per row. Keys above a row bound are cut into chunks
that go to different blocks; their Gram matrices are added up in a second, small
exchange. Few-key skew therefore never lands in one task.

A row without a vector (an item the model does not know) adds nothing but keeps its
key in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starfold.session import new_folder

CHUNK_ROWS = 4096
BLOCK_ROWS = 200_000
# Gram matrices that wait to be solved together, and rows that are multiplied at a time.
OPEN_BYTES = 32 << 20


@dataclass(frozen=True)
class RidgeSpec:
    """How a group is solved.

    intercept: "free" leaves the bias out of the penalty, "penalised" includes it,
    "lstsq" is unpenalised least squares with the smallest norm.
    per_row: multiply the penalty by the number of rows.
    """

    alphas: tuple[float, ...] = (100.0,)
    intercept: str = "free"
    per_row: bool = False
    min_rows: int = 2


@dataclass(frozen=True)
class KeySizes:
    """Number of rows, and the keys with too many of them for one chunk: ``key, n_chunks``."""

    rows: int
    heavy: DataFrame


def key_sizes(rows: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> KeySizes:
    """Sizes of all keys, counted once and written; one number reaches the driver."""
    path = new_folder(rows.sparkSession, "key-sizes")
    rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = rows.sparkSession.read.parquet(path)
    chunks = F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int").alias("n_chunks")
    return KeySizes(counts.agg(F.sum("n")).first()[0] or 0,
                    counts.where(F.col("n") > chunk_rows).select(key, chunks))


def add_blocks(rows: DataFrame, key: str, spread: str, sizes: KeySizes, block_rows: int = BLOCK_ROWS, home: str | None = None) -> DataFrame:
    """Mark every row with the chunk of its key and the block of the chunk.

    home: a column by which keys are dealt instead, so that those that share vectors meet in one block.
    """
    blocks = max(1, -(-sizes.rows // block_rows))
    marked = rows.join(sizes.heavy, key, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64(spread), F.col("n_chunks")).cast("int")
    return marked.withColumn("chunk", chunk).withColumn(
        "block", F.pmod(F.xxhash64(home or key, "chunk"), F.lit(blocks)).cast("int"))


def written_routes(rows: DataFrame, key: str, other: str, sizes: KeySizes) -> DataFrame:
    """The blocks that each ``other`` has rows in, ``other, blocks``: for callers that solve the same rows several times."""
    path = new_folder(rows.sparkSession, "routes")
    add_blocks(rows.select(key, other), key, other, sizes).groupBy(F.col(other).alias("other")).agg(
        F.collect_set("block").alias("blocks")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def routed(rows: DataFrame, other: str, vectors: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Each vector once for every block with a row of its owner: ``block, kind, id, vec, bias``."""
    vectors = vectors.select(other, "vec", F.col("bias").cast("double").alias("bias"))
    if routes is None:
        sent = rows.select(F.col("block").alias("block"), other).distinct().join(vectors, other)
    else:
        # exploded after the join, so that a vector and its blocks are one row each until then
        sent = routes.withColumnRenamed("other", other).join(vectors, other).select(other, "vec", "bias", F.explode("blocks").alias("block"))
    return sent.select(
        "block", F.lit(0).alias("kind"), F.col(other).cast("long").alias("id"), "vec", "bias")


# --------------------------------------------------------------------------- solving


def _solve(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(left, right[..., None])[..., 0]
    except np.linalg.LinAlgError as failed:
        raise ValueError("ridge system without a unique solution; use a positive penalty") from failed


def solve_grams(grams: np.ndarray, priors: np.ndarray, alpha: float, spec: RidgeSpec):
    """Solve a stack of groups given the Gram matrices of their rows ``[x, y, 1]``."""
    k = grams.shape[1] - 2
    n = np.maximum(grams[:, k + 1, k + 1], 1.0)
    penalty = alpha * (n if spec.per_row else np.ones_like(n))
    if spec.intercept == "free":
        mean_x = grams[:, :k, k + 1] / n[:, None]
        mean_y = grams[:, k, k + 1] / n
        scatter = grams[:, :k, :k] - n[:, None, None] * mean_x[:, :, None] * mean_x[:, None, :]
        cross = grams[:, :k, k] - n[:, None] * mean_x * mean_y[:, None]
        vec = _solve(scatter + penalty[:, None, None] * np.eye(k), cross)
        bias = mean_y - np.einsum("bk,bk->b", mean_x, vec)
        theta = np.concatenate([vec, bias[:, None]], axis=1)
    columns = [*range(k), k + 1]
    normal = grams[:, columns][:, :, columns]
    right = grams[:, columns, k]
    if spec.intercept == "penalised":
        eye = penalty[:, None, None] * np.eye(k + 1)
        theta = _solve(normal + eye, right + penalty[:, None] * priors)
    elif spec.intercept == "lstsq":
        inverse = np.linalg.pinv(normal, rcond=1e-11, hermitian=True)
        theta = np.einsum("bij,bj->bi", inverse, right)
    sse = (grams[:, k, k] - 2.0 * np.einsum("bi,bi->b", theta, right)
           + np.einsum("bi,bij,bj->b", theta, normal, theta))
    if spec.intercept == "penalised":
        spread = penalty * ((theta - priors) ** 2).sum(axis=1)
    else:
        spread = penalty * (theta[:, :k] ** 2).sum(axis=1)
    return theta[:, :k], theta[:, k], np.maximum(sse, 0.0), spread


# --------------------------------------------------------------------------- streaming


def _list_matrix(column: pa.ChunkedArray | pa.Array, dtype: type | None = np.float64) -> np.ndarray:
    """Rows of a list column (nulls skipped) as a matrix; without a dtype, of the numbers that the column has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n_valid = len(column) - column.null_count
    if n_valid == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if dtype is not None:
        flat = flat.astype(dtype)
    return flat.reshape(n_valid, -1)


def _float_lists(matrix: np.ndarray, present: np.ndarray) -> pa.Array:
    """Matrix rows as a list column that is null where ``present`` is false."""
    lengths = np.where(present, matrix.shape[1] if matrix.ndim == 2 else 0, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = pa.array(np.ascontiguousarray(matrix[present]).ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~present))


def _segments(*keys: np.ndarray) -> np.ndarray:
    changed = np.zeros(len(keys[0]), dtype=bool)
    changed[0] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(changed), len(changed))


RESULT = pa.schema([
    ("key", pa.int64()), ("alpha", pa.float64()), ("n", pa.int64()),
    ("vec", pa.list_(pa.float64())), ("bias", pa.float64()),
    ("sse", pa.float64()), ("spread", pa.float64()), ("gram", pa.list_(pa.float64())),
])
RESULT_DDL = ("key long, alpha double, n long, vec array<double>, bias double, "
              "sse double, spread double, gram array<double>")


def _batch(key, alpha, n, vec, present, bias, sse, spread, gram, has_gram) -> pa.RecordBatch:
    def scalar(values):
        return pa.array(values, pa.float64(), mask=~present)

    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(alpha, pa.float64()), pa.array(n, pa.int64()),
         _float_lists(vec, present), scalar(bias), scalar(sse), scalar(spread),
         _float_lists(gram, has_gram)], schema=RESULT)


def _solved(keys: list, grams: list, priors: list, spec: RidgeSpec) -> Iterator[pa.RecordBatch]:
    """Result rows of closed groups, one per penalty."""
    counts = np.array([0 if g is None else round(g[-1, -1]) for g in grams], dtype=np.int64)
    usable = np.flatnonzero(counts >= max(spec.min_rows, 1))
    key = np.array(keys, dtype=np.int64)
    present = np.zeros(len(keys), dtype=bool)
    present[usable] = True
    none = np.zeros(len(keys), dtype=bool)
    stack = np.stack([grams[i] for i in usable]) if len(usable) else None
    for alpha in spec.alphas:
        k = 0 if stack is None else stack.shape[1] - 2
        vec, bias = np.zeros((len(keys), k)), np.zeros(len(keys))
        sse, spread = np.zeros(len(keys)), np.zeros(len(keys))
        if stack is not None:
            prior = np.stack([
                np.zeros(k + 1) if priors[i] is None else priors[i] for i in usable])
            vec[usable], bias[usable], sse[usable], spread[usable] = solve_grams(
                stack, prior, alpha, spec)
        yield _batch(key, np.full(len(keys), alpha), counts, vec, present, bias, sse, spread,
                     np.zeros((len(keys), 0)), none)


def _partials(keys: list, grams: list, priors: list) -> Iterator[pa.RecordBatch]:
    """Unsolved chunks of heavy keys: Gram matrix followed by the prior."""
    known = [i for i, g in enumerate(grams) if g is not None or priors[i] is not None]
    if not known:
        return
    sizes = [(grams[i].shape[0] if grams[i] is not None else len(priors[i]) + 1) for i in known]
    p = sizes[0]
    flat = np.zeros((len(known), p * p + p - 1))
    for row, i in enumerate(known):
        if grams[i] is not None:
            flat[row, : p * p] = grams[i].ravel()
        if priors[i] is not None:
            flat[row, p * p:] = priors[i]
    m = len(known)
    none, zero = np.zeros(m, dtype=bool), np.zeros(m)
    yield _batch(np.array([keys[i] for i in known], dtype=np.int64), zero,
                 np.zeros(m, dtype=np.int64), np.zeros((m, 0)), none, zero, zero, zero,
                 flat, np.ones(m, dtype=bool))


class Vectors:
    """The vectors of a block, found by the id of their owner; only a run's rows are made double."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id")
        self.ids = table.column("id").to_numpy()
        self.vec = _list_matrix(table.column("vec"), None)
        self.bias = table.column("bias").to_numpy()

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each owner, and whether it is known."""
        if not len(self.ids):
            return np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids


def _runs(rows: pa.Table, vectors: Vectors) -> Iterator[tuple]:
    """Key, chunk, chunks of the key, and matrix ``[x, y]`` of the known rows, run by run; ``None`` if there are none."""
    key, chunk = rows.column("key").to_numpy(), rows.column("chunk").to_numpy()
    n_chunks = rows.column("n_chunks").to_numpy()
    at, known = vectors.find(rows.column("other").to_numpy())
    y = rows.column("y").to_numpy()
    order = np.lexsort((chunk, key))
    key, chunk, n_chunks, at, known, y = (a[order] for a in (key, chunk, n_chunks, at, known, y))
    bounds = _segments(key, chunk)
    for start, stop in zip(bounds[:-1], bounds[1:]):
        part, z = at[start:stop][known[start:stop]], None
        if len(part):
            z = np.column_stack([vectors.vec[part], y[start:stop][known[start:stop]] - vectors.bias[part]])
        yield int(key[start]), int(chunk[start]), int(n_chunks[start]), z, order[start:stop][known[start:stop]]


def _solve_block(spec: RidgeSpec):
    """Solutions of a block's light keys, and partial Gram matrices of its heavy ones."""

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return RESULT.empty_table()
        kind = sent.column("kind").to_numpy()
        vectors = Vectors(sent.filter(pa.array(kind == 0)))
        prior_rows = sent.filter(pa.array(kind == 1))
        priors = dict(zip(prior_rows.column("id").to_pylist(), np.column_stack(
            [_list_matrix(prior_rows.column("vec")), prior_rows.column("bias").to_numpy()]))) if prior_rows.num_rows else {}
        out: list[pa.RecordBatch] = []
        light: list[tuple] = []
        heavy: list[tuple] = []
        held = 0

        def flush() -> None:
            if light:
                out.extend(_solved(*map(list, zip(*light)), spec))
            if heavy:
                out.extend(_partials(*map(list, zip(*heavy))))
            light.clear()
            heavy.clear()

        for key, chunk, n_chunks, z, _ in _runs(rows, vectors):
            gram = None
            if z is not None:
                z = np.column_stack([z, np.ones(len(z))])
                gram = z.T @ z
                held += gram.nbytes
            (light if n_chunks == 1 else heavy).append((key, gram, priors.get(key) if chunk == 0 else None))
            if held > OPEN_BYTES:
                flush()
                held = 0
        flush()
        return pa.Table.from_batches(out, RESULT)

    return run


def _merge(spec: RidgeSpec):
    """Add up the chunks of heavy keys; solved keys pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, state = None, None

        def close():
            p = int(round((np.sqrt(5 + 4 * len(state)) - 1) / 2))
            gram, prior = state[: p * p].reshape(p, p), state[p * p:]
            return _solved([ident], [gram], [prior], spec)

        for batch in batches:
            has_gram = np.asarray(batch.column("gram").is_valid())
            if not has_gram.any():
                yield batch.cast(RESULT)
                continue
            passed = batch.filter(pa.array(~has_gram))
            if passed.num_rows:
                yield passed.cast(RESULT)
            chunks = batch.filter(pa.array(has_gram))
            flat = _list_matrix(chunks.column("gram"))
            for key, row in zip(chunks.column("key").to_numpy(), flat):
                if ident is not None and key != ident:
                    yield from close()
                    state = None
                ident = int(key)
                state = row.copy() if state is None else state + row
        if ident is not None:
            yield from close()

    return run


# --------------------------------------------------------------------------- operator


def ridge_by_key(
    rows: DataFrame,
    vectors: DataFrame,
    key: str,
    other: str,
    spec: RidgeSpec,
    priors: DataFrame | None = None,
    sizes: KeySizes | None = None,
    chunk_rows: int = CHUNK_ROWS,
    routes: DataFrame | None = None,
) -> DataFrame:
    """One ridge solution per key.

    rows: ``key, other, y``. vectors: ``other, vec, bias``; the target of a row is ``y``
    minus the bias of its ``other``. Vectors travel in the type they have (floats are half
    the exchange) and are computed with in double. priors: ``key, vec, bias`` the solution is
    pulled towards (penalised intercept only). sizes: result of :func:`key_sizes`
    on a table with the same keys, when the caller already has it. routes: result of
    :func:`written_routes` on the same rows and sizes.
    Returns ``key, alpha, n, vec, bias, sse, spread``; ``vec`` is null below
    ``spec.min_rows`` usable rows.
    """
    if sizes is None:
        sizes = key_sizes(rows, key, chunk_rows)
    blocks = max(1, -(-sizes.rows // BLOCK_ROWS))
    data = add_blocks(rows.select(key, other, F.col("y").cast("double").alias("y")), key, other, sizes).select(
        F.col(key).cast("long").alias("key"), F.col(other).cast("long").alias("other"), "y", "chunk", "n_chunks", "block")
    sent = routed(data, "other", vectors.select(F.col(other).alias("other"), "vec", "bias"), routes)
    if priors is not None:
        # A prior goes to the first chunk of its key.
        first = F.pmod(F.xxhash64(F.col(key), F.lit(0)), F.lit(blocks)).cast("int")
        sent = sent.unionByName(priors.select(
            first.alias("block"), F.lit(1).alias("kind"), F.col(key).cast("long").alias("id"),
            F.col("vec").cast(vectors.schema["vec"].dataType).alias("vec"), F.col("bias").cast("double").alias("bias")))
    grams = data.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_solve_block(spec), RESULT_DDL)
    merged = grams.repartition("key").sortWithinPartitions("key").mapInArrow(_merge(spec), RESULT_DDL)
    return merged.drop("gram").withColumnRenamed("key", key)
