"""Tiled products and conjugate gradients against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import tiles as T
from starfold.operators.features import project
from starfold.plans import train as training


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(60, 25)) * (rng.random((60, 25)) < 0.2)
    matrix[7] = 0.0  # an item without features
    rows = [(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    return matrix, spark.createDataFrame(rows, "movieId long, feature_id int, value double").repartition(3)


@pytest.mark.parametrize("sizes", [(8_192, 4_096), (9, 4)])
def test_products_are_those_of_the_matrix(spark, sparse, monkeypatch, sizes):
    monkeypatch.setattr(T, "ITEMS_PER_TILE", sizes[0])
    monkeypatch.setattr(T, "FEATURES_PER_TILE", sizes[1])
    matrix, features = sparse
    rng = np.random.default_rng(3)
    w, x = rng.normal(size=(25, 3)), rng.normal(size=(60, 3))
    weights = spark.createDataFrame([(j, [float(v) for v in w[j]]) for j in range(25) if j != 4], "feature_id int, vec array<double>")
    w[4] = 0.0  # a feature without weights adds nothing
    tiles = T.tiled(features, written=True)
    got = {r.movieId: r.vec for r in T.times(tiles, weights, 3).collect()}
    known = matrix.copy()
    known[:, 4] = 0.0
    assert set(got) == {i for i in range(60) if known[i].any()}
    for i, vec in got.items():
        assert vec == pytest.approx(matrix[i] @ w)
    items = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "movieId long, vec array<double>")
    back = {r.feature_id: r.vec for r in T.transposed_times(tiles, items, 3).collect()}
    assert {j: pytest.approx(v) for j, v in back.items()} == {j: list(matrix[:, j] @ x) for j in range(25) if matrix[:, j].any()}


def test_shuffled_rows_do_not_grow_with_the_nonzeros_vectors(spark, sparse):
    matrix, features = sparse
    weights = spark.createDataFrame([(j, [1.0] * 4, 0.5) for j in range(25)], "feature_id int, vec array<double>, bias double")
    plan = project(features, weights, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert " Join " not in plan and "FlatMapCoGroupsInArrow" in plan


def test_weights_are_those_of_a_direct_solve(spark, sparse, tmp_path):
    matrix, features = sparse
    rng = np.random.default_rng(5)
    total, bias, strength = rng.normal(size=(60, 2)), rng.normal(size=60), rng.uniform(1, 4, 60)
    start = rng.normal(size=(25, 3)) * 0.1
    content = matrix @ start
    params = training.TrainParams(components=2, weight_decay=0.3, content_rounds=60, content_tolerance=1e-6)
    weights = spark.createDataFrame([(j, [float(v) for v in start[j, :2]], float(start[j, 2])) for j in range(25)], "feature_id int, vec array<double>, bias double")
    rest = spark.createDataFrame([(i, [float(v) for v in total[i] - content[i, :2]], float(bias[i] - content[i, 2]), float(strength[i])) for i in range(60)],
                                 "movieId long, vec array<double>, bias double, s double")
    found = training.conjugate_weights(weights, rest, T.tiled(features, written=True), F.col("s"), params, str(tmp_path / "cg")).collect()
    left = matrix.T @ (strength[:, None] * matrix) + 0.3 * np.eye(25)
    want = np.linalg.solve(left, matrix.T @ (strength[:, None] * np.column_stack([total, bias])))
    got = np.zeros((25, 3))
    for r in found:
        got[r.feature_id] = [*r.vec, r.bias]
    assert got == pytest.approx(want, abs=1e-4)


def test_the_objective_falls_below_that_of_single_steps(spark, tmp_path):
    rng = np.random.default_rng(11)
    matrix = rng.normal(size=(40, 6))
    taste = rng.normal(size=(50, 6)) * 0.4
    rows = [(u, i, float(np.clip(3 + taste[u] @ matrix[i] + rng.normal() * 0.2, 0.5, 5))) for u in range(50) for i in rng.choice(40, 12, replace=False).tolist()]
    ratings = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    features = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(40) for j in range(6)], "movieId long, feature_id int, value double")
    objective = {}
    for solver in ("step", "gradients"):
        params = training.TrainParams(components=4, epochs=3, min_ratings=1, content_solver=solver)
        training.train(spark, ratings, str(tmp_path / solver), features, params)
        from starfold.sources import store

        objective[solver] = store.read_progress(spark, str(tmp_path / solver)).orderBy(F.desc("epoch")).first()["objective"]
    assert objective["gradients"] < objective["step"]


def test_a_feature_is_sent_to_the_tiles_that_hold_it(spark, monkeypatch):
    monkeypatch.setattr(T, "ITEMS_PER_TILE", 1)
    features = spark.createDataFrame([(i, i // 2, 2.0) for i in range(40)], "movieId long, feature_id int, value double")
    tiles = T.tiled(features, written=True)
    weights = spark.createDataFrame([(j, [float(j)]) for j in range(20)], "feature_id int, vec array<double>")
    assert tiles.item_blocks > 20
    assert T._to_tiles(tiles, weights).count() <= 40
    scales = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "movieId long, vec array<double>")
    got = {r.feature_id: r.vec[0] for r in T.there_and_back(tiles, weights, scales, 1).collect()}
    assert got == {j: 4.0 * j * (4 * j + 1) for j in range(20)}
