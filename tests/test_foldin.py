"""Fold-in, leave-one-out and prediction, against direct solutions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starfold.operators import evaluate, foldin, scoring

TINY = [(10, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (30, [1.0, 1.0, 0.0]), (40, [0.0, 0.0, 1.0])]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(m, v, 0.0) for m, v in TINY],
                                 "movieId long, vec array<float>, bias double")


def ratings(spark, rows):
    return spark.createDataFrame(rows, "movieId long, rating double")


@pytest.mark.parametrize("rows", [[(10, 5.0)], [(10, 5.0), (999, 1.0)]])
def test_too_few_known_ratings(spark, tiny, rows):
    with pytest.raises(ValueError):
        foldin.fold_in_user(ratings(spark, rows), tiny, 3.5)
    users = foldin.fold_in(ratings(spark, rows).withColumn("userId", F.lit(7)), tiny, 3.5)
    assert [(r.status, r.n, r.vec) for r in users.collect()] == [("too_few", 1, None)]


def test_shapes(spark, tiny):
    vec, bias = foldin.fold_in_user(
        ratings(spark, [(10, 5.0), (20, 1.0), (30, 3.0)]), tiny, 3.5, alpha=1.0)
    assert vec.shape == (3,) and isinstance(bias, float)


def test_prediction_formula(spark):
    row = spark.range(1).select(scoring.predict(
        F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)), F.lit(0.1),
        F.array(F.lit(0.5), F.lit(0.5), F.lit(10.0)), F.lit(0.2), F.lit(3.5)).alias("p")).first()
    assert row.p == pytest.approx(5.3)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 5)).astype(np.float32).astype(float)
    biases = rng.normal(size=60) * 0.1
    items = spark.createDataFrame(
        [(i, [float(x) for x in vectors[i]], float(biases[i])) for i in range(60)],
        "movieId long, vec array<float>, bias double")
    rows = []
    for user in range(25):
        n = 55 if user == 3 else int(rng.integers(1, 15))
        rows += [(user, int(m), float(rng.integers(1, 11) / 2))
                 for m in rng.choice(70, size=n, replace=False)]
    table = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    return vectors, biases, items, rows, table


def solve(vectors, biases, rows, alpha):
    x = np.array([vectors[m] for _, m, _ in rows])
    y = np.array([r - 3.0 - biases[m] for _, m, r in rows])
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


@pytest.mark.parametrize("chunk_rows", [4096, 8])
def test_fold_in_equals_direct_solution(world, chunk_rows):
    vectors, biases, items, rows, table = world
    users = foldin.fold_in(table, items, 3.0, [1.0, 50.0], chunk_rows=chunk_rows).collect()
    assert len(users) == 50
    for r in users:
        own = [x for x in rows if x[0] == r.userId and x[1] < 60]
        assert r.n == len(own)
        if len(own) < 2:
            assert r.status == "too_few"
            continue
        w, b = solve(vectors, biases, own, r.alpha)
        assert np.allclose(r.vec, w, atol=1e-10) and r.bias == pytest.approx(b)


@pytest.mark.parametrize("chunk_rows", [4096, 8])
def test_leave_one_out_equals_refits(world, chunk_rows):
    vectors, biases, items, rows, table = world
    got = foldin.leave_one_out(table, items, 3.0, [1.0, 50.0], chunk_rows=chunk_rows).collect()
    for r in got:
        own = [x for x in rows if x[0] == r.userId and x[1] < 60]
        errors = []
        for i, (_, m, rating) in enumerate(own):
            w, b = solve(vectors, biases, own[:i] + own[i + 1:], r.alpha)
            score = 3.0 + b + biases[m] + vectors[m] @ w
            errors.append(min(5.0, max(0.5, score)) - rating)
        assert r.n == len(own) >= 3
        assert r.rmse == pytest.approx(np.sqrt(np.mean(np.square(errors))))
        assert r.mae == pytest.approx(np.mean(np.abs(errors)))
        assert r.mean_error == pytest.approx(np.mean(errors))


def test_strong_penalty_leaves_the_bias_only(world):
    vectors, biases, items, rows, table = world
    for r in foldin.fold_in(table, items, 3.0, [1e12]).where("status = 'ok'").collect():
        own = [x for x in rows if x[0] == r.userId and x[1] < 60]
        assert np.abs(r.vec).max() < 1e-8
        assert r.bias == pytest.approx(np.mean([x[2] - 3.0 - biases[x[1]] for x in own]))


def test_least_squares_has_the_smallest_norm(world):
    vectors, biases, items, rows, table = world
    for r in foldin.fold_in(table, items, 3.0, solver="least_squares").where(
            "status = 'ok'").collect():
        own = [x for x in rows if x[0] == r.userId and x[1] < 60]
        a = np.column_stack([np.ones(len(own)), [vectors[m] for _, m, _ in own]])
        want = np.linalg.lstsq(a, np.array([x[2] - 3.0 - biases[x[1]] for x in own]), rcond=None)[0]
        assert np.allclose([r.bias, *r.vec], want, atol=1e-8)


def test_tuned_fold_in_uses_each_users_best_penalty(world):
    _, _, items, _, table = world
    best = {r.userId: r.alpha for r in foldin.best_alpha(
        foldin.leave_one_out(table, items, 3.0, [0.1, 10.0], clamp=False)).collect()}
    tuned = {r.userId: r.alpha for r in foldin.fold_in_tuned(table, items, 3.0, [0.1, 10.0]).collect()}
    assert tuned == best and best


def test_cascade_holds_few_rows_and_each_users_items_once(spark, monkeypatch):
    def block(alphas, clamp, min_rows):
        def run(rows, sent):
            width = float(foldin.Vectors(sent).vec.itemsize)
            return pa.Table.from_pydict({"key": [0], "alpha": [1.0], "n": [rows.num_rows], "se": [float(sent.num_rows)],
                                         "ae": [width], "e": [0.0]}, foldin._LOO)
        return run

    monkeypatch.setattr(foldin, "_loo_block", block)
    ratings = spark.range(24_000).selectExpr("id div 12 as userId", "id as movieId", "3.5d as rating")
    samples = ratings.selectExpr("userId", "12 as n", "explode(sequence(0, 4)) as draw", "movieId")
    items = ratings.selectExpr("movieId", "array(1f, 2f) as vec", "0d as bias")
    seen = evaluate.cascade_errors(ratings, {2: items}, 3.0, samples, [1.0], [12], 5).collect()
    assert sum(r.n_rows for r in seen) == 120_000 and max(r.n_rows for r in seen) < 60_000
    assert sum(round(r.rmse ** 2 * r.n_rows) for r in seen) == 24_000
    assert {round(r.mae * r.n_rows) for r in seen} == {4}


def test_draws_are_nested_in_the_pool(world):
    _, _, _, rows, table = world
    drawn = evaluate.draws(table, [5, 55, 99], 3).collect()
    sizes = {}
    for r in drawn:
        sizes.setdefault((r.userId, r.n, r.draw), set()).add(r.movieId)
    assert all(len(v) == key[1] for key, v in sizes.items())
    assert {key for key in sizes if key[1] == 55} == {(3, 55, 0)}
