"""Training on a planted signal, continuing a run, and the evaluations around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import stats
from starfold.operators import ridge
from starfold.operators.ridge import RidgeSpec, key_sizes, ridge_by_key, written_routes
from starfold.plans import train as training
from starfold.session import new_folder
from starfold.sources import store


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n_users, n_items, n_features = 200, 80, 10
    features = rng.random((n_items, n_features)) < 0.25
    vectors = features @ (rng.normal(size=(n_features, 3)) * 0.5) + rng.normal(size=(n_items, 3)) * 0.2
    biases = features @ (rng.normal(size=n_features) * 0.2)
    users, levels = rng.normal(size=(n_users, 3)) * 0.6, rng.normal(size=n_users) * 0.2
    rows = []
    for u in range(n_users):
        for i in rng.choice(n_items, size=30, replace=False):
            score = 3.3 + levels[u] + biases[i] + users[u] @ vectors[i] + rng.normal() * 0.2
            rows.append((u, int(i), float(np.clip(np.round(2 * score) / 2, 0.5, 5.0))))
    ratings = spark.createDataFrame(rows, "userId long, movieId long, rating double").repartition(4)
    long = spark.createDataFrame([(i, f, 1.0) for i in range(n_items) for f in range(n_features)
                                  if features[i, f]], "movieId long, feature_id int, value double")
    return ratings, long, float(np.std([r[2] for r in rows]))


def test_holdout_ablation(spark, planted):
    ratings, features, deviation = planted
    out = training.holdout_eval(spark, ratings, features, new_folder(spark, "holdout"),
                                training.TrainParams(components=4, epochs=3, reg_user=2.0, reg_item=2.0),
                                n_users=None)
    rmse = {r.variant: r.rmse for r in out.collect()}
    assert rmse["hybrid"] < 0.6 * deviation
    assert rmse["hybrid"] <= rmse["identity_only"] and rmse["content_only"] < deviation
    assert {"n_users", "n_items", "epochs", "k", "train_interactions", "elapsed_min"} < set(out.columns)


def test_training_continues_and_improves(spark, planted):
    ratings, features, _ = planted
    folder = new_folder(spark, "model")
    params = training.TrainParams(components=4, epochs=1, eval_every=2)
    training.train(spark, ratings, folder, features, params, tag="k4")
    longer = training.TrainParams(components=4, epochs=3, eval_every=2)
    model = training.train(spark, ratings, folder, features, longer, tag="k4")
    progress = store.read_progress(spark, folder, "k4").orderBy("epoch").collect()
    assert [r.epoch for r in progress] == [1, 2, 3]
    assert [r.rmse is None for r in progress] == [False, False, False]
    objective = [r.objective for r in progress]
    assert objective == sorted(objective, reverse=True)
    assert model.items.count() == 80 and model.weights.count() == 10
    with pytest.raises(ValueError):
        training.train(spark, ratings, folder, features, training.TrainParams(components=5), "k4")
    with pytest.raises(ValueError):
        store.load_model(spark, folder, "k9")
    assert store.available_tags(spark, folder, ["k4", "k9"]) == ["k4"]
    fresh = training.train(spark, ratings, folder, features, params, tag="k4", fresh=True)
    assert store.last_config(spark, folder, "k4")["epoch"] == 1 and fresh.global_mean == pytest.approx(
        model.global_mean)


def _means(model):
    return model.items.count(), model.global_mean


def test_a_continued_run_takes_the_given_ratings(spark):
    few = spark.createDataFrame([(u, i, 3.0) for u in range(20) for i in range(4)], "userId long, movieId long, rating double")
    more = spark.createDataFrame([(u, i, 5.0) for u in range(40) for i in range(6)], "userId long, movieId long, rating double")
    folder = new_folder(spark, "resume")
    one, two = (training.TrainParams(components=3, epochs=n, min_ratings=5) for n in (1, 2))
    assert _means(training.train(spark, few, folder, None, one)) == (4, 3.0)
    assert _means(training.train(spark, few, folder, None, one)) == (4, 3.0)
    with pytest.raises(ValueError):  # finished, and the new ratings would not be learned
        training.train(spark, more, folder, None, one)
    with pytest.raises(ValueError):
        training.train(spark, few, folder, None, training.TrainParams(components=3, epochs=1, min_ratings=5, reg_item=1.0))
    model = training.train(spark, more, folder, None, two)
    assert _means(model) == (6, 5.0)
    assert store.read_epoch(spark, folder, "users", "default", 2).count() == 40
    shrunk = training.train(spark, few, folder, None, training.TrainParams(components=3, epochs=3, min_ratings=5))
    assert _means(shrunk) == (4, 3.0)


def test_features_are_stored_once_as_tiles(spark, planted):
    import os

    ratings, features, _ = planted
    folder = new_folder(spark, "model")
    one = training.TrainParams(components=2, epochs=1)
    model = training.train(spark, ratings, folder, features, one)
    assert "features" not in os.listdir(f"{folder.removeprefix('file://')}/work/tag=default") and model.weights.count() == 10


def test_a_continued_run_takes_the_given_features(spark, planted):
    ratings, features, _ = planted
    folder = new_folder(spark, "refeature")
    one, two, three = (training.TrainParams(components=3, epochs=n) for n in (1, 2, 3))
    training.train(spark, ratings, folder, None, one)
    with pytest.raises(ValueError):
        training.train(spark, ratings, folder, features, one)
    model = training.train(spark, ratings, folder, features.where("feature_id < 5"), two)
    assert model.weights.count() == 5
    assert training.train(spark, ratings, folder, features, three).weights.count() == 10
    with pytest.raises(ValueError):
        training.train(spark, ratings, folder, None, training.TrainParams(components=3, epochs=4))
    fresh = training.train(spark, ratings, folder, None, one, fresh=True)
    assert fresh.weights is None


def test_heavy_items_are_split_with_their_prior(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 2)), i, [float(v) for v in rng.normal(size=3)], float(rng.normal()))
            for i in range(60)] + [(9, 100, [1.0, 0.0, 0.0], 2.0)]
    data = spark.createDataFrame([(k, o, y) for k, o, _, y in rows], "key long, other long, y double")
    vectors = spark.createDataFrame([(o, v, 0.0) for _, o, v, _ in rows], "other long, vec array<double>, bias double")
    priors = {0: ([1.0, 2.0, 3.0], 0.5), 9: ([0.5, 0.0, 0.0], 1.0)}
    prior = spark.createDataFrame([(k, v, b) for k, (v, b) in priors.items()],
                                  "key long, vec array<double>, bias double")
    for chunk_rows in (1000, 7):
        for per_row in (False, True):
            spec = RidgeSpec((2.0,), "penalised", per_row, 1)
            got = ridge_by_key(data, vectors, "key", "other", spec, prior, chunk_rows=chunk_rows).collect()
            assert {r.key for r in got} == {0, 1, 9}
            for r in got:
                x = np.array([[*v, 1.0] for k, _, v, _ in rows if k == r.key])
                y = np.array([t for k, _, _, t in rows if k == r.key])
                m = np.array([*priors[r.key][0], priors[r.key][1]] if r.key in priors else [0.0] * 4)
                strength = 2.0 * (len(y) if per_row else 1)
                want = np.linalg.solve(x.T @ x + strength * np.eye(4), x.T @ y + strength * m)
                assert np.allclose([*r.vec, r.bias], want)
                assert r.sse == pytest.approx(((y - x @ want) ** 2).sum())


def test_stored_routes_send_the_same_vectors_without_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ridge, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 30)), int(rng.integers(0, 40)), float(rng.normal())) for _ in range(400)] + [(1, None, 1.0), (99, 1000, 1.0)]
    data = spark.createDataFrame(rows, "key long, other long, y double")
    vectors = spark.createDataFrame([(o, [float(o), 1.0], 0.1) for o in range(40)], "other long, vec array<double>, bias double")
    spec, sizes = RidgeSpec((2.0,), "penalised", False, 1), key_sizes(data, "key", 8)
    routes = written_routes(data, "key", "other", sizes)
    marked = ridge.add_blocks(data, "key", "other", sizes)
    assert sorted(map(str, ridge.routed(marked, "other", vectors, routes).collect())) == sorted(map(str, ridge.routed(marked, "other", vectors).collect()))
    assert "key-sizes" not in "".join(ridge.routed(marked, "other", vectors, routes).inputFiles())  # the rows are not dealt again
    plain, sent = ({r.key: r for r in ridge_by_key(data, vectors, "key", "other", spec, sizes=sizes, routes=known).collect()} for known in (None, routes))
    assert plain.keys() == sent.keys() and sent[99].vec is None
    for key, row in plain.items():
        assert row.n == sent[key].n and (row.vec is None or np.allclose([*row.vec, row.bias, row.sse], [*sent[key].vec, sent[key].bias, sent[key].sse]))


def test_learning_curve_and_joint_user(spark, planted):
    ratings, _, deviation = planted
    params = training.TrainParams(**{**training.PLAIN.__dict__, "components": 3, "epochs": 2})
    curve = training.cross_validate(spark, ratings, new_folder(spark, "cv"), 2, params)
    rows = curve.collect()
    assert {(r.fold, r.n_epochs, r.part) for r in rows} == {
        (f, e, p) for f in (0, 1) for e in (1, 2) for p in ("train", "test")}
    assert min(r.rmse for r in rows if r.part == "test") < deviation
    personal = ratings.where("userId = 5").select("movieId", "rating")
    own = training.joint_user(spark, ratings, personal, new_folder(spark, "joint"), params, -1)
    assert [(r.userId, len(r.vec), r.n) for r in own.collect()] == [(-1, 3, 30)]


def test_learning_curves_of_several_penalties(spark, planted):
    params = training.TrainParams(**{**training.PLAIN.__dict__, "components": 2, "epochs": 1})
    rows = training.regularisation_grid(spark, planted[0], new_folder(spark, "grid"), [0.1, 10.0], 2, params).collect()
    assert {(r.reg, r.fold, r.part) for r in rows} == {(g, f, p) for g in (0.1, 10.0) for f in (0, 1) for p in ("train", "test")}
    fit = {g: sum(r.rmse for r in rows if r.reg == g and r.part == "train") for g in (0.1, 10.0)}
    assert fit[0.1] < fit[10.0]


def test_dry_run_keeps_the_mean_of_all_users(spark, planted):
    ratings, _, _ = planted
    folder = new_folder(spark, "dry")
    params = training.TrainParams(components=2, dry_run=True)
    model = training.train(spark, ratings, folder, None, params)
    assert model.weights is None
    assert model.global_mean == pytest.approx(ratings.agg(F.avg("rating")).first()[0])
    last = store.read_progress(spark, folder).orderBy(F.desc("epoch")).first()
    assert last.epoch == last.of == 5 and last.done


def test_convergence_point(spark):
    curve = spark.createDataFrame([(10, 1.0), (20, 0.9), (30, 0.8995), (40, 0.5)],
                                  "n_epochs int, rmse double")
    assert stats.convergence_point(curve).first().converged_at == 30
