"""Blocked ranking against scoring every pair."""

import numpy as np
import pytest

from starfold.operators import scoring
from starfold.plans import recommend as rec


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(50, 4)).astype(np.float32).astype(float)
    b = rng.normal(size=50) * 0.3
    u, base = rng.normal(size=(20, 4)), 3 + rng.normal(size=20)
    rated = {(x, int(m)) for x in range(20)
             for m in rng.choice(55, size=40 if x == 2 else 8, replace=False)}
    return (q, b, u, base, rated,
            spark.createDataFrame([(i, [float(x) for x in q[i]], float(b[i])) for i in range(50)],
                                  "movieId long, vec array<float>, bias double"),
            spark.createDataFrame([(x, [float(y) for y in u[x]], float(base[x])) for x in range(20)],
                                  "userId long, vec array<double>, base double"),
            spark.createDataFrame(sorted(rated), "userId long, movieId long"))


@pytest.mark.parametrize("blocks", [(2048, 8192, 4096), (3, 7, 5)])
@pytest.mark.parametrize("min_support", [0.0, 0.8])
def test_top_items(world, monkeypatch, blocks, min_support):
    q, b, u, base, rated, items, users, pairs = world
    for name, value in zip(("USERS_PER_BLOCK", "ITEMS_PER_BLOCK", "RATED_PER_PIECE"), blocks):
        monkeypatch.setattr(scoring, name, value)
    got = {}
    for r in scoring.top_items(users, items, pairs, 6, min_support=min_support).collect():
        got.setdefault(r.userId, []).append((r["rank"], r.movieId, round(r.raw, 9)))
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    for x in range(20):
        raw = u[x] @ q.T + base[x] + b
        score = np.clip(raw, 0.5, 5.0)
        own = [m for y, m in rated if y == x and m < 50]
        support = (unit @ unit[own].T).max(axis=1)
        open_items = [i for i in range(50) if i not in own
                      and (not min_support or support[i] >= min_support)]
        best = sorted(open_items, key=lambda i: (-score[i], i))[:6]
        want = [(n + 1, i, round(raw[i], 9)) for n, i in enumerate(best)]
        assert sorted(got.get(x, [])) == want


def test_ties_keep_ascending_ids_and_zero_is_empty(spark):
    items = spark.createDataFrame([(i, [0.0], 9.0) for i in (5, 3, 8, 1)],
                                  "movieId long, vec array<float>, bias double")
    users = spark.createDataFrame([(1, [0.0], 3.0)], "userId long, vec array<double>, base double")
    none = spark.createDataFrame([], "userId long, movieId long")
    top = scoring.top_items(users, items, none, 3).orderBy("rank").collect()
    assert [(r.movieId, r.score) for r in top] == [(1, 5.0), (3, 5.0), (5, 5.0)]
    assert scoring.top_items(users, items, none, 9).count() == 4
    assert scoring.top_items(users, items, none, 0).count() == 0


def test_most_blocks_are_skipped_when_lengths_are_skewed(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(scoring, "ITEMS_PER_BLOCK", 100)
    monkeypatch.setattr(scoring, "USERS_PER_BLOCK", 16)
    q = rng.normal(size=(3_000, 8)) * (rng.pareto(2.0, 3_000)[:, None] + 0.05)
    b, u = rng.normal(size=3_000) * 0.1, rng.normal(size=(60, 8))
    items = spark.createDataFrame([(i, [float(x) for x in q[i]], float(b[i])) for i in range(3_000)], "movieId long, vec array<double>, bias double")
    users = spark.createDataFrame([(x, [float(y) for y in u[x]], 0.0) for x in range(60)], "userId long, vec array<double>, base double")
    rated = spark.createDataFrame([(x, i) for x in range(60) for i in range(x, 3_000, 7)], "userId long, movieId long")
    met = []
    wanted = scoring.wanted_blocks
    monkeypatch.setattr(scoring, "wanted_blocks", lambda *a: met.append(wanted(*a)) or met[-1])
    found = {}
    for r in scoring.top_items(users, items, rated, 5, bounds=None).orderBy("userId", "rank").collect():
        found.setdefault(r.userId, []).append(r.movieId)
    for x in range(60):
        score = q @ u[x] + b
        score[x::7] = -np.inf
        assert found[x] == np.lexsort((np.arange(3_000), -score))[:5].tolist()
    visits = met[0].count() + 60
    print("blocks met:", visits, "of", 60 * 30)
    assert visits < 0.5 * 60 * 30


def test_a_block_that_can_only_tie_is_met_for_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ITEMS_PER_BLOCK", 2)
    # all clamped to five; the longest vectors have the largest ids
    items = spark.createDataFrame([(i, [10.0 + i], 0.0) for i in range(9)], "movieId long, vec array<float>, bias double")
    users = spark.createDataFrame([(1, [1.0], 3.0), (2, [-1.0], 3.0)], "userId long, vec array<double>, base double")
    none = spark.createDataFrame([], "userId long, movieId long")
    top = scoring.top_items(users, items, none, 2).orderBy("userId", "rank").collect()
    assert [(r.userId, r.movieId, r.score) for r in top] == [(1, 0, 5.0), (1, 1, 5.0), (2, 0, 0.5), (2, 1, 0.5)]


@pytest.mark.parametrize("least", [0.5, 0.9, 0.999])
def test_cosines_are_computed_lazily(least):
    rng = np.random.default_rng(6)
    groups = rng.normal(size=(20, 16))
    rated = np.repeat(groups, 60, axis=0) + rng.normal(size=(1_200, 16)) * 0.15
    rated /= np.linalg.norm(rated, axis=1, keepdims=True)
    items = np.concatenate([rated[::3] + rng.normal(size=(400, 16)) * 0.005, rng.normal(size=(3_600, 16))])
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    score = rng.normal(size=4_000).round(2)
    score[::50] = -np.inf
    profile = scoring.Profile(rated)
    found = scoring.verified(score, items, profile, 5, least, -np.inf)
    support = (items @ rated.T).max(axis=1)
    open_items = np.flatnonzero((support >= least) & np.isfinite(score))
    assert found.tolist() == open_items[np.lexsort((open_items, -score[open_items]))][:5].tolist()
    assert profile.computed < 0.2 * len(items) * len(rated)
    assert scoring.verified(score, items, profile, 5, least, 10.0).tolist() == []
    assert profile.support(items[found]) == pytest.approx(support[found])


def test_no_rated_direction_and_no_item():
    nothing = scoring.Profile(np.zeros((3, 2)))
    assert not nothing.passing(np.array([[1.0, 0.0]]), 0.1).any()
    assert scoring.verified(np.zeros(0), np.zeros((0, 2)), nothing, 5, 0.5, -np.inf).tolist() == []


def test_components_are_those_of_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(scoring, "ITEMS_PER_BLOCK", 40)
    q, b, u = rng.normal(size=(300, 5)) * rng.pareto(2.0, 300)[:, None], rng.normal(size=300), rng.normal(size=(12, 5))
    items = spark.createDataFrame([(i, [float(x) for x in q[i]], float(b[i])) for i in range(300)], "movieId long, vec array<double>, bias double").repartition(4)
    users = spark.createDataFrame([(x, [float(y) for y in u[x]]) for x in range(12)] + [(99, None)], "userId long, vec array<double>")
    rows = {r.userId: r for r in scoring.score_components(users, items).collect()}
    assert sorted(rows) == list(range(12))
    for x, r in rows.items():
        own = q @ u[x]
        assert [r.personal_min, r.personal_max, r.personal_std] == pytest.approx([own.min(), own.max(), own.std()])
        assert [r.popularity_min, r.popularity_max, r.popularity_std] == pytest.approx([b.min(), b.max(), b.std()])
        assert r.std_ratio == pytest.approx(own.std() / b.std())


def test_two_tiers(spark):
    items = spark.createDataFrame([(i, [1.0, i / 10], i / 100) for i in range(30)],
                                  "movieId long, vec array<float>, bias double")
    names = spark.createDataFrame([(i, f"T{i}", "Drama") for i in range(29)],
                                  "movieId long, title string, genres string")
    rows = [(1, m, 4.0) for m in range(9)] + [(2, m, 4.0 if m % 2 else 1.0) for m in range(10)]
    matched = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    everyone = spark.createDataFrame([(1,), (2,), (3,)], "userId long")
    out = rec.recommend_tiered(matched, items, names, 3.0, 2, n=4, users=everyone)
    by_user = {u: out.where(f"userId = {u}").orderBy("rank").collect() for u in (1, 2, 3)}
    assert {u: {r.tier for r in rows} for u, rows in by_user.items()} == {
        1: {"popularity"}, 2: {"item_cf"}, 3: {"popularity"}}
    assert [r.movieId for r in by_user[3]] == [29, 28, 27, 26]
    assert by_user[3][0].title == "Unknown" and by_user[3][0].genres == "(no genres listed)"
    assert not {r.movieId for r in by_user[2]} & set(range(10))


def test_most_blocks_are_skipped_when_only_biases_differ(spark, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(scoring, "ITEMS_PER_BLOCK", 100)
    q = rng.normal(size=(3_000, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)  # of equal lengths
    b, u = rng.normal(size=3_000), rng.normal(size=(20, 4)) * 0.05
    items = spark.createDataFrame([(i, [float(x) for x in q[i]], float(b[i])) for i in range(3_000)], "movieId long, vec array<double>, bias double")
    users = spark.createDataFrame([(x, [float(y) for y in u[x]], 3.0) for x in range(20)], "userId long, vec array<double>, base double")
    none = spark.createDataFrame([], "userId long, movieId long")
    met = []
    wanted = scoring.wanted_blocks
    monkeypatch.setattr(scoring, "wanted_blocks", lambda *a: met.append(wanted(*a)) or met[-1])
    found = {}
    for r in scoring.top_items(users, items, none, 5, bounds=None).orderBy("userId", "rank").collect():
        found.setdefault(r.userId, []).append(r.movieId)
    for x in range(20):
        assert found[x] == np.argsort(-(q @ u[x] + b))[:5].tolist()
    assert met[0].count() < 0.1 * 20 * 30


def test_bounds_of_blocks_hold_for_all_users():
    rng = np.random.default_rng(10)
    q, b = rng.normal(size=(400, 3)) * rng.pareto(2.0, 400)[:, None], rng.normal(size=400)
    length = np.linalg.norm(q, axis=1)
    for weight, usual in ((1.0, 0.7), (0.5, 3.0), (0.0, 1.0)):
        reach = weight * b + usual * length
        parts = np.array_split(np.argsort(-reach), 10)
        stat = lambda f, x: np.array([f(x[p]) for p in parts])
        blocks = scoring.Blocks(np.arange(10), stat(np.max, length), stat(np.max, b), stat(np.min, b), stat(np.min, np.arange(400)),
                                stat(np.min, length), stat(np.max, reach), (weight, usual))
        u, w, base = rng.normal(size=(50, 3)), rng.normal(size=50), rng.normal(size=50)
        w[:10] = 0.0
        score = base[:, None] + np.outer(w, b) + u @ q.T
        bound = blocks.reach(base, w, np.linalg.norm(u, axis=1))
        assert (np.column_stack([score[:, p].max(axis=1) for p in parts]) <= bound).all()


def test_a_profile_of_equal_directions_has_no_empty_cluster():
    rows = np.repeat([[1.0, 0.0]], 40, axis=0)
    rows[-1] = [0.0, 1.0]
    profile = scoring.Profile(rows)
    assert all(len(m) for m in profile.members)
    assert profile.passing(np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), 0.9).tolist() == [True, True, False]


def test_popular_items_whose_biases_differ_in_the_last_bits_are_tied(spark):
    items = spark.createDataFrame([(1, [1.0], 0.1 + 0.2), (2, [1.0], 0.5), (0, [1.0], 0.3)], "movieId long, vec array<double>, bias double")
    names = spark.createDataFrame([(i, str(i), "Drama") for i in range(3)], "movieId long, title string, genres string")
    none = spark.createDataFrame([], "userId long, movieId long, rating double")
    out = rec.recommend_tiered(none, items, names, 0.0, 1, users=spark.createDataFrame([(7,)], "userId long"))
    assert [r.movieId for r in out.orderBy("rank").collect()] == [2, 0, 1]


@pytest.mark.parametrize("name", ["recommend_topn", "recommend_tiered"])
def test_queries_rank_by_the_whole_vectors(spark, name):
    from starfold.registry import queries

    class Tables(queries.Derived):
        """Twelve rated and thirty open items that differ in the last of 64 numbers only."""

        mean = 3.0
        ratings = stored = property(lambda self: spark.createDataFrame([(1, m, 5.0 if m % 2 else 1.0) for m in range(12)], "userId long, movieId long, rating double"))
        items = property(lambda self: spark.createDataFrame([(m, str(m), "Drama") for m in range(42)], "movieId long, title string, genres string"))

        def table(self, name):
            return spark.createDataFrame([(1,)], "c_custkey long")

        def factors(self, size=None):
            rows = [(m, ([1.0] + [0.0] * 62 + [m / 100 if m > 11 else m % 2 * 2.0 - 1])[:size], 0.0) for m in range(42)]
            return spark.createDataFrame(rows, "movieId long, vec array<float>, bias double")

    rows = getattr(queries, name)(Tables(spark, "")).orderBy("rank").collect()
    assert [r.movieId for r in rows] == [41 - i for i in range(5 if name == "recommend_topn" else 25)]
