"""Content features: statistics, vocabulary and the shared encoder."""

import math

import numpy as np
import pytest

from starfold import schemas
from starfold.operators import features as feat


def record(i, **changes):
    base = dict(tmdb_id=i, genre_ids=[28, 18], runtime=100.0, release_date="2001-02-03",
                original_language="en", vote_average=7.0, vote_count=10, budget=5.0, revenue=9.0,
                keyword_ids=[1], keyword_names=["based on novel", "café"], director_ids=[1],
                cast=[(7, 0), (8, 1)])
    return tuple({**base, **changes}.values())


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [record(i, budget=float(i % 7), revenue=float(i % 5) * 3, vote_count=i % 4,
                   runtime=float(i % 3) * 50, director_ids=[i % 2], cast=[(i % 3, 0), (9, 1)],
                   release_date="" if i % 6 == 0 else f"{1990 + i}-01-01",
                   keyword_names=["heist"] * (i % 3) + ["based on novel"]) for i in range(1, 25)]
    links = spark.createDataFrame([(i + 1000, i) for i in range(1, 25)], "movieId long, tmdbId long")
    return feat.linked_records(spark.createDataFrame(rows, schemas.RECORD), links)


def test_exact_medians_equal_numpy(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 1001, 30_000):
        values = np.where(rng.random(n) < 0.2, 0.0, np.round(rng.exponential(size=n), 3))
        values[0] = 1.0
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        sketch = df.agg(feat.median_sketch("v").alias("v")).first()
        got = feat.exact_medians(df, {"v": sketch["v"]})["v"]
        assert got == pytest.approx(np.median(values[values > 0]))


def test_statistics_have_defaults(spark):
    empty = spark.createDataFrame([record(1, runtime=0.0, release_date="", vote_count=0,
                                          budget=0.0, revenue=0.0)], schemas.RECORD)
    links = spark.createDataFrame([(5, 1)], "movieId long, tmdbId long")
    stats = feat.fit_numeric(feat.linked_records(empty, links)).first()
    assert (stats.bayesian_m, stats.runtime_impute_value, stats.budget_impute_value) == (6, 90, 1)
    assert (stats.year_mean, stats.year_std, stats.runtime_std) == (1990, 20, 1)


def test_encoder_values(spark, corpus):
    vocab, stats = feat.fit_vocab(corpus), feat.fit_numeric(corpus)
    names = {r.feature_id: r.name for r in vocab.collect()}
    assert sorted(names) == list(range(len(names)))
    assert {"kw:based", "kw:on", "kw:novel", "kw:heist"} == {n for n in names.values() if n[:3] == "kw:"}
    rows = {(r.movieId, names[r.feature_id]): r.value
            for r in feat.transform(corpus, vocab, stats).collect()}
    assert rows[(1001, "genre:Action")] == 1.0 and rows[(1001, "is_english")] == 1.0
    assert rows[(1001, "cast:9")] == 0.5
    n, df = 24, 16
    idf = math.log((1 + n) / (1 + df)) + 1
    weights = {"heist": (1 + math.log(2)) * idf, "based": 1.0, "on": 1.0, "novel": 1.0}
    length = math.sqrt(sum(w * w for w in weights.values()))
    assert rows[(1002, "kw:heist")] == pytest.approx(weights["heist"] / length)


def test_new_items_are_encoded_like_the_corpus(spark, corpus):
    vocab, stats = feat.fit_vocab(corpus), feat.fit_numeric(corpus)
    whole = {(r.movieId, r.feature_id): r.value
             for r in feat.transform(corpus, vocab, stats).where("movieId = 1007").collect()}
    one = {(r.movieId, r.feature_id): r.value for r in feat.transform(
        corpus.where("movieId = 1007"), vocab, stats).collect()}
    assert one == pytest.approx(whole)


def test_repeated_ids_count_once(spark, corpus):
    vocab, stats = feat.fit_vocab(corpus), feat.fit_numeric(corpus)
    links = spark.createDataFrame([(1, 1)], "movieId long, tmdbId long")
    twice = feat.linked_records(spark.createDataFrame(
        [record(1, genre_ids=[28, 28, 5], director_ids=[1, 1], cast=[(9, 3), (9, 1)])],
        schemas.RECORD), links)
    names = {r.feature_id: r.name for r in vocab.collect()}
    rows = {names[r.feature_id]: r.value for r in feat.transform(twice, vocab, stats).collect()}
    assert rows["genre:Action"] == 1.0 and rows["director:1"] == 1.0 and rows["cast:9"] == 0.5


def test_representation_of_cold_and_unknown_items(spark):
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "movieId long")
    factors = spark.createDataFrame([(1, [1.0, 2.0], 0.5), (2, [1.0, 1.0], 0.1)],
                                    "movieId long, vec array<float>, bias double")
    features = spark.createDataFrame([(1, 0, 2.0), (3, 0, 1.0), (3, 1, 1.0)], schemas.ITEM_FEATURES)
    weights = spark.createDataFrame([(0, [1.0, 0.0], 0.25), (1, [0.0, 1.0], 0.5)],
                                    schemas.FEATURE_WEIGHTS)
    content = feat.project(features, weights, 2)

    def rows(mode):
        return {r.movieId: (r.vec, r.bias, r.status) for r in feat.item_representations(
            items, factors, content, mode).collect()}

    identity, hybrid = rows("identity"), rows("hybrid")
    assert identity[1] == ([1.0, 2.0], 0.5, "warm") and hybrid[1] == ([3.0, 2.0], 1.0, "warm")
    assert identity[2] == hybrid[2]
    assert identity[3] == hybrid[3] == ([1.0, 1.0], 0.75, "cold")
    assert identity[4] == (None, None, "unscorable")


def test_terms_are_counted_without_a_row_per_term_in_the_shuffle(spark):
    rows = [(1, ["Red fox", "fox"]), (2, ["red"]), (2, ["red", "a"]), (None, ["fox"])]
    records = spark.createDataFrame(rows, "movieId long, keyword_names array<string>")
    counts = feat.term_counts(records)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.movieId, r.term): r.tf for r in counts.collect()} == {(1, "red"): 1, (1, "fox"): 2, (2, "red"): 2, (None, "fox"): 1}
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_terms_are_counted_in_tasks_of_bounded_texts(spark):
    rows = [(i % 50, [f"word{i % 7}", "fox " * 20]) for i in range(400)] + [(None, None), (None, ["fox"])]
    records = spark.createDataFrame(rows, "movieId long, keyword_names array<string>")
    counts = feat.term_counts(records, text_bytes=500)
    assert counts.rdd.getNumPartitions() > 60  # about 35 kB of text; merged again, all of it would be held in one task
    found = {(r.movieId, r.term): r.tf for r in counts.collect()}
    expected = {}
    for movie, names in rows:
        for term in " ".join(names or []).split():
            expected[movie, term] = expected.get((movie, term), 0) + 1
    assert found == expected


def test_records_that_are_kept_are_derived_once(spark):
    from starfold.registry.derived import Derived

    derived = Derived(spark, "nowhere")
    derived.records = spark.createDataFrame([(1, ["a"]), (2, [])], "tmdb_id long, keyword_names array<string>").repartition(2)
    kept = derived.keep_records()
    assert derived.records is kept and kept.inputFiles()
    assert sorted(r.tmdb_id for r in kept.collect()) == [1, 2]
    assert "Exchange" not in kept._jdf.queryExecution().toString()  # a scan and nothing of what they came from
