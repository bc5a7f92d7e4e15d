"""Readers, stores and streams on small files."""

import json
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starfold import schemas
from starfold.operators import features as feat
from starfold.registry import queries
from starfold.session import new_folder
from starfold.sources import store, tables
from starfold.streaming import jobs
from starfold.streaming.store import BatchStore, newest


def test_csv_tables(spark, tmp_path):
    (tmp_path / "movies.csv").write_text(
        'movieId,title,genres\n1,"Good, the ""Bad"" (1966)",Western|War\n2,Plain (2000),(no genres listed)\n')
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,4.5,99\n")
    (tmp_path / "links.csv").write_text(
        "movieId,imdbId,tmdbId\n1,0012,10.0\n2,0013,\n3,0014,10.0\n4,0015,11.0\n")
    assert [r.title for r in tables.items(spark, str(tmp_path / "movies.csv")).collect()] == [
        'Good, the "Bad" (1966)', "Plain (2000)"]
    rows = tables.ratings(spark, str(tmp_path / "ratings.csv"))
    assert rows.columns == ["userId", "movieId", "rating"] and rows.first().rating == 4.5
    links = tables.links(spark, str(tmp_path / "links.csv"))
    assert {r.tmdbId: r.movieId for r in tables.catalog_to_item(links).collect()} == {10: 3, 11: 4}


def test_profile_keeps_the_last_rating_or_all(spark):
    rows = spark.createDataFrame([(1, 5, 1, 2.0), (1, 5, 2, 4.0), (1, 6, 3, 3.0)],
                                 "userId long, movieId long, line_no long, rating double")
    assert {(r.movieId, r.rating) for r in tables.profile(rows).collect()} == {(5, 4.0), (6, 3.0)}
    assert tables.profile(rows, dedup=False).count() == 3


@pytest.fixture
def exports(spark, tmp_path):
    days = [("alice", "2026-01-01"), ("alice", "2026-06-15"), ("alice", "2026-03-10"),
            ("alice-b", "2026-09-01")]
    spark.createDataFrame([(u, d, i) for i, (u, d) in enumerate(days)],
                          "user string, snapshot_date string, line_no int").write.partitionBy(
        "user", "snapshot_date").parquet(str(tmp_path / "exports"))
    return spark.read.schema("line_no int, user string, snapshot_date string").parquet(
        str(tmp_path / "exports"))


def test_exact_snapshot(exports):
    rows = tables.latest_snapshot(exports, "alice", "2026-01-01").collect()
    assert [r.line_no for r in rows] == [0]


def test_newest_snapshot(exports):
    rows = tables.latest_snapshot(exports, "alice").collect()
    assert [str(r.snapshot_date) for r in rows] == ["2026-06-15"]
    assert tables.latest_snapshot(exports).count() == 2


def test_unknown_user(exports):
    with pytest.raises(ValueError):
        tables.latest_snapshot(exports, "nobody")


def test_record_store(spark, tmp_path):
    path = str(tmp_path / "records")
    record = {"tmdb_id": 3, "genre_ids": [28], "runtime": 90, "cast": [{"id": 1, "order": 0}]}
    (tmp_path / "records").mkdir()
    (tmp_path / "records" / "a.json").write_text(json.dumps(record) + "\n\n" + json.dumps(
        {**record, "tmdb_id": 4}) + "\n")
    stored = tables.record_store(spark, path)
    assert sorted(r.tmdb_id for r in stored.collect()) == [3, 4]
    for _ in range(2):  # a retried run does not double its lines
        store.append_records(spark.createDataFrame([(5, 80.0)], "tmdb_id long, runtime double"), path, "second")
    assert sorted(r.tmdb_id for r in tables.record_store(spark, path).collect()) == [3, 4, 5]


def _shuffle_files(spark):
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_query_that_made_them(spark, tmp_path):
    new_folder(spark, "any")
    before, held = _shuffle_files(spark), spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count()
    held.write.parquet(str(tmp_path / "counts"))
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert held.collect() and len(held.collect()) == 1000  # and again, from the start


def test_record_lines_are_compressed(spark, tmp_path):
    path = str(tmp_path / "records")
    store.append_records(spark.createDataFrame([(5, ["word"] * 1000)], "tmdb_id long, keyword_names array<string>"), path, "first")
    lines = [f for f in os.listdir(f"{path}/first") if f.startswith("part-")]
    assert lines and all(f.endswith(".json.gz") for f in lines) and sum(os.path.getsize(f"{path}/first/{f}") for f in lines) < 1000
    assert [len(r.keyword_names) for r in tables.record_store(spark, path).collect()] == [1000]


@pytest.mark.parametrize("name", ["predict_requests", "stream_features"])
def test_records_and_counts_go_when_all_that_reads_them_is_written(spark, name):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") if new_folder(spark, "any") else None
    before = set(os.listdir(shared))
    rows = queries.REGISTRY[name](spark, "/root/testdata/sf0.001")
    made = set(os.listdir(shared)) - before
    assert any(f.startswith("content-") for f in made) and not any(f.startswith("all-records-") for f in made)
    for folder in (f for f in made if os.path.isdir(f"{shared}/{f}/features") and f.startswith("content-")):
        assert not {"records", "term_counts"} & set(os.listdir(f"{shared}/{folder}"))
    assert rows.count() > 0


def test_progress_of_a_repeated_epoch_is_replaced(spark, tmp_path):
    for epoch, rmse in ((1, 0.9), (2, 0.8), (2, 0.7)):
        store.append_progress(spark, str(tmp_path), "k4", {"epoch": epoch, "of": 2, "rmse": rmse})
    rows = store.read_progress(spark, str(tmp_path), "k4").orderBy("epoch").collect()
    assert [(r.epoch, r.rmse) for r in rows] == [(1, 0.9), (2, 0.7)]


def test_result_of_a_run_is_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 2):
        store.write_result(spark.range(n), path, "2026-01-01", "csv")
    assert spark.read.option("header", True).csv(path).count() == 2


def test_content_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1.0)], schemas.ITEM_FEATURES)
    vocab = feat.genre_dictionary(rows)
    stats = spark.createDataFrame([(1.0,)], "bayesian_m double")
    store.write_content_store(store.ContentStore(rows, vocab, stats), str(tmp_path))
    loaded = store.load_content_store(spark, str(tmp_path))
    assert loaded.vocab.count() == 26 and loaded.features.first().value == 1.0


def test_streams_over_several_batches(spark, tmp_path):
    factors = spark.createDataFrame([(i, [float(i), 1.0 / (i + 1)], 0.0) for i in range(6)],
                                    "movieId long, vec array<float>, bias double")
    schema = "userId long, movieId long, rating double, line_no long"
    batches = [[(1, 0, 4.0, 0), (1, 1, 3.0, 1), (2, 0, 1.0, 2)], [(2, 3, 5.0, 3), (1, 0, 2.0, 4)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(schema).parquet(source)
        jobs.fold_in_stream(arrivals, factors, 3.0, out, [1.0]).awaitTermination()
        arrivals = spark.readStream.schema(schema).parquet(source)
        jobs.record_stream(arrivals, "movieId", "line_no", out + "-records").awaitTermination()
    users = {r.userId: r for r in jobs.current_users(spark, out).collect()}
    assert {u: (r.n, r.status) for u, r in users.items()} == {1: (2, "ok"), 2: (2, "ok")}
    stored = {r.movieId: r.line_no for r in jobs.stored_records(spark, out + "-records", schema).collect()}
    assert stored == {0: 2, 1: 1, 3: 3}
    batch = spark.createDataFrame([r for b in batches for r in b], schema)
    from starfold.operators.foldin import fold_in
    whole = {r.userId: r for r in fold_in(tables.profile(batch), factors, 3.0, [1.0]).collect()}
    for user, row in users.items():
        assert row.vec == pytest.approx(whole[user].vec) and row.bias == pytest.approx(whole[user].bias)


def test_batch_that_runs_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 4.0, 0)], "userId long, movieId long, rating double, line_no long")
    store = BatchStore(spark, str(tmp_path / "rows"), "userId")
    for _ in range(2):
        store.write(rows, 0)
    assert store.read(RATED).count() == 1


def test_last_line_of_the_links_file_wins(spark, tmp_path):
    lines = ["movieId,imdbId,tmdbId"] + [f"{i},0{i},{i * 10}" for i in range(50, 20, -1)] + ["3,x,400.0", "60,y,", "2,z,400.0"]
    (tmp_path / "links.csv").write_text("\n".join(lines) + "\n")
    bridge = {r.tmdbId: r.movieId for r in tables.catalog_to_item(tables.links(spark, str(tmp_path / "links.csv"))).collect()}
    assert bridge[400] == 2 and bridge[500] == 50 and len(bridge) == 30
    plain = spark.createDataFrame([(9, 1), (4, 1)], "movieId long, tmdbId long")
    assert tables.catalog_to_item(plain).first().movieId == 9


def test_last_line_of_an_export_wins(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Date,Name,Year,URI,Rating\n2020,A,1999,u,2\n2020,B,,u,3.5\n2021,A,1999,u,4\n")
    rows = tables.exports(spark, str(tmp_path / "e.csv"))
    own = rows.withColumn("userId", F.lit(1)).withColumn("movieId", F.length("title"))
    assert {(r.movieId, r.rating) for r in tables.profile(own.where("title = 'A'")).collect()} == {(1, 4.0)}
    assert [r.year for r in rows.where("title = 'B'").collect()] == [None]


RATED = "userId long, movieId long, rating double, line_no long"


def test_fold_in_state_over_twelve_batches(spark, tmp_path):
    """A batch reads what arrives and no more, and the solutions are those of all latest ratings."""
    from starfold.operators.foldin import fold_in

    rng = random.Random(7)
    factors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], rng.gauss(0, 0.5)) for i in range(40)], "movieId long, vec array<float>, bias double")
    rows, line = [], 0
    for batch in range(12):
        for _ in range(60):  # items 40 to 44 are unknown, and ratings change
            rows.append((batch, rng.randrange(8), rng.randrange(45), rng.randrange(1, 11) / 2, line))
            line += 1
    late = rows[5]
    rows += [(11, *late[1:4], late[4]), (11, late[1], late[2], 0.5, -1)]  # the same line again, and one older than all
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in range(12):
        spark.createDataFrame([r[1:] for r in rows if r[0] == batch], RATED).coalesce(1).write.mode("append").parquet(source)
    arrivals = spark.readStream.schema(RATED).option("maxFilesPerTrigger", 1).parquet(source)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = jobs.fold_in_stream(arrivals, factors, 3.0, out, [1.0, 10.0], partitions=2, compact_every=5)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    query.awaitTermination()
    # the frozen factors and the batch are all that is read, and no ratings are stored beside the state
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) == 12 and max(read) <= 62
    assert sorted(os.listdir(out)) == ["checkpoint", "users"]
    found = {(r.userId, r.alpha): r for r in jobs.current_users(spark, out).collect()}
    whole = fold_in(tables.profile(spark.createDataFrame([r[1:] for r in rows], RATED)), factors, 3.0, [1.0, 10.0]).collect()
    assert len(found) == len(whole) == 16
    for row in whole:
        mine = found[row.userId, row.alpha]
        assert (mine.n, mine.status) == (row.n, row.status)
        assert mine.vec == pytest.approx(row.vec, abs=1e-9) and mine.bias == pytest.approx(row.bias, abs=1e-9)


def test_state_of_users_with_too_few_or_unknown_items(spark, tmp_path):
    factors = spark.createDataFrame([(1, [1.0], 0.0), (2, [2.0], 0.0)], "movieId long, vec array<float>, bias double")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 9, 3.0, 0), (2, 1, 3.0, 1), (3, 1, 3.0, 2), (3, 2, None, 3)], RATED).write.parquet(source)
    jobs.fold_in_stream(spark.readStream.schema(RATED).parquet(source), factors, 3.0, out, partitions=2).awaitTermination()
    assert sorted((r.userId, r.n, r.status, r.vec) for r in jobs.current_users(spark, out).collect()) == [
        (1, 0, "too_few", None), (2, 1, "too_few", None), (3, 1, "too_few", None)]


def test_compaction_between_batches_and_a_failure_in_it(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "rows"), "userId")

    def batch(n):
        return spark.createDataFrame([(u, n, float(n), n) for u in range(20)], RATED)

    def now():
        return sorted((r.userId, r.movieId, r.batch_id) for r in store.read(RATED).collect())

    for n in range(3):
        store.write(batch(n), n)
    before = now()
    store.merge(RATED, 1)  # ends before its mark is set
    assert now() == before and store.marks() == []
    store.compact(RATED, 1)
    assert now() == before and [last for last, _ in store.marks()] == [1]
    # what the first mark covers is still there for readers that began before it
    assert store.batches() == [0, 1, 2]
    store.write(batch(3), 3)
    store.write(batch(3), 3)  # runs again
    old = store.read(RATED)
    store.compact(RATED, 2, lambda rows: newest(rows, "userId"))
    assert store.batches() == [2, 3] and len(os.listdir(tmp_path / "rows" / "_merged")) == 2
    assert old.count() == 80  # its files have outlived the mark
    assert now() == sorted((u, n, n) for u in range(20) for n in (2, 3))
    assert sorted(r.movieId for r in store.read(RATED, before=3, buckets=store.touched(batch(0).where("userId = 4"))).where("userId = 4").collect()) == [2]
    store.compact(RATED, 2)  # nothing new
    assert [last for last, _ in store.marks()] == [1, 2]


def test_ratings_without_a_user_do_not_mix_with_others(spark, tmp_path):
    from starfold.operators.foldin import fold_in

    factors = spark.createDataFrame([(i, [float(i), 1.0 / (i + 1)], 0.0) for i in range(6)], "movieId long, vec array<float>, bias double")
    rows = spark.createDataFrame([(u, i, float(1 + (i + u) % 5), 10 * u + i) for u in range(1, 5) for i in range(u)] + [(None, 5, 3.0, 90), (None, 4, 1.0, 91)], RATED)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(source)
    jobs.fold_in_stream(spark.readStream.schema(RATED).parquet(source), factors, 3.0, out, [1.0], partitions=1).awaitTermination()
    found = {r.userId: r for r in jobs.current_users(spark, out).collect()}
    assert {u: r.n for u, r in found.items()} == {1: 1, 2: 2, 3: 3, 4: 4}  # as before, nobody has no row in the result
    for row in fold_in(rows.where("userId is not null"), factors, 3.0, [1.0]).where("status = 'ok'").collect():
        assert found[row.userId].vec == pytest.approx(row.vec)


class CountedState:
    """State of one user in memory, with the number of accesses."""

    def __init__(self):
        self.calls, self.values, self.maps = 0, {}, {}

    def getValueState(self, name, *schema):
        return CountedVariable(self, self.values, name)

    def getMapState(self, name, *schema):
        return CountedVariable(self, self.maps, name)


class CountedVariable:
    def __init__(self, owner, held, name):
        self.owner, self.held, self.name = owner, held, name

    def get(self):
        self.owner.calls += 1
        return self.held.get(self.name)

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.owner.calls += 1
        self.held[self.name] = value

    def getValue(self, key):
        self.owner.calls += 1
        return self.held.get(key)

    def containsKey(self, key):
        return self.getValue(key) is not None

    def updateValue(self, key, value):
        self.owner.calls += 1
        self.held[key] = value


def _arrive(taste, rows, vectors):
    frame = pd.DataFrame(rows, columns=["movieId", "rating", "line_no"])
    frame["vec"], frame["bias"] = [vectors[i] for i in frame["movieId"]], 0.1
    return next(taste.handleInputRows((1, False), iter([frame]), None)).iloc[0]


def test_state_of_a_user_is_read_and_written_in_few_calls():
    from starfold.streaming.state import TasteState

    taste, state = TasteState(3.0, [1.0]), CountedState()
    taste.init(state)
    vectors = {i: np.array([1.0 + i % 7, i % 5 - 2.0]) for i in range(60)}
    assert _arrive(taste, [(i, 4.0, i) for i in range(60)], vectors).n == 60
    assert state.calls <= 4
    state.calls = 0
    assert _arrive(taste, [(i, 2.0, 100 + i) for i in range(60)], vectors).n == 60
    assert state.calls <= 4


def test_chunks_of_a_user_grow_with_their_ratings():
    from starfold.operators.ridge import RidgeSpec, solve_grams
    from starfold.streaming.state import CHUNK_ITEMS, TasteState

    rng = np.random.default_rng(3)
    taste, state = TasteState(3.0, [1.0]), CountedState()
    taste.init(state)
    ids = 10 ** 6 + 64 * np.arange(5 * CHUNK_ITEMS)  # a common factor does not crowd a chunk
    vectors = {i: rng.normal(size=2) for i in ids.tolist()}
    latest, line = {}, 0
    for size in (40, CHUNK_ITEMS, 3 * CHUNK_ITEMS, 5 * CHUNK_ITEMS, 60):
        some = rng.choice(ids, size, replace=False).tolist()
        rows = [(i, float(rng.integers(1, 6)), line + n) for n, i in enumerate(some)]
        line += size
        state.calls = 0
        found = _arrive(taste, rows + [(some[0], 0.5, -1)], vectors)
        latest.update({i: r for i, r, _ in rows})
        x = np.array([[*vectors[i], r - 3.1, 1.0] for i, r in latest.items()])
        vec, bias, _, _ = solve_grams((x.T @ x)[None], np.zeros((1, 3)), 1.0, RidgeSpec(alphas=(1.0,)))
        assert found.n == len(latest) and found.vec == pytest.approx(vec[0]) and found.bias == pytest.approx(bias[0])
    held = [len(v[0]) // 24 for v in state.maps.values()]
    assert sum(held) == len(latest) and max(held) < 2 * CHUNK_ITEMS and len(held) > 1
    assert state.calls < 2 * len(held) + 4
