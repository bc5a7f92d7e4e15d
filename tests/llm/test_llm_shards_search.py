"""Shards and nearest neighbours against their laws and brute force."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from starfold.llm import sharding, vp_trees


def test_shards(odd, odd_rows):
    found = sharding.shard(odd, 5).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter(tuple(r)[:3] for r in found) == want
    bytes_of, places = Counter(), {}
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        bytes_of[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r["size"] for r in found)
    assert max(bytes_of.values()) - min(bytes_of.values()) <= largest
    assert {(r["virtual_slot"], r["shard"]) for r in found}.__len__() == len({r["virtual_slot"] for r in found})


def test_no_rows_to_shard(empty):
    assert sharding.shard(empty, 24).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(empty, 0)


def test_editing_moves_little_and_levels():
    rng = np.random.default_rng(2)
    sizes = {s: int(rng.pareto(1.5) * 1000) + 1 for s in range(sharding.SLOTS)}
    first = sharding.first_map(24)
    second = sharding.edited(first, sizes, 24)

    def loads(slot_map, shards):
        total = [0] * shards
        for slot, shard in slot_map.items():
            total[shard] += sizes[slot]
        return total

    after = loads(second, 24)
    assert (max(after) - min(after)) / np.mean(after) < 0.001
    assert sharding.edited(second, sizes, 24) == second
    grown = sharding.edited(second, sizes, 25)
    assert (max(loads(grown, 25)) - min(loads(grown, 25))) / np.mean(after) < 0.001
    fewer = sharding.edited(second, sizes, 23)
    assert max(fewer.values()) == 22 and (max(loads(fewer, 23)) - min(loads(fewer, 23))) / np.mean(after) < 0.001


def test_versions_are_stored(spark):
    stored = sharding.store(spark, [{0: 1, 1: 0}, {0: 0, 1: 1}], {0: 7})
    assert {tuple(r) for r in sharding.latest(stored).collect()} == {(0, 0, 7), (1, 1, 0)}


def test_shards_are_written(odd, tmp_path):
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_shards(rows, sharding.shard(rows, 3), str(tmp_path / "shards"))
    back = rows.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == rows.count() and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def vectors(seed=5, n=700, dim=6):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dim)) * rng.uniform(0.2, 3, size=(n, 1))
    points[100:260] = points[0]  # one vector that many rows hold
    points[300:310] = points[300]
    rows = [(int(i), p.tolist(), "x") for i, p in enumerate(points)]
    rows[7] = (7, None, "x")
    rows[20] = (20, [0.0] * dim, "x")
    rows[21] = (21, [float("nan")] + [1.0] * (dim - 1), "x")
    rows[40] = (40, [float("inf")] + [1.0] * (dim - 1), "x")
    rows[41] = (41, [None] + [1.0] * (dim - 1), "x")
    rows[60] = (60, [1.0, 2.0], "x")
    rows[61] = (61, [2.0, 2.0], "x")
    rows.append((None, [1.0] * dim, "x"))
    rows.append(rows[3])
    return rows


def exact(rows, every, k):
    held = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            held[i] = np.array(v)
    result = {}
    for q, v in held.items():
        if q % every == 0:
            near = sorted(((-float(np.einsum("ij,j->i", w[None], v)[0]), i) for i, w in held.items() if i != q and len(w) == len(v)))[:k]
            result[q] = [(i, -s) for s, i in near]
    return result


@pytest.mark.parametrize("factor, shard_rows", [(1.0, 10_000), (1.0, 90), (0.9, 200)])
def test_neighbours(spark, factor, shard_rows):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string").withColumnRenamed("shard", "dim")
    found = {}
    for r in sorted(vp_trees.neighbours(table, 20, 20, factor, shard_rows).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    want = exact(rows, 20, 20)
    assert found.keys() == {q for q, near in want.items() if near}
    if factor == 1.0:
        for q, near in found.items():
            assert [i for i, _ in near] == [i for i, _ in want[q]]
            assert np.allclose([s for _, s in near], [s for _, s in want[q]], rtol=1e-14)
    else:
        hits = sum(len({i for i, _ in near} & {i for i, _ in want[q]}) for q, near in found.items())
        assert hits >= 0.9 * sum(len(v) for v in want.values())


def test_ties_go_to_the_smaller_id():
    """More distinct vectors than a search keeps have the same product with a query."""
    rng = np.random.default_rng(9)
    points = np.unique(rng.integers(0, 3, (1500, 8)), axis=0).astype(float)
    points = points[points.any(axis=1)]
    ids = rng.permutation(len(points)).astype(np.int64)
    queries = np.concatenate([np.eye(8), -np.eye(8), points[:20]])
    asked = np.concatenate([np.arange(-16, 0), ids[:20]])
    for leaf_rows in (64, 256, 5_000):
        q, found, score = vp_trees.Search(vp_trees.Tree(ids, points, 20, leaf_rows).to_bytes()).nearest(asked, queries, 20, 1.0)
        for own, v in zip(asked, queries):
            near = sorted((-float(w @ v), int(i)) for i, w in zip(ids, points) if i != own)[:20]
            assert list(zip(-score[q == own], found[q == own])) == near


def recall(points, every=20, k=20, factor=vp_trees.FACTOR):
    """Share of the true nearest that a tree of production size finds, and share of its rows that are compared."""
    class Counting(vp_trees.Search):
        seen = 0

        def _visit(self, number, who):
            low, high, vantage = self.nodes[number, :3].astype(np.int64)
            if vantage < 0:
                self.seen += len(who) * (high - low)
            super()._visit(number, who)

    ids = np.arange(len(points))
    hits = seen = wanted = 0
    for shard in np.array_split(ids, -(-len(ids) // vp_trees.SHARD_ROWS)):
        tree = vp_trees.Tree(shard, points[shard], k)
        assert len(tree.nodes) >= 7  # several levels
        search, asked = Counting(tree.to_bytes()), ids[::every]
        q, found, _ = search.nearest(asked, points[asked], k, factor)
        seen += search.seen
        for own in asked:
            score = points[shard] @ points[own]
            score[shard == own] = -np.inf
            kth = np.partition(score, -k)[-k]
            hits += (points[found[q == own]] @ points[own] >= kth - 1e-9).sum()
            wanted += k
    return hits / wanted, seen / (len(ids) * len(asked))


@pytest.mark.parametrize("dim", [3, 6])
def test_recall_where_halves_are_skipped(dim):
    points = np.random.default_rng(2).normal(size=(16_000, dim))
    found, visited = recall(points / np.linalg.norm(points, axis=1)[:, None])
    print(f"{dim} dimensions: recall {found:.4f}, rows visited {visited:.4f}")
    assert found >= 0.9 and visited < 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables not present")
def test_recall_of_embeddings():
    found, visited = recall(np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float64))
    print(f"embeddings: recall {found:.4f}, rows visited {visited:.4f}")
    assert found >= 0.9


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vp_trees.neighbours(none, 20, 20).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert vp_trees.neighbours(one, 20, 20).count() == 0


def test_an_index_is_not_asked_for_more_than_it_holds():
    tree = vp_trees.Search(vp_trees.Tree(np.arange(5), np.eye(5), 3).to_bytes())
    with pytest.raises(ValueError):
        tree.nearest(np.array([0]), np.eye(5)[:1], 4, 1.0)
